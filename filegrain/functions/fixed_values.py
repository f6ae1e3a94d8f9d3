"""Fixed values.

Word lists, lookup tables, weights, cut-offs and patterns that decide results.
They are data: every analysis takes them as an argument with these defaults.
"""

# --- risk signals: tier 1, 2, 3 -------------------------------------------

TIER1_SIGNALS = (
    "going concern", "material weakness", "restatement", "default",
    "covenant violation", "insolvency", "bankruptcy", "SEC investigation",
    "DOJ", "criminal", "class action", "fraud", "cybersecurity incident",
    "data breach", "force majeure", "impairment", "goodwill impairment",
    "write-off", "write-down", "regulatory action",
)

TIER2_SIGNALS = (
    "significant uncertainty", "substantial doubt", "adverse",
    "contingent liability", "unfavorable", "declining revenue",
    "revenue decline", "net loss", "operating loss", "cash burn",
    "negative cash flow", "restructuring", "layoff", "workforce reduction",
    "supply chain disruption", "tariff", "trade restriction", "sanctions",
    "litigation", "settlement", "injunction", "compliance failure",
    "impairment charge", "liquidity risk", "interest rate risk",
    "foreign exchange", "currency risk", "inflation",
)

TIER3_SIGNALS = (
    "may", "could", "risk", "uncertain", "volatility", "competition",
    "macroeconomic", "recession", "slowdown", "customer concentration",
    "key personnel", "cybersecurity", "technology risk", "execution risk",
    "integration risk", "acquisition", "leverage", "refinancing", "dilution",
)

# Scores are kept in hundredths of a point so that sums are exact.
SIGNAL_WEIGHT = {1: 3, 2: 2, 3: 1}
BASE_HUNDREDTHS = {1: 100, 2: 50, 3: 10}
IN_CHANGE_HUNDREDTHS = {1: 150, 2: 75, 3: 15}
NEW_HUNDREDTHS = {1: 1200, 2: 600, 3: 100}
MAGNITUDE_HUNDREDTHS = {"minor": 200, "moderate": 500, "major": 1000}
MATERIALITY_FLOORS = (("critical", 3500), ("high", 2000), ("moderate", 800))
MATERIALITY_RANK = {"unknown": -1, "low": 0, "moderate": 1, "high": 2, "critical": 3}
CHANGE_BELOW = (("minor", 0.10), ("moderate", 0.30))

HIT_CAPS = {1: 20, 2: 20, 3: 30}
NEW_REMOVED_CAP = 15

# --- sentence alignment ----------------------------------------------------

MIN_SENTENCE_CHARS = 20
REWRITE_SIMILARITY = 0.40
SAME_SIMILARITY = 0.95

# --- ten-domain taxonomy: (domain, label, tier, keywords) -------------------

RISK_TAXONOMY = (
    ("financial", "Financial & Liquidity Risk", 1, (
        "liquidity", "cash flow", "debt", "leverage", "refinancing",
        "credit facility", "covenant", "default", "insolvency", "going concern",
        "cash burn", "negative cash flow", "working capital", "capital raise",
        "impairment", "write-off", "write-down", "goodwill impairment",
        "material weakness", "restatement", "net loss", "operating loss",
    )),
    ("legal_regulatory", "Legal & Regulatory Risk", 1, (
        "litigation", "lawsuit", "class action", "settlement", "injunction",
        "SEC", "DOJ", "regulatory action", "investigation", "criminal",
        "compliance", "GDPR", "CCPA", "antitrust", "FDA", "FTC",
        "enforcement", "penalty", "fine", "sanction",
    )),
    ("cybersecurity", "Cybersecurity & Data Risk", 1, (
        "cybersecurity", "data breach", "cyber attack", "ransomware",
        "phishing", "malware", "unauthorized access", "data privacy",
        "personal data", "information security", "incident response",
        "zero-day", "vulnerability", "hacking", "third-party vendor risk",
    )),
    ("operational", "Operational Risk", 2, (
        "supply chain", "manufacturing", "disruption", "outage",
        "key personnel", "talent", "workforce reduction", "layoff",
        "restructuring", "systems failure", "technology failure",
        "business continuity", "force majeure", "natural disaster",
        "concentration risk", "single source",
    )),
    ("market_competitive", "Market & Competitive Risk", 2, (
        "competition", "market share", "pricing pressure", "commoditization",
        "new entrants", "disruptive technology", "substitution",
        "customer concentration", "churn", "demand decline", "revenue decline",
        "declining revenue", "market downturn",
    )),
    ("macro_geopolitical", "Macroeconomic & Geopolitical Risk", 2, (
        "recession", "inflation", "interest rate", "foreign exchange",
        "currency risk", "tariff", "trade restriction", "sanctions",
        "geopolitical", "war", "conflict", "trade war", "export control",
        "macroeconomic", "global economy", "slowdown",
    )),
    ("strategic", "Strategic & Execution Risk", 2, (
        "acquisition", "merger", "integration risk", "execution risk",
        "strategic initiative", "transformation", "product launch",
        "expansion", "new market", "joint venture", "partnership risk",
        "organic growth", "pipeline",
    )),
    ("technology", "Technology & Innovation Risk", 2, (
        "artificial intelligence", "AI", "machine learning", "cloud",
        "platform risk", "technology risk", "obsolescence", "legacy system",
        "digital transformation", "algorithm", "model risk",
        "intellectual property", "patent", "trade secret",
    )),
    ("esg_climate", "ESG & Climate Risk", 3, (
        "climate change", "carbon", "greenhouse gas", "ESG",
        "sustainability", "environmental regulation", "climate risk",
        "physical risk", "transition risk", "net zero", "TCFD",
        "social responsibility", "DEI", "diversity", "human rights",
    )),
    ("reputational", "Reputational & Brand Risk", 3, (
        "reputational", "brand", "public perception", "media",
        "social media", "negative publicity", "trust", "credibility",
        "customer confidence", "product recall", "misinformation",
    )),
)
EXCERPTS_PER_DOMAIN = 5
EXCERPT_CHARS = 250

QUICK_TAXONOMY = (
    ("Financial & Liquidity", ("liquidity", "cash flow", "debt", "net loss", "going concern", "default")),
    ("Legal & Regulatory", ("litigation", "class action", "SEC", "DOJ", "regulatory", "compliance")),
    ("Cybersecurity & Data", ("cybersecurity", "data breach", "ransomware", "unauthorized access")),
    ("Operational", ("supply chain", "disruption", "key personnel", "restructuring")),
    ("Market & Competitive", ("competition", "market share", "customer concentration", "declining revenue")),
    ("Macroeconomic & Geopolitical", ("inflation", "interest rate", "tariff", "sanctions", "recession", "geopolitical")),
    ("Strategic & Execution", ("acquisition", "integration risk", "execution risk")),
    ("Technology & Innovation", ("artificial intelligence", "cloud", "obsolescence", "intellectual property")),
    ("ESG & Climate", ("climate change", "ESG", "carbon", "sustainability")),
    ("Reputational", ("reputational", "brand", "trust")),
)

MDA_KEYWORDS = (
    "revenue", "net income", "operating income", "cash flow", "liquidity",
    "earnings", "gross margin", "operating margin", "capital expenditure",
    "free cash flow", "debt", "guidance", "outlook", "increased", "decreased",
)
HIGHLIGHT_MIN_CHARS = 40
HIGHLIGHT_MAX_CHARS = 300
HIGHLIGHT_KEY_CHARS = 60
HIGHLIGHT_SHOWN_CHARS = 200

# --- event reports: (item, label, tier) --------------------------------------

EVENT_ITEMS = (
    ("1.01", "Entry into a Material Definitive Agreement", 2),
    ("1.02", "Termination of a Material Definitive Agreement", 2),
    ("1.03", "Bankruptcy or Receivership", 1),
    ("1.04", "Mine Safety - Reporting of Shutdowns and Patterns", 3),
    ("2.01", "Completion of Acquisition or Disposition of Assets", 2),
    ("2.02", "Results of Operations and Financial Condition", 2),
    ("2.03", "Creation of a Direct Financial Obligation", 2),
    ("2.04", "Triggering Events / Acceleration of Obligations", 1),
    ("2.05", "Costs Associated with Exit / Disposal Activities", 2),
    ("2.06", "Material Impairments", 1),
    ("3.01", "Notice of Delisting / Failure to Satisfy Listing", 1),
    ("3.02", "Unregistered Sales of Equity Securities", 3),
    ("3.03", "Material Modification to Rights of Security Holders", 2),
    ("4.01", "Changes in Registrant's Certifying Accountant", 1),
    ("4.02", "Non-Reliance on Previously Issued Financials", 1),
    ("5.01", "Changes in Control of Registrant", 1),
    ("5.02", "Departure/Election of Directors or Officers", 2),
    ("5.03", "Amendments to Articles of Incorporation/Bylaws", 3),
    ("5.04", "Temporary Suspension of Trading Under Benefit Plans", 2),
    ("5.05", "Amendments to Code of Ethics", 4),
    ("5.07", "Submission of Matters to a Vote of Security Holders", 3),
    ("6.01", "ABS Informational and Computational Material", 4),
    ("7.01", "Regulation FD Disclosure", 3),
    ("8.01", "Other Events", 3),
    ("9.01", "Financial Statements and Exhibits", 4),
)
TIER_NAMES = {1: "critical", 2: "high", 3: "moderate", 4: "low"}
EVENT_ITEM_PATTERN = r"(?i)item\s+(\d\.\d{2})\b"
EVENT_LAST_ITEM_CHARS = 2000
EVENT_EXCERPT_CHARS = 300

# --- proxy statements: (phrase, tier) ----------------------------------------

GOVERNANCE_PHRASES = (
    ("say-on-pay", 2),
    ("related party transaction", 1),
    ("related-party transaction", 1),
    ("golden parachute", 1),
    ("shareholder proposal", 2),
    ("proxy contest", 1),
    ("dissident", 1),
    ("activist", 1),
    ("executive compensation", 3),
    ("clawback", 2),
    ("poison pill", 1),
    ("staggered board", 2),
    ("dual-class", 2),
    ("related person transaction", 1),
    ("stock option repricing", 1),
    ("excessive compensation", 1),
    ("compensation consultant", 3),
    ("say on golden parachute", 1),
)
GOVERNANCE_POINTS = {1: 5, 2: 3, 3: 1}
GOVERNANCE_EXCERPT = (60, 80, 250)

# --- ownership -----------------------------------------------------------------

ACTIVIST_PHRASES = (
    "intends to engage", "board representation", "strategic alternatives",
    "activist", "proxy fight", "special committee", "underperformance",
    "unlock value", "divest", "spin-off", "sell the company",
    "replace management", "shareholder value", "engage in discussions",
    "nominate", "withhold vote",
)
OWNERSHIP_FORMS = ("SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A", "13F-HR", "13F-HR/A")
PERCENT_PATTERN = r"\b(\d{1,2}(?:\.\d{1,2})?)\s*%"
REPORTING_PERSON_PATTERN = r"(?i)name of reporting person[s]?\s*:?\s*([A-Z][A-Za-z0-9 ,.&'-]{2,80})"
FILER_PATTERN = r"(?i)(?:filed by|filer)\s*:?\s*([A-Z][A-Za-z0-9 ,.&'-]{2,80})"
UNKNOWN_FILER = "Unknown filer"

# --- Form 4 ----------------------------------------------------------------------

TRANSACTION_LABELS = {
    "P": "Open market purchase",
    "S": "Open market sale",
    "A": "Award / grant",
    "M": "Option exercise",
    "F": "Tax withholding",
    "G": "Gift",
    "C": "Conversion",
    "D": "Disposition (non-sale)",
}
OTHER_TRANSACTION = "Other"
UNKNOWN_INSIDER = "Unknown insider"

# --- reported facts: (metric, tags in priority order) -------------------------------

FACT_TAGS = (
    ("accounts_receivable", ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent")),
    ("inventory", ("InventoryNet", "InventoryFinishedGoodsNetOfReserves")),
    ("capex", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForCapitalImprovements")),
    ("current_assets", ("AssetsCurrent",)),
    ("current_liabilities", ("LiabilitiesCurrent",)),
    ("revenue", ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax")),
    ("net_income", ("NetIncomeLoss",)),
    ("cash_and_equivalents", ("CashAndCashEquivalentsAtCarryingValue",)),
    ("total_debt", ("LongTermDebtNoncurrent", "DebtCurrent")),
)
LOW_CURRENT_RATIO = 1.0
TIGHT_CURRENT_RATIO = 1.5
HEAVY_CAPEX_PERCENT = 15

# --- forms and sections --------------------------------------------------------------

CORE_FORMS = ("10-Q", "10-K", "20-F")
ALLOWED_FORMS = (
    "10-Q", "10-K", "20-F", "8-K", "DEF 14A", "4",
    "SC 13D", "SC 13G", "13F-HR", "SC 13D/A", "SC 13G/A", "13F-HR/A",
)

RISK_KEYWORDS = (
    "risk", "could", "may", "uncertain", "adverse", "material",
    "competition", "regulatory", "harm", "impact", "exposure",
    "liability", "loss", "failure", "breach",
)
MDA_SECTION_KEYWORDS = (
    "revenue", "operating", "liquidity", "results", "cash",
    "quarter", "year", "income", "loss", "expense", "financial",
    "increased", "decreased", "compared", "net",
)

# (section, item label, display name, start patterns, end patterns, next items,
#  keywords, least characters for the plain-text strategy), by form; "10-K" also
# serves forms without an entry of their own.
SECTION_SPECS = {
    "10-K": (
        ("risk_factors", "Item 1A", "Risk Factors",
         (r"item\s+1a[\.\s—\-–]+risk\s+factors", r"item\s+1a\b"),
         (r"item\s+1b\b", r"item\s+2\b"),
         ("item 1b", "item 2"), RISK_KEYWORDS, 1500),
        ("mda", "Item 7", "Management's Discussion and Analysis",
         (r"item\s+7[\.\s—\-–]+management", r"item\s+7[\.\s]+discussion",
          r"item\s+7[\.\s]+md", r"item\s+7\b"),
         (r"item\s+7a\b", r"item\s+8\b", r"item\s+8[\.\s]+financial"),
         ("item 7a", "item 8"), MDA_SECTION_KEYWORDS, 4000),
    ),
    "10-Q": (
        ("risk_factors", "Item 1A", "Risk Factors",
         (r"item\s+1a[\.\s—\-–]+risk\s+factors", r"item\s+1a\b"),
         (r"item\s+1b\b", r"item\s+2\b"),
         ("item 1b", "item 2"), RISK_KEYWORDS, 1500),
        ("mda", "Item 2", "Management's Discussion and Analysis",
         (r"item\s+2[\.\s—\-–]+management", r"item\s+2[\.\s]+discussion",
          r"item\s+2[\.\s]+md"),
         (r"item\s+3\b", r"item\s+3[\.\s]+quantitative", r"item\s+4\b"),
         ("item 3", "item 4"), MDA_SECTION_KEYWORDS, 4000),
    ),
    "20-F": (
        ("risk_factors", "Item 3.D", "Risk Factors",
         (r"item\s+3\.?\s*d[\.\s—\-–]+risk\s+factors", r"item\s+3\.?\s*d\b",
          r"d\.\s+risk\s+factors"),
         (r"item\s+4\b", r"item\s+3\.?\s*e\b"),
         ("item 4", "item 3.e"), RISK_KEYWORDS, 1500),
        ("mda", "Item 5", "Operating and Financial Review and Prospects",
         (r"item\s+5[\.\s—\-–]+operating\s+and\s+financial",
          r"item\s+5[\.\s]+operating", r"item\s+5\b"),
         (r"item\s+6\b",),
         ("item 6",), MDA_SECTION_KEYWORDS, 4000),
    ),
}

METHOD_CONFIDENCE = {
    "anchor_href": 0.92,
    "heading_tag": 0.85,
    "ixbrl_div": 0.82,
    "toc_link": 0.78,
    "pattern_match": 0.70,
    "raw_fallback": 0.20,
}
MIN_SECTION_CHARS = 500
PLAUSIBLE_CHARS = 200
PLAUSIBLE_KEYWORDS = 2
STUB_CHARS = 5_000
HUGE_CHARS = 2_000_000
GATE_MDA_CHARS = 5_000
GATE_RISK_CHARS = 2_000
BOLD_PATTERN = r"font-weight\s*:\s*(bold|700|800|900)"

# pointer phrases and the length below which they count: (limit, phrases)
EXTRACTION_POINTER = (2000, (
    "incorporated by reference", "annual report on form 10-k", "see our 10-k",
    "see part i, item 1a", "refer to our annual report",
))
COMPARISON_POINTER = (3000, (
    "incorporated by reference", "annual report on form 10-k",
    "our annual report", "refer to part i, item 1a",
))
REPORT_POINTER = (2000, (
    "incorporated by reference", "annual report on form 10-k", "see our 10-k",
    "see part i, item 1a",
))

# --- messages ------------------------------------------------------------------------

TICKER_STOP_WORDS = (
    "I", "A", "AN", "THE", "FOR", "OF", "AND", "OR", "IN", "ON", "AT",
    "TO", "IS", "IT", "BE", "MY", "ME", "WE", "US", "DO", "GO", "GET",
    "CAN", "SEC", "CEO", "CFO", "AI", "ML", "API", "USD", "UK", "EU",
    "GDP", "IPO", "ETF", "GENERATE", "REPORT", "ANALYZE", "COMPARE",
    "SHOW", "WHAT", "HOW", "WHY", "WHEN", "WHO", "TELL", "GIVE", "RISK",
    "RISKS", "TREND", "TRENDS", "FILING", "ANNUAL", "QUARTER", "EXECUTIVE",
    "LATEST", "HI", "HELLO", "HEY", "PLEASE", "THANKS", "THANK", "YES", "NO",
    "TWO", "LAST", "OVER", "TIME", "DATA", "NEWS", "INFO", "ABOUT", "WITH",
    "FROM", "YOUR", "THEIR", "ITS", "HAS", "HAVE", "HAD", "ARE", "WAS", "WERE",
    "CATEGORIZE", "BREAKDOWN", "TYPES", "DOMAIN", "CLASSIFY", "CATEGORIES",
    "HISTORY", "YEARS", "PAST", "TRAJECTORY", "HISTORICALLY", "DIFFERENCE",
    "VERSUS", "BOTH", "FILINGS", "RECENT", "NEW", "OLD",
)
SHORT_STOP_WORDS = ("I", "A", "THE", "FOR", "AND", "OR", "IN", "OF", "AT", "MY", "ME", "IS", "IT", "DO", "SO")
GREETINGS = (
    "hi", "hello", "hey", "good morning", "good evening",
    "what can you do", "help me", "how does this work",
    "what are you", "who are you",
)
DOMAIN_STEMS = ("analyz", "compar", "risk", "filing", "report", "trend")
TOOL_FAILURE_PHRASES = (
    "pipeline_success=False", "Could not fetch", "Cik resolution failed",
    "No filing found", "Analysis failed", "Could not load", "Tool error",
    "No tool available", "No tools found",
)
TOOL_RESULT_CHARS = 100
RESPONSE_FAILURE_PHRASES = (
    "api quota reached", "api key error", "invalid api key", "403 forbidden",
    "connection error", "api error", "exception",
)

# ordered intent rules: (tool, words), first match wins
CHAT_INTENTS = (
    ("compare_filings", ("compare", "vs", "versus", "difference", "last two", "both filings")),
    ("risk_trends", ("trend", "history", "years", "over time", "past", "trajectory", "historically")),
    ("categorize_risks", ("categor", "breakdown", "types", "domain", "classify", "categories")),
)
CHAT_DEFAULT_INTENT = "executive_report"
ROUTER_INTENTS = (
    ("compare_filings", ("compare", "what changed", "difference", "vs prior")),
    ("generate_executive_report", ("report", "executive", "summary", "overview", "brief")),
    ("analyze_8k_events", ("8-k", "8k", "event", "material event", "recent news")),
    ("analyze_insider_activity", ("insider", "buying", "selling", "form 4", "officers")),
    ("analyze_ownership", ("ownership", "activist", "13d", "institutional", "who owns")),
    ("analyze_proxy", ("proxy", "governance", "compensation", "board", "def 14a")),
    ("analyze_risk_trends", ("trend", "trajectory", "over time", "history", "years")),
    ("categorize_risks", ("risk", "categorize", "breakdown", "domains", "types of risk")),
)
RUNNER_INTENTS = (
    ("executive_report", ("executive report", "analyst report")),
    ("compare_filings", ("compare",)),
    ("risk_trends", ("trend", "history", "years")),
    ("risk_categorizer", ("categorize", "category", "breakdown")),
)

# --- plans, results -----------------------------------------------------------------------

# (plan, analyses per period, -1 = unlimited, period days)
PLAN_LIMITS = (("free_trial", 10, 1), ("pro", 500, 30), ("business", -1, 30))
UNLIMITED_PLANS = ("pro", "business")
FREE_DAILY_LIMIT = 2
RESULT_TTL_DAYS = (3, 7)
CONTEXT_MESSAGES = 12
CONTEXT_TOOL_CHARS = 1500
CONTEXT_CHARS = 2000
USER_PLANS = ("free", "pro", "business")
SUBSCRIPTION_STATUSES = ("active", "cancelled", "expired", "past_due")
ANALYSIS_STATUSES = ("pending", "processing", "completed", "failed")
MESSAGE_ROLES = ("user", "assistant", "system")
