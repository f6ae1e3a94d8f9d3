"""Queries over filings: recency, sections, items, trends, whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from filegrain.functions import fixed_values as fv
from filegrain.functions import narrative as say
from filegrain.functions.scoring import find_hits, of_tier, signals
from filegrain.functions.text import strip, strip_markup
from filegrain.operators import recency
from filegrain.operators import sections as S
from filegrain.operators.insider import form4_transactions, transaction_rows
from filegrain.operators.nodes import heading, outline
from filegrain.plans import categorize, compare, report, trends
from filegrain.plans import filings as plans
from filegrain.sources.landed import with_body_status

from . import query, table
from .corpus import (
    FORMS, SQL_DISCLOSURES, WS, accession, disclosures, letters, lit, pair_bodies, pair_index, series_bodies, series_index,
    sql_alignment, sql_compared, sql_letters, sql_lexicon, sql_longer, sql_materiality, sql_note, sql_sections, sql_sentences, sql_trim, strings,
)
from .landed import CONTEXT_SQL, _facts
from .texts import QUICK_ROWS

ACC2 = "lpad(CAST(doc_id * 10 + 2 AS VARCHAR), 18, '0')"
SERIES_SQL = f"WITH {SQL_DISCLOSURES}, {sql_sections('disc', 'doc_id % 5', 'sents', ACC2)}"
DATE_SQL = "CAST(DATE '2015-01-01' + CAST(doc_id % 6 * 91 AS INTEGER) AS DATE)"


# --- recency ---------------------------------------------------------------------------


def _source_index(spark, d):
    doc = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.upper("source").alias("ticker"), F.element_at(F.array(*[F.lit(f) for f in FORMS]), (doc % 3 + 1).cast("int")).alias("form_type"),
        F.lpad((doc % 50).cast("string"), 10, "0").alias("cik"), accession(doc, 2).alias("accession_number"),
        F.date_add(F.lit("2001-01-01").cast("date"), (doc * 7 % 900).cast("int")).alias("filing_date"), (F.lit(0) - doc).alias("index_pos"),
    )


SOURCE_SQL = f"""src AS (
  SELECT upper(source) AS ticker, ({strings(FORMS)})[doc_id % 3 + 1] AS form_type, {ACC2} AS accession_number,
    CAST(DATE '2001-01-01' + CAST(doc_id * 7 % 900 AS INTEGER) AS DATE) AS filing_date, doc_id FROM documents
)"""


@query("latest_n_filings", f"""WITH {SOURCE_SQL},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, form_type ORDER BY filing_date DESC, doc_id DESC) AS INT) AS rn FROM src)
SELECT ticker, form_type, accession_number, filing_date, rn FROM r WHERE rn <= 10""")
def q_latest(spark, d):
    return recency.newest(_source_index(spark, d), recency.clamp(12, 1, 10)).select(
        "ticker", "form_type", "accession_number", "filing_date", "rn"
    )


@query("filing_pairs", f"""WITH r AS (
  SELECT 'P' || {sql_letters('doc_id % 701')} AS ticker, '10-K' AS form_type, {ACC2} AS acc, doc_id,
    row_number() OVER (PARTITION BY doc_id % 701 ORDER BY doc_id DESC) AS rn FROM documents
), g AS (
  SELECT ticker, form_type, CAST(count(*) AS INT) AS n_filings, max(acc) FILTER (rn = 1) AS newer_accession, max(acc) FILTER (rn = 2) AS older_accession
  FROM r WHERE rn <= 2 GROUP BY ALL
)
SELECT *, CASE WHEN n_filings < 2 THEN 'Only ' || n_filings || ' 10-K filing(s) found for ' || ticker || ' (CIK 0000000000). Comparison requires at least two.' END AS coverage_gap_note FROM g""")
def q_pairs(spark, d):
    doc = F.col("doc_id")
    index = table(spark, d, "documents").select(
        F.concat(F.lit("P"), letters(doc % 701)).alias("ticker"), F.lit("10-K").alias("form_type"), F.lit("0000000000").alias("cik"),
        accession(doc, 2).alias("accession_number"), F.lit(None).cast("date").alias("filing_date"), (F.lit(0) - doc).alias("index_pos"),
    )
    return recency.filing_pairs(index).select(
        "ticker", "form_type", "n_filings", "newer_accession", "older_accession", "coverage_gap_note"
    )


@query("filing_bodies", """SELECT page_id, CAST(CASE WHEN page_id % 10 = 0 THEN 0 ELSE strlen(html) END AS INT) AS html_byte_length,
  page_id % 10 <> 0 AS fetch_success, CASE WHEN page_id % 10 = 0 THEN 'No document body available' END AS failure_reason FROM pages""")
def q_bodies(spark, d):
    pages = table(spark, d, "pages")
    index = pages.select("page_id", F.col("page_id").alias("accession_number"))
    # a tenth of the bodies never arrived
    bodies = pages.select(F.col("page_id").alias("accession_number"), F.when(F.col("page_id") % 10 != 0, F.col("html")).alias("html"))
    return with_body_status(index, bodies).select("page_id", "html_byte_length", "fetch_success", "failure_reason")


# --- markup and sections ------------------------------------------------------------------


def sql_markup(html: str, sep: str) -> str:
    from filegrain.functions.text import _NAMED, WS_CHARS, WS_CLASS

    x = html
    for tag in ("script", "style", "noscript"):
        x = f"regexp_replace({x}, {lit(f'(?is)<{tag}\\b[^>]*>.*?</{tag}{WS}*>')}, chr(1), 'g')"
    x = f"regexp_replace({x}, {lit('(?s)<!--.*?-->|<[!?/]?[A-Za-z][^>]*>')}, chr(1), 'g')"
    for name, char in _NAMED:
        x = f"replace({x}, '&{name};', {lit(char)})"
    x = f"replace({x}, '&amp;', '&')"
    x = f"regexp_replace({x}, {lit(f'{WS}*\\x01[{WS_CLASS}\\x01]*')}, chr(1), 'g')"
    return f"replace(trim({x}, {lit(WS_CHARS)} || chr(1)), chr(1), {sep})"


@query("page_text", f"SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, {sql_markup('html', lit(' '))} AS t FROM pages)")
def q_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", strip_markup(F.col("html"), " ").alias("t")).select(
        "page_id", F.length("t").alias("chars"), F.md5("t").alias("digest")
    )


@query("page_outline", f"""SELECT page_id, md5({sql_markup('html', 'chr(10)')}) AS digest,
  CAST(len(regexp_extract_all(html, '(?i)<h[1-4]\\b')) AS INT) AS n_headings, CAST(len(regexp_extract_all(html, '(?i)<b\\b')) AS INT) AS n_bold FROM pages""")
def q_outline(spark, d):
    o = table(spark, d, "pages").select("page_id", outline(F.col("html")).alias("o"))
    n = lambda *tags: F.size(F.filter("o.marks", lambda m: m["tag"].isin(*tags)))
    return o.select("page_id", F.md5("o.text").alias("digest"), n("h1", "h2", "h3", "h4").alias("n_headings"), n("b").alias("n_bold"))


def _series_filings(spark, d):
    return series_index(spark, d).join(series_bodies(spark, d), "accession_number")


def _extracted(spark, d):
    return S.extract(_series_filings(spark, d).withColumn("document_url", F.concat(F.lit("https://files.example/"), "accession_number")))


CONF = "CASE m " + " ".join(f"WHEN '{m}' THEN {c}" for m, c in fv.METHOD_CONFIDENCE.items()) + " END"


@query("extracted_sections", f"""{SERIES_SQL},
long AS (
  SELECT accession_number, 'risk_factors' AS section_name, CASE WHEN form_type = '20-F' THEN 'Item 3.D' ELSE 'Item 1A' END AS item_label, rm AS m, risk_text AS t, risk_ok AS ok FROM sec
  UNION ALL
  SELECT accession_number, 'mda', CASE form_type WHEN '20-F' THEN 'Item 5' WHEN '10-Q' THEN 'Item 2' ELSE 'Item 7' END, dm, mda_text, mda_ok FROM sec
)
SELECT accession_number, section_name, item_label, m AS method, ok AS extraction_success, CAST({CONF} AS DOUBLE) AS confidence_score,
  length(t) AS char_count, md5(t) AS digest, 'https://files.example/' || accession_number || '#' || replace(item_label, ' ', '') AS source_reference FROM long""")
def q_sections(spark, d):
    return S.section_rows(_extracted(spark, d), ["accession_number"]).select(
        "accession_number", "section_name", "item_label", "method", "extraction_success", "confidence_score",
        "char_count", F.md5("text").alias("digest"), "source_reference",
    )


@query("known_gaps", f"""{SERIES_SQL}
SELECT accession_number, concat_ws('; ',
  CASE WHEN NOT risk_ok THEN 'Risk Factors could not be isolated (method: raw_fallback)' END,
  CASE WHEN NOT mda_ok THEN 'MD&A could not be isolated (method: raw_fallback)' END,
  CASE WHEN length(full_text) < 5000 THEN 'Filing HTML is unusually short — may be a stub or redirect' END,
  CASE WHEN length(full_text) > 2000000 THEN 'Filing HTML is very large (>2MB) — extraction may have boundary errors' END) AS known_gaps,
  risk_ok AND mda_ok AS both_succeeded, risk_ok OR mda_ok AS any_succeeded, length(full_text) AS full_doc_char_count FROM sec""")
def q_gaps(spark, d):
    return _extracted(spark, d).select(
        "accession_number", F.array_join("known_gaps", "; ").alias("known_gaps"), "both_succeeded", "any_succeeded", "full_doc_char_count"
    )


@query("standalone_headings", f"""{SERIES_SQL}
SELECT accession_number, CAST(CASE layout WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 4 END AS INT) AS n_headings,
  CAST(CASE layout WHEN 3 THEN 2 ELSE 0 END AS INT) AS n_toc_links, CAST(0 AS INT) AS n_toc_entries FROM sec""")
def q_headings(spark, d):
    o = series_bodies(spark, d).select("accession_number", outline(F.col("html")).alias("o"))
    n = lambda test: F.size(F.filter("o.marks", test))
    return o.select(
        "accession_number", n(S.standalone_heading).alias("n_headings"), n(lambda m: m["href"].isNotNull()).alias("n_toc_links"),
        n(lambda m: m["plain_at"].isNotNull() & S.toc_entry(F.col("o.plain"), m)).alias("n_toc_entries"),
    )


# Headings in compatibility characters and what they stand for.
WIDE_HEADINGS = (
    ("Ｉtem １A. Risk Factors", "item 1a. risk factors"), ("Item 7. ﬁnancial ½ ²", "item 7. financial 1\u20442 2"),
    ("Item 1A.\u2003Risk\u00a0 Factors", "item 1a. risk factors"), ("ITEM Ⅷ ①", "item viii 1"),
)
_HEADING = "(" + strings(h for h, _ in WIDE_HEADINGS) + ")[doc_id % 4 + 1]"


@query("contents_entries", f"""WITH {SQL_DISCLOSURES},
line AS (
  SELECT doc_id, i, {sql_trim("translate(substr(s, 1, 20 + 30 * (i % 3)), '<>&', '   ')")} || CASE WHEN i % 2 = 1 THEN ' ' || (doc_id % 300 + i) ELSE '' END AS l
  FROM (SELECT doc_id, unnest(sents[1:6]) AS s, generate_subscripts(sents[1:6], 1) AS i FROM disc)),
counted AS (SELECT doc_id, count(*) FILTER (length(l) < 80 AND regexp_matches(l, '[0-9]{{1,3}}\\s*$')) AS n FROM line GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_toc_entries, ({strings(w for _, w in WIDE_HEADINGS)})[doc_id % 4 + 1] AS heading, TRUE AS standalone
FROM disc LEFT JOIN counted USING (doc_id)""")
def q_contents(spark, d):
    """Bodies that begin with a table of contents, its lines bold and numbered every other time, and a heading in wide characters."""
    doc = F.col("doc_id")
    line = lambda s, i: F.concat(
        F.lit("<b>"), strip(F.translate(F.substring(s, F.lit(1), 20 + 30 * ((i + 1) % 3)), "<>&", "   ")),
        F.when(i % 2 == 0, F.concat(F.lit(" "), (doc % 300 + i + 1).cast("string"))).otherwise(""), F.lit("</b><br>"),
    )
    title = F.element_at(F.array(*[F.lit(h) for h, _ in WIDE_HEADINGS]), (doc % 4 + 1).cast("int"))
    html = F.concat(F.array_join(F.transform(F.slice("sents", 1, 6), line), ""), F.lit("<h2>"), title, F.lit("</h2><p>"), F.lit("text</p>"))
    o = disclosures(spark, d).select("doc_id", outline(html).alias("o"))
    last = F.element_at(F.filter("o.marks", lambda m: m["tag"] == "h2"), 1)
    return o.select(
        "doc_id", F.size(F.filter("o.marks", lambda m: (m["tag"] == "b") & S.toc_entry(F.col("o.plain"), m))).alias("n_toc_entries"),
        heading(F.col("o.plain"), last).alias("heading"), S.standalone_heading(last).alias("standalone"),
    )


PAIR_LAYOUT = f"""WITH {SQL_DISCLOSURES},
two AS (SELECT doc_id, 1 AS side, {sql_longer('older_sents')} AS sx FROM disc UNION ALL SELECT doc_id, 2, {sql_longer('sents')} FROM disc),
{sql_sections('two', '(doc_id + side) % 5', 'sx', "lpad(CAST(doc_id * 10 + side AS VARCHAR), 18, '0')")}"""


def _gate_sql(side: str, label: str) -> str:
    strict = "n.form_type IN ('10-K', '20-F')"
    return f"""CASE WHEN NOT {side}.mda_ok THEN '{label} MD&A: extraction failed (method=' || {side}.dm || ', ' || length({side}.mda_text) || ' chars) — full document used as fallback.'
    WHEN length({side}.mda_text) < 5000 THEN '{label} MD&A: only ' || length({side}.mda_text) || ' chars extracted (minimum 5000) — likely a fragment.' END,
  CASE WHEN {strict} AND NOT {side}.risk_ok THEN '{label} Risk Factors: extraction failed (method=' || {side}.rm || ', ' || length({side}.risk_text) || ' chars).'
    WHEN {strict} AND length({side}.risk_text) < 2000 THEN '{label} Risk Factors: only ' || length({side}.risk_text) || ' chars extracted (minimum 2000).' END"""


GATE_SQL = f"""{PAIR_LAYOUT},
gate AS (
  SELECT n.doc_id, n.form_type, nullif(concat_ws(' | ', {_gate_sql('n', 'newer')}, {_gate_sql('o', 'older')}), '') AS issues
  FROM sec n JOIN sec o ON n.doc_id = o.doc_id AND n.side = 2 AND o.side = 1
)"""


@query("extraction_gate", f"""{GATE_SQL}
SELECT 'D' || {sql_letters('doc_id')} AS ticker, form_type, 'Extraction quality below threshold — comparison unreliable. ' || issues AS gate FROM gate""")
def q_gate(spark, d):
    p = compare.paired(pair_index(spark, d), pair_bodies(spark, d))
    return p.select("ticker", "form_type", S.extraction_gate(F.col("newer"), F.col("older"), F.col("form_type")).alias("gate"))


POINTED = "CASE WHEN doc_id % 3 = 0 THEN 'See our Annual Report on Form 10-K. ' WHEN doc_id % 3 = 1 THEN 'Refer to Part I, Item 1A. ' ELSE '' END || text"


@query("pointer_flag", f"""SELECT doc_id,
  length(t) < 2000 AND contains(lower(t), 'annual report on form 10-k') AS extraction_pointer,
  length(t) < 3000 AND (contains(lower(t), 'annual report on form 10-k') OR contains(lower(t), 'refer to part i, item 1a')) AS comparison_pointer,
  length(t) < 2000 AND contains(lower(t), 'annual report on form 10-k') AS report_pointer
FROM (SELECT doc_id, {POINTED} AS t FROM documents)""")
def q_pointer(spark, d):
    lead = F.when(F.col("doc_id") % 3 == 0, "See our Annual Report on Form 10-K. ").when(
        F.col("doc_id") % 3 == 1, "Refer to Part I, Item 1A. ").otherwise("")
    t = table(spark, d, "documents").select("doc_id", F.concat(lead, "text").alias("t"))
    return t.select(
        "doc_id", S.pointer(F.col("t"), fv.EXTRACTION_POINTER).alias("extraction_pointer"),
        S.pointer(F.col("t"), fv.COMPARISON_POINTER).alias("comparison_pointer"), S.pointer(F.col("t"), fv.REPORT_POINTER).alias("report_pointer"),
    )


@query("plausible_sections", f"""WITH {SQL_DISCLOSURES}
SELECT doc_id, length(text) >= 200 AND len(list_filter({strings(fv.RISK_KEYWORDS)}, lambda k: contains(lower(text), k))) >= 2 AS plausible_risk,
  length(text) >= 200 AND len(list_filter({strings(fv.MDA_SECTION_KEYWORDS)}, lambda k: contains(lower(text), k))) >= 2 AS plausible_mda FROM disc""")
def q_plausible(spark, d):
    return disclosures(spark, d).select(
        "doc_id", S.plausible(F.col("text"), fv.RISK_KEYWORDS).alias("plausible_risk"),
        S.plausible(F.col("text"), fv.MDA_SECTION_KEYWORDS).alias("plausible_mda"),
    )


START, END = "(?i)amid (?:litigation|fraud|debt)", "(?i)amid (?:default|merger|may|cloud)"
# pieces and matches as lists in SQL, positions from their running lengths
OFFSETS_SQL = f"""WITH {SQL_DISCLOSURES},
cut AS (
  SELECT doc_id, text, regexp_split_to_array(text, '{START}') AS sp, regexp_extract_all(text, '{START}') AS sm,
    regexp_split_to_array(text, '{END}') AS ep, regexp_extract_all(text, '{END}') AS em FROM disc
),
pos AS (
  SELECT doc_id, text,
    list_transform(sm, lambda m, i: list_sum(list_transform(sp[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(sm[1:i-1], lambda p: length(p))), 0)) AS s0,
    list_transform(sm, lambda m, i: list_sum(list_transform(sp[1:i], lambda p: length(p))) + list_sum(list_transform(sm[1:i], lambda p: length(p)))) AS s1,
    list_transform(em, lambda m, i: list_sum(list_transform(ep[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(em[1:i-1], lambda p: length(p))), 0)) AS e0
  FROM cut
)"""


@query("match_offsets", f"""{OFFSETS_SQL}
SELECT doc_id, CAST(len(s0) AS INT) AS n, array_to_string(list_transform(s0, lambda x: CAST(x AS BIGINT)), ',') AS starts,
  array_to_string(list_transform(s1, lambda x: CAST(x AS BIGINT)), ',') AS ends FROM pos WHERE len(s0) > 0""")
def q_offsets(spark, d):
    from filegrain.functions.text import match_spans

    m = disclosures(spark, d).select("doc_id", match_spans(F.col("text"), START).alias("m"))
    join = lambda f: F.array_join(F.transform("m", lambda x: x[f].cast("string")), ",")
    return m.where(F.size("m") > 0).select("doc_id", F.size("m").alias("n"), join("first").alias("starts"), join("past").alias("ends"))


@query("section_by_pattern", f"""{OFFSETS_SQL},
bodies AS (
  SELECT doc_id, k, {sql_trim('substr(text, CAST(a AS BIGINT) + 1, CAST(coalesce(list_min(list_filter(e0, lambda e: e >= b)), length(text)) - a AS BIGINT))')} AS body
  FROM (SELECT doc_id, text, e0, unnest(s0) AS a, unnest(s1) AS b, generate_subscripts(s0, 1) AS k FROM pos)
)
SELECT doc_id, arg_min(body, k) AS section_text FROM bodies WHERE length(body) >= 300 GROUP BY doc_id""")
def q_by_pattern(spark, d):
    s = disclosures(spark, d).select("doc_id", S.pattern_section(F.col("text"), START, END, 300).alias("section_text"))
    return s.where(F.col("section_text").isNotNull())


# --- event reports ------------------------------------------------------------------------

ITEM_POOL = [n for n, _, _ in fv.EVENT_ITEMS] + ["5.06", "9.99"]


def _event_filings(spark, d, docs=None):
    """Every document as an event report: each third sentence opens an item."""
    doc = F.col("doc_id")
    pool = F.array(*[F.lit(n) for n in ITEM_POOL])
    body = F.transform("sents", lambda s, i: F.when(
        i % 3 == 1, F.concat(F.lit("<p>Item "), F.element_at(pool, ((F.length(s) + i) % len(ITEM_POOL) + 1)), F.lit(" "), s, F.lit("</p>"))
    ).otherwise(F.concat(F.lit("<p>"), s, F.lit("</p>"))))
    plain = F.transform("sents", lambda s: F.replace(F.replace(s, F.lit("&"), F.lit(" ")), F.lit("<"), F.lit(" ")))
    docs = disclosures(spark, d, docs).withColumn("sents", plain)
    return docs.select(
        F.concat(F.lit("E"), letters(F.floor(doc / 5))).alias("ticker"), F.lit("8-K").alias("form_type"),
        accession(doc, 2).alias("accession_number"), F.date_add(F.lit("2022-01-01").cast("date"), (doc % 5).cast("int")).alias("filing_date"),
        (F.lit(0) - doc).alias("index_pos"), F.when(doc % 11 != 0, F.array_join(body, "\n")).alias("html"),
    )


def _events(spark, d):
    f = _event_filings(spark, d)
    return plans.eight_k_items(f.drop("html"), f.select("accession_number", "html"), 10)


ITEM_ROWS = ", ".join(f"({lit(n)}, {lit(label)}, {t}, '{fv.TIER_NAMES[t]}')" for n, label, t in fv.EVENT_ITEMS)
EVENT_SQL = f"""WITH {SQL_DISCLOSURES}, items(item_number, label, tier, materiality) AS (VALUES {ITEM_ROWS}),
bodies AS (
  SELECT doc_id, array_to_string(list_transform(list_transform(list_transform(sents, lambda s: replace(replace(s, '&', ' '), '<', ' ')),
    lambda s, i: CASE WHEN (i - 1) % 3 = 1 THEN 'Item ' || ({strings(ITEM_POOL)})[(length(s) + i - 1) % {len(ITEM_POOL)} + 1] || ' ' || s ELSE s END),
    lambda s: {sql_trim('s')}), chr(10)) AS t
  FROM disc WHERE doc_id % 11 <> 0
),
cut AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '(?i)item\\s+(\\d\\.\\d{{2}})\\b', 1)) AS item_number,
    unnest(regexp_split_to_array(t, '(?i)item\\s+\\d\\.\\d{{2}}\\b')[2:]) AS body, generate_subscripts(regexp_extract_all(t, '(?i)item\\s+(\\d\\.\\d{{2}})\\b', 1), 1) AS k,
    len(regexp_extract_all(t, '(?i)item\\s+(\\d\\.\\d{{2}})\\b', 1)) AS n
  FROM bodies
),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_number ORDER BY k) AS seen FROM cut JOIN items USING (item_number)
),
events AS (
  SELECT doc_id, 'E' || {sql_letters('doc_id // 5')} AS ticker, {ACC2} AS accession_number,
    CAST(DATE '2022-01-01' + CAST(doc_id % 5 AS INTEGER) AS DATE) AS filing_date, item_number, label, tier, materiality,
    row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS item_pos,
    substr({sql_trim(f"regexp_replace(CASE WHEN k = n THEN substr(body, 1, 2000) ELSE body END, {lit(WS + '+')}, ' ', 'g')")}, 1, 300) AS excerpt
  FROM firsts WHERE seen = 1
)"""


@query("item_spans", f"""{EVENT_SQL}
SELECT ticker, accession_number, filing_date, CAST(item_pos AS INT) AS item_pos, item_number, label, tier, materiality, excerpt FROM events""")
def q_items(spark, d):
    return plans.eight_k_events(_events(spark, d)).select(
        "ticker", "accession_number", "filing_date", "item_pos", "item_number", "label", "tier", "materiality", "excerpt"
    )


@query("highest_event", f"""{EVENT_SQL},
worst AS (
  SELECT ticker, arg_min('Item ' || item_number || ' — ' || label || ' (' || filing_date || ')', tier * 1000000000000 - doc_id * 10000 + item_pos) AS w,
    count(*) AS n FROM events GROUP BY ticker
),
f AS (SELECT 'E' || {sql_letters('doc_id // 5')} AS ticker, count(*) AS filing_count, count(*) FILTER (doc_id % 11 <> 0 AND text <> '') AS parsed_count FROM disc GROUP BY 1)
SELECT f.ticker, filing_count, parsed_count, CAST(coalesce(n, 0) AS BIGINT) AS event_count, w AS highest_risk_event FROM f LEFT JOIN worst USING (ticker)""")
def q_highest(spark, d):
    return plans.eight_k_summary(_events(spark, d)).drop("pipeline_success", "failure_reason")


def _requests(found, absent):
    """Tickers with filings, and ones that have none."""
    return found.select("ticker").unionByName(absent.select("ticker")).distinct()


@query("event_failures", f"""WITH r AS (SELECT DISTINCT unnest(['E' || {sql_letters('doc_id // 5')}, 'NE' || {sql_letters('doc_id // 7')}]) AS ticker FROM documents)
SELECT ticker, NOT starts_with(ticker, 'N') AS pipeline_success, CASE WHEN starts_with(ticker, 'N') THEN 'No 8-K filings found for ' || ticker || '.' END AS failure_reason FROM r""")
def q_event_failures(spark, d):
    f = _event_filings(spark, d)
    absent = table(spark, d, "documents").select(F.concat(F.lit("NE"), letters(F.floor(F.col("doc_id") / 7))).alias("ticker"))
    out = plans.eight_k_summary(_events(spark, d), _requests(f, absent))
    return out.select("ticker", "pipeline_success", "failure_reason")


OWNERSHIP_KINDS = (*fv.OWNERSHIP_FORMS, "10-K")
_OWNERSHIP_FORM = f"({strings(OWNERSHIP_KINDS)})[doc_id % {len(OWNERSHIP_KINDS)} + 1]"


@query("ownership_failures", f"""WITH {SQL_DISCLOSURES},
f AS (SELECT 'O' || {sql_letters('doc_id // 3')} AS ticker, {_OWNERSHIP_FORM} AS form, doc_id % 5 <> 0 AS readable FROM disc),
found AS (SELECT ticker, count(*) AS n FROM f WHERE form <> '10-K' AND readable GROUP BY ticker),
r AS (SELECT DISTINCT unnest([ticker, 'N' || ticker]) AS ticker FROM f)
SELECT r.ticker, n IS NOT NULL AS pipeline_success, CAST(coalesce(n, 0) AS BIGINT) AS n_filings,
  CASE WHEN n IS NULL THEN 'No 13D, 13G, or 13F-HR filings (including amendments) found for ' || r.ticker ||
    '. This is common for smaller companies with no activist or institutional >5% holders currently on file with the SEC.' END AS failure_reason
FROM r LEFT JOIN found USING (ticker)""")
def q_ownership_failures(spark, d):
    """Companies with filings of some forms, some of them unreadable, and companies that have none."""
    doc = F.col("doc_id")
    f = disclosures(spark, d).select(
        F.concat(F.lit("O"), letters(F.floor(doc / 3))).alias("ticker"), doc.cast("string").alias("accession_number"), F.lit(None).cast("date").alias("filing_date"),
        F.element_at(F.array(*map(F.lit, OWNERSHIP_KINDS)), (doc % len(OWNERSHIP_KINDS) + 1).cast("int")).alias("form_type"), doc.alias("index_pos"),
        F.when(doc % 5 != 0, F.concat(F.lit("<p>Schedule filed by holder "), letters(doc), F.lit("</p>"))).alias("html"),
    )
    absent = f.select(F.concat(F.lit("N"), "ticker").alias("ticker"))
    out = plans.ownership(f.drop("html"), f.select("accession_number", "html"), 6, _requests(f, absent))
    return out.select("ticker", "pipeline_success", F.coalesce("filing_count", F.lit(0)).cast("long").alias("n_filings"), "failure_reason")


# --- trends --------------------------------------------------------------------------------

POINTS_SQL = f"""{SERIES_SQL}, {sql_lexicon()},
rh AS (SELECT doc_id, sum(base) AS pts, list(signal) FILTER (tier <= 2) AS set, list(signal ORDER BY ord) FILTER (tier = 1) AS t1
  FROM sec, lex WHERE contains(lower(risk_text), lower(signal)) GROUP BY 1),
mh AS (SELECT doc_id, sum(base) AS pts, list(signal) FILTER (tier <= 2) AS set, list(signal ORDER BY ord) FILTER (tier = 1) AS t1
  FROM sec, lex WHERE contains(lower(mda_text), lower(signal)) GROUP BY 1),
points AS (
  SELECT 'T' || {sql_letters('doc_id // 6')} AS ticker, form_type, accession_number, {DATE_SQL} AS filing_date, doc_id,
    coalesce(rh.pts, 0) / 100.0::DOUBLE AS risk_raw_score, {sql_materiality('coalesce(rh.pts, 0)')} AS risk_materiality,
    coalesce(mh.pts, 0) / 100.0::DOUBLE AS mda_raw_score, {sql_materiality('coalesce(mh.pts, 0)')} AS mda_materiality,
    length(risk_text) AS risk_char_count, length(mda_text) AS mda_char_count, risk_ok AND mda_ok AS extraction_success,
    list_sort(list_distinct(list_concat(coalesce(rh.set, []), coalesce(mh.set, [])))) AS signal_set,
    list_sort(list_distinct(list_concat(coalesce(rh.t1[1:3], []), coalesce(mh.t1[1:3], []))))[1:6] AS top_signals
  FROM sec LEFT JOIN rh USING (doc_id) LEFT JOIN mh USING (doc_id)
),
steps AS (SELECT *, lag(signal_set) OVER w AS before, lag(doc_id) OVER w IS NOT NULL AS has_before, row_number() OVER w AS k,
  count(*) OVER (PARTITION BY ticker, form_type) AS n FROM points WINDOW w AS (PARTITION BY ticker, form_type ORDER BY doc_id)),
moves AS (
  SELECT *, 'appeared' AS change, unnest(list_filter(signal_set, lambda s: NOT list_contains(before, s))) AS signal FROM steps WHERE has_before
  UNION ALL
  SELECT *, 'removed', unnest(list_filter(before, lambda s: NOT list_contains(signal_set, s))) FROM steps WHERE has_before
)"""


def _points(spark, d):
    return trends.trend_points(series_index(spark, d), series_bodies(spark, d), 8)


@query("trend_points", f"""{POINTS_SQL}
SELECT ticker, form_type, accession_number, filing_date, risk_raw_score, risk_materiality, mda_raw_score, mda_materiality,
  risk_char_count, mda_char_count, extraction_success, array_to_string(signal_set, ',') AS signals, array_to_string(top_signals, ',') AS top_signals FROM points""")
def q_points(spark, d):
    return _points(spark, d).select(
        "ticker", "form_type", "accession_number", "filing_date", "risk_raw_score", "risk_materiality", "mda_raw_score",
        "mda_materiality", "risk_char_count", "mda_char_count", "extraction_success",
        F.array_join("signal_set", ",").alias("signals"), F.array_join("top_signals", ",").alias("top_signals"),
    )


@query("signal_transitions", f"{POINTS_SQL} SELECT ticker, form_type, filing_date, accession_number, change, signal FROM moves")
def q_transitions(spark, d):
    return trends.signal_transitions(_points(spark, d))


@query("trend_summary", f"""{POINTS_SQL},
counts AS (SELECT ticker, form_type, count(*) FILTER (change = 'appeared') AS a, count(*) FILTER (change = 'removed') AS r,
  list(signal ORDER BY k, signal) FILTER (change = 'appeared') AS al, list(signal ORDER BY k, signal) FILTER (change = 'removed') AS rl FROM moves GROUP BY ALL),
g AS (
  SELECT ticker, form_type, CAST(count(*) AS INT) AS n_points, min(filing_date) AS d0, max(filing_date) AS d1,
    arg_min(risk_raw_score, k) AS first_score, arg_max(risk_raw_score, k) AS last_score,
    arg_max(filing_date, rank * 1000 - k) AS peak_risk_date, arg_max(risk_raw_score, rank * 1000 - k) AS peak_risk_score, arg_max(risk_materiality, rank * 1000 - k) AS peak
  FROM (SELECT *, CASE risk_materiality WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END AS rank FROM steps) GROUP BY ALL
),
t AS (SELECT g.*, coalesce(a, 0) AS a, coalesce(r, 0) AS r, al, rl, round(last_score - first_score, 6) AS delta FROM g LEFT JOIN counts USING (ticker, form_type)),
u AS (SELECT *, CASE WHEN n_points < 2 THEN 'single_point' WHEN delta > 5 THEN 'deteriorating' WHEN delta < -5 THEN 'improving' ELSE 'stable' END AS trajectory FROM t)
SELECT ticker, form_type, n_points, trajectory, peak_risk_date, peak_risk_score, CAST(a AS INT) AS total_new_signals, CAST(r AS INT) AS total_removed_signals,
  concat_ws(' ', 'Risk trend for ' || n_points || CASE WHEN form_type = '10-Q' THEN ' quarterly' ELSE ' annual' END || ' filings (' || d0 || ' → ' || d1 || ').',
    'Trajectory: ' || upper(trajectory) || '.',
    'Risk score moved ' || printf('%.1f', first_score) || ' → ' || printf('%.1f', last_score) || ' (' || CASE WHEN delta > 0 THEN '↑' ELSE '↓' END || printf('%.1f', abs(last_score - first_score)) || ').',
    'New signals over period: ' || array_to_string(al[1:5], ', ') || '.', 'Removed signals: ' || array_to_string(rl[1:3], ', ') || '.',
    CASE WHEN peak IN ('high', 'critical') THEN 'Peak risk period: ' || peak_risk_date || ' (materiality=' || upper(peak) || ').' END) AS analyst_summary
FROM u""")
def q_trend_summary(spark, d):
    return trends.trend_summary(_points(spark, d)).select(
        "ticker", "form_type", "n_points", "trajectory", "peak_risk_date", "peak_risk_score", "total_new_signals",
        "total_removed_signals", "analyst_summary",
    )


@query("full_history_transitions", f"""WITH {SQL_DISCLOSURES}, {sql_lexicon()},
p AS (SELECT source, doc_id, coalesce(list(signal ORDER BY signal) FILTER (signal IS NOT NULL), []) AS set
  FROM disc LEFT JOIN lex ON tier <= 2 AND contains(lower(text), lower(signal)) GROUP BY ALL),
s AS (SELECT *, lag(set) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM p)
SELECT source, doc_id, 'appeared' AS change, unnest(list_filter(set, lambda x: NOT list_contains(before, x))) AS signal FROM s WHERE before IS NOT NULL
UNION ALL
SELECT source, doc_id, 'removed', unnest(list_filter(before, lambda x: NOT list_contains(set, x))) FROM s WHERE before IS NOT NULL""")
def q_full_history(spark, d):
    p = disclosures(spark, d).select(
        "source", "doc_id", F.array_sort(signals(of_tier(find_hits(F.col("text")), 1, 2))).alias("signal_set")
    )
    # 512 consecutive ids to a bucket: a hot source spreads over many tasks
    return trends.full_history_transitions(p, ["source"], ["doc_id"], F.floor(F.col("doc_id") / 512), ["source", "doc_id"])


# --- whole analyses -----------------------------------------------------------------------------


_SIDE_GAPS = """concat_ws('; ', CASE WHEN NOT {s}.risk_ok THEN 'Risk Factors could not be isolated (method: raw_fallback)' END,
  CASE WHEN NOT {s}.mda_ok THEN 'MD&A could not be isolated (method: raw_fallback)' END,
  CASE WHEN length({s}.full_text) < 5000 THEN 'Filing HTML is unusually short — may be a stub or redirect' END)"""


@query("compare_extraction", f"""{PAIR_LAYOUT},
long AS (
  SELECT *, 'risk_factors' AS section, rm AS m, length(risk_text) AS chars FROM sec UNION ALL SELECT *, 'mda', dm, length(mda_text) FROM sec
),
sided AS (SELECT doc_id, form_type, side, section, m, chars, CAST({CONF} AS DOUBLE) AS confidence, {_SIDE_GAPS.format(s='long')} AS gaps FROM long)
SELECT 'D' || {sql_letters('n.doc_id')} AS ticker, n.form_type, n.section AS section_name, n.m AS newer_method, o.m AS older_method,
  n.confidence AS newer_confidence, o.confidence AS older_confidence, n.chars AS newer_chars, o.chars AS older_chars, n.gaps AS newer_gaps, o.gaps AS older_gaps
FROM sided n JOIN sided o ON o.doc_id = n.doc_id AND o.section = n.section AND n.side = 2 AND o.side = 1""")
def q_compare_extraction(spark, d):
    c = compare.compare_filings(pair_index(spark, d), pair_bodies(spark, d))
    both = lambda name, field, shown=lambda x: x: [shown(F.col(f"{s}_extraction.{field}")).alias(f"{s}_{name}") for s in ("newer", "older")]
    return c.select(
        "ticker", "form_type", "section_name", *both("method", "method"), *both("confidence", "confidence_score"), *both("chars", "char_count"),
        *both("gaps", "known_gaps", lambda g: F.array_join(g, "; ")),
    )


COMPARE_SQL = f"""{GATE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {sql_lexicon()},
long AS (
  SELECT doc_id, form_type, side, 'risk_factors' AS section, risk_text AS t, rm AS method FROM sec
  UNION ALL SELECT doc_id, form_type, side, 'mda', mda_text, dm FROM sec
),
source AS (
  SELECT n.doc_id || ':' || n.section AS k, n.doc_id, n.form_type, n.section, n.method, issues, issues IS NULL AS compared,
    CASE WHEN issues IS NULL THEN n.t END AS text, CASE WHEN issues IS NULL THEN o.t END AS older_text,
    CASE WHEN issues IS NULL THEN {sql_sentences('o.t', normalise=True)} END AS o, CASE WHEN issues IS NULL THEN {sql_sentences('n.t', normalise=True)} END AS n
  FROM long n JOIN long o ON o.doc_id = n.doc_id AND o.section = n.section AND n.side = 2 AND o.side = 1 JOIN gate g ON g.doc_id = n.doc_id
),
{sql_alignment('source')}, {sql_compared('source')}"""


@query("compare_filings", f"""{COMPARE_SQL}
SELECT 'D' || {sql_letters('doc_id')} AS ticker, form_type, section AS section_name, compared AS pipeline_success,
  CASE WHEN NOT compared THEN 'Extraction quality below threshold — comparison unreliable. ' || issues END AS failure_reason, method,
  magnitude, pct_changed, unchanged_count, rewritten_count, removed_count, added_count, total / 100.0::DOUBLE AS raw_score, {sql_materiality('total')} AS materiality,
  CASE WHEN NOT compared THEN 'No text available for ' || section || ' — scoring skipped.' ELSE {sql_note("CASE section WHEN 'mda' THEN 'MD&A' ELSE 'Risk Factors' END")} END AS analyst_note
FROM ascored""")
def q_compare(spark, d):
    return compare.compare_filings(pair_index(spark, d), pair_bodies(spark, d)).select(
        "ticker", "form_type", "section_name", "pipeline_success", "failure_reason", "method", "magnitude", "pct_changed",
        "unchanged_count", "rewritten_count", "removed_count", "added_count", "raw_score", "materiality", "analyst_note",
    )


@query("compare_gate", f"""{GATE_SQL}
SELECT 'D' || {sql_letters('doc_id')} AS ticker, form_type, s AS section_name, issues IS NULL AS pipeline_success FROM gate, (VALUES ('risk_factors'), ('mda')) v(s)""")
def q_compare_gate(spark, d):
    return compare.compare_filings(pair_index(spark, d), pair_bodies(spark, d)).select(
        "ticker", "form_type", "section_name", "pipeline_success"
    )


@query("compare_signals", f"""{GATE_SQL}, {sql_lexicon()},
long AS (
  SELECT doc_id, form_type, side, 'risk_factors' AS section_name, risk_text AS t FROM sec
  UNION ALL SELECT doc_id, form_type, side, 'mda', mda_text FROM sec
),
good AS (SELECT l.*, {sql_sentences('t', normalise=True)} AS s FROM long l JOIN gate g USING (doc_id) WHERE issues IS NULL),
h AS (SELECT doc_id, side, section_name, signal, tier, ord FROM good, lex WHERE contains(lower(t), lower(signal))),
fresh AS (SELECT doc_id, section_name, list(signal ORDER BY ord)[1:15] AS l FROM h n WHERE side = 2 AND NOT EXISTS (
  SELECT 1 FROM h o WHERE o.side = 1 AND o.doc_id = n.doc_id AND o.section_name = n.section_name AND o.ord = n.ord) GROUP BY ALL),
gone AS (SELECT doc_id, section_name, list(signal ORDER BY ord)[1:15] AS l FROM h n WHERE side = 1 AND NOT EXISTS (
  SELECT 1 FROM h o WHERE o.side = 2 AND o.doc_id = n.doc_id AND o.section_name = n.section_name AND o.ord = n.ord) GROUP BY ALL),
t1 AS (SELECT doc_id, section_name, list(signal ORDER BY ord)[1:20] AS l FROM h WHERE side = 2 AND tier = 1 GROUP BY ALL)
SELECT 'D' || {sql_letters('n.doc_id')} AS ticker, n.form_type, n.section_name, CAST(len(o.s) AS INT) AS total_older_sentences, CAST(len(n.s) AS INT) AS total_newer_sentences,
  coalesce(array_to_string(fresh.l, ','), '') AS new_signals, coalesce(array_to_string(gone.l, ','), '') AS removed_signals, coalesce(array_to_string(t1.l, ','), '') AS tier1
FROM good n JOIN good o ON o.doc_id = n.doc_id AND o.section_name = n.section_name AND n.side = 2 AND o.side = 1
LEFT JOIN fresh ON fresh.doc_id = n.doc_id AND fresh.section_name = n.section_name
LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.section_name = n.section_name
LEFT JOIN t1 ON t1.doc_id = n.doc_id AND t1.section_name = n.section_name""")
def q_compare_signals(spark, d):
    c = compare.compare_filings(pair_index(spark, d), pair_bodies(spark, d)).where("pipeline_success")
    names = lambda col: F.array_join(F.transform(col, lambda h: h["signal"]), ",")
    return c.select(
        "ticker", "form_type", "section_name", "total_older_sentences", "total_newer_sentences",
        names("new_signals").alias("new_signals"), names("removed_signals").alias("removed_signals"), names("tier1_hits").alias("tier1"),
    )


@query("overall_materiality", f"""{COMPARE_SQL},
rated AS (SELECT *, {sql_materiality('total')} AS m FROM ascored WHERE compared),
best AS (SELECT doc_id, form_type, arg_max(m, CASE m {" ".join(f"WHEN '{n}' THEN {r}" for n, r in fv.MATERIALITY_RANK.items())} END) AS overall_materiality FROM rated GROUP BY 1, 2),
named AS (
  SELECT doc_id, section, unnest(new_list[1:5]) AS signal, generate_subscripts(new_list[1:5], 1) AS i, CASE section WHEN 'mda' THEN 1 ELSE 0 END AS g FROM rated
  UNION ALL
  SELECT doc_id, section, unnest(t1[1:3]), generate_subscripts(t1[1:3], 1), CASE section WHEN 'mda' THEN 3 ELSE 2 END FROM rated
),
seen AS (
  SELECT n.doc_id, n.section, n.signal, tier, weight, i + g * 100 AS place, row_number() OVER (PARTITION BY doc_id, n.signal ORDER BY i + g * 100) AS mention
  FROM named n JOIN lex l ON l.signal = n.signal
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -tier, -weight, place) AS r FROM seen WHERE mention = 1)
SELECT 'D' || {sql_letters('b.doc_id')} AS ticker, form_type, overall_materiality,
  coalesce(string_agg(signal || ' [' || section || ']', '; ' ORDER BY r) FILTER (r <= 10), '') AS top_signals
FROM best b LEFT JOIN ranked r ON r.doc_id = b.doc_id GROUP BY b.doc_id, form_type, overall_materiality""")
def q_overall(spark, d):
    c = compare.compare_filings(pair_index(spark, d), pair_bodies(spark, d)).where("pipeline_success")
    return compare.overall(c, ["ticker", "form_type"]).select(
        "ticker", "form_type", "overall_materiality", F.array_join("top_signals", "; ").alias("top_signals")
    )


def _tax_sql() -> str:
    rows = ", ".join(f"({i}, {lit(k)}, {t}, {lit(w)})" for i, (k, _, t, kws) in enumerate(fv.RISK_TAXONOMY) for w in kws)
    return f"tax(d, category, tier, keyword) AS (VALUES {rows})"


@query("categorize_risks", f"""{SERIES_SQL}, {_tax_sql()},
newest AS (SELECT * FROM sec QUALIFY row_number() OVER (PARTITION BY doc_id // 6 ORDER BY doc_id DESC) = 1),
ss AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(risk_text, {lit(f'([.!?]){WS}+([A-Z"' + "'" + '(])')}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda z: {sql_trim('z')}), lambda z: length(z) >= 20)) AS s FROM newest WHERE risk_ok),
hits AS (SELECT DISTINCT doc_id, d, category, tier, keyword FROM ss, tax WHERE contains(lower(s), lower(keyword))),
cats AS (SELECT doc_id, d, category, tier, count(*) AS n FROM hits GROUP BY ALL),
per AS (SELECT doc_id, CAST(count(*) AS INT) AS n_domains, CAST(sum(n) AS INT) AS total, CAST(count(*) FILTER (tier = 1) AS INT) AS t1,
  string_agg(category, ',' ORDER BY tier, -n, d) AS domains FROM cats GROUP BY 1)
SELECT 'T' || {sql_letters('doc_id // 6')} AS ticker, form_type, accession_number, risk_ok AS pipeline_success, length(risk_text) AS risk_section_char_count,
  CASE WHEN risk_ok THEN coalesce(n_domains, 0) END AS total_domains_identified, CASE WHEN risk_ok THEN coalesce(total, 0) END AS total_signals,
  CASE WHEN risk_ok THEN coalesce(t1, 0) END AS tier1_domain_count, CASE WHEN risk_ok THEN coalesce(domains, '') END AS domains
FROM newest LEFT JOIN per USING (doc_id)""")
def q_categorize(spark, d):
    c = categorize.categorize_risks(series_index(spark, d), series_bodies(spark, d))
    return c.select(
        "ticker", "form_type", "accession_number", "pipeline_success", "risk_section_char_count",
        "total_domains_identified", "total_signals", "tier1_domain_count",
        F.array_join(F.transform("categories", lambda x: x["category"]), ",").alias("domains"),
    )


def _sql_choose(key: str, words: dict, fill: str = "") -> str:
    """CASE over one of the report's word lists; ``fill`` are the values for its blanks, as SQL."""
    def text(t: str) -> str:
        return f"format({lit(t.replace('%%', '%').replace('%s', '{}'))}{fill})" if fill else lit(t)

    cases = " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in words.items() if k is not None)
    return f"CASE {key} {cases} " + (f"ELSE {text(words[None])} " if None in words else "") + "END"


def _sql_heading(title: str) -> str:
    return f"{lit(title)}, repeat('─', 40)"


def _sql_dated(days: int) -> str:
    return f"strftime(DATE '2020-01-01' + CAST(doc_id % 300 + {days} AS INTEGER), '%Y-%m-%d')"


def _sql_quoted(names: str, n: int) -> str:
    return f"""array_to_string(list_transform({names}[1:{n}], lambda x: '"' || x || '"'), ', ')"""


def _sql_percent(section: str) -> str:
    return f"printf('%.0f', {section}_pct * 100)"


def _sql_changed(section: str, label: str, missing: str) -> str:
    word = _sql_choose(f"{section}_magnitude", say.MAGNITUDE_WORDS)
    return f"CASE WHEN {section}_compared THEN {lit(label)} || {word} || ' (' || {_sql_percent(section)} || '% of sentences affected)' ELSE {lit(label + missing)} END"


def _sql_score(section: str, label: str) -> str:
    return f"{lit(label)} || {_sql_choose(f'{section}_rating', say.RATING_MARKS)} || ' ' || upper({section}_rating) || '  (score ' || printf('%.1f', {section}_total / 100.0) || ')'"


def _sql_facts() -> str:
    shown = (("Revenue", "revenue"), ("Net Income", "net_income"), ("Cash and Equivalents", "cash_and_equivalents"), ("Total Debt", "total_debt"), ("Current Ratio", "current_ratio"), ("Capex", "capex"))
    value = lambda c: f"printf('%.2f', {c})" if c == "current_ratio" else f"format('{{:,.0f}}', {c})"
    return ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{name}: ' || {value(c)} END" for name, c in shown)


_RANK = "CASE {} " + " ".join(f"WHEN '{n}' THEN {r}" for n, r in fv.MATERIALITY_RANK.items()) + " END"
_SIDE_COLUMNS = ", ".join(
    f"{s}.compared AS {s}_compared, {s}.pct_changed AS {s}_pct, {s}.magnitude AS {s}_magnitude, {s}.rating AS {s}_rating, {s}.total AS {s}_total, "
    f"{s}.new_list AS {s}_new, {s}.gone_list AS {s}_gone" for s in ("risk", "mda")
)
_OPENING = _sql_choose("overall", say.OPENINGS, ", ticker, CASE form_type WHEN '10-K' THEN 'annual' ELSE 'quarterly' END, newer")
_RISK_CHANGE = _sql_choose("risk_magnitude", say.RISK_CHANGES, f", {_sql_percent('risk')}, older")
_CONTEXT = "replace(substr(text, greatest(1, p - 60), p + length(signal) + 60 - greatest(1, p - 60)), chr(10), ' ')"

REPORT_SQL = f"""{PAIR_LAYOUT.replace("WITH ", "WITH RECURSIVE ", 1)}, {sql_lexicon()}, {CONTEXT_SQL.removeprefix("WITH ")}, quick(i, category, kws) AS (VALUES {QUICK_ROWS}),
two_sides AS (
  SELECT n.doc_id, n.form_type, n.rm, n.risk_ok OR n.mda_ok AS good, length(n.risk_text) AS risk_chars, length(n.mda_text) AS mda_chars, n.accession_number AS accession,
    CASE WHEN n.risk_ok THEN n.risk_text END AS nr, CASE WHEN n.mda_ok THEN n.mda_text END AS nm,
    CASE WHEN o.risk_ok AND (n.risk_ok OR n.mda_ok) AND NOT (n.risk_ok AND length(n.risk_text) < {fv.REPORT_POINTER[0]} AND
      len(list_filter({strings(fv.REPORT_POINTER[1])}, lambda p: contains(lower(n.risk_text), p))) > 0) THEN o.risk_text END AS old_r,
    CASE WHEN o.mda_ok AND (n.risk_ok OR n.mda_ok) THEN o.mda_text END AS old_m
  FROM sec n JOIN sec o ON o.doc_id = n.doc_id AND n.side = 2 AND o.side = 1 WHERE n.form_type <> '20-F'),
halves AS (
  SELECT doc_id, form_type, good, 'risk_factors' AS section, nr AS text, old_r AS older_text FROM two_sides
  UNION ALL SELECT doc_id, form_type, good, 'mda', nm, old_m FROM two_sides),
source AS (
  SELECT *, doc_id || ':' || section AS k, CASE WHEN compared THEN {sql_sentences('older_text', normalise=True)} END AS o, CASE WHEN compared THEN {sql_sentences('text', normalise=True)} END AS n
  FROM (SELECT *, coalesce(length(text), 0) > 0 AND coalesce(length(older_text), 0) > 0 AS compared FROM halves)),
{sql_alignment('source')}, {sql_compared('source')},
marked AS (
  SELECT h.k, h.signal, h.tier, h.ord, h.is_new, row_number() OVER (PARTITION BY h.k, h.tier ORDER BY h.ord) AS r, '...' || {sql_trim(_CONTEXT)} || '...' AS context
  FROM (SELECT m.*, s.text, strpos(lower(s.text), lower(m.signal)) AS p FROM amarked m JOIN source s ON s.k = m.k WHERE tier <= 2) h),
bullets AS (
  SELECT k, string_agg('  • ' || signal || CASE WHEN is_new THEN ' [NEW]' ELSE '' END || chr(10) || '    ' || substr(context, 1, 120), chr(10) ORDER BY ord) FILTER (tier = 1 AND r <= 6) AS b1,
    string_agg('  • ' || signal || CASE WHEN is_new THEN ' [NEW]' ELSE '' END, chr(10) ORDER BY ord) FILTER (tier = 2 AND r <= 5) AS b2 FROM marked GROUP BY k),
categories AS (
  SELECT doc_id, string_agg('  ' || rpad(category, 30, ' ') || '  ' || c || ' signals', chr(10) ORDER BY -c, i) AS lines
  FROM (SELECT doc_id, i, category, len(list_filter(kws, lambda w: contains(lower(text), w))) AS c FROM source, quick WHERE section = 'risk_factors') WHERE c > 0 GROUP BY doc_id),
names AS (SELECT k, list(lower(signal)) AS ns FROM amarked WHERE tier <= 2 GROUP BY k),
told AS (SELECT k, doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (
  SELECT k, doc_id, list_filter({sql_sentences('text', openers='A-Z', min_chars=40)}, lambda z: length(z) <= 300) AS x FROM source WHERE section = 'mda' AND text IS NOT NULL)),
points AS (
  SELECT k, doc_id, s, pos, len(list_filter({strings(fv.MDA_KEYWORDS)}, lambda w: contains(lower(s), w))) + 2 * len(list_filter(coalesce(ns, []), lambda w: contains(lower(s), w))) AS score
  FROM told LEFT JOIN names USING (k)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY k, substr(s, 1, 60) ORDER BY -score, pos) AS seen FROM points WHERE score > 0),
best_told AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY -score, pos) AS rank FROM firsts WHERE seen = 1),
highlights AS (SELECT doc_id, list(substr(s, 1, 200) ORDER BY rank) AS hs FROM best_told WHERE rank <= 5 GROUP BY doc_id),
facts AS (SELECT cik, list_filter([{_sql_facts()}], lambda x: x IS NOT NULL) AS fs FROM ctx),
rated AS (SELECT *, {sql_materiality('total')} AS rating FROM ascored),
wide AS (
  SELECT t.*, {_SIDE_COLUMNS},
    CASE WHEN {_RANK.format('risk.rating')} >= {_RANK.format('mda.rating')} THEN risk.rating ELSE mda.rating END AS overall, b1, b2, c.lines AS category_lines,
    CASE WHEN len(fs) > 0 THEN fs ELSE hs END AS shown, {_sql_dated(730).replace('doc_id', 't.doc_id')} AS newer, {_sql_dated(365).replace('doc_id', 't.doc_id')} AS older, 'D' || {sql_letters('t.doc_id')} AS ticker
  FROM two_sides t JOIN rated risk ON risk.doc_id = t.doc_id AND risk.section = 'risk_factors' JOIN rated mda ON mda.doc_id = t.doc_id AND mda.section = 'mda'
  LEFT JOIN bullets b ON b.k = risk.k LEFT JOIN categories c ON c.doc_id = t.doc_id LEFT JOIN highlights h ON h.doc_id = t.doc_id
  LEFT JOIN facts f ON f.cik = lpad(CAST(t.doc_id AS VARCHAR), 10, '0')),
named AS (
  SELECT doc_id, section, unnest(new_list[1:5]) AS signal, generate_subscripts(new_list[1:5], 1) AS i, CASE section WHEN 'mda' THEN 1 ELSE 0 END AS g FROM rated
  UNION ALL SELECT doc_id, section, unnest(t1[1:3]), generate_subscripts(t1[1:3], 1), CASE section WHEN 'mda' THEN 3 ELSE 2 END FROM rated),
mentioned AS (
  SELECT n.doc_id, n.section, n.signal, l.tier, l.weight, i + g * 100 AS place, row_number() OVER (PARTITION BY doc_id, n.signal ORDER BY i + g * 100) AS mention
  FROM named n JOIN lex l ON l.signal = n.signal),
foremost AS (
  SELECT doc_id, string_agg(signal || ' [' || section || ']', '; ' ORDER BY r) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -tier, -weight, place) AS r FROM mentioned WHERE mention = 1) WHERE r <= 8 GROUP BY doc_id)
SELECT ticker, form_type, good AS pipeline_success, CAST(newer AS DATE) AS filing_date,
  CASE WHEN NOT good THEN 'Could not extract Risk Factors or MD&A from ' || ticker || '''s ' || form_type || ' filing (filed ' || newer ||
    '). The filing may use an unsupported format (image-based PDF, heavily customized XBRL, or exhibit-only filing).' END AS failure_reason,
  CASE WHEN good THEN overall END AS overall_materiality, CASE WHEN good THEN coalesce(top, '') ELSE '' END AS top_signals,
  CASE WHEN good THEN array_to_string(list_filter([
    repeat('=', 64), '  DISCLOSURE RISK — ANALYST REPORT', '  ' || ticker || '  |  ' || form_type || '  |  Filed ' || newer, '  Generated June 30, 2024', repeat('=', 64), '',
    'OVERALL RISK RATING:  ' || {_sql_choose('overall', say.RATING_MARKS)} || ' ' || upper(overall), '', {_sql_heading('EXECUTIVE SUMMARY')},
    {_OPENING} || ' ' || CASE WHEN risk_compared THEN {_RISK_CHANGE} ELSE 'Risk Factor comparison was not available (e.g., 10-Q incorporating 10-K by reference).' END || ' ' ||
      concat_ws(' ', CASE WHEN len(risk_new) > 0 THEN 'Notably, new risk signals emerged, including ' || {_sql_quoted('risk_new', 3)} || '.' END,
        CASE WHEN len(risk_gone) > 0 THEN 'Conversely, previously flagged risks such as ' || {_sql_quoted('risk_gone', 2)} || ' are no longer present.' END) || ' ' ||
      CASE WHEN mda_compared THEN 'The Management''s Discussion and Analysis (MD&A) section saw ' || {_sql_choose('mda_magnitude', say.MAGNITUDE_WORDS)} || ' changes, with ' || {_sql_percent('mda')} || '% of sentences affected. '
        ELSE 'MD&A comparison was not available. ' END || {_sql_choose('mda_rating', say.MDA_TONES)},
    '', {_sql_heading('WHAT CHANGED VS PRIOR FILING')},
    {_sql_changed('risk', 'Risk Factors:  ', 'comparison not available (10-Q incorporates 10-K by reference)')},
    CASE WHEN risk_compared AND len(risk_new) > 0 THEN '  ⚠  New risk signals appeared: ' || array_to_string(risk_new[1:5], ', ') END,
    CASE WHEN risk_compared AND len(risk_gone) > 0 THEN '  ✓  Risk signals removed: ' || array_to_string(risk_gone[1:3], ', ') END,
    {_sql_changed('mda', 'MD&A:          ', 'comparison not available')}, '', {_sql_heading('TOP RISK SIGNALS')},
    'Critical (Tier 1):' || chr(10) || b1 || chr(10), 'Elevated (Tier 2):' || chr(10) || b2 || chr(10),
    CASE WHEN len(shown) > 0 THEN array_to_string([{_sql_heading('MD&A FINANCIAL HIGHLIGHTS')}, '  • ' || array_to_string(shown, chr(10) || '  • '), ''], chr(10)) END,
    CASE WHEN category_lines IS NOT NULL THEN array_to_string([{_sql_heading('RISK CATEGORIES PRESENT')}, category_lines, ''], chr(10)) END,
    {_sql_heading('SECTION SCORES')}, {_sql_score('risk', '  Risk Factors:  ')}, {_sql_score('mda', '  MD&A:          ')}, '', {_sql_heading('FILING DETAILS')},
    '  Ticker:          ' || ticker, '  Form type:       ' || form_type, '  Filing date:     ' || newer, '  Prior filing:    ' || older, '  Accession:       ' || accession,
    '  Risk chars:      ' || format('{{:,}}', risk_chars), '  MD&A chars:      ' || format('{{:,}}', mda_chars), '  Extraction:      ' || rm, '', repeat('─', 64),
    {strings(report.CLOSING)[1:-1]}, repeat('=', 64)], lambda x: x IS NOT NULL), chr(10)) END AS report
FROM wide LEFT JOIN foremost USING (doc_id)"""


@query("executive_report", REPORT_SQL)
def q_report(spark, d):
    return report.executive_reports(
        pair_index(spark, d), pair_bodies(spark, d), _facts(spark, d), F.lit("2024-06-30").cast("date")
    ).withColumn("top_signals", F.array_join("top_signals", "; "))


@query("report_status", f"""{PAIR_LAYOUT}
SELECT 'D' || {sql_letters('doc_id')} AS ticker, form_type, risk_ok OR mda_ok AS pipeline_success, CAST(DATE '2020-01-01' + CAST(doc_id % 300 + 730 AS INTEGER) AS DATE) AS filing_date,
  CASE WHEN NOT (risk_ok OR mda_ok) THEN 'Could not extract Risk Factors or MD&A from D' || {sql_letters('doc_id')} || '''s ' || form_type || ' filing (filed ' ||
    CAST(DATE '2020-01-01' + CAST(doc_id % 300 + 730 AS INTEGER) AS DATE) || '). The filing may use an unsupported format (image-based PDF, heavily customized XBRL, or exhibit-only filing).' END AS failure_reason,
  CASE WHEN risk_ok OR mda_ok THEN '  Risk chars:      ' || format('{{:,}}', length(risk_text)) END AS risk_line
FROM sec WHERE side = 2 AND form_type <> '20-F'""")
def q_report_status(spark, d):
    r = q_report(spark, d)
    line = F.nullif(F.regexp_extract("report", r"(?m)^(  Risk chars: .*)$", 1), F.lit(""))
    return r.select("ticker", "form_type", "pipeline_success", "filing_date", "failure_reason", line.alias("risk_line"))


@query("proxy_governance", f"""WITH {SQL_DISCLOSURES},
p AS (SELECT *, doc_id // 2 AS c FROM disc QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) = 1),
t AS (SELECT c, doc_id, {sql_trim("replace(replace(text, '&', ' '), '<', ' ')")} AS t FROM p),
g(signal, points) AS (VALUES {", ".join(f"({lit(p)}, {fv.GOVERNANCE_POINTS[x]})" for p, x in fv.GOVERNANCE_PHRASES)}),
s AS (SELECT doc_id, sum(points) AS pts, count(*) AS n FROM t, g WHERE contains(lower(t), signal) GROUP BY 1)
SELECT 'G' || {sql_letters('c')} AS ticker, {ACC2} AS accession_number, t <> '' AS pipeline_success,
  CAST(coalesce(pts, 0) AS INT) AS governance_risk_score, CAST(coalesce(n, 0) AS INT) AS signal_count FROM t LEFT JOIN s USING (doc_id)""")
def q_proxy(spark, d):
    doc = F.col("doc_id")
    plain = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit(" ")), F.lit("<"), F.lit(" "))
    docs = disclosures(spark, d).select(
        F.concat(F.lit("G"), letters(F.floor(doc / 2))).alias("ticker"), F.lit("DEF 14A").alias("form_type"),
        accession(doc, 2).alias("accession_number"), F.lit("2024-01-01").cast("date").alias("filing_date"), (F.lit(0) - doc).alias("index_pos"),
        F.when(F.col("text") != "", F.concat(F.lit("<div>"), plain, F.lit("</div>"))).alias("html"),
    )
    out = plans.proxy_governance(docs.drop("html"), docs.select("accession_number", "html"))
    return out.select(
        "ticker", "accession_number", "pipeline_success", F.coalesce("governance_risk_score", F.lit(0)).alias("governance_risk_score"),
        F.coalesce(F.size("governance_signals"), F.lit(0)).alias("signal_count"),
    )


# --- insider ---------------------------------------------------------------------------------------

CODES = {"purchase": "P", "view": "S", "click": "A", "signup": "X", "error": ""}


def _form4(spark, d):
    """Every event as a Form 4 filing: XML in two spellings, a tenth only as a
    rendered table."""
    e = table(spark, d, "events")
    code = F.lit("")
    for k, v in CODES.items():
        code = F.when(F.col("event_type") == k, F.lit(v)).otherwise(code)
    # shares in whole units, written with thousands commas
    shares = F.call_function("format_number", F.floor(F.col("value") * 100).cast("double"), F.lit("#,##0"))
    eid = F.col("event_id")
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))

    def doc(up):
        n = (lambda s: s.upper()) if up else (lambda s: s)
        return F.concat(
            F.lit('<?xml version="1.0"?><ownershipDocument><reportingOwner>'),
            tag(n("rptOwnerName"), F.concat(F.lit("Owner &amp; Sons "), F.col("user_id").cast("string"))),
            tag(n("isDirector"), F.when(F.col("user_id") % 2 == 0, "1").otherwise("0")), tag(n("isOfficer"), F.when(F.col("user_id") % 3 == 0, "1").otherwise("0")),
            F.when(F.col("user_id") % 5 == 0, tag(n("officerTitle"), F.lit("Chief Officer"))).otherwise(""),
            F.lit("</reportingOwner><nonDerivativeTable>"),
            tag(n("nonDerivativeTransaction"), F.concat(
                F.when(code != "", tag(n("transactionCode"), code)).otherwise(""),
                tag(n("transactionShares"), tag("value", shares)),
                F.when(eid % 4 != 0, tag(n("transactionPricePerShare"), tag("value", (eid % 90).cast("string")))).otherwise(""),
                tag(n("sharesOwnedFollowingTransaction"), F.concat(F.lit("\n"), tag("value", (eid * 3).cast("string")))),
            )),
            F.lit("</nonDerivativeTable></ownershipDocument>"),
        )

    html = F.concat(
        F.lit("<table><tr><td>Name and Address of Reporting Person*</td><td>"), F.lit("Table Owner</td></tr><tr><th>a</th><td>b</td><td>"),
        code, F.lit("</td><td>"), shares, F.lit("</td></tr></table>"),
    )
    return e.select(
        F.concat(F.lit("I"), letters(F.floor(eid / 20))).alias("ticker"), F.lit("4").alias("form_type"),
        eid.alias("accession_number"), F.to_date("ts").alias("filing_date"), (F.lit(0) - eid).alias("index_pos"),
        F.when(eid % 10 != 0, F.when(eid % 3 == 0, doc(True)).otherwise(doc(False))).alias("xml"),
        F.when(eid % 10 == 0, html).alias("rendered_html"),
    )


FORM4_SQL = f"""WITH tx AS (
  SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'P' WHEN 'view' THEN 'S' WHEN 'click' THEN 'A' WHEN 'signup' THEN 'X' ELSE '' END AS code,
    floor(value * 100) AS shares, event_id % 10 = 0 AS rendered, 'I' || {sql_letters('event_id // 20')} AS ticker FROM events
), rows AS (
  SELECT * FROM tx WHERE code <> '' AND NOT (rendered AND code = 'X')
)"""


@query("form4_transactions", f"""{FORM4_SQL}
SELECT event_id AS accession_number, code, CASE code WHEN 'P' THEN 'Open market purchase' WHEN 'S' THEN 'Open market sale' WHEN 'A' THEN 'Award / grant' ELSE 'Other' END AS transaction_type,
  CAST(shares AS DOUBLE) AS shares, CASE WHEN NOT rendered AND event_id % 4 <> 0 THEN CAST(event_id % 90 AS DOUBLE) END AS price,
  CASE WHEN NOT rendered THEN CAST(event_id * 3 AS DOUBLE) END AS owned_after,
  CASE WHEN rendered THEN 'Table Owner' ELSE 'Owner & Sons ' || user_id END AS insider_name,
  CASE WHEN rendered THEN 'Insider' WHEN user_id % 5 = 0 THEN 'Chief Officer' WHEN user_id % 6 = 0 THEN 'Director, Officer'
    WHEN user_id % 2 = 0 THEN 'Director' WHEN user_id % 3 = 0 THEN 'Officer' ELSE 'Insider' END AS insider_title
FROM rows""")
def q_form4(spark, d):
    return transaction_rows(form4_transactions(_form4(spark, d))).select(
        "accession_number", "code", "transaction_type", "shares", "price", "owned_after", "insider_name", "insider_title"
    )


@query("insider_net", f"""{FORM4_SQL},
f AS (SELECT ticker, count(*) AS total_filings FROM tx GROUP BY 1),
g AS (
  SELECT ticker, coalesce(sum(shares) FILTER (code = 'P'), 0) AS bought, coalesce(sum(shares) FILTER (code = 'S'), 0) AS sold,
    count(*) FILTER (code = 'P') AS buy_count, count(*) FILTER (code = 'S') AS sell_count, count(*) AS filings_with_data FROM rows GROUP BY 1
)
SELECT ticker, CAST(bought AS DOUBLE) AS net_shares_bought, CAST(sold AS DOUBLE) AS net_shares_sold, buy_count, sell_count, filings_with_data, total_filings,
  ticker || ' insider activity across ' || total_filings || ' recent Form 4 filings ' ||
  CASE WHEN filings_with_data < total_filings THEN '(parsed ' || filings_with_data || '/' || total_filings || ' filings successfully)' ELSE '' END || ': ' ||
  buy_count || ' purchase transaction(s) totaling ' || format('{{:,}}', CAST(bought AS BIGINT)) || ' shares, ' || sell_count || ' sale transaction(s) totaling ' ||
  format('{{:,}}', CAST(sold AS BIGINT)) || ' shares. Net position: ' || CASE WHEN bought > sold THEN 'net buying' WHEN bought < sold THEN 'net selling' ELSE 'balanced activity' END ||
  ' (' || CASE WHEN bought >= sold THEN '+' ELSE '' END || format('{{:,}}', CAST(bought - sold AS BIGINT)) || ' shares).' AS summary
FROM f JOIN g USING (ticker)""")
def q_insider(spark, d):
    f = _form4(spark, d)
    docs = f.select("accession_number", "xml", "rendered_html")
    return plans.insider_activity(f.drop("xml", "rendered_html"), docs, 25).where("pipeline_success").drop(
        "transaction_count", "pipeline_success", "failure_reason")


@query("insider_failures", f"""{FORM4_SQL},
f AS (SELECT upper(code) AS code, event_id, rendered, ticker || '-' || event_type AS ticker FROM (SELECT tx.*, e.event_type FROM tx JOIN events e USING (event_id))),
g AS (
  SELECT ticker, count(*) AS n, count(*) FILTER (code <> '' AND NOT (rendered AND code = 'X')) AS parsed,
    array_to_string(list(event_id || ': ' || CASE WHEN rendered THEN 'no XML found' ELSE 'XML fetched but 0 transactions parsed' END ORDER BY event_id)[1:5], ' | ') AS notes
  FROM f GROUP BY 1),
r AS (SELECT DISTINCT unnest([ticker, 'N' || ticker]) AS ticker FROM f)
SELECT r.ticker, coalesce(parsed > 0, FALSE) AS pipeline_success,
  CASE WHEN n IS NULL THEN 'No Form 4 filings found for ' || r.ticker || ' in the recent submissions window. This can happen for companies with very low insider trading activity recently.'
    WHEN parsed = 0 THEN 'Found ' || n || ' Form 4 filing(s) for ' || r.ticker || ' but could not parse transaction data from any of them. Diagnostic: ' || notes END AS failure_reason
FROM r LEFT JOIN g USING (ticker)""")
def q_insider_failures(spark, d):
    """A company for each kind of event, so that some have only filings without transactions."""
    kinds = table(spark, d, "events").select(F.col("event_id").alias("accession_number"), "event_type")
    f = _form4(spark, d).join(kinds, "accession_number").withColumn("ticker", F.concat_ws("-", "ticker", "event_type"))
    index = f.drop("xml", "rendered_html", "event_type").withColumn("filing_date", F.lit(None).cast("date")).withColumn("index_pos", F.col("accession_number"))
    absent = f.select(F.concat(F.lit("N"), "ticker").alias("ticker"))
    out = plans.insider_activity(index, f.select("accession_number", "xml", "rendered_html"), 25, _requests(f, absent))
    return out.select("ticker", "pipeline_success", "failure_reason")


