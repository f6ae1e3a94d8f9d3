"""Executive report per company: comparison, facts and categories in one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import narrative as say
from ..functions.scoring import RISK_LEXICON, Lexicon, materiality_rank, of_tier, top_signals, with_context
from ..functions.text import fixed
from ..operators.categories import highlight_sentences, quick_categories
from ..operators.facts import fact_highlights, financial_context
from ..operators.recency import SERIES
from ..operators.sections import pointer
from .compare import by_section, compare_texts, paired, usable_reason

REPORT_FORMS = ("10-Q", "10-K")
CLOSING = ("A summary worked out from the texts of both filings.", "It recommends nothing; what the filings say is what counts.")


def executive_reports(
    index: DataFrame, bodies: DataFrame, facts: DataFrame, report_date: Column, *,
    lexicon: Lexicon = RISK_LEXICON, title: str = "DISCLOSURE RISK — ANALYST REPORT",
) -> DataFrame:
    """One row per series: the report text, the rating and leading signals, or
    the reason why no report can be written. ``report_date`` is given, so equal
    inputs give equal reports."""
    pairs = paired(index.where(F.col("form_type").isin(*REPORT_FORMS)), bodies, drop_unread=False)
    ok = lambda side, s: F.coalesce(F.col(f"{side}.{s}.extraction_success"), F.lit(False))
    usable = ok("newer", "risk_factors") | ok("newer", "mda")
    pairs = pairs.withColumn("_reason", F.coalesce(
        usable_reason(F.col("newer"), F.col("older")),
        F.when(~usable, F.format_string(
            "Could not extract Risk Factors or MD&A from %s's %s filing (filed %s). The filing may use an "
            "unsupported format (image-based PDF, heavily customized XBRL, or exhibit-only filing).",
            "ticker", "form_type", F.col("newer.filing_date").cast("string"),
        )),
    ))

    def texts(s: str) -> dict[str, Column]:
        new = F.when(ok("newer", s) & F.col("_reason").isNull(), F.col(f"newer_{s}"))
        old = F.when(ok("older", s) & F.col("_reason").isNull(), F.col(f"older_{s}"))
        if s == "risk_factors":
            old = F.when(~pointer(F.col(f"newer_{s}"), fv.REPORT_POINTER), old)
        return {"newer_text": new, "older_text": old, "delta_newer": new, "delta_older": old}

    rows = by_section(pairs, [
        *SERIES, "cik", "_reason",
        F.col("newer.filing_date").alias("newer_date"), F.col("older.filing_date").alias("older_date"),
        F.col("newer.accession_number").alias("newer_accession"),
        F.col("newer.risk_factors.method").alias("risk_method"),
        F.col("newer.risk_factors.char_count").alias("risk_chars"), F.col("newer.mda.char_count").alias("mda_chars"),
    ], texts)
    scored = compare_texts(rows, keys=list(SERIES), lexicon=lexicon)
    t12 = F.concat(of_tier(F.col("hits"), 1), of_tier(F.col("hits"), 2))
    risk_row = F.col("section_name") == "risk_factors"
    section = F.struct(
        F.col("section_name"), F.col("delta_success").alias("compared"), F.col("pct_changed"), F.col("magnitude"),
        F.col("new_hits"), F.col("removed_hits"), F.col("materiality"), F.col("raw_score"),
        of_tier(F.col("hits"), 2).alias("t2"),
        with_context(of_tier(F.col("hits"), 1), F.col("newer_text")).alias("t1"),
        F.when(risk_row, quick_categories(F.col("newer_text"))).alias("categories"),
        F.when(~risk_row, highlight_sentences(F.col("newer_text"), t12)).alias("highlights"),
    )
    # two narrow rows per series come together
    carried = ("cik", "_reason", "newer_date", "older_date", "newer_accession", "risk_method", "risk_chars", "mda_chars")
    together = scored.groupBy(*SERIES).agg(
        *[F.first(c).alias(c) for c in carried], F.collect_list(section).alias("_s"),
    )
    pick = lambda s: F.get(F.filter("_s", lambda x: x["section_name"] == s), F.lit(0))
    together = together.withColumn("risk", pick("risk_factors")).withColumn("mda", pick("mda")).drop("_s")
    context = financial_context(facts)
    together = together.join(context, "cik", "left").withColumn("_facts", fact_highlights())
    rating = F.when(
        materiality_rank(F.col("risk.materiality")) >= materiality_rank(F.col("mda.materiality")), F.col("risk.materiality")
    ).otherwise(F.col("mda.materiality"))
    together = together.withColumn("overall_materiality", rating)
    good = F.col("_reason").isNull()
    leading = F.slice(top_signals([
        (s, _slim(F.col(f"{c}.new_hits")), _slim(F.col(f"{c}.t1"))) for s, c in (("risk_factors", "risk"), ("mda", "mda"))
    ]), 1, 8)
    return together.select(
        *SERIES,
        good.alias("pipeline_success"),
        F.col("_reason").alias("failure_reason"),
        F.col("newer_date").alias("filing_date"),
        F.when(good, F.col("overall_materiality")).alias("overall_materiality"),
        F.when(good, leading).otherwise(F.array().cast("array<string>")).alias("top_signals"),
        F.when(good, _report(report_date, title)).alias("report"),
    )


def _slim(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["signal"].alias("signal"), h["tier"].alias("tier"), h["weight"].alias("weight"),
    ))


def _change_line(label: str, s: Column, missing: str) -> Column:
    return F.when(s["compared"], F.format_string(
        label + "%s (%s%% of sentences affected)", say.choose(s["magnitude"], say.MAGNITUDE_WORDS), fixed(s["pct_changed"] * 100, 0),
    )).otherwise(F.lit(label + missing))


def _report(report_date: Column, title: str) -> Column:
    risk, mda = F.col("risk"), F.col("mda")
    rating = F.col("overall_materiality")
    newer, older = F.col("newer_date").cast("string"), F.col("older_date").cast("string")
    marks = lambda level: say.choose(level, say.RATING_MARKS)
    names = lambda hits, n: F.array_join(F.transform(F.slice(hits, 1, n), lambda h: h["signal"]), ", ")
    none = F.array().cast("array<string>")
    header = say.lines(
        say.rule(64, "="), F.lit(f"  {title}"),
        F.format_string("  %s  |  %s  |  Filed %s", "ticker", "form_type", newer),
        F.concat(F.lit("  Generated "), F.date_format(report_date, "MMMM dd, yyyy")),
        say.rule(64, "="), F.lit(""),
        F.concat(F.lit("OVERALL RISK RATING:  "), marks(rating), F.lit(" "), F.upper(rating)), F.lit(""),
        say.heading("EXECUTIVE SUMMARY"),
        say.verdict(F.col("ticker"), F.col("form_type"), rating, risk, mda, newer, older), F.lit(""),
    )
    moved = F.filter(F.array(
        _change_line("Risk Factors:  ", risk, "comparison not available (10-Q incorporates 10-K by reference)"),
        F.when(risk["compared"] & (F.size(risk["new_hits"]) > 0), F.concat(
            F.lit("  ⚠  New risk signals appeared: "), names(risk["new_hits"], 5))),
        F.when(risk["compared"] & (F.size(risk["removed_hits"]) > 0), F.concat(
            F.lit("  ✓  Risk signals removed: "), names(risk["removed_hits"], 3))),
        _change_line("MD&A:          ", mda, "comparison not available"),
    ), lambda x: x.isNotNull())
    signal_lists = [
        F.when(F.size(risk[tier]) > 0, F.concat(
            F.array(F.lit(label)), say.bullet_signals(risk[tier], risk["new_hits"], n, quote), F.array(F.lit("")),
        )).otherwise(none)
        for tier, label, n, quote in (("t1", "Critical (Tier 1):", 6, True), ("t2", "Elevated (Tier 2):", 5, False))
    ]
    highlights = F.when(F.size("_facts") > 0, F.col("_facts")).otherwise(F.coalesce(mda["highlights"], none))
    categories = F.coalesce(risk["categories"], F.array().cast("array<struct<category:string,signals:int>>"))
    section_of = lambda title, rows: F.when(F.size(rows) > 0, F.concat(
        say.lines(say.heading(title)), rows, F.array(F.lit(""))
    )).otherwise(none)
    score = lambda label, s: F.format_string(
        label + "%s %s  (score %s)", marks(s["materiality"]), F.upper(s["materiality"]), fixed(s["raw_score"], 1)
    )
    footer = say.lines(
        say.heading("SECTION SCORES"), score("  Risk Factors:  ", risk), score("  MD&A:          ", mda), F.lit(""),
        say.heading("FILING DETAILS"),
        F.concat(F.lit("  Ticker:          "), F.col("ticker")), F.concat(F.lit("  Form type:       "), F.col("form_type")),
        F.concat(F.lit("  Filing date:     "), newer), F.concat(F.lit("  Prior filing:    "), older),
        F.concat(F.lit("  Accession:       "), F.col("newer_accession")),
        F.format_string("  Risk chars:      %,d", "risk_chars"), F.format_string("  MD&A chars:      %,d", "mda_chars"),
        F.concat(F.lit("  Extraction:      "), F.col("risk_method")), F.lit(""),
        say.rule(64),
        *map(F.lit, CLOSING), say.rule(64, "="),
    )
    return F.array_join(F.concat(
        header,
        say.lines(say.heading("WHAT CHANGED VS PRIOR FILING")), moved, F.array(F.lit("")),
        say.lines(say.heading("TOP RISK SIGNALS")), *signal_lists,
        section_of("MD&A FINANCIAL HIGHLIGHTS", F.transform(highlights, lambda h: F.concat(F.lit("  • "), h))),
        section_of("RISK CATEGORIES PRESENT", F.transform(categories, lambda c: F.concat(
            F.lit("  "), F.rpad(c["category"], 30, " "), F.lit("  "), c["signals"].cast("string"), F.lit(" signals")))),
        footer,
    ), "\n")
