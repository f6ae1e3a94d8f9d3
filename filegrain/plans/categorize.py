"""Sort the risks of every company's newest filing into domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.categories import Taxonomy, categorise, category_summary
from ..operators.recency import newest, with_bodies
from ..operators.sections import extract


def categorize_risks(index: DataFrame, bodies: DataFrame, taxonomy: Taxonomy = fv.RISK_TAXONOMY) -> DataFrame:
    """One row per series: category array, totals and narrative, or the reason
    why its risk section could not be read."""
    ranked = newest(index.where(F.col("form_type").isin(*fv.CORE_FORMS)), 1)
    rows = extract(with_bodies(ranked, bodies))
    risk = F.col("risk_factors")
    readable = risk["extraction_success"] & (F.length(risk["text"]) > 0)
    rows = (
        rows.withColumn("failure_reason", F.when(~readable, F.when(
            F.col("full_doc_char_count") == 0,
            F.format_string("Could not fetch %s filing for %s.", "form_type", "ticker"),
        ).otherwise(F.concat(
            F.lit("Risk Factors section could not be extracted: "), F.coalesce(risk["failure_reason"], F.lit("empty"))
        ))))
        .withColumn("risk_section_char_count", risk["char_count"])
        .withColumn("categories", F.when(readable, categorise(risk["text"], taxonomy)))
        .withColumn("pipeline_success", readable)
    )
    rows = category_summary(rows, "categories", F.col("ticker"), F.col("form_type"), F.col("filing_date").cast("string"))
    return rows.withColumn("executive_summary", F.when(F.col("pipeline_success"), F.col("executive_summary"))).select(
        "ticker", "form_type", "accession_number", "filing_date", "pipeline_success", "failure_reason",
        "risk_section_char_count", "categories", "total_domains_identified", "total_signals",
        "tier1_domain_count", "top_domains", "executive_summary",
    )
