"""Latest reported financial facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import fixed, whole

Metrics = Sequence[tuple[str, Sequence[str]]]


def latest_per_tag(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Value with the latest ``end`` per tag, the first listed on ties. Combined
    before the exchange, so a company with very many facts stays cheap."""
    best = F.max_by(F.struct("val", "end"), F.struct("end", (-F.col("pos")).alias("p")))
    return (
        facts.groupBy(*keys, "tag").agg(best.alias("b"))
        .select(*keys, "tag", F.col("b.val").alias("val"), F.col("b.end").alias("end"))
    )


def financial_context(facts: DataFrame, keys: Sequence[str] = ("cik",), metrics: Metrics = fv.FACT_TAGS) -> DataFrame:
    """One wide row per company: each metric from its first tag with a value,
    the current ratio, the period end and the metrics that are missing."""
    wanted = [tag for _, tags in metrics for tag in tags]
    latest = latest_per_tag(facts.where(F.col("tag").isin(*wanted)), keys)
    of = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    wide = latest.groupBy(*keys).agg(
        *[of(t, "val").alias(f"v_{t}") for t in wanted],
        *[of(t, "end").alias(f"e_{t}") for t in wanted],
    )
    first = lambda tags, p: F.coalesce(*[F.col(f"{p}_{t}") for t in tags])

    def end_of(tags: Sequence[str]) -> Column:
        out = None
        for t in tags:
            hit = F.col(f"v_{t}").isNotNull()
            out = F.when(hit, F.col(f"e_{t}")) if out is None else out.when(hit, F.col(f"e_{t}"))
        return out

    return wide.select(
        *keys,
        *[first(tags, "v").cast("double").alias(m) for m, tags in metrics],
        F.coalesce(*[end_of(tags) for _, tags in metrics]).alias("period_end"),
    ).withColumn(
        "current_ratio",
        F.when(F.col("current_liabilities") != 0, F.round(F.col("current_assets") / F.col("current_liabilities"), 3)),
    ).withColumn(
        "missing_metrics",
        F.filter(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m, _ in metrics]), lambda m: m.isNotNull()),
    )


def liquidity_note(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), F.lit("Current ratio unavailable — liquidity risk cannot be quantitatively validated."))
        .when(ratio < fv.LOW_CURRENT_RATIO, F.format_string(
            "Current ratio %s is below 1.0 — liabilities exceed liquid assets, elevating liquidity/going-concern risk.", fixed(ratio, 2)))
        .when(ratio < fv.TIGHT_CURRENT_RATIO, F.format_string("Current ratio %s is tight — limited liquidity buffer.", fixed(ratio, 2)))
        .otherwise(F.format_string("Current ratio %s indicates adequate short-term liquidity.", fixed(ratio, 2)))
    )


def capex_note(capex: Column, revenue: Column) -> Column:
    percent = F.try_divide(capex, revenue) * 100
    return (
        F.when(percent.isNull(), F.lit("CapEx-to-revenue ratio unavailable."))
        .when(percent > fv.HEAVY_CAPEX_PERCENT, F.format_string(
            "CapEx is %s%% of revenue — heavy infrastructure/strategic investment, "
            "consistent with AI/capacity buildout risk language.", fixed(percent, 1)))
        .otherwise(F.format_string("CapEx is %s%% of revenue — within typical range.", fixed(percent, 1)))
    )


def fact_highlights() -> Column:
    """Lines for the report, from the wide row; ratios keep two decimals."""
    shown = (
        ("Revenue", "revenue"), ("Net Income", "net_income"), ("Cash and Equivalents", "cash_and_equivalents"),
        ("Total Debt", "total_debt"), ("Current Ratio", "current_ratio"), ("Capex", "capex"),
    )
    lines = F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(
            F.lit(f"{name}: "), fixed(F.col(c), 2) if c == "current_ratio" else whole(F.col(c))
        ))
        for name, c in shown
    ])
    return F.filter(lines, lambda x: x.isNotNull())
