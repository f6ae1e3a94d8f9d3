"""Risk over the newest filings of every series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import RISK_LEXICON, Lexicon, materiality_rank
from ..functions.rows import struct_rows
from ..functions.text import fixed
from ..operators.recency import SERIES, newest, previous_row, with_bodies
from ..operators.sections import extract
from .score import filing_scores

CHRONO = ("filing_date", "rn")


def trend_points(
    index: DataFrame, bodies: DataFrame, n: int = 4, *,
    lexicon: Lexicon = RISK_LEXICON, require_success: bool = False,
) -> DataFrame:
    """One scored row per filing among the ``n`` newest of each series with a
    readable body. For whole histories see ``full_history_transitions``."""
    ranked = newest(index.where(F.col("form_type").isin(*fv.CORE_FORMS)), n)
    # empty bodies go after the reading: a filter on ``html`` would be pushed
    # below the join
    extracted = extract(with_bodies(ranked, bodies, keep_absent=False)).where("readable")
    if require_success:
        extracted = extracted.where("both_succeeded")
    return (
        filing_scores(extracted, lexicon)
        .withColumn("extraction_success", F.col("both_succeeded"))
        .withColumn("failure_note", F.nullif(F.array_join("known_gaps", ", "), F.lit("")))
        .drop("risk_factors", "mda", "known_gaps", "both_succeeded", "any_succeeded", "full_doc_char_count", "readable")
    )


def _moves(df: DataFrame, before: Column, keep: Sequence[str]) -> DataFrame:
    """Signals gained and lost against the set ``before``, one row each."""
    now = F.col("signal_set")
    tagged = lambda kind, a, b: F.transform(
        F.array_sort(F.array_except(a, b)), lambda s: F.struct(F.lit(kind).alias("change"), s.alias("signal"))
    )
    return struct_rows(df, keep, F.concat(tagged("appeared", now, before), tagged("removed", before, now)))


def signal_transitions(points: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Signals that appear or disappear from one filing to the next. ``points``
    hold the ``n`` newest filings of a series, so a window per series is bounded."""
    w = Window.partitionBy(*keys).orderBy(F.col("filing_date").asc(), F.col("rn").desc())
    keep = [*keys, "filing_date", "accession_number"]
    seen = points.withColumn("_before", F.lag("signal_set").over(w)).where(F.col("_before").isNotNull())
    return _moves(seen, F.col("_before"), keep)


def full_history_transitions(
    points: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, keep: Sequence[str],
) -> DataFrame:
    """The same over whole histories of any length: series are cut into buckets
    of ``order`` and only bucket ends are compared across (``previous_row``)."""
    seen = previous_row(points, keys, order, bucket, "signal_set", "before").where("has_before")
    return _moves(seen, F.col("before"), keep)


def trend_summary(points: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Trajectory, peak and narrative per series; the points of a series (the
    ``n`` newest) are gathered once and read in order."""
    gathered = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("filing_date").alias("d"), (-F.col("rn")).alias("o"), F.col("accession_number").alias("a"),
        F.col("risk_raw_score").alias("score"), F.col("risk_materiality").alias("m"), F.col("signal_set").alias("set"),
    ))).alias("p"))
    p = F.col("p")
    first, last = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
    step = F.zip_with(
        F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))),
        lambda a, b: F.when(b.isNotNull(), F.struct(
            F.array_sort(F.array_except(b["set"], a["set"])).alias("new"),
            F.array_sort(F.array_except(a["set"], b["set"])).alias("gone"),
        )),
    )
    out = gathered.withColumn("_step", F.filter(step, lambda s: s.isNotNull()))
    out = (
        out.withColumn("n_points", F.size(p))
        .withColumn("first_date", first["d"]).withColumn("last_date", last["d"])
        .withColumn("first_score", first["score"]).withColumn("last_score", last["score"])
        .withColumn("score_delta", last["score"] - first["score"])
        .withColumn("_new", F.flatten(F.transform("_step", lambda s: s["new"])))
        .withColumn("_gone", F.flatten(F.transform("_step", lambda s: s["gone"])))
        .withColumn("_peak", F.array_max(F.transform(p, lambda x, i: F.struct(
            materiality_rank(x["m"]).alias("rank"), (-i).alias("i"), x["d"].alias("d"), x["score"].alias("score"), x["m"].alias("m"),
        ))))
    )
    delta = F.round("score_delta", 6)
    out = out.withColumn(
        "trajectory",
        F.when(F.col("n_points") < 2, "single_point").when(delta > 5, "deteriorating")
        .when(delta < -5, "improving").otherwise("stable"),
    ).withColumn("total_new_signals", F.size("_new")).withColumn("total_removed_signals", F.size("_gone"))
    kind = F.when(F.col("form_type") == "10-Q", "quarterly").otherwise("annual")
    head = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    text = F.concat_ws(
        " ",
        F.format_string("Risk trend for %d %s filings (%s → %s).", F.col("n_points"), kind,
                        F.col("first_date").cast("string"), F.col("last_date").cast("string")),
        F.format_string("Trajectory: %s.", F.upper("trajectory")),
        F.format_string("Risk score moved %s → %s (%s%s).", fixed(F.col("first_score"), 1), fixed(F.col("last_score"), 1),
                        F.when(delta > 0, "↑").otherwise("↓"), fixed(F.abs("score_delta"), 1)),
        F.when(F.size("_new") > 0, F.concat(F.lit("New signals over period: "), head("_new", 5), F.lit("."))),
        F.when(F.size("_gone") > 0, F.concat(F.lit("Removed signals: "), head("_gone", 3), F.lit("."))),
        F.when(F.col("_peak.m").isin("high", "critical"), F.format_string(
            "Peak risk period: %s (materiality=%s).", F.col("_peak.d").cast("string"), F.upper("_peak.m"))),
    )
    return (
        out.withColumn("peak_risk_date", F.col("_peak.d")).withColumn("peak_risk_score", F.col("_peak.score"))
        .withColumn("overall_trend_note", F.format_string(
            "Risk score %s from %s to %s.", "trajectory", fixed(F.col("first_score"), 1), fixed(F.col("last_score"), 1)))
        .withColumn("analyst_summary", text)
        .drop("p", "_step", "_new", "_gone", "_peak")
    )
