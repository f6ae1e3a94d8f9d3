"""Newest-N, newest/older pairs, latest version, previous row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("ticker", "form_type")


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def newest_first() -> list[Column]:
    return [F.col("filing_date").desc_nulls_last(), F.col("index_pos").asc()]


def newest(
    index: DataFrame,
    n: int,
    *,
    keys: Sequence[str] = SERIES,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The ``n`` newest rows of each series, numbered by ``rn`` from the newest.

    Rank the narrow index, not the bodies: the filter on ``rn`` becomes a
    group limit that cuts every partition to ``n`` rows per series before the
    exchange, so a series holding a third of all rows still sends few.
    """
    w = Window.partitionBy(*keys).orderBy(*(order or newest_first()))
    return index.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def with_bodies(
    ranked: DataFrame, bodies: DataFrame, key: str = "accession_number", keep_absent: bool = True,
) -> DataFrame:
    """Bring the bodies to the ranked keys; keys without a body are kept with
    NULLs unless ``keep_absent`` is off.

    The wide side is always the streamed one: a semi join drops the bodies that
    were not ranked, then their index columns are added. Either way only the
    narrow ranked side can be broadcast, by its size; beyond that both joins
    share one exchange of the bodies. Absent keys need the key column alone.
    """
    found = bodies.join(ranked.select(key), key, "left_semi").join(ranked, key, "left")
    if not keep_absent:
        return found
    absent = ranked.join(bodies.select(key), key, "left_anti")
    return found.unionByName(absent, allowMissingColumns=True)


def filing_pairs(index: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Newer and older filing of each series; a lone filing keeps a gap note."""
    side = lambda rn, c: F.max(F.when(F.col("rn") == rn, F.col(c)))
    return (
        newest(index, 2, keys=keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_filings"),
            F.max("cik").alias("cik"),
            side(1, "accession_number").alias("newer_accession"),
            side(1, "filing_date").alias("newer_date"),
            side(2, "accession_number").alias("older_accession"),
            side(2, "filing_date").alias("older_date"),
        )
        .withColumn(
            "coverage_gap_note",
            F.when(
                F.col("n_filings") < 2,
                F.format_string(
                    "Only %d %s filing(s) found for %s (CIK %s). Comparison requires at least two.",
                    "n_filings", "form_type", "ticker", "cik",
                ),
            ),
        )
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    alias: str,
) -> DataFrame:
    """``lag(value)`` over whole, unbounded series without one task per series.

    ``bucket`` must not decrease along ``order``. Rows look back inside their
    bucket; the first row of a bucket takes the last value of the series'
    preceding bucket, found on one row per bucket.
    """
    df = df.withColumn("_bucket", bucket)
    parts = [*keys, "_bucket"]
    inside = Window.partitionBy(*parts).orderBy(*order)
    last = (
        df.groupBy(*parts)
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")))
        .drop("_last")
    )
    return (
        df.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_before", F.lag(F.struct(value)).over(inside))
        .join(last, parts)
        .withColumn("_from", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
        .withColumn(alias, F.col("_from")[value])
        .withColumn(f"has_{alias}", F.col("_from").isNotNull())
        .drop("_bucket", "_first", "_before", "_carried", "_from")
    )
