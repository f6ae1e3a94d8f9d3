"""Stored analysis results: keys, expiry, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def result_key(tool: Column, ticker: Column, form: Column, extra: Column | None = None) -> Column:
    parts = [tool, F.upper(ticker), form]
    if extra is not None:
        parts.append(F.nullif(extra, F.lit("")))
    return F.concat_ws(":", *parts)


def ttl_days(days: Column) -> Column:
    low, high = fv.RESULT_TTL_DAYS
    return F.greatest(F.lit(low), F.least(days, F.lit(high)))


def storable(results: DataFrame) -> DataFrame:
    """Successful results with their expiry."""
    return results.where("success").withColumn(
        "expires_at", F.col("written_at") + F.make_dt_interval(days=ttl_days(F.col("ttl")))
    )


def unexpired(results: DataFrame, now: Column, keys: list[str] | None = None) -> DataFrame:
    """The newest result per key that is still valid at ``now``. Expired rows are
    dropped in the scan; the rest combine before the exchange."""
    keys = keys or ["result_key"]
    live = results.where((F.col("expires_at") > now) & (F.col("written_at") <= now))
    rest = [c for c in live.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("written_at", "result_id")).alias("_r")
    return live.groupBy(*keys).agg(best).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def without_stored(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Requests that still need work."""
    return requests.join(live.select("result_key"), "result_key", "left_anti")


def as_json(df: DataFrame, columns: list[str], alias: str = "payload") -> DataFrame:
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(alias))


def from_json(df: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.from_json(column, schema).alias("_v")).select(*keep, "_v.*")
