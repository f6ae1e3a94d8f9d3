"""Users, plans, usage and data quality of the application tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rows import left_join_present


def with_subscription(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every user with plan and status; a free active one where none is stored."""
    return (
        users.join(subscriptions, "user_id", "left")
        .withColumn("plan", F.coalesce("plan", F.lit("free")))
        .withColumn("status", F.coalesce("status", F.lit("active")))
    )


def effective_plan(plan: Column, status: Column) -> Column:
    return F.when(status == "active", plan).otherwise(F.lit("free"))


def plan_from_code(code: Column, codes: Mapping[str, str]) -> Column:
    """Plan of a billing code; unknown codes count as ``pro``."""
    out = F.lit("pro")
    for plan_code, plan in codes.items():
        out = F.when(code == plan_code, F.lit(plan)).otherwise(out)
    return out


def plan_limit(plan: Column) -> Column:
    out = F.lit(0)
    for name, limit, _ in fv.PLAN_LIMITS:
        out = F.when(plan == name, F.lit(limit)).otherwise(out)
    return out


def plan_days(plan: Column) -> Column:
    out = F.lit(30)
    for name, _, days in fv.PLAN_LIMITS:
        out = F.when(plan == name, F.lit(days)).otherwise(out)
    return out


def next_midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")


def period_end(plan: Column, start: Column) -> Column:
    """Trials end at the next midnight, paid periods after their days."""
    days = F.make_dt_interval(days=plan_days(plan))
    return F.when(plan == "free_trial", next_midnight(start)).otherwise(start + days)


def local_date(ts: Column, zone: Column) -> Column:
    """Calendar day of a UTC timestamp in the user's zone (UTC when unset)."""
    return F.to_date(F.from_utc_timestamp(ts, F.coalesce(zone, F.lit("UTC"))))


def daily_usage(usage: DataFrame, users: DataFrame, free_limit: int = fv.FREE_DAILY_LIMIT) -> DataFrame:
    """Runs per user and local day against the free limit. ``usage(user_id,
    ts)`` is counted per quarter hour first, so only small rows meet the users."""
    # quarter hours: every zone in use is offset by a multiple of them
    slot = F.date_trunc("hour", "ts") + F.make_dt_interval(mins=(F.floor(F.minute("ts") / 15) * 15).cast("int"))
    slots = usage.groupBy("user_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    unlimited = F.col("effective_plan").isin(*fv.UNLIMITED_PLANS)
    counted = (
        slots.join(users, "user_id")
        .withColumn("effective_plan", effective_plan(F.col("plan"), F.col("status")))
        .groupBy("user_id", "effective_plan", local_date(F.col("slot"), F.col("timezone")).alias("usage_date"))
        .agg(F.sum("n").alias("today_count"))
    )
    return (
        counted.withColumn("daily_limit", F.when(~unlimited, F.lit(free_limit)))
        .withColumn("remaining", F.when(~unlimited, F.greatest(F.lit(0), free_limit - F.col("today_count"))))
        .withColumn("allowed", unlimited | (F.col("today_count") < free_limit))
    )


def plan_usage(charges: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """Analyses used in each user's current period, limit, days left. A period
    that ended before ``now`` starts again at ``now`` with nothing used. Charges
    from before the earliest period are left unread."""
    current = (
        plans.withColumn("_ended", now > F.col("period_end"))
        .withColumn("period_start", F.when(F.col("_ended"), now).otherwise(F.col("period_start")))
        .withColumn("period_end", F.when(F.col("_ended"), period_end(F.col("plan"), now)).otherwise(F.col("period_end")))
    )
    inside = (F.col("ts") >= F.col("period_start")) & (F.col("ts") <= now)
    earliest = current.agg(F.min("period_start")).scalar()
    used = (
        charges.where((F.col("ts") >= earliest) & (F.col("ts") <= now)).join(current.select("user_id", "period_start"), "user_id")
        .where(inside).groupBy("user_id").agg(F.count(F.lit(1)).alias("charged"))
    )
    limit = plan_limit(F.col("plan"))
    left = F.floor((F.unix_micros(F.col("period_end").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(86_400_000_000))
    return (
        current.join(used, "user_id", "left")
        .withColumn("plan_limit", limit)
        .withColumn("_charged", F.coalesce("charged", F.lit(0)))
        .withColumn("analyses_used", F.when(limit == -1, F.lit(0)).otherwise(F.least(F.col("_charged"), limit)).cast("long"))
        .withColumn("remaining", F.when(limit != -1, F.greatest(F.lit(0), limit - F.col("analyses_used"))))
        .withColumn("days_remaining", F.greatest(F.lit(0), left).cast("int"))
        .withColumn("allowed", (limit == -1) | (F.col("analyses_used") < limit))
        .drop("charged", "_charged", "_ended")
    )


def plan_changes(plans: DataFrame, changes: DataFrame) -> DataFrame:
    """Plans after their latest change: usage back to zero, a new period. Unknown
    plans change nothing."""
    known = changes.where(F.col("new_plan").isin(*[p for p, _, _ in fv.PLAN_LIMITS]))
    latest = known.groupBy("user_id").agg(
        F.max_by("new_plan", F.struct("ts", "change_id")).alias("new_plan"), F.max("ts").alias("changed_at")
    )
    changed = F.col("new_plan").isNotNull()
    return (
        plans.join(latest, "user_id", "full_outer")
        .select(
            "user_id",
            F.coalesce("new_plan", "plan").alias("plan"),
            F.when(changed, F.lit(0)).otherwise(F.col("analyses_used")).alias("analyses_used"),
            F.when(changed, F.col("changed_at")).otherwise(F.col("period_start")).alias("period_start"),
            F.when(changed, period_end(F.col("new_plan"), F.col("changed_at"))).otherwise(F.col("period_end")).alias("period_end"),
        )
    )


def default_rows(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions completed with a free one for every user without any.
    Running it again adds nothing."""
    missing = users.select("user_id").distinct().join(subscriptions.select("user_id"), "user_id", "left_anti")
    return subscriptions.select("user_id", "plan", "status").unionByName(
        missing.select("user_id", F.lit("free").alias("plan"), F.lit("active").alias("status"))
    )


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    return children.where(F.col(child_key).isNotNull()).join(
        parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti"
    )


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children that survive a cascading delete of missing parents."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children with keys of missing parents emptied."""
    seen = parents.select(F.col(parent_key).alias(child_key), F.lit(True).alias("_seen")).distinct()
    return left_join_present(children, seen, child_key).withColumn(child_key, F.when(F.col("_seen"), F.col(child_key))).drop("_seen")


def domain_violations(
    df: DataFrame, keys: Sequence[str],
    allowed: Mapping[str, Sequence[str]] | None = None, required: Sequence[str] = (),
) -> DataFrame:
    """Rows with the names of the rules they break."""
    rules = [
        *[F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(f"{c} not allowed")) for c, values in (allowed or {}).items()],
        *[F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required],
    ]
    broken = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return df.select(*keys, F.array_join(broken, "; ").alias("violations")).where(F.col("violations") != "")


def owned_by(df: DataFrame, user: Column) -> DataFrame:
    """Rows of one owner only."""
    return df.where(F.col("user_id") == user)


def visible_rows(df: DataFrame, viewers: DataFrame) -> DataFrame:
    """For every viewer the rows they own; ``viewers(user_id, …)``."""
    return df.join(viewers, "user_id")


def history_pages(analyses: DataFrame, columns: Sequence[str], *, limit: int = 20, offset: int = 0) -> DataFrame:
    """The same page of every user's history at once, newest first by ``place``.
    Users with very long histories are cut before the exchange."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id"))
    ranked = analyses.select(*columns).withColumn("place", F.row_number().over(w))
    return ranked.where((F.col("place") <= offset + limit) & (F.col("place") > offset))


def history_page(
    analyses: DataFrame, columns: Sequence[str], *, limit: int = 20, offset: int = 0,
    ticker: str | None = None, tool: str | None = None,
) -> DataFrame:
    """A page of analyses, newest first, big columns left unread."""
    if ticker:
        analyses = analyses.where(F.col("ticker") == ticker.upper())
    if tool:
        analyses = analyses.where(F.col("tool_name") == tool)
    return analyses.select(*columns).orderBy(F.col("created_at").desc(), F.col("id")).offset(offset).limit(limit)


def user_of_code(subscriptions: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """User behind a billing code, one row per code (the least id on ties)."""
    owners = subscriptions.groupBy(column).agg(F.min("user_id").alias("user_id"))
    return codes.join(owners, column, "left")


def conversation_counters(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("last_message_at")
    )


def context_messages(
    messages: DataFrame, n: int = fv.CONTEXT_MESSAGES, newest: bool = True, roles: Sequence[str] | None = None,
) -> DataFrame:
    """The last (or first) ``n`` messages of each conversation, oldest first by
    ``position``; of them those of the named roles."""
    order = [F.col("created_at").desc(), F.col("id").desc()] if newest else [F.col("created_at").asc(), F.col("id").asc()]
    ranked = messages.withColumn("_rn", F.row_number().over(Window.partitionBy("conversation_id").orderBy(*order)))
    kept = ranked.where(F.col("_rn") <= n)
    if newest:
        size = F.count(F.lit(1)).over(Window.partitionBy("conversation_id"))
        kept = kept.withColumn("position", (size - F.col("_rn") + 1).cast("int"))
    else:
        kept = kept.withColumn("position", F.col("_rn"))
    return (kept.where(F.col("role").isin(*roles)) if roles else kept).drop("_rn")
