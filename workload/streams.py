"""Streaming jobs run over the supplied tables to completion, from where they lie, whatever
the order of their files. Each drains into files in the session's checkpoint folder and reads
them back; the SQL is the batch twin over all rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from filegrain.functions.scoring import find_hits, of_tier, signals
from filegrain.session import shared_folder
from filegrain.streaming import jobs

from . import query
from .corpus import SQL_DISCLOSURES, disclosures, sql_lexicon
from .filings import EVENT_SQL, _event_filings


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_folder(spark)}/filegrain-{name}-{uuid.uuid4().hex}"


def _stream(spark, d: str, name: str, files: int = 1):
    """A supplied table as a stream, some files at a time, without a copy. The path is
    written as a pattern: a plain one has to be a folder, a table may be a file."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{d}/{name}.parque[t]")


def _ts(c="ts"):
    return F.to_timestamp(F.col(c).cast("string"))


@query("stream_event_items", f"""{EVENT_SQL}
SELECT accession_number, ticker, CAST(item_pos AS INT) AS item_pos, item_number, label, tier, materiality, excerpt FROM events""")
def q_stream_items(spark, d):
    folder = scratch(spark, "items")
    filings = _event_filings(spark, d, _stream(spark, d, "documents"))
    jobs.drain(jobs.classify_events(filings), f"{folder}/out", f"{folder}/cp")
    return spark.read.parquet(f"{folder}/out").drop("filing_date")


@query("stream_ttl_keys", """WITH RECURSIVE e AS (
  SELECT event_type || ':' || user_id AS result_key, ts, 3 + user_id % 5 AS days FROM events
),
passed AS (
  SELECT result_key, min(ts) AS ts, min(days) AS days FROM e GROUP BY 1
  UNION ALL
  SELECT p.result_key, min(e.ts), min(e.days) FROM passed p JOIN e ON e.result_key = p.result_key AND e.ts >= p.ts + to_days(CAST(p.days AS INTEGER)) GROUP BY p.result_key, p.ts
)
SELECT result_key, CAST(epoch_us(ts) AS BIGINT) AS at FROM passed""")
def q_stream_ttl(spark, d):
    return _ttl_judged(spark, d, "60 days").where(~F.col("late")).select("result_key", F.unix_micros("ts").alias("at"))


def _ttl_judged(spark, d, lateness: str, files: int = 4):
    """All that the stream puts out. The table's times span 30 days and its files may hold any of them, so requests
    may be 60 days late; a beat far ahead ends the wait for more."""
    folder = scratch(spark, "ttl")
    jobs.use_rocksdb(spark)
    land = lambda rows: spark.createDataFrame(rows, jobs.BEATS).coalesce(1).write.mode("append").parquet(f"{folder}/beats")
    land([])
    for beat in ([], [(None, dt.datetime(2200, 1, 1), None, True)]):
        if beat:
            land(beat)
        e = _stream(spark, d, "events", files).select(
            F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("result_key"), _ts().alias("ts"),
            ((3 + F.col("user_id") % 5) * 86_400).alias("ttl_seconds"),
        )
        beats = spark.readStream.schema(jobs.BEATS).parquet(f"{folder}/beats")
        jobs.drain(jobs.first_within_ttl(e, lateness, beats), f"{folder}/out", f"{folder}/cp")
    return spark.read.parquet(f"{folder}/out")


@query("stream_daily_counts", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def q_stream_daily(spark, d):
    folder = scratch(spark, "daily")
    e = _stream(spark, d, "events", 4).select("user_id", _ts().alias("ts"))
    jobs.drain_parts(e, jobs.count_parts, f"{folder}/out", f"{folder}/cp")
    return jobs.summed_parts(spark, f"{folder}/out", ["user_id", "day"]).select("user_id", F.to_date("day").alias("day"), "n")


@query("stream_conversation_counters", "SELECT conv_id AS conversation_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY 1")
def q_stream_counters(spark, d):
    folder = scratch(spark, "counters")
    m = _stream(spark, d, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.timestamp_seconds(F.col("turn") * 60 + 1704067200).alias("created_at"))
    jobs.drain(jobs.conversation_counters(m), f"{folder}/out", f"{folder}/cp", "update")
    last = jobs.newest_rows(spark, f"{folder}/out", ["conversation_id"])
    return last.select("conversation_id", "message_count", F.floor((F.unix_seconds("last_message_at") - 1704067200) / 60).alias("last_turn"))


@query("stream_signal_transitions", f"""WITH {SQL_DISCLOSURES}, {sql_lexicon()},
p AS (SELECT doc_id, coalesce(list(signal) FILTER (signal IS NOT NULL), []) AS set
  FROM disc LEFT JOIN lex ON tier <= 2 AND contains(lower(text), lower(signal)) GROUP BY ALL),
s AS (SELECT *, lag(set) OVER (PARTITION BY doc_id // 6 ORDER BY doc_id) AS before FROM p)
SELECT doc_id AS seq, 'appeared' AS change, unnest(list_filter(set, lambda x: NOT list_contains(before, x))) AS signal FROM s WHERE before IS NOT NULL
UNION ALL
SELECT doc_id, 'removed', unnest(list_filter(before, lambda x: NOT list_contains(set, x))) FROM s WHERE before IS NOT NULL""")
def q_stream_transitions(spark, d):
    folder = scratch(spark, "transitions")
    jobs.use_rocksdb(spark)
    doc = F.col("doc_id")
    points = disclosures(spark, d, _stream(spark, d, "documents", 4)).select(
        F.floor(doc / 6).cast("string").alias("ticker"), F.lit("10-K").alias("form_type"), doc.cast("string").alias("accession_number"),
        doc.alias("seq"), signals(of_tier(find_hits(F.col("text")), 1, 2)).alias("signals"),
    )
    jobs.drain(jobs.signal_transitions(points), f"{folder}/out", f"{folder}/cp")
    return jobs.standing(spark.read.parquet(f"{folder}/out")).select("seq", "change", "signal")


EFFECT_SQL = """b AS (
  SELECT user_id, event_id, ts, (['pro', 'business'])[event_id % 2 + 1] AS plan,
    CASE event_type WHEN 'purchase' THEN 'charge.success' WHEN 'signup' THEN 'subscription.create' WHEN 'error' THEN 'invoice.payment_failed' WHEN 'click' THEN 'subscription.disable' ELSE 'other' END AS event FROM events
),
k AS (SELECT *, CASE event WHEN 'subscription.disable' THEN 'cancelled' WHEN 'invoice.payment_failed' THEN 'past_due' ELSE 'active' END AS status,
  CASE WHEN event IN ('charge.success', 'subscription.create') THEN plan ELSE 'free_trial' END AS usage FROM b WHERE event <> 'other')"""


@query("stream_billing", f"""WITH {EFFECT_SQL}
SELECT user_id, arg_max(status, ts) AS status, arg_max(plan, ts) FILTER (event IN ('charge.success', 'subscription.create')) AS plan, arg_max(usage, ts) AS usage_plan FROM k GROUP BY 1""")
def q_stream_billing(spark, d):
    folder = scratch(spark, "billing")
    kind = F.col("event_type")
    e = _stream(spark, d, "events").select(
        "user_id", "event_id", "ts", F.when(F.col("event_id") % 2 == 0, "pro").otherwise("business").alias("plan"),
        F.when(kind == "purchase", "charge.success").when(kind == "signup", "subscription.create").when(kind == "error", "invoice.payment_failed")
        .when(kind == "click", "subscription.disable").otherwise("other").alias("event"),
    )
    jobs.drain(jobs.billing_status(e), f"{folder}/out", f"{folder}/cp", "update")
    return jobs.newest_rows(spark, f"{folder}/out", ["user_id"])
