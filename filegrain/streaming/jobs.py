"""Structured Streaming versions of the time-driven jobs."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rows import element_rows
from ..functions.text import strip_markup
from ..operators.items import event_items


def classify_events(filings: DataFrame) -> DataFrame:
    """Event items as filings land; stateless, append."""
    items = event_items(strip_markup(F.col("html"), "\n"))
    keep = ["accession_number", "ticker", "filing_date"]
    return element_rows(filings, keep, items, pos="item_pos", item="item").select(*keep, "item_pos", "item.*")


TTL_SCHEMA = "result_key string, ts timestamp, late boolean"


class WithinTtl(StatefulProcessor):
    """Judges each key's requests in the order of their times, in whatever order they arrive.

    A request waits in the key's state until the watermark is past its time: then none that
    precedes it can come any more, and an event-time timer, one for each key, judges all that
    are due. A request goes through when nothing holds its key at its own time; its TTL then
    holds the key. A request that comes behind the watermark is put out as late. What held a
    key goes when the watermark is past the expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "expiry bigint")
        self._waiting = handle.getListState("waiting", "at bigint, ttl bigint")
        self._timer = handle.getValueState("timer", "at bigint")

    def _wake(self, known: int | None, at: int | None) -> None:
        """One timer for the key, ``known`` before: at this microsecond the watermark is past it."""
        wanted = None if at is None else at // 1000 + 1
        if known == wanted:
            return
        if known is not None:
            self._handle.deleteTimer(known)
        if wanted is None:
            self._timer.clear()
        else:
            self._handle.registerTimer(wanted)
            self._timer.update((wanted,))

    # each call to the state is a message to the JVM, each frame costs more than a judgement: none that can be spared

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        arrived = [(int(at), int(ttl)) for frame in rows for at, ttl in zip(frame["at"], frame["ttl"])]
        kept = [x for x in arrived if x[0] >= past]
        if kept:
            self._waiting.appendList(kept)
            first, timer = min(kept)[0], self._timer.get()
            if timer is None or first // 1000 + 1 < timer[0]:
                self._wake(timer and timer[0], first)
        if len(kept) < len(arrived):
            yield _judged(key, [], [at for at, _ in arrived if at < past])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self._waiting.get())
        held = self._held.get()
        expiry = held and held[0]
        passed = []
        for at, ttl in (x for x in waiting if x[0] < past):
            if expiry is None or at >= expiry:
                expiry = at + ttl
                passed.append(at)
        left = [x for x in waiting if x[0] >= past]
        if left:
            if len(left) < len(waiting):
                self._waiting.put(left)
        elif waiting:
            self._waiting.clear()
        if expiry is not None and expiry >= past:
            if held is None or held[0] != expiry:
                self._held.update((expiry,))
        else:
            expiry = None
            if held is not None:
                self._held.clear()
        if left or expiry is not None:
            self._wake(None, left[0][0] if left else expiry)
        else:
            self._timer.clear()
        if passed:
            yield _judged(key, passed, [])

    def close(self) -> None:
        pass


def _judged(key, passed: list[int], late: list[int]) -> pd.DataFrame:
    return pd.DataFrame({
        "result_key": pd.Series([key[0]] * (len(passed) + len(late)), dtype="object"),
        "ts": pd.to_datetime(passed + late, unit="us"), "late": pd.Series([False] * len(passed) + [True] * len(late), dtype="bool"),
    })


BEATS = "result_key string, ts timestamp, ttl_seconds bigint, beat boolean"


def first_within_ttl(requests: DataFrame, lateness: str = "1 day", beats: DataFrame | None = None) -> DataFrame:
    """``requests(result_key, ts, ttl_seconds)`` → (result_key, ts, late): those whose key no earlier one
    that went through still holds, and those that came too late to be judged.

    Each request brings its own TTL. ``lateness`` is how far behind the newest one may come; as long
    is a request held back. ``beats`` (BEATS, a stream) carries times without requests: where no more
    requests come, a beat moves the watermark on. Needs the RocksDB state store provider
    (see ``use_rocksdb``)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = requests.select("result_key", "ts", F.col("ttl_seconds").cast("bigint").alias("ttl_seconds"), F.lit(False).alias("beat"))
    if beats is not None:
        rows = rows.unionByName(beats)
    # the filter names the event time, or it would be moved below the watermark, which would not see the beats;
    # the event time itself is left behind, or late rows would be dropped before they are told
    timed = rows.withWatermark("ts", lateness).where(~(F.col("beat") & F.col("ts").isNotNull())).select(
        "result_key", F.unix_micros("ts").alias("at"), (F.col("ttl_seconds") * 1_000_000).cast("long").alias("ttl")
    )
    return timed.groupBy("result_key").transformWithStateInPandas(WithinTtl(), TTL_SCHEMA, "append", "EventTime")


def count_parts(usage: DataFrame) -> DataFrame:
    """Runs per user and UTC day in some rows. Parts are summed when they are read (``summed_parts``), so rows may come in any
    order, however late, and a stream keeps no state for them."""
    return usage.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def drain_parts(stream: DataFrame, part, path: str, checkpoint: str) -> None:
    """``part`` of each trigger's rows, in a folder of the trigger's own that a retry replaces."""
    def save(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def summed_parts(spark: SparkSession, path: str, keys: Sequence[str], value: str = "n") -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum(value).alias(value))


def daily_counts(usage: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Runs per user and UTC day. In update mode open days come out too and are
    replaced as they grow; read them back with ``newest_rows``."""
    return (
        usage.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("window.start").alias("day"), "n")
    )


def conversation_counters(messages: DataFrame) -> DataFrame:
    """Running counters, update mode; one small row of state per conversation."""
    return messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("last_message_at")
    )


TRANSITION_SCHEMA = (
    "ticker string, form_type string, accession_number string, seq bigint, change string, signal string, sign int"
)


class SignalTransitions(StatefulProcessor):
    """State per series: the signals of its filings by their place. Rows come as
    (ticker, form_type, accession_number, seq, signals), in any order.

    A filing is compared with the one before it. One that comes in between two others takes
    back (sign -1) what the second differed in from the first, and puts out (sign 1) what each
    now differs in from its neighbour. A filing that comes again replaces itself. Only
    neighbours' signals are read from the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._filings = handle.getMapState("filings", "seq bigint, accession_number string", "signals array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticker, form = key
        batch = sorted((int(p), a, tuple(s)) for f in rows for p, a, s in zip(f["seq"], f["accession_number"], f["signals"]))
        places = sorted((int(p), a) for p, a in self._filings.keys())
        out = []

        def signals(at: int) -> set[str]:
            return set(self._filings.getValue(places[at])[0])

        def differ(at: int, sign: int) -> None:
            """What the filing at this place differs in from the one before it."""
            if 0 < at < len(places):
                (seq, accession), now, before = places[at], signals(at), signals(at - 1)
                out.extend((ticker, form, accession, seq, "appeared", s, sign) for s in sorted(now - before))
                out.extend((ticker, form, accession, seq, "removed", s, sign) for s in sorted(before - now))

        for seq, accession, found in batch:
            place = (seq, accession)
            at = bisect_left(places, place)
            again = at < len(places) and places[at] == place
            differ(at, -1)
            if again:
                differ(at + 1, -1)
            else:
                places.insert(at, place)
            self._filings.updateValue(place, (list(found),))
            differ(at, 1)
            differ(at + 1, 1)
        yield pd.DataFrame(out, columns=["ticker", "form_type", "accession_number", "seq", "change", "signal", "sign"])

    def close(self) -> None:
        pass


def standing(changes: DataFrame) -> DataFrame:
    """Changes that have not been taken back."""
    columns = [c for c in changes.columns if c != "sign"]
    return changes.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")


def signal_transitions(points: DataFrame) -> DataFrame:
    """Rows with a sign; ``standing`` reads what holds. Needs the RocksDB state store provider (see ``use_rocksdb``)."""
    # the stream's own Python runner starts before shipped files are in place
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return points.groupBy("ticker", "form_type").transformWithStateInPandas(
        SignalTransitions(), TRANSITION_SCHEMA, "append", "None"
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


# fixed values: what a billing event does to (status, usage plan)
BILLING_EFFECTS = {
    "charge.success": ("active", None),
    "subscription.create": ("active", None),
    "subscription.disable": ("cancelled", "free_trial"),
    "invoice.payment_failed": ("past_due", "free_trial"),
}


def billing_status(events: DataFrame) -> DataFrame:
    """Latest effect per user: status, plan of the subscription, usage plan. The
    subscription keeps its plan when it lapses; the usage plan falls back.

    The later event wins whatever the order of arrival, and each user's latest
    events are all the state there is, so the same aggregation serves a batch and,
    in update mode, a stream that writes only the users a trigger touched."""
    known = events.where(F.col("event").isin(*BILLING_EFFECTS))
    status = usage_plan = None
    for event, (s, p) in BILLING_EFFECTS.items():
        is_event = F.col("event") == event
        plan = F.lit(p) if p else F.col("plan")
        status = F.when(is_event, s) if status is None else status.when(is_event, s)
        usage_plan = F.when(is_event, plan) if usage_plan is None else usage_plan.when(is_event, plan)
    order = F.struct("ts", "event_id")
    pays = F.col("event").isin("charge.success", "subscription.create")
    return known.groupBy("user_id").agg(
        F.max_by(status, order).alias("status"),
        F.max_by("plan", F.when(pays, order)).alias("plan"),
        F.max_by(usage_plan, order).alias("usage_plan"),
    )


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run all available input to completion into parquet files. In update mode
    each trigger's rows carry its ``batch_id`` and a retried trigger replaces its
    own; ``newest_rows`` reads what holds."""
    if mode == "append":
        query = (
            stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        query = (
            stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start()
        )
    query.awaitTermination()


def newest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows of an update stream as they stand: each key's from its last batch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return last.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
