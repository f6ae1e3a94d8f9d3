import datetime as dt
import random

import harness
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from filegrain.streaming import jobs


SERIES = "ticker string, form_type string, accession_number string, seq bigint, signals array<string>"


def transitions(spark, folder, triggers):
    jobs.use_rocksdb(spark)
    for rows in triggers:
        spark.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        jobs.drain(jobs.signal_transitions(spark.readStream.schema(SERIES).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/cp")
    return spark.read.parquet(f"{folder}/out")


def test_late_filing_takes_back_what_it_changes(spark, tmp_path):
    out = transitions(spark, tmp_path, (
        [("A", "10-K", "a1", 1, ["x"]), ("A", "10-K", "a3", 3, ["x", "y"])], [("A", "10-K", "a2", 2, ["z"]), ("A", "10-K", "a4", 4, ["y"])],
    ))
    got = {(r["seq"], r["change"], r["signal"]) for r in jobs.standing(out).collect()}
    assert got == {(2, "appeared", "z"), (2, "removed", "x"), (3, "appeared", "x"), (3, "appeared", "y"), (3, "removed", "z"), (4, "removed", "x")}
    assert [(r["seq"], r["signal"]) for r in out.where("sign < 0").collect()] == [(3, "y")]


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_filings_gives_the_same_series(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(t, "10-K", f"{t}{i}", i // 2, rng.sample("uvwxyz", rng.randint(0, 4))) for t in "AB" for i in range(12)]
    want = set()
    for (t, _, _, _, before), (u, _, a, seq, now) in zip(rows, rows[1:]):
        if t == u:
            want |= {(a, seq, "appeared", s) for s in set(now) - set(before)} | {(a, seq, "removed", s) for s in set(before) - set(now)}
    shuffled = rng.sample(rows, len(rows)) + rng.sample(rows, 3)  # some come twice
    out = transitions(spark, tmp_path, [shuffled[i : i + 9] for i in range(0, len(shuffled), 9)])
    assert {(r["accession_number"], r["seq"], r["change"], r["signal"]) for r in jobs.standing(out).collect()} == want


def test_billing_is_order_free(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("u", 1, t(1), "pro", "charge.success"), ("u", 2, t(5), None, "subscription.disable"), ("u", 3, t(3), "business", "subscription.create"),
            ("v", 4, t(2), "pro", "charge.success"), ("v", 5, t(9), None, "unknown")]
    schema = "user_id string, event_id int, ts timestamp, plan string, event string"
    for name, order in (("a", rows), ("b", rows[::-1])):
        base = f"{tmp_path}/{name}"
        for r in order:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
            jobs.drain(jobs.billing_status(spark.readStream.schema(schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/cp", "update")
        got = {r["user_id"]: (r["status"], r["plan"], r["usage_plan"]) for r in jobs.newest_rows(spark, f"{base}/out", ["user_id"]).collect()}
        assert got == {"u": ("cancelled", "business", "free_trial"), "v": ("active", "pro", "pro")}


REQUESTS = "result_key string, ts timestamp, ttl_seconds long"


def judged(spark, folder, triggers, lateness):
    """What came out by the end, with a beat after the last trigger."""
    jobs.use_rocksdb(spark)
    beat = (None, dt.datetime(2100, 1, 1), None, True)
    for n, rows in enumerate([*triggers, []]):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        spark.createDataFrame([beat] if n == len(triggers) else [], jobs.BEATS).coalesce(1).write.mode("append").parquet(f"{folder}/beats")
        stream = spark.readStream.schema(REQUESTS).parquet(f"{folder}/in")
        beats = spark.readStream.schema(jobs.BEATS).parquet(f"{folder}/beats")
        jobs.drain(jobs.first_within_ttl(stream, lateness, beats), f"{folder}/out", f"{folder}/cp")
    rows = [(r["result_key"], r["ts"], r["late"]) for r in spark.read.parquet(f"{folder}/out").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def in_order(requests):
    held, out = {}, set()
    for key, at, ttl in sorted(requests, key=lambda r: (r[1], r[2])):
        if key not in held or at >= held[key]:
            held[key] = at + dt.timedelta(seconds=ttl)
            out.add((key, at, False))
    return out


def test_ttl_over_several_triggers(spark, tmp_path):
    """A key is held for its own TTL from the request that went through, not longer; late rows within the lateness are judged in order."""
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    week, three = 7 * 86_400, 3 * 86_400
    triggers = (
        [("k", day(1), week), ("k", day(2), week), ("m", day(1, 5), three)],
        [("k", day(7, 23), week), ("m", day(4, 6), three)],
        [("k", day(11), week), ("n", day(11), three)],
        [("n", day(10, 12), three), ("n", day(14), three), ("k", day(18), week)],
    )
    got = judged(spark, tmp_path, triggers, "2 days")
    assert got == in_order([r for t in triggers for r in t])
    assert got == {(k, t, False) for k, t in (("k", day(1)), ("k", day(11)), ("k", day(18)), ("m", day(1, 5)), ("m", day(4, 6)), ("n", day(10, 12)), ("n", day(14)))}


def test_requests_behind_the_watermark_are_told(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    triggers = ([("k", day(10), 60), ("m", day(20), 60)], [("k", day(5), 60), ("k", day(19, 12), 60)], [("new", day(3), 60)])
    got = judged(spark, tmp_path, triggers, "1 day")
    assert got == {("k", day(10), False), ("m", day(20), False), ("k", day(19, 12), False), ("k", day(5), True), ("new", day(3), True)}


@pytest.mark.parametrize("seed", range(2))
def test_requests_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    requests = [(rng.choice("abc"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(20 * 86_400)), rng.choice((3_600, 86_400, 4 * 86_400))) for _ in range(120)]
    assert judged(spark, tmp_path, [requests[i::4] for i in range(4)], "30 days") == in_order(requests)


def test_parts_are_summed_in_any_order(spark, tmp_path):
    schema = "user_id string, ts timestamp"
    for hours in ((30, 1), (2,), (900,), (3,)):
        rows = [("u", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.drain_parts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), jobs.count_parts, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["day"].date().isoformat(), r["n"]) for r in jobs.summed_parts(spark, f"{tmp_path}/out", ["user_id", "day"]).collect()}
    assert got == {("2024-01-01", 3), ("2024-01-02", 1), ("2024-02-07", 1)}


def test_open_days_come_out_and_grow(spark, tmp_path):
    schema = "user_id string, ts timestamp"
    for hours in ((1, 2), (3,), (30,)):
        rows = [("u", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.drain(jobs.daily_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp", "update")
    got = {(r["day"].day, r["n"]) for r in jobs.newest_rows(spark, f"{tmp_path}/out", ["user_id", "day"]).collect()}
    assert got == {(1, 3), (2, 1)}


@pytest.mark.parametrize("name", ["stream_daily_counts", "stream_ttl_keys", "stream_signal_transitions"])
def test_tables_of_several_files_in_no_order(spark, con, sf_dir, tmp_path, name):
    """As bench.py lands them: each file spans all days and all companies."""
    for t in ("events", "documents"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(6).write.parquet(f"{tmp_path}/{t}.parquet")
    assert harness.compare(spark, con, lambda s, _: entry_point.queries()[name](s, str(tmp_path)), entry_point.oracle_sql()[name], sf_dir) is None


def test_state_is_asked_no_more_than_needed(monkeypatch):
    """Calls to the state of a key whose one request goes through: each is a message to the JVM."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.rows = name, []

        def __getattr__(self, method):
            def call(*a):
                calls.append((self.name, method))
                if method in ("update", "appendList", "put"):
                    self.rows = (self.rows if method == "appendList" else []) + (list(a[0]) if method != "update" else [a[0]])
                elif method == "clear":
                    self.rows = []
                elif method == "exists":
                    return bool(self.rows)
                elif method == "get":
                    return iter(self.rows) if self.name == "waiting" else (self.rows[0] if self.rows else None)
            return call

    class Handle:
        def getValueState(self, name, schema):
            return State(name)

        getListState = getValueState

        def registerTimer(self, at):
            calls.append(("timer", "register"))

        deleteTimer = registerTimer

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    processor, times = jobs.WithinTtl(), Times()
    processor.init(Handle())
    assert list(processor.handleInputRows(("a",), iter([pd.DataFrame({"at": [5_000_000], "ttl": [1_000_000]})]), times)) == []
    times.now = 9_000
    (out,) = processor.handleExpiredTimer(("a",), times, None)
    assert out["ts"].tolist() == [pd.Timestamp(5, unit="s")] and not out["late"].any()
    assert len(calls) <= 9
