"""The keyed store against a dictionary, over compactions, retries and late versions."""

import datetime as dt
import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from filegrain.sources.store import ResultStore, drain_into

START = dt.datetime(2024, 1, 1)
ROWS = "k string, part int, value double, written_at timestamp, result_id long, expires_at timestamp, deleted boolean"


def at(hours):
    return START + dt.timedelta(hours=hours)


def moment(hours):
    return F.lit(at(hours))


def store_in(spark, path):
    return ResultStore(spark, str(path), "k string, part int", "value double", buckets=4)


def row(key, version, value=None, hours=None, lasts=None):
    hours = version if hours is None else hours
    return (key, 0, value, at(hours), version, None if lasts is None else at(hours + lasts), value is None)


def held(rows, now):
    newest = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        if r[3] <= at(now):
            newest[r[0], r[1]] = r
    return {k: r[2] for k, r in newest.items() if not r[6] and (r[5] is None or r[5] > at(now))}


def read(store, now):
    return {(r.k, r.part): r.value for r in store.read(moment(now)).collect()}


def test_put_overwrite_delete_expire(spark, tmp_path):
    store = store_in(spark, tmp_path)
    frame = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert read(store, 5) == {}
    store.put(frame(row("a", 1, 1.0), row("b", 1, 2.0, lasts=10), row("c", 1, 3.0)).drop("deleted"), 0)
    store.put(frame(row("a", 2, 4.0)).drop("deleted"), 1)
    store.delete(frame(row("c", 3)).select("k", "part", "written_at", "result_id"), 2)
    assert read(store, 5) == {("a", 0): 4.0, ("b", 0): 2.0} and read(store, 1) == {("a", 0): 1.0, ("b", 0): 2.0, ("c", 0): 3.0}
    assert read(store, 12) == {("a", 0): 4.0}
    assert store.compact(moment(5), F.expr("interval 100 hours")) == 1 and read(store, 5) == {("a", 0): 4.0, ("b", 0): 2.0}
    assert store.compact(moment(5)) == 1  # nothing new
    store.put(frame(row("a", 9, 9.0)).drop("deleted"), 1)  # a retried batch that the base has
    assert read(store, 10) == {("a", 0): 4.0, ("b", 0): 2.0}
    store.put(frame(row("c", 2, 7.0)).drop("deleted"), 3)  # older than the delete
    assert read(store, 5) == {("a", 0): 4.0, ("b", 0): 2.0}


@pytest.mark.parametrize("seed", range(3))
def test_against_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    store = store_in(spark, tmp_path)
    versions = list(range(60))
    rows = [row(rng.choice("abcdefg"), v, None if rng.random() < 0.2 else v / 2, lasts=rng.choice([None, 3, 30])) for v in versions]
    rng.shuffle(rows)
    seen = []
    for batch in range(6):
        part = rows[batch * 10 : batch * 10 + 10]
        store.apply(spark.createDataFrame(part, ROWS), batch)
        store.apply(spark.createDataFrame(part, ROWS), batch)
        seen += part
        if rng.random() < 0.5:
            store.compact(moment(200), F.expr("interval 1000 hours"))
        assert read(store, 200) == held(seen, 200)
    wanted = spark.createDataFrame([("a", 0), ("c", 0), ("zz", 1), ("a", 0)], "k string, part int")
    got = {(r.k, r.part): r.value for r in store.lookup(wanted, moment(200)).collect()}
    assert got == {k: v for k, v in held(rows, 200).items() if k[0] in "ac"}


def test_compaction_drops_what_is_outdated(spark, tmp_path):
    store = store_in(spark, tmp_path)
    store.apply(spark.createDataFrame([row("a", 1, 1.0, lasts=2), row("b", 1), row("c", 1, 5.0)], ROWS), 0)
    store.compact(moment(100), F.expr("interval 50 hours"))
    assert spark.read.parquet(f"{tmp_path}/base-1-0-0").count() == 1 and read(store, 100) == {("c", 0): 5.0}


def test_two_compactions_cannot_take_one_version(spark, tmp_path):
    store = store_in(spark, tmp_path)
    store.apply(spark.createDataFrame([row("a", 1, 1.0)], ROWS), 0)
    spark.createDataFrame([("base-other", 0)], "base string, through bigint").coalesce(1).write.parquet(f"{tmp_path}/manifest/version=1")
    late = ResultStore(spark, str(tmp_path), "k string, part int", "value double", buckets=4)
    object.__setattr__(late, "_current", lambda: (0, -1, None))  # it looked before the other was done
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        late.compact(moment(5))


def test_lookup_opens_only_its_buckets(spark, tmp_path):
    store = store_in(spark, tmp_path)
    store.apply(spark.createDataFrame([row(f"k{i}", 1, float(i)) for i in range(200)], ROWS), 0)
    store.compact(moment(5))
    found = store.lookup(spark.createDataFrame([("k7", 0)], "k string, part int"), moment(5))
    assert [r.value for r in found.collect()] == [7.0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)


def test_a_stream_into_the_store(spark, tmp_path):
    store = store_in(spark, tmp_path / "store")
    rng = random.Random(4)
    rows = [row(rng.choice("abc"), v, None if v % 7 == 0 else float(v)) for v in range(40)]
    rng.shuffle(rows)
    for part in (rows[:15], rows[15:30], rows[30:]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain_into(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp", compact_every=2, now=moment(60))
    assert read(store, 100) == held(rows, 100) and store._current()[0] == 1
