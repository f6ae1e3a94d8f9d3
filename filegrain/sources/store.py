"""A keyed store of results in plain Parquet: written in batches, merged when read, compacted now and then.

Layout under one folder that all machines share::

    delta/batch=7/bucket=3/…    rows of one batch; a batch that is written again replaces itself
    base-2/bucket=3/…           what held when version 2 was compacted
    manifest/version=2/…        one row: the base folder and the last batch it has in it

The newest version of a key wins, whatever batch brought it; a delete is a version too. A
version hides older ones even when it has expired. Compaction writes a new base beside the
old one and then its manifest row, which makes it count at once: readers go by the highest
version, and two compactions cannot take the same one. Deletes and expired rows leave the
base when they are older than ``grace``: until then a late, older version must not come back.

Reading combines versions before its exchange. ``lookup`` reads only the buckets that the wanted
keys fall in. Nothing is collected but the manifest's row and the numbers of such buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each row beside keys and payload.
WRITTEN, VERSION, EXPIRES, DELETED = "written_at", "result_id", "expires_at", "deleted"
OWN = f"{WRITTEN} timestamp, {VERSION} bigint, {EXPIRES} timestamp, {DELETED} boolean"


@dataclass(frozen=True)
class ResultStore:
    """``keys`` and ``payload`` are DDL column lists; ``buckets`` so many that the rows of one fit a task."""

    spark: SparkSession
    path: str
    keys: str
    payload: str
    buckets: int = 64

    @property
    def key_names(self) -> list[str]:
        return [c.split()[0] for c in self.keys.split(",")]

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in f"{self.keys}, {self.payload}, {OWN}".split(",")]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key_names), F.lit(self.buckets)).cast("int")

    # ---- writing ----

    def put(self, rows: DataFrame, batch: int) -> None:
        """``rows``: keys, payload, written_at, result_id and expires_at (NULL: never). Does nothing if the batch is in the base already."""
        self._write(rows.withColumn(DELETED, F.lit(False)), batch)

    def delete(self, rows: DataFrame, batch: int) -> None:
        """``rows``: keys, written_at and result_id of the deletes."""
        payload = [c.split() for c in self.payload.split(",")]
        empty = {name: F.lit(None).cast(kind) for name, kind in (*payload, (EXPIRES, "timestamp"))}
        self._write(rows.withColumns(empty).withColumn(DELETED, F.lit(True)), batch)

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Puts and deletes of one batch, told apart by ``deleted``."""
        self._write(rows, batch)

    def _write(self, rows: DataFrame, batch: int) -> None:
        if batch <= self._current()[1]:
            return
        placed = rows.select(*self.columns).withColumn("bucket", self._bucket())
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/batch={batch}")

    # ---- reading ----

    def _current(self) -> tuple[int, int, str | None]:
        """(version, last batch in its base, base folder) that holds now."""
        try:
            manifest = self.spark.read.schema("base string, through bigint, version int").parquet(f"{self.path}/manifest")
            row = manifest.orderBy(F.desc("version")).first()
        except AnalysisException as e:  # nothing was compacted yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row["version"], row["through"], row["base"]) if row else (0, -1, None)

    def _rows(self) -> DataFrame:
        """All versions that count: the base's and those of later batches."""
        schema = f"{self.keys}, {self.payload}, {OWN}"
        _, through, base = self._current()
        empty = self.spark.createDataFrame([], f"{schema}, bucket int, batch bigint")
        rows = empty
        if base is not None:
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{base}").withColumn("batch", F.lit(through))
        try:
            delta = self.spark.read.schema(f"{schema}, batch bigint, bucket int").parquet(f"{self.path}/delta").where(F.col("batch") > through)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return rows
        return rows.unionByName(delta) if base is not None else delta.select(*empty.columns)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key_names]
        best = F.max_by(F.struct(*rest), F.struct(WRITTEN, VERSION, "batch")).alias("r")
        return rows.groupBy(*self.key_names).agg(best).select(*self.key_names, *[F.col("r")[c].alias(c) for c in rest])

    def _valid(self, now: Column) -> Column:
        return ~F.col(DELETED) & (F.col(EXPIRES).isNull() | (F.col(EXPIRES) > now))

    def read(self, now: Column) -> DataFrame:
        """What holds at ``now``: keys, payload and the version's columns."""
        newest = self._newest(self._rows().where(F.col(WRITTEN) <= now))
        return newest.where(self._valid(now)).select(*[c for c in self.columns if c != DELETED])

    def lookup(self, wanted: DataFrame, now: Column) -> DataFrame:
        """``read`` for the keys of ``wanted``: other buckets are not opened."""
        keys = wanted.select(*self.key_names).distinct()
        buckets = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        rows = self._rows().where(F.col("bucket").isin(buckets) & (F.col(WRITTEN) <= now)).join(keys, self.key_names, "left_semi")
        return self._newest(rows).where(self._valid(now)).select(*[c for c in self.columns if c != DELETED])

    # ---- compaction ----

    def compact(self, now: Column, grace: Column | None = None) -> int:
        """A new base of the newest versions; the version it has. ``grace``: how late an older version may still come."""
        version, through, _ = self._current()
        rows = self._rows()
        last = rows.agg(F.max("batch")).first()[0]
        if last is None or last <= through:
            return version
        rows = rows.where(F.col("batch") <= last)  # what comes meanwhile stays in its delta
        outdated = ~self._valid(now) & (F.greatest(F.col(WRITTEN), F.coalesce(EXPIRES, WRITTEN)) < now - (grace if grace is not None else F.expr("interval 0 seconds")))
        held = self._newest(rows).where(~outdated).select(*self.columns, "bucket")
        base = f"base-{version + 1}-{through + 1}-{last}"
        held.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{base}")
        manifest = self.spark.createDataFrame([(base, last)], "base string, through bigint").coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version + 1}")
        return version + 1


def drain_into(stream: DataFrame, store: ResultStore, checkpoint: str, compact_every: int = 0, now: Column | None = None) -> None:
    """All available input of a stream of puts and deletes (``deleted``) into the store, a batch for each trigger."""
    def save(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            store.compact(now if now is not None else F.current_timestamp(), F.expr("interval 7 days"))

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
