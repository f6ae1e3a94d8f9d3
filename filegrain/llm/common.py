"""What several operators share: folds, words, shared scratch tables, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filegrain.session import ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts are handed to Python in batches of so many rows: one text can be megabytes.
ROWS_PER_BATCH = 500
FOLDS = 5


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def non_empty(words: Column) -> Column:
    """A split leaves an empty string at either end when the text begins or ends with a separator."""
    return F.array_remove(words, "")


def held_out(key: Column) -> Column:
    """One row in five by the key's checksum. A row without a key counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def scratch(spark: SparkSession) -> str:
    """The folder that all machines share. Only where the session names none, as in tests, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="filegrain-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unit_hash(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, or all where there are fewer, chosen by the key's hash.

    For fitting classifiers only. One counting pass, then a filter: no label is gathered in one task.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items()):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    return rows.where(unit_hash(F.col(key)) < share)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on small Arrow batches: it gets a RecordBatch and returns one."""
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                yield fn(batch.slice(at, ROWS_PER_BATCH))

    return df.mapInArrow(run, schema)
