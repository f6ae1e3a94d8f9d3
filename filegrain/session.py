"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution decides joins from measured sizes: nothing here forces a
# broadcast of data that grows. Arrow batches are bounded in bytes because one
# filing body can be megabytes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a narrow side of bounded partitions is hashed, so that the wide side is not sorted
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


#: Of a batch where one row holds a whole document: rows that the reader takes, rows that go to Python at once.
BODY_ROWS, BODY_ARROW_ROWS = 256, 256


def few_rows_a_batch(spark: SparkSession) -> None:
    """From now on the session's scans read, and its Python workers are sent, batches of few rows: rows are counted there, not
    bytes, and with the usual thousands the bodies of one batch alone can fill a task's memory."""
    for key, most in (("spark.sql.parquet.columnarReaderBatchSize", BODY_ROWS), ("spark.sql.execution.arrow.maxRecordsPerBatch", BODY_ARROW_ROWS)):
        now = int(spark.conf.get(key))
        spark.conf.set(key, str(most if now <= 0 else min(now, most)))


def ship_package() -> None:
    """Give the executors this package, once per application: what runs in
    Python workers is imported there by name."""
    sc = SparkSession.active().sparkContext
    if getattr(sc, "_filegrain_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="filegrain-"), "filegrain"), "zip",
        root_dir=os.path.dirname(package), base_dir=os.path.basename(package),
    )
    sc.addPyFile(archive)
    sc._filegrain_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, named in ``spark.checkpoint.dir``. A local one
    is made only where the session names none and runs on one machine, as tests do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="filegrain-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
