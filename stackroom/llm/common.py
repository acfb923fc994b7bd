"""Shared plumbing of the training-data operators: tables, scratch space, word patterns."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. A folder of this machine is used only where
    nothing is configured and the master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = found.get()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stackroom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; the files are scratch
        pass


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and rereads it,
    so that an executor lost later costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stackroom-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return write_table(df, path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet to a path, in place of what a failed run left there, and rereads it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets shuffle files go: Spark drops them once the driver's JVM has collected what refers
    to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
