"""Helpers shared by the training-data operators: shared storage, row identity and word expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Paths of the tables that materialize() wrote, by the identity of the DataFrame that reads them.
_written: dict[int, tuple[DataFrame, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local session may go without the setting; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        # A path without a scheme means what Spark takes it for, not the disk of whoever opens it.
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="phenoquarry-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


def workdir(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder; nothing exists there yet."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation."""
    path = workdir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more; other DataFrames are passed over."""
    for df in tables:
        _, path = _written.pop(id(df), (None, None))
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if a (materialised) table has at most max_rows rows, the proven bound behind a broadcast."""
    return df.count() <= max_rows


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() is used where it does the same: on text without non-ASCII capitals."""
    # lower() differs from the A-Z mapping only on non-ASCII characters that have a lower-case form.
    touched = c.rlike(r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\x{2160}-\x{216F}\x{24B6}-\x{24CF}]]")
    return F.when(touched, F.translate(c, _UPPER, _UPPER.lower())).otherwise(F.lower(c))


def text_key(c: Column) -> Column:
    """128-bit digest of a text (null counts as empty). With the doc_id it identifies a document; rows that repeat both are one document."""
    return F.md5(F.coalesce(c, F.lit("")))
