"""Intermediate tables in the folder that the cluster shares, for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folder of a local master without ``spark.checkpoint.dir`` (tests), once it has been made.
_LOCAL: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a temporary folder serves a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = _LOCAL[0] if _LOCAL else _LOCAL.append(tempfile.mkdtemp(prefix="skein-")) or _LOCAL[0]
    folder = folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_skein"
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


#: Shuffle files of a query are deleted when it ends, not when the driver's next full collection of garbage comes.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a new shared path and read back; the shuffle files of its plan are gone then."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    was = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*made: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these, or what they say that they read; nothing may read it afterwards."""
    for df in made:
        if path := getattr(df, "_skein_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
