"""Result sinks: metric rows, runtimes, assignments, cached embeddings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.attention import Settings
from . import schema

#: Columns of a metric row in their order; further columns follow.
ORDER = [f.strip().split()[0] for f in schema.METRICS.split(",")]


def settings_columns() -> set[str]:
    """Names of an encoder's settings, which rows of a run may carry; they are not results."""
    return set(Settings.__dataclass_fields__)


def clean_results(df: DataFrame, drop: Collection[str] = ()) -> DataFrame:
    """Metric columns first, in order, then others, without settings and what the caller drops. Names are told apart by case."""
    internal = settings_columns() | set(drop)
    kept = [c for c in df.columns if c not in internal]
    return df.select(*[f"`{c}`" for c in ORDER if c in kept], *[f"`{c}`" for c in kept if c not in ORDER])


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both with the union of their columns, old columns first."""
    return clean_results(old).unionByName(clean_results(new), allowMissingColumns=True)


def append_results(df: DataFrame, path: str) -> None:
    """Append metric or runtime rows to a Parquet table; columns may be added, readers merge the schemas."""
    clean_results(df).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return clean_results(spark.read.option("mergeSchema", True).parquet(path))


def append_assignments(df: DataFrame, path: str) -> None:
    """Append ``Model, Dataset, run_id, clustering, file, cluster`` rows, partitioned so that a run can be replaced."""
    df.write.mode("append").partitionBy("Model", "Dataset", "run_id").json(path)


def completed_runs(results: DataFrame, rows_per_run: int) -> DataFrame:
    """``Model, Dataset, run_id`` of the runs that have all their rows."""
    return results.groupBy("Model", "Dataset", "run_id").agg(F.count("*").alias("n")).where(F.col("n") >= rows_per_run).drop("n")


def open_runs(planned: DataFrame, results: DataFrame, rows_per_run: int) -> DataFrame:
    """Planned runs that are not completed."""
    return planned.join(completed_runs(results, rows_per_run), ["Model", "Dataset", "run_id"], "left_anti")


def cache_key(method: str, dataset: str, run_id: int, settings: dict) -> str:
    """Digest of what an embedding depends on: the scalar settings, by name."""
    plain = {k: v for k, v in settings.items() if isinstance(v, str | int | float | bool | type(None))}
    return hashlib.md5(json.dumps({"method": method, "dataset": dataset, "run": run_id, **plain}, sort_keys=True).encode()).hexdigest()


def cached_embedding(spark: SparkSession, folder: str | None, key: str, build) -> DataFrame:
    """The embedding stored under ``key``, or that which ``build()`` gives, stored first."""
    if not folder:
        return build()
    path = f"{folder.rstrip('/')}/{key}"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(conf).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fields(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names
