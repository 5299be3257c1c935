"""Readers of entity tables, dependency tables and raw extractor models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..functions.text import tidy_path, trimmed
from . import schema
from .csv_ranges import read_csv_ranges

#: Texts that a CSV file means as missing.
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed column names; columns named like a file as tidy paths; trimmed module and dependency type."""
    out = []
    for c in df.columns:
        name, col = c.strip(), F.col(f"`{c}`")
        if "file" in name.lower():
            col = tidy_path(col.cast("string"))
        elif name in ("Module", "Dependency_Type"):
            col = trimmed(col.cast("string"))
        out.append(col.alias(name))
    return df.select(out)


def read_csv(spark: SparkSession, path: str, known: str) -> DataFrame:
    """CSV files with header and a stated schema: known columns have their type, all others are text.

    No inference pass, so a module called ``1`` stays a text. Missing values become null. Files are read by byte ranges
    (see :mod:`skein.sources.csv_ranges`), and the rows get ``row_id`` without gaps in file order, files in the order of
    their names.
    """
    texts = read_csv_ranges(spark, path, missing=MISSING)
    types = {f.name: f.dataType for f in StructType.fromDDL(known)}
    cols = []
    for n in texts.columns[:-1]:
        kind, value = types.get(n.strip(), StringType()), F.col(f"`{n}`")
        if isinstance(kind, LongType):
            value = value.try_cast("double").cast("long")  # counts may be written as 3.0
        elif not isinstance(kind, StringType):
            value = value.try_cast(kind)
        cols.append(value.alias(n))
    return texts.select(*cols, "row_id")


def load_dataset(spark: SparkSession, folder: str, files: tuple[str, str], name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entity and dependency table of a system, normalised, with a ``dataset`` column if a name is given."""
    folder = folder.replace("\\", "/").rstrip("/")
    pair = [normalize_columns(read_csv(spark, f"{folder}/{f}", s)) for f, s in zip(files, (schema.ENTITIES, schema.DEPENDENCIES), strict=True)]
    return tuple(df.withColumn("dataset", F.lit(name)) if name else df for df in pair)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The raw extractor model of a JSON file: one row with ``variables`` and ``cells``. Pickles are not loaded."""
    return spark.read.schema(schema.MODEL).option("multiLine", True).json(path)


def find_model(spark: SparkSession, folder: str, dataset: str) -> str | None:
    """First ``*-file.json`` in the folder, else the first ``<dataset>*.json``; listed through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for pattern in ("*-file.json", f"{dataset}*.json"):
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        if found := at.getFileSystem(conf).globStatus(at):
            return min(str(x.getPath()) for x in found)
    return None
