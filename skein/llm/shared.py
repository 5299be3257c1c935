"""Small helpers that the corpus operators have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python and Java agree on this class: white space is U+0020 and U+0009..U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows held out from every fit: crc32(doc_id as text) mod 4 has this remainder.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of a local master without ``spark.checkpoint.dir`` (tests), once it has been made.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see; the session's ``spark.checkpoint.dir``.

    Only where that is unset: a temporary folder for a local master (tests), else a folder in the warehouse.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.startswith("local["):
        return _LOCAL[0] if _LOCAL else _LOCAL.append(tempfile.mkdtemp(prefix="skein-")) or _LOCAL[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_skein"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what :func:`materialize` wrote for ``df``; nothing may read it afterwards."""
    if path := getattr(df, "_skein_path", None):
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, rows: int = 256) -> DataFrame:
    """One output row for each input row: ``make()`` runs once in a task and gives a function of the columns' values.

    Output goes back in batches of ``rows``, so a task holds one Arrow batch of input and a few output rows.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                out = [one(*row) for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

    return df.mapInArrow(run, schema)


def map_many(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str, rows: int = 256) -> DataFrame:
    """As :func:`map_batches`, but the function gives a list of output rows for each input row."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=arrow.field(i).type) for i in range(len(arrow))], schema=arrow)
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part, out = batch.slice(k, rows), []
                for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                    out += one(*row)
                    if len(out) >= 4096:
                        yield pack(out)
                        out = []
                if out:
                    yield pack(out)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow schema of a DDL string; needs a session, so it is made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def held_out(id_col: str = "doc_id"):
    """Column: the row is kept out of every fit."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == HELD_OUT


def share_of(key, rows: int, n: int):
    """Column: the row is one of about ``rows`` of ``n``, picked by a hash of ``key``; 62 bits tell any number apart."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 62)) < (1 << 62) * rows // max(n, rows)


def bitmap_filter(df: DataFrame, key, small: DataFrame, small_key, bits: int = 22) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``small``: a semi-join reduction before a shuffle.

    ``small_key`` and ``key`` are bigint hashes. What is broadcast is a bitmap of 2**bits bits in words of 64, so at
    most 2**(bits-6) rows (65,536 by default, about 1 MB) however large ``small`` is. False positives remain and
    must be removed by the join that follows; no true match is lost.
    """
    words = small.select(F.pmod(small_key, F.lit(1 << bits)).alias("b")).groupBy(F.shiftright("b", 6).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("_m"))
    at = F.pmod(key, F.lit(1 << bits))
    hit = df.withColumns({"_k": at}).withColumn("_w", F.shiftright("_k", 6))
    return hit.join(F.broadcast(words), "_w").where(F.col("_m").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_k") % 64).cast("int"))) != 0).drop("_w", "_m", "_k")
