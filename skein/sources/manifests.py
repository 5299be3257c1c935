"""Appendable tables whose columns may widen, by numbered manifests.

A table is a folder of Parquet parts and of manifests. The manifest of the highest number lists the parts, each with the
key of the run that wrote it, and the columns of all with their types. An append writes its part first, then makes the
manifest of the next number, which succeeds for one writer only; another one reads what has come in between and tries the
next number. So readers see whole appends, columns and parts change at once, a run that is repeated adds nothing, and a
part that no manifest lists is never read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Appends that may come in between before a writer gives up.
TRIES = 100


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf)


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; 0 and an empty one for a table that is not there."""
    jvm, fs = _files(spark, path)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*.json")) or []
    names = [m[1] for x in found if (m := re.fullmatch(r"(\d+)\.json", x.getPath().getName()))]
    if not names:
        return 0, {"columns": [], "parts": []}
    newest = max(names, key=int)
    return int(newest), json.loads(spark.read.text(f"{path}/manifest/{newest}.json", wholetext=True).first()[0])


def _put(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Make the manifest of this number unless it is there: it is written aside and renamed, which fails on a name in use."""
    jvm, fs = _files(spark, path)
    to, aside = (jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{x}") for x in (f"{number:010d}.json", f".{uuid.uuid4().hex}.tmp"))
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        done = not fs.exists(to) and fs.rename(aside, to)
    except Exception:  # some file systems raise where others return false
        done = False
    if not done:
        fs.delete(aside, False)
    return bool(done)


def _widened(columns: list[dict], more: StructType) -> list[dict]:
    """Old columns first, then new ones; a column keeps its type, and one of another type is an error."""
    known = {c["name"]: c["type"] for c in columns}
    out = list(columns)
    for f in more.fields:
        kind = f.dataType.jsonValue()
        if known.setdefault(f.name, kind) != kind:
            raise ValueError(f"column {f.name!r} has another type in the table")
        if f.name not in [c["name"] for c in out]:
            out.append({"name": f.name, "type": kind})
    return out


def _commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> bool:
    for _ in range(TRIES):
        number, now = latest(spark, path)
        new = change(now)
        if new is None:
            return False
        if _put(spark, path, number + 1, new):
            return True
    raise RuntimeError(f"{path}: {TRIES} other writers came first")


def _write(df: DataFrame, path: str) -> str:
    name = f"part-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def append(df: DataFrame, path: str, key: str) -> bool:
    """Append the rows of run ``key``; false, and nothing is added, if the table has that run already."""
    spark = df.sparkSession
    if any(key in p["keys"] for p in latest(spark, path)[1]["parts"]):
        return False
    _widened(latest(spark, path)[1]["columns"], df.schema)  # before anything is written
    name = _write(df, path)

    def change(now: dict) -> dict | None:
        if any(key in p["keys"] for p in now["parts"]):
            return None
        return {"columns": _widened(now["columns"], df.schema), "parts": [*now["parts"], {"name": name, "keys": [key]}]}

    added = _commit(spark, path, change)
    if not added:  # the same run has come in between
        jvm, fs = _files(spark, path)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return added


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with all columns; those that a part lacks are null. A table that is not there has neither."""
    return _rows(spark, path, latest(spark, path)[1])


def _rows(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    fields = [{**c, "nullable": True, "metadata": {}} for c in manifest["columns"]]
    schema = StructType.fromJson({"type": "struct", "fields": fields})
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{p['name']}" for p in manifest["parts"]])


def compact(spark: SparkSession, path: str, files: int = 1) -> int:
    """Write the listed parts as one of ``files`` files and list it in their place; the parts that it stands for.

    Parts that are appended meanwhile stay listed beside it. Old parts are kept, as readers may still read them.
    """
    old = latest(spark, path)[1]
    if len(old["parts"]) < 2:
        return 0
    gone = {p["name"] for p in old["parts"]}
    name = _write(_rows(spark, path, old).repartition(files), path)
    keys = [k for p in old["parts"] for k in p["keys"]]

    def change(now: dict) -> dict | None:
        if not gone <= {p["name"] for p in now["parts"]}:
            return None  # another one has put them together
        return {"columns": now["columns"], "parts": [{"name": name, "keys": keys}, *[p for p in now["parts"] if p["name"] not in gone]]}

    return len(gone) if _commit(spark, path, change) else 0
