"""CSV with quoted line feeds, read by byte ranges in parallel.

A range of a file does not tell by itself whether it begins inside quotes. So each range is summed up first, for both
cases: how it leaves the next range, and how many records begin in it. Such a sum is a map of two states (outside or
inside quotes), and maps are chained by a running prefix: a range that leaves one state whatever came before fixes it,
and those behind only keep it or turn it. Then every range is read again from its true state and cut at true line ends.
Records that lie in one range are done there; the few pieces of those that cross a range's end meet by shuffle.

Two reads of the file, one row a range and two pieces a range are all that moves. Quotes follow RFC 4180: a field that
begins with a quote ends with one, two quotes inside are one; a quote within an unquoted field is a character.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.store import materialize

#: Up to so many ranges (a row of a path and four numbers each) are broadcast to the second read; more meet by shuffle.
FEW_RANGES = 100_000

_SUMS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_()), ("n_out", pa.int64()), ("n_in", pa.int64())])
_PARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
#: Kinds of parts: a whole record, the first part of one, one that goes on from the range before and ends, or does not.
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def inside_after(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether the end of ``line`` lies inside quotes, if its start does or not."""
    if '"' not in line:
        return inside
    at, size = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
            at += 1
        elif at < size and line[at] == '"':
            inside = True
            at += 1
            continue
        # what is left of a field up to the delimiter is text
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line`` in the order of each range; ``block`` is where the range begins in its file."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str], bool]]:
    """Runs of lines of one range within a batch, and whether the range is new."""
    last = None
    for batch in batches:
        files, blocks, lines = (batch.column(n).to_pylist() for n in range(3))
        k = 0
        while k < len(lines):
            n = k + 1
            while n < len(lines) and blocks[n] == blocks[k] and files[n] == files[k]:
                n += 1
            yield files[k], blocks[k], lines[k:n], (files[k], blocks[k]) != last
            last, k = (files[k], blocks[k]), n


def _blank(line: str) -> bool:
    return not line or line == "\r"


def _sum_up(delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        give = lambda row: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SUMS, strict=True)], schema=_SUMS)
        for file, block, lines, new in _ranges(batches):
            if new:
                if now:
                    yield give(now)
                now = [file, block, False, True, 0, 0]
            for line in lines:
                out, into = now[2], now[3]
                now[4] += not out and not _blank(line)
                now[5] += not into and not _blank(line)
                if '"' in line:
                    now[2] = inside_after(line, out, delimiter)
                    now[3] = now[2] if out == into else inside_after(line, into, delimiter)
        if now:
            yield give(now)

    return run


def range_states(sums: DataFrame) -> DataFrame:
    """``file, block, inside, before``: the state in which each range begins and the records that begin before it, in all
    files in the order of their names; and ``open``: whether its file ends inside quotes."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("after_out") & ~F.col("after_in")).cast("long")).over(before), F.lit(0))
    seen = sums.withColumn("turns", turns)
    # the last range before that leaves one state whatever came before, and the turns up to and with it (it is no turn)
    fixed = F.last(F.when(F.col("after_out") == F.col("after_in"), F.struct("after_out", "turns")), ignorenulls=True).over(before)
    seen = seen.withColumn("fixed", fixed)
    odd = (F.col("turns") - F.coalesce(F.col("fixed.turns"), F.lit(0))) % 2 == 1
    seen = seen.withColumn("inside", F.coalesce(F.col("fixed.after_out"), F.lit(False)) != odd)
    seen = seen.withColumn("n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.last(F.when(F.col("inside"), F.col("after_in")).otherwise(F.col("after_out"))).over(whole)
    seen = seen.withColumn("open", ends).withColumn("here", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = seen.groupBy("file").agg(F.sum("n").alias("n"))
    # one row a file
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return seen.join(files, "file").select("file", "block", "inside", (F.col("earlier") + F.col("here")).alias("before"), "open")


def _cut(delimiter: str):
    """Parts of records from rows ``file, block, line, inside, before`` in the order of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, held, inside, carried, row = None, [], False, False, 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARTS, strict=True)], schema=_PARTS)

        def close(done: bool) -> None:
            nonlocal row
            kind = (TAIL if done else MIDDLE) if carried else WHOLE if done else HEAD
            out.append((*at, -1 if carried else row, kind, "\n".join(held)))
            row += not carried
            held.clear()

        for batch in batches:
            for file, block, line, starts, before in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                if (file, block) != at:
                    if held:
                        close(False)
                    if starts is None:
                        raise ValueError(f"the ranges of {file} have changed between two reads")
                    at, inside, carried, row = (file, block), starts, starts, before
                if not inside and not held and _blank(line):
                    continue
                held.append(line)
                inside = inside_after(line, inside, delimiter)
                if not inside:
                    close(True)
                    carried = False
                if len(out) >= 2048:
                    yield give()
                    out.clear()
        if held:
            close(False)
        if out:
            yield give()

    return run


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``file, row, record``: the records of CSV files, numbered from 0 without gaps, files in the order of their names.

    Blank lines between records are none; a carriage return before the line feed that ends a record is not of it. A file
    whose last quote is not closed is an error, since no record of it can be trusted. An empty file has no records.
    """
    lines = _lines(spark, path)
    sums = lines.mapInArrow(_sum_up(delimiter), "file string, block long, after_out boolean, after_in boolean, n_out long, n_in long")
    states = materialize(range_states(sums), "ranges")
    n, broken = states.agg(F.count("*"), F.min(F.when(F.col("open"), F.col("file")))).first()
    if broken:
        raise ValueError(f"{broken}: a quoted field is not closed at the end of the file")
    known = states.select("file", "block", "inside", "before")
    if n <= FEW_RANGES:
        ready = lines.join(F.broadcast(known), ["file", "block"], "left")
    else:
        ready = lines.withColumn("place", F.monotonically_increasing_id()).join(known, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "place")
    parts = ready.select("file", "block", "line", "inside", "before").mapInArrow(_cut(delimiter), "file string, block long, row long, kind int, record string")
    whole = parts.where(F.col("kind") == WHOLE).select("file", "row", "record")
    split = parts.where(F.col("kind") != WHOLE)
    # two parts of a range at most: one that goes on from the range before, then one that begins a record
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == HEAD)
    begun = F.last(F.when(F.col("kind") == HEAD, F.col("row")), ignorenulls=True).over(order)
    pieces = split.withColumn("row", begun).groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == HEAD).alias("head"), "record"))).alias("all"))
    # of one range the part that begins the record counts; it has no other of this record
    joined = pieces.select("file", "row", F.array_join(F.transform("all", lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(joined).select("file", "row", F.regexp_replace("record", r"\r\z", "").alias("record"))


def read_csv_ranges(spark: SparkSession, path: str, delimiter: str = ",", missing: tuple[str, ...] = ()) -> DataFrame:
    """The columns of CSV files with one header, as texts, and ``row_id`` in file order, by :func:`csv_records`.

    The header is the first record of each file and must be the same in all. Values in ``missing`` become null; a record
    with fewer fields has nulls at the end, further fields are left out. ``row_id`` starts at 0 and has no gaps.
    """
    records = csv_records(spark, path, delimiter)
    first = records.groupBy("file").agg(F.min_by("record", "row").alias("record"), F.min("row").alias("at")).select("file", "at", "record")
    heads = first.select("record").distinct().limit(2).collect()
    if not heads:
        return spark.createDataFrame([], "row_id long")
    if len(heads) > 1:
        raise ValueError(f"{path}: files with different headers")
    options = {"sep": delimiter, "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    names = next(csv.reader(io.StringIO(heads[0][0], newline=""), delimiter=delimiter))
    fields = ", ".join(f"_f{k} string" for k in range(len(names)))
    starts = first.select("file", "at", (F.row_number().over(Window.orderBy("at"))).cast("long").alias("headers"))  # one row a file
    rows = records.join(F.broadcast(starts), "file").where("row > at")
    out = rows.select((F.col("row") - F.col("headers")).alias("row_id"), F.from_csv("record", fields, options).alias("r"))
    value = lambda k: F.when(~F.col(f"r._f{k}").isin(*missing), F.col(f"r._f{k}")) if missing else F.col(f"r._f{k}")
    return out.select(*[value(k).alias(n) for k, n in enumerate(names)], "row_id")
