"""Packing of tokenised documents into fixed sequences: shortest-pack-first over the length histogram.

1. Each document's ids (plus one end id) are cut into pieces of at most ``width`` ids. A piece gets its rank among the
   pieces of its length that its task has seen; only lengths, ranks and checksums are written.
2. The histogram of lengths has at most ``width`` entries, so it is packed on the driver whatever the corpus size:
   lengths are placed longest first, each into the open pattern with the most room, and patterns carry counts.
3. Ranks become global by a running sum of the tasks' counts for each length; rank ``r`` of a length belongs to the
   pattern whose interval of ranks holds ``r``. Patterns are joined back by binary search, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Most pieces of text whose ids a task remembers before it starts afresh.
CACHE = 400_000
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSAFE = re.compile(f" [{_SPACE}]|[{_SPACE}] ")
_SAFE = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit bytes, remembered by piece of text.

    A single space between two characters that are no white space always starts a new word of the vocabulary's
    pattern, so a text may be encoded piece by piece there. The rank file holds the vocabulary of the tokenizer file
    of the same name; tests compare both.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.json")) as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.added = {x: np.array([i], "<u4").tobytes() for x, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                out = np.array(encode(piece), "<u4").tobytes()
                if len(piece) <= 64:
                    self[piece] = out
                return out

        self.known = Known()

    def __call__(self, text: str) -> bytes:
        """Ids of a text; the strings of the vocabulary's added tokens are those tokens wherever they stand."""
        if self.special and self.special.search(text):
            return b"".join(self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(self.special.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        parts = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        # the first piece has no space before it
        return self.known[parts[0]] + b"".join(map(self.known.__getitem__, [" " + p for p in parts[1:]]))


def pack_histogram(counts: dict[int, int], width: int) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths, count)`` that hold every length of the histogram as often as it occurs.

    Lengths go longest first; each goes to the open pattern with the most room left (the shortest pack), as many
    times as that pattern stands, and a pattern that is only partly used is split in two. A length splits one pattern
    and opens two at most, so there are at most three patterns for each length, however often lengths occur.
    """
    room: dict[int, list[tuple[list[int], int]]] = {}
    sizes: list[int] = []  # sorted keys of room
    done: list[tuple[list[int], int]] = []

    def put(pattern: list[int], count: int, left: int) -> None:
        if left == 0:
            done.append((pattern, count))
        elif left in room:
            room[left].append((pattern, count))
        else:
            room[left] = [(pattern, count)]
            insort(sizes, left)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        if not 0 < length <= width:
            raise ValueError(f"length {length} is not in 1..{width}")
        while todo:
            if not sizes or sizes[-1] < length:
                times = width // length  # a new pattern takes the length as often as it fits, if there are so many
                each, rest = divmod(todo, times)
                if each:
                    put([length] * times, each, width - times * length)
                if rest:
                    put([length] * rest, 1, width - rest * length)
                break
            left = sizes[-1]
            pattern, count = room[left].pop()
            if not room[left]:
                del room[left]
                sizes.pop()
            used = min(count, todo)
            if used < count:
                put(pattern, count - used, left)
            put([*pattern, length], used, left - length)
            todo -= used
    return done + [x for left in sizes for x in room[left]]


def _slots(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its intervals, their first sequence ids, their offsets in the sequence."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, count in patterns:
        at = 0
        for length in lengths:
            rank = used.get(length, 0)
            slots.setdefault(length, []).append((rank, first, at))
            used[length] = rank + count
            at += length
        first += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}


def cut_documents(docs: DataFrame, width: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``width`` ids: id, start, length, checksum, ids of the document, task and rank in the task.

    A document that is longer than ``width`` is cut into full pieces and a remainder. Null text: no ids but the end.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, task_rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode, seen = TaskContext.get().partitionId(), Encoder(), {}
        end = np.array([end_id], "<u4").tobytes()
        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field(0).type, *[pa.int64()] * 6]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"]
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = (encode(text) if text else b"") + end
                    n = len(ids) // 4
                    for start in range(0, n, width):
                        piece = ids[start * 4 : (start + width) * 4]
                        length = len(piece) // 4
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        out.append((key, start, length, zlib.crc32(piece), n, task, rank))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, width: int = 2048) -> DataFrame:
    """``pieces`` (of :func:`cut_documents`, already written) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``width`` rows
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(histogram, width)))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])

    names = [c for c in pieces.columns if c not in ("task", "task_rank")]
    kinds = dict(pieces.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = length == value
                ranks, firsts, offsets = table[int(value)]
                at = np.searchsorted(ranks, rank[mine], "right") - 1
                sequence[mine] = firsts[at] + rank[mine] - ranks[at]
                offset[mine] = offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.select(*names, (F.col("task_rank") + F.col("before")).alias("rank")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, width: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document in sequences of at most ``width`` ids; one row for each piece.

    Returns the id, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id`` (gapless from 0) and ``offset``. What
    crosses the network is one row of numbers for each piece; the histogram and the patterns have a size bounded by
    ``width``. Null and empty texts are one piece that holds the end id. Repeated ids are packed as separate
    documents. An empty table gives no rows. Further columns are not read.
    """
    return place_pieces(materialize(cut_documents(docs, width, end_id, id_col, text_col), "pieces"), width)
