"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by an error budget that grows with its length. It is cut into budget-plus-one
pieces: a passage within the budget holds one piece unchanged. Pieces of a block of items are found by one automaton;
around each hit the whole item is verified with Myers' bit-parallel distance. Case (A-Z) and white space are levelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_many

#: One edit for so many characters of an item.
CHARS_PER_EDIT = 16
#: Most characters of the items that are searched for at once; larger benchmarks take more passes.
BLOCK_CHARS = 4_000_000


def level(text: str) -> str:
    """A-Z lowered, each run of white space one space, trimmed."""
    # bytes know A-Z and ASCII white space only, which are never part of another character
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def places(text: str) -> list[int]:
    """For each character of ``level(text)`` its place in ``text``; one more entry for the end."""
    out, last = [], True
    for i, c in enumerate(text):
        gap = c == " " or "\t" <= c <= "\r"
        if not gap or not last:
            out.append(i)
        last = gap
    if out and last:
        out.pop()
    return [*out, out[-1] + 1 if out else 0]


def budget(n: int) -> int:
    """Edits that an item of ``n`` characters may differ by."""
    return n // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """Budget-plus-one pieces of nearly equal length with their offsets."""
    n, k = len(item), budget(len(item)) + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of ``text``, and the first end where it is reached (Myers 1999).

    ``anchored``: the part starts where the text starts.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    carry = 1 if anchored else 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | carry) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.items = [(key, text, masks_of(text), masks_of(text[::-1])) for key, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for at, piece in pieces(text):
                found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def levelled(self, text: str) -> list[tuple[int, int, int, int]]:
        """``place of the item, distance, start, end`` in a levelled text: the best match of each item."""
        if self.empty or not text:
            return []
        spans: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, at in where:
                spans.setdefault(i, set()).add(end + 1 - size - at)
        out = []
        for i, starts in spans.items():
            _, item, masks, back = self.items[i]
            m, e = len(item), budget(len(item))
            if e == 0:  # a short item, which must not lie inside a word: each start by itself
                outer = lambda a, b: not (a and text[a - 1].isalnum() and item[0].isalnum() or b < len(text) and text[b].isalnum() and item[-1].isalnum())  # noqa: B023, E731
                first = next((s for s in sorted(starts) if outer(s, s + m)), None)
                if first is not None:
                    out.append((i, 0, first, first + m))
                continue
            windows: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - e), s + m + e
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
            best = None
            for a, b in windows:
                part = text[a:b]
                d, end = best_end(masks, m, part)
                if d > e or best and best[1] <= d:
                    continue
                size = best_end(back, m, part[:end][::-1], anchored=True)[1]
                start, stop = a + end - size, a + end
                best = (i, d, start, stop)
            if best:
                out.append(best)
        return out

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``item, distance, start, end`` in the text itself (code points, end exclusive)."""
        if not text:
            return []
        found = self.levelled(level(text))
        if not found:
            return []
        at = places(text)
        return [(self.items[i][0], d, at[a], at[b - 1] + 1 if b else 0) for i, d, a, b in sorted(found)]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, levelled, in blocks of bounded size; null and blank items are left out, equal rows count once."""
    block, size = [], 0
    rows = benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).distinct().orderBy(item_col, text_col)
    for key, text in rows.toLocalIterator():
        text = level(text)
        if text:
            block.append((key, text))
            size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that it holds within the error budget: ids, ``distance, start, end``.

    ``start`` and ``end`` are code points of the document's text. Of several matches the closest counts, then the
    first. The benchmark is a stated query set: it is read in blocks of ``BLOCK_CHARS`` characters, each of which is
    searched for in all documents, without a shuffle. Items with a budget of 0 must stand between word ends. Null and
    empty texts and an empty benchmark give no rows; repeated documents give repeated rows; an item id that stands for
    several texts gives a row for each; further columns are not read.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, `{item_col}` {dict(benchmark.dtypes)[item_col]}, distance long, start long, end long"
    out = spark.createDataFrame([], schema)
    for k, block in enumerate(item_blocks(benchmark, item_col, item_text_col)):
        shipped = spark.sparkContext.broadcast(block)

        def make(shipped=shipped):
            match = Matcher(shipped.value)
            return lambda key, text: [(key, *m) for m in match(text)]

        part = map_many(docs.select(id_col, text_col), make, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item within its error budget, with all their columns; one pass for a block."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text_col):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            match = Matcher(shipped.value)
            for batch in batches:
                yield batch.filter(pa.array([not t or not match.levelled(level(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
