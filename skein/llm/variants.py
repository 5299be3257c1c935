"""Spelling variants: words one edit apart, by two-dimensional range reporting on wavelet trees.

A word that differs from ``w`` by one edit at place ``i`` starts with the first ``i`` letters of ``w`` and ends with the
letters of ``w`` behind the edit. In a list of words of one length, those that start so are an interval of the list in
forward order, those that end so an interval of the list in reverse order (words read backwards). A wavelet tree over the
reverse ranks, in forward order, reports the words in both.

The lists are cut, so that no task holds them all. Of an edit's two sides one has half of the letters at least. For edits
in the second half of a word, the words that start with its first half lie together in forward order: the list of a length
is cut in that order, and a word is sent to the pieces in which its first half occurs. Edits in the first half are the
same with all words read backwards. So each piece has its own two orders and its own tree, and no pair is missed.

Letters are the code points up to U+00FF, so a word of a piece is a row of bytes (Latin-1), compared by NumPy as a whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, share_of

#: Words have so many code points and occurrences at least; a form is so many times as frequent as its word.
MIN_CHARS, MIN_COUNT, FACTOR = 5, 3, 2
#: A word loses a letter where a hash of its document and itself is divisible by this (a stand-in for misspellings).
SPOILT = 97
#: Words of a piece, pieces of one length at most, words of the sample from which the cuts are taken, letters of a cut.
PIECE, PIECES, SAMPLE, CUT = 25_000, 4096, 100_000, 64
#: Words that a task counts before it hands on its sums; bytes of words that are built at once.
HELD, ROOM = 400_000, 1 << 24

#: Runs of letters of lower-cased UTF-8: a-z and U+00C0..U+00FF, whose first byte is C3.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(key: object, text: str, spoilt: int = SPOILT) -> Counter[str]:
    """Words of a text with counts. ``spoilt`` = 0 takes them as they are."""
    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
    out: Counter[str] = Counter()
    for run, n in Counter(_RUN.findall(text.encode("utf-8", "replace").translate(_LOWER))).items():
        word = run.decode()
        if spoilt and (h := zlib.crc32(run, seed)) % spoilt == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_count: int, spoilt: int) -> DataFrame:
    """``word, n``: words of ``min_chars`` letters and ``min_count`` occurrences or more. Counts meet in the task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(key, text, spoilt).items():
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) > HELD:
                    yield give()
                    held.clear()
        if held:
            yield give()

    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WaveletTree:
    """Wavelet tree of a permutation, by levels of bits from the highest: reports the values of an index range that lie in
    a value range, for many queries at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        now = values.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            zero = (now >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))))  # zeros before each place of the level
            now = np.concatenate((now[zero], now[~zero]))

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, value)`` for all places lo <= i < hi whose value v has low <= v < high."""
        query, start = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        a, b = lo.astype(np.int64), hi.astype(np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = self.bits - 1 - level
            a0, b0 = zeros[a], zeros[b]
            turn = zeros[-1]
            # a node holds the values start .. start + 2**bit - 1 of its half
            query, start = np.concatenate((query, query)), np.concatenate((start, start + (1 << bit)))
            a, b = np.concatenate((a0, turn + a - a0)), np.concatenate((b0, turn + b - b0))
            keep = (a < b) & (start < high[query]) & (start + (1 << bit) > low[query])
            query, start, a, b = query[keep], start[keep], a[keep], b[keep]
        return query, start


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, filled with zeros, which sort before all letters."""
    return np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, width), np.uint8)


def _text(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common start of each pair of rows."""
    same = x == y
    return np.where(same.all(1), x.shape[1], same.argmin(1))


def _most_in_common(ordered: np.ndarray, query: np.ndarray, itself: bool) -> np.ndarray:
    """The longest start that each row of ``query`` shares with a row of ``ordered`` (sorted) other than itself."""
    at = np.searchsorted(_text(ordered), _text(query))
    best = np.zeros(len(query), np.int64)
    for step in (-1, 0, 1) if itself else (-1, 0):
        there = (at + step >= 0) & (at + step < len(ordered))
        rows = np.flatnonzero(there)
        shared = _agree(ordered[at[rows] + step], query[rows])
        if itself:
            shared[shared == query.shape[1]] = 0
        best[rows] = np.maximum(best[rows], shared)
    return best


def _interval(ordered: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows of ``ordered`` that start with the first ``size`` letters of each row."""
    text = _text(ordered)
    inside = np.arange(rows.shape[1]) < size[:, None]
    return np.searchsorted(text, _text(np.where(inside, rows, 0))), np.searchsorted(text, _text(np.where(inside, rows, 255)), "right")


def least_start(size: int, more: int, back: bool) -> int:
    """Letters before the edits that are looked for in forward order, or (``back``) in the words read backwards.

    Forward order has the edits from the middle on, backward order exactly the others; ``more`` letters are added.
    """
    return size - size // 2 + more if back else size // 2


def near_in_piece(own: list[bytes], query: list[bytes], back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(index into query, index into own)`` of words that differ by one edit behind :func:`least_start` letters.

    All words of ``own`` are of one length, those of ``query`` of the same (a letter is replaced) or of one less (a letter
    of the other word is added); both hold a word once, read backwards if ``back``. An added letter counts at the first of
    the places (read forwards) that give the same word. A place is tried only if its start and its end occur in another
    word at all, which the neighbours in both orders tell.
    """
    none = np.zeros(0, np.int64)
    if not own or not query:
        return none, none
    width, size = len(own[0]), len(query[0])
    same = width == size
    mine, asked = _matrix(own, width), _matrix(query, width)
    turn = lambda rows, n: np.concatenate((rows[:, :n][:, ::-1], rows[:, n:]), 1)
    order = np.argsort(_text(mine), kind="stable")
    forward = mine[order]
    turned, asked_back = turn(mine, width), turn(asked, size)
    by_end = np.argsort(_text(turned), kind="stable")
    reverse = turned[by_end]
    rank = np.empty(len(own), np.int64)
    rank[by_end] = np.arange(len(own))
    tree = WaveletTree(rank[order])
    at = np.minimum(np.searchsorted(_text(forward), _text(asked)), len(own) - 1)
    itself = (_text(forward)[at] == _text(asked)).astype(np.int64)  # the query is in this piece: no other word, if alone
    # places of an edit: the start is i letters, the end width - 1 - i
    first = np.maximum(least_start(size, width - size, back), width - 1 - _most_in_common(reverse, asked_back, same))
    last = np.minimum(width - 1, _most_in_common(forward, asked, same))
    n = np.maximum(0, last - first + 1)
    found_q, found_o = [none], [none]
    upto = np.cumsum(n)
    step = max(1, ROOM // width)
    for at in range(0, int(upto[-1]), step):
        k = np.arange(at, min(at + step, int(upto[-1])))
        q = np.searchsorted(upto, k, "right")
        i = first[q] + k - (upto[q] - n[q])
        lo, hi = _interval(forward, asked[q], i)
        low, high = _interval(reverse, asked_back[q], width - 1 - i)
        go = np.flatnonzero((hi - lo > itself[q]) & (high - low > itself[q]))
        hit, value = tree.report(lo[go], hi[go], low[go], high[go])
        x, hit = by_end[value], go[hit]
        if same:
            good = _text(mine)[x] != _text(asked)[q[hit]]
        else:
            place = i[hit]
            before = np.clip(place + (1 if back else -1), 0, width - 1)
            good = (before == place) | (mine[x, place] != mine[x, before])
        found_q.append(q[hit][good])
        found_o.append(x[good])
    return np.concatenate(found_q), np.concatenate(found_o)


def _cuts(words: DataFrame, back: bool) -> dict[int, list[str]]:
    """Where the lists of each length are cut: quantiles of a sample of about ``SAMPLE`` words, ``CUT`` letters each.

    At most ``PIECES`` cuts of a length of up to ``PIECE`` words a piece, and at most ``SAMPLE`` in all.
    """
    total = words.count()
    read = F.reverse("word") if back else F.col("word")
    picked = words.where(share_of(F.col("word"), SAMPLE, total)).select(F.col("size"), F.left(read, F.lit(CUT)).alias("head")).collect()
    out: dict[int, list[str]] = {}
    for size in {r["size"] for r in picked}:
        heads = sorted(r["head"] for r in picked if r["size"] == size)
        pieces = min(PIECES, len(heads), -(-len(heads) * max(total, SAMPLE) // (SAMPLE if total > SAMPLE else total) // PIECE) if total > SAMPLE else -(-len(heads) // PIECE))
        out[size] = sorted({heads[k * len(heads) // pieces] for k in range(1, pieces)})
    return out


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` for each word of ``words`` (distinct, ``word, n``) with a near one: their number, and the
    most frequent of them (of several the smallest) as ``struct<m, form>`` with ``m`` its negative count."""
    sized = words.withColumn("size", F.length("word"))
    shipped = sized.sparkSession.sparkContext.broadcast([_cuts(sized, False), _cuts(sized, True)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["side", "size", "piece", "word", "n", "own", "role"]
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(word)
                for side, cuts in enumerate(shipped.value):
                    read = word[::-1] if side else word
                    mine = bisect_right(cuts.get(size, []), read[:CUT])
                    out.append((side, size, mine, read, n, True, 0))
                    for more in (0, 1):
                        at, half = cuts.get(size + more, []), read[: least_start(size, more, bool(side))][:CUT]
                        # words that start so lie from here to there
                        for piece in range(bisect_left(at, half), bisect_right(at, half + "\xff" * (CUT - len(half))) + 1):
                            out.append((side, size + more, piece, read, n, False, more))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int32())], names=names)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        side = bool(key[0].as_py())
        rows = list(zip(*(table.column(c).to_pylist() for c in ("word", "n", "own", "role")), strict=True))
        plain = lambda w: w[::-1] if side else w
        own = [(w.encode("latin-1"), plain(w), n) for w, n, mine, _ in rows if mine]
        best: dict[str, list] = {}

        def note(word: str, n: int, other: str) -> None:
            if (b := best.get(word)) is None:
                best[word] = [1, -n, other]
            else:
                b[0] += 1
                if (-n, other) < (b[1], b[2]):
                    b[1:] = -n, other

        for role in (0, 1):
            asked = [(w.encode("latin-1"), plain(w), n) for w, n, mine, r in rows if not mine and r == role]
            for q, o in zip(*(a.tolist() for a in near_in_piece([w[0] for w in own], [w[0] for w in asked], side)), strict=True):
                (_, x, nx), (_, y, ny) = asked[q], own[o]
                note(x, ny, y)
                if role:  # the longer word is not asked for the shorter one
                    note(y, nx, x)
        values = list(best.values())
        return pa.table({"word": pa.array(list(best), pa.string()), "n_near": pa.array([v[0] for v in values], pa.int64()), "m": pa.array([v[1] for v in values], pa.int64()), "form": pa.array([v[2] for v in values], pa.string())})

    dealt = words.select("word", "n").mapInArrow(deal, "side int, size int, piece int, word string, n long, own boolean, role int")
    part = dealt.groupBy("side", "size", "piece").applyInArrow(search, "word string, n_near long, m long, form string")
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: forms followed to the last, by rounds of pointer doubling.

    Counts at least double from a word to its form, so chains are short and have no cycle.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        now = new.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, spoilt: int = SPOILT) -> DataFrame:
    """One row for each word of ``docs``: ``word, form, root`` (string), ``n, n_near, form_n`` (long).

    Words are runs of the letters A-Z (lower-cased), a-z and U+00C0..U+00FF of ``min_chars`` letters or more that occur
    ``min_count`` times or more in all; in each document a word whose hash ``spoilt`` divides loses a letter first (0:
    none does). Two words are near if one letter is added, dropped or replaced. A word's form is its most frequent near
    word, of several the smallest by code point, if that one is at least ``factor`` times as frequent; else null.
    ``root`` is the last of the chain of forms, or the word itself.

    ``min_chars`` is 4 at least, so that either half of a word has two letters. Null and empty texts have no words; a null
    id counts as the empty one in the hash; repeated rows count each; very long words cost what their letters cost, but
    for words that share half of their letters and more. An empty table gives no rows; further columns, whatever their
    names, are not read.
    """
    words = materialize(vocabulary(docs, id_col, text_col, min_chars, min_count, spoilt), "words")
    near = materialize(near_words(words), "near")
    joined = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best")).alias("best")), "joined")
    last = roots(joined.where("best is not null").select("word", F.col("best.form").alias("form")))
    return joined.join(last, "word", "left").select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.m")).alias("form_n"))
