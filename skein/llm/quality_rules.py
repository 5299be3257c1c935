"""Quality rules: compression bands over the whole text and over fixed chunks, beside plain word statistics.

Repetitive text compresses far better than prose of its length, and noise far worse. Every text gets the ratio
``raw bytes / zstandard bytes`` as a whole and for each chunk of fixed size; limits depend on the length, because a
longer text offers the compressor more to refer back to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .shared import WORD, map_batches

_WORD = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio. ``whole``: (bytes up to, lowest, highest); the last row holds for all longer texts.

    From 257 to 65,536 bytes a limit is a quantile of the ratios of the labelled clean rows of that length which the
    base rule passes and which are not held out (sf0.1, 2,432 rows): the 99 % quantile and 3 % above it, or 6 % where
    there are fewer than 30 rows; the 1 % quantile and 10 % below it. No labelled row is shorter or longer; there the
    limits are loose. Chunk limits come from the same rows' chunks in the same way.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (256, 0.45, 2.4), (362, 1.31, 1.7), (512, 1.3, 1.87), (724, 1.33, 1.87), (1024, 1.45, 1.99), (1448, 1.59, 2.07), (2048, 1.69, 2.14),
        (2896, 1.76, 2.2), (4096, 1.84, 2.27), (5792, 1.92, 2.34), (8192, 1.93, 2.39), (11585, 2.0, 2.43), (16384, 2.05, 2.55),
        (65536, 2.11, 2.63), (float("inf"), 1.5, 3.4),
    )
    chunk_bytes: int = 2048
    #: Chunks (the last one only if it has half the size) outside these limits are bad; the text fails if more than
    #: this share of its chunks is bad.
    chunk: tuple[float, float] = (1.65, 2.16)
    bad_share: float = 0.34
    min_words: int = field(default=50)
    repeat_percent: int = field(default=50)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n + 2)
    size = len(number)
    if size == n + 2:
        return 0
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # three ids do not fit into 63 bits
        pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
        key = pair * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def word_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORD.findall(text)
    seen: set[str] = set()
    duplicate = 0
    for line in text.split("\n"):
        if line in seen:
            duplicate += 1
        elif _WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), duplicate, repeated_words(words)


def compression_verdict(data: bytes, compress, bands: Bands) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bad chunks, verdict. An empty text passes with ratio 0."""
    if not data:
        return 0.0, 0.0, True
    ratio = len(data) / len(compress(data))
    low, high = next((a, b) for top, a, b in bands.whole if len(data) <= top)
    step, bad, count = bands.chunk_bytes, 0, 0
    for at in range(0, len(data), step):
        part = data[at : at + step]
        if len(part) * 2 >= step:
            count += 1
            bad += not bands.chunk[0] <= len(part) / len(compress(part)) <= bands.chunk[1]
    share = bad / count if count else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.bad_share


def verdict(text: str | None, compress, bands: Bands) -> bool:
    """Whether a text is kept."""
    words = _WORD.findall(text or "")
    if len(words) < bands.min_words or 100 * repeated_words(words) > bands.repeat_percent * len(words):
        return False
    return compression_verdict(text.encode(), compress, bands)[2]


def score_quality(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row for each row of ``docs``: the word statistics, the base rule, the ratios and ``kept``.

    ``kept`` is false if the base rule fails (fewer than ``min_words`` words, or more than ``repeat_percent`` percent
    of the words in repeated windows), else the verdict of the compression bands. Map only, no shuffle. A null text
    has no words, so it fails; an empty table gives no rows; repeated rows give repeated results; further columns are
    not read.
    """

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress

        def one(key, text):
            text = text or ""
            n, chars, symbols, duplicate, repeat = word_statistics(text)
            ratio, share, good = compression_verdict(text.encode(), compress, bands)
            failed = n < bands.min_words or 100 * repeat > bands.repeat_percent * n
            return key, n, chars, symbols, duplicate, repeat, failed, not failed and good, round(ratio, 6), round(share, 6)

        return one

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double")


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that :func:`score_quality` keeps, with all their columns; one pass, no join."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            keep = [verdict(t, compress, bands) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
