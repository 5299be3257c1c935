"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution over hashed character trigrams, fitted from labelled texts. A document is a
mixture of languages: expectation-maximisation estimates the proportions from its trigram counts, and the set of
languages is chosen by penalised likelihood (a language stays only if it raises the log-likelihood by more than the
penalty of one more parameter).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, map_batches

#: Trigrams are hashed to so many buckets.
BUCKETS = 1 << 15
#: The fit reads at most so many labelled rows of a language, those with the smallest hash of their id.
FIT_ROWS = 2000
#: Rounds of expectation-maximisation, and the penalty (times the log of the number of trigrams) of a language.
ROUNDS, PENALTY = 12, 2.0


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the trigrams of the lower-cased words; anything but letters parts words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0)
    letter = (codes >= 0x61) & (codes <= 0x7A)
    wide = codes >= 0x80
    if wide.any():
        values, back = np.unique(codes[wide], return_inverse=True)
        letter[wide] = np.array([chr(v).isalpha() for v in values.tolist()])[back]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    # runs of separators count once
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    key = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    key = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)
    count = np.bincount(key.astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


def mixture(logs: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Proportions of all languages (rows of ``logs``: log-probabilities of the document's trigrams), and the set.

    EM runs over all languages first; then, from the largest share down, a language joins the set if the penalised
    log-likelihood grows, and EM over the final set gives the proportions. Others have the proportion 0.
    """
    languages, total = len(logs), count.sum()
    like = np.exp(logs - logs.max(0))

    def fit(rows: list[int]) -> tuple[np.ndarray, float]:
        p, part = np.full(len(rows), 1 / len(rows)), like[rows]
        for _ in range(ROUNDS if len(rows) > 1 else 0):
            mix = p @ part
            p = np.maximum(p * (part @ (count / mix)) / total, 1e-12)
            p /= p.sum()
        return p, float(count @ np.log(np.maximum(p @ part, 1e-300)))

    p, _ = fit(list(range(languages)))
    order = sorted(range(languages), key=lambda i: (-p[i], i))
    chosen = order[:1]
    best, value = fit(chosen)
    for extra in order[1:]:
        if p[extra] < 0.02:
            break
        new, more = fit([*chosen, extra])
        if more - value <= PENALTY * np.log(total + 1):
            break
        chosen, best, value = [*chosen, extra], new, more
    out = np.zeros(languages)
    out[chosen] = best
    return out, chosen


class LanguageModel:
    """Log-probabilities of the buckets by language."""

    def __init__(self, names: list[str], logs: np.ndarray) -> None:
        self.names, self.logs = names, logs

    def __call__(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Best language, its proportion, and the chosen set with proportions. ``und`` without any letter."""
        at, count = trigram_counts(text) if text else (np.zeros(0, np.int64), None)
        if not len(at) or not self.names:
            return "und", 0.0, []
        share, chosen = mixture(self.logs[:, at], count)
        best = min(chosen, key=lambda i: (-share[i], i))
        return self.names[best], min(1.0, float(share[best])), [(self.names[i], float(share[i])) for i in chosen]


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on at most ``rows`` labelled rows of each language that are not held out; counts are summed in Spark.

    Rows without text or language are left out. What reaches the driver is one array of ``BUCKETS`` counts for each
    language. Without any labelled row every prediction is ``und``.
    """
    fit = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = {r[0]: r[1] for r in fit.groupBy(lang_col).count().collect()}  # one row for each language
    if not n:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    # a share of each language by a hash of the id; the hash spreads evenly, so the bound is met but for chance
    share = F.lit(0)
    for name, count in n.items():
        share = F.when(F.col(lang_col) == name, F.lit(min(1 << 20, int((1 << 20) * rows / count) + 1))).otherwise(share)
    picked = fit.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share).select(lang_col, text_col)

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, c = trigram_counts(text)
                sums.setdefault(lang, np.zeros(BUCKETS))[at] += c
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.float64())], names=["lang", "bucket", "n"])

    sums = picked.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    names, logs = [], []
    for r in sorted(sums.collect(), key=lambda r: r["lang"]):
        c = np.full(BUCKETS, 0.02)
        c[np.array(r["b"])] += np.array(r["n"])
        names.append(r["lang"])
        logs.append(np.log(c / c.sum()))
    return LanguageModel(names, np.array(logs) if logs else np.zeros((0, BUCKETS)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``held_out``, ``lang_pred``, ``score`` (its proportion), ``languages``.

    ``languages`` lists the chosen set as ``name:proportion``. A text that is null, empty or has no letter gives
    ``und`` with score 0. Map only; repeated rows give repeated results; further columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shipped.value

        def one(key, out, text):
            name, score, chosen = model(text)
            return key, out, name, round(score, 6), ",".join(f"{k}:{v:.4f}" for k, v in chosen)

        return one

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("_out"), text_col), make, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, languages string")
