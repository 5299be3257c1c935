"""Mixing sources to target weights by capped water-filling. Native SQL only.

1. Sources are ranked by name without a task that sorts them all: ranges of names, counts of the ranges, ranks inside.
2. Water-filling: the level is what is left of the budget, divided by the weights that are still free; a source whose
   level times weight exceeds its cap (epochs times size) is clamped, and its excess goes to the others by weight, until
   none is above. A round is one sum over the sources; only three numbers reach the driver.
3. A source repeats all its documents as often as its target holds its size in full. Of the rest it takes documents in
   the order of a seeded hash; the one at the end of the rest is taken in part, so a source meets its target to a word.

The end of the rest is found by four digits of the hash, 4,096 values each: sums by source and digit, a running sum over
one source's digits, then the same among the documents of the digit at which the rest ends. So no task orders the
documents of a source, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, materialize

#: Weights of the sources in the order of their names, repeating; a document is taken so many times at most.
WEIGHTS, EPOCHS = (1, 2, 3), 3
#: Bits of a digit of the hash, and digits.
BITS, DIGITS = 12, 4
#: Tables of sources are broadcast up to so many rows of names up to so many characters each, else joined by shuffle.
SMALL_ROWS, SMALL_NAME = 10_000, 200


def word_size(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: str, *parts: Column) -> Column:
    """The first 48 bits of a digest of ``seed`` and ``parts``."""
    joined = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.left(F.md5(joined.cast("binary")), F.lit(BITS * DIGITS // 4)), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (distinct names in ``src``) with ``place``: ranks from 0 by code point, null last."""
    ranges = materialize(sources.repartitionByRange(F.col("src").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    # as many rows as there are ranges
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").asc_nulls_last())) - 1
    out = materialize(ranges.withColumn("inside", inside).join(before, "part").select("src", "size", (F.col("before") + F.col("inside")).alias("place")), "ranked")
    discard(ranges)
    return out


def water_level(sources: DataFrame, budget: int) -> float:
    """The level at which the free sources' weights and the clamped sources' caps (columns ``weight, cap``) make ``budget``.

    The level only rises from round to round, so a source that is clamped once stays so; a round without a new one ends.
    If all are clamped (the budget is all caps or more), the level is infinite.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        n, held, free = sources.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n is None or n == clamped:
            return level
        if not free:
            return float("inf")
        level, clamped = (budget - held) / free, n


def _attach(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    """``left`` with the columns of its source in ``right`` (columns ``src`` and others); null is a source as well.

    A table of sources whose bound has been checked is broadcast; a larger one meets the rows by source and a salt, so a
    hot source is dealt over 32 tasks at least.
    """
    right = right.withColumnRenamed("src", "_src")
    if small:
        return left.join(F.broadcast(right), F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    salted = left.withColumn("_own", (F.col("key") % 32).cast("int"))
    return salted.join(right, F.col("src").eqNullSafe(F.col("_src")) & (F.col("_own") == F.col("_salt"))).drop("_src", "_own", "_salt")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """``src, size, target, whole, rest`` by source of ``sized`` (columns ``src, size``).

    ``target`` is the source's part of ``share`` of all sizes, capped at ``epochs`` times its own size. ``whole`` is how
    often its documents are taken in full, ``rest`` the words to take beyond that.
    """
    sources = ranked(sized.groupBy("src").agg(F.sum("size").alias("size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.select("src", "size", weight.cast("long").alias("weight"), (F.col("size") * epochs).alias("cap"))
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = water_level(sources, int(total * share) if share != 1.0 else total)
    target = F.when(F.col("cap") < F.col("weight") * F.lit(level), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    need = F.floor(F.col("target") + 0.5).cast("long")
    out = sources.select("src", "size", target.alias("target")).withColumn("need", need)
    return out.select("src", "size", "target", F.expr("if(size = 0, 0L, need div size)").alias("whole"), F.expr("if(size = 0, 0L, need % size)").alias("rest"))


def _digit(level: int) -> Column:
    return F.shiftright(F.col("key"), BITS * (DIGITS - 1 - level)).bitwiseAND(F.lit((1 << BITS) - 1))


def ends(sized: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """``src, last, left, tied``: the hash at which a source's rest ends, words left for it, words of its documents.

    Documents of a smaller hash are taken, those of a larger one not. Sources without a rest have no row.
    """
    left = sources.where("rest > 0").select("src", "rest", F.lit(0).cast("long").alias("last"))
    for level in range(DIGITS):
        # at the first digit both sides of the test are 0
        near = _attach(sized.select("src", "size", "key"), left, small).where(F.shiftright("key", BITS * (DIGITS - level)) == F.col("last"))
        sums = near.groupBy("src", "rest", "last", _digit(level).alias("digit")).agg(F.sum("size").alias("sum"))
        # a source has 4,096 digits at most
        upto = F.sum("sum").over(Window.partitionBy("src").orderBy("digit"))
        found = sums.withColumn("upto", upto).where("upto >= rest and upto - sum < rest")
        left = materialize(found.select("src", (F.col("rest") - F.col("upto") + F.col("sum")).alias("rest"), (F.shiftleft("last", BITS) + F.col("digit")).alias("last"), F.col("sum").alias("tied")), "digits")
    return left.select("src", "last", F.col("rest").alias("left"), "tied")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: id, ``size, source_size`` (long), ``target`` (double, its source's), ``copies``
    (whole repetitions) and ``taken`` (long, words the mix takes, repetitions counted).

    ``taken`` is ``copies`` times the size, but for the one document of a source at which its rest ends: of that one, its
    first ``taken - copies * size`` words are taken once more. Each source's taken words are its target, rounded, unless
    rows tie: rows that agree in id and text share what is left for them alike, each rounded down, so one word a row may
    be missing. No document exceeds ``epochs`` times its size. The order of documents depends on ``seed``, id and text
    alone, so reruns agree, however the rows are dealt.

    A null source is a source, the last one. A null or empty text has the size 0, and a source without words the target 0.
    Null ids are an id like any other. An empty table gives no rows; further columns, whatever their names, are not read.
    """
    kind = F.col(id_col).alias("doc")
    sized = materialize(docs.select(kind, F.col(source_col).cast("string").alias("src"), word_size(F.col(text_col)).alias("size"), seeded(seed, F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key")), "sized")
    sources = materialize(targets(sized, weights, epochs, share), "targets")
    n, longest = sources.agg(F.count("*"), F.max(F.length("src"))).first()
    small = n <= SMALL_ROWS and (longest or 0) <= SMALL_NAME
    plan = sources
    last = ends(sized, sources, small).withColumnRenamed("src", "_of")
    plan = materialize(plan.join(last, F.col("src").eqNullSafe(F.col("_of")), "left").drop("_of").withColumnRenamed("size", "source_size"), "plan")
    both = _attach(sized, plan, small)
    part = F.when(F.col("key") < F.col("last"), F.col("size")).when(F.col("key") == F.col("last"), F.expr("size * left div tied")).otherwise(0)
    part = F.coalesce(part, F.lit(0))
    copies = F.col("whole") + (F.col("size") > 0).cast("long") * (part >= F.col("size")).cast("long")
    return both.select(F.col("doc").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("whole") * F.col("size") + part).alias("taken"))
