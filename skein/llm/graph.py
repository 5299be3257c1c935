"""Connected components of an undirected edge table, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _towards(edges: DataFrame, low: str, high: str) -> DataFrame:
    """Edges (node, neighbour) of both or one direction as columns u, v."""
    return edges.select(F.col(low).alias("u"), F.col(high).alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` (smallest node of its component) for every node of ``edges`` (columns ``a``, ``b``).

    Large star: every node's larger neighbours move to its smallest neighbour; small star: the others do. A node's
    smallest neighbour is a grouped minimum, so a hub is pre-aggregated and the join that follows may be split. Rounds
    grow with the logarithm of the diameter; each is written to the shared folder. Loops and nulls are left out. What the
    result reads can be discarded (:func:`.shared.discard`) once it has been written elsewhere.
    """
    norm = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(norm, "edges")
    mark = None
    for _ in range(most_rounds):
        both = _towards(now, "a", "b").unionByName(_towards(now, "b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "edges")
        down = _towards(large, "a", "b")  # v < u holds
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        small = materialize(small, "edges")
        discard(now)
        discard(large)
        now = small
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if mark == was or not mark[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._skein_path = now._skein_path
    return out
