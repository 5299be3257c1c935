"""Partition metrics. One contingency table feeds all but TurboMQ; every table carries ``dataset``.

``pairs``: ``dataset, entity, a, b`` with the recovered cluster ``a`` and the true one ``b``.
``assigned``: ``dataset, entity, cluster``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

THRESHOLDS = (0.33, 0.5, 0.66, 0.8)


def align(recovered: DataFrame, truth: DataFrame) -> DataFrame:
    """Entities that both partitions hold, with both clusters."""
    a = recovered.select("dataset", "entity", F.col("cluster").alias("a"))
    return a.join(truth.select("dataset", "entity", F.col("cluster").alias("b")), ["dataset", "entity"])


def contingency(pairs: DataFrame) -> DataFrame:
    """``dataset, a, b, n``."""
    return pairs.groupBy("dataset", "a", "b").agg(F.count("*").alias("n"))


def _margins(table: DataFrame) -> DataFrame:
    """The contingency table with both margins."""
    return table.withColumn("na", F.sum("n").over(Window.partitionBy("dataset", "a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("dataset", "b")))


def _choose2(c: str):
    return (F.col(c).cast("double") * (F.col(c) - 1)) / 2


def ari(table: DataFrame) -> DataFrame:
    """``dataset, ari``: adjusted Rand index; 1 where it is not defined."""
    one = lambda key: table.groupBy("dataset", key).agg(F.sum("n").alias("m")).groupBy("dataset").agg(F.sum(_choose2("m")).alias(f"s{key}"))
    both = table.groupBy("dataset").agg(F.sum(_choose2("n")).alias("sc"), F.sum("n").alias("m"))
    row = both.join(one("a"), "dataset").join(one("b"), "dataset").withColumn("pairs", _choose2("m"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("pairs"))
    top = (F.col("sa") + F.col("sb")) / 2
    return row.select("dataset", F.coalesce(F.try_divide(F.col("sc") - expected, top - expected), F.lit(1.0)).alias("ari"))


def c2c(table: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, base: str = "recovered") -> DataFrame:
    """``dataset`` and one column for each threshold: percent of the clusters of ``base`` that another one covers."""
    key = {"recovered": "a", "truth": "b"}[base]
    share = _margins(table).withColumn("s", F.col("n").cast("double") / F.greatest("na", "nb"))
    best = share.groupBy("dataset", key).agg(F.max("s").alias("s"))
    cut = [t / 100 if t > 1 else t for t in thresholds]
    return best.groupBy("dataset").agg(*[(F.lit(100.0) * F.sum((F.col("s") >= t).cast("double")) / F.count("*")).alias(f"c2c_cvg_{round(t * 100)}") for t in cut])


def mojo_tags(table: DataFrame) -> DataFrame:
    """``dataset, a, b, n``: the true clusters that a recovered one shares most with, all ties."""
    top = table.withColumn("top", F.max("n").over(Window.partitionBy("dataset", "a")))
    return top.where("n = top").select("dataset", "a", "b", "n")


def mojo_moves(table: DataFrame) -> DataFrame:
    """``dataset, moves, clusters``: entities outside their cluster's best match, and recovered clusters."""
    best = table.groupBy("dataset", "a").agg(F.sum("n").alias("na"), F.max("n").alias("top"))
    return best.groupBy("dataset").agg(F.sum(F.col("na") - F.col("top")).alias("moves"), F.count("*").alias("clusters"))


def _dense(pdf: pd.DataFrame) -> np.ndarray:
    a, b = pd.factorize(pdf["a"], sort=True)[0], pd.factorize(pdf["b"], sort=True)[0]
    out = np.zeros((a.max() + 1, b.max() + 1), np.int64)
    np.add.at(out, (a, b), pdf["n"].to_numpy())
    return out


def table_metrics(table: DataFrame) -> DataFrame:
    """``dataset`` with MoJoFM, A2A, the four coverages and the adjusted Rand index of a contingency table.

    Matching and assignment work on clusters, not entities: a group holds at most (clusters x clusters) numbers.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _dense(pdf)
        row = {"dataset": pdf["dataset"].iloc[0], "mojo_cost": kernels.mojo_cost(t), "mojofm": kernels.mojofm(t), "a2a": kernels.a2a(t), "weight": kernels.best_weight(t)}
        row |= {f"c2c_cvg_{round(x * 100)}": kernels.coverage(t, x) for x in THRESHOLDS} | {"ari": kernels.adjusted_rand(t)}
        return pd.DataFrame([row])

    return table.groupBy("dataset").applyInPandas(run, "dataset string, mojo_cost long, mojofm double, a2a double, weight double, c2c_cvg_33 double, c2c_cvg_50 double, c2c_cvg_66 double, c2c_cvg_80 double, ari double")


def a2a_files(recovered: DataFrame, truth: DataFrame) -> DataFrame:
    """``dataset, a2a`` of two architectures (``dataset, entity, cluster``) whose entities may differ.

    Entities of one side only count as added or removed; an entity may lie in several clusters of a side.
    """
    a, b = recovered.distinct(), truth.distinct()
    sizes = lambda df, c: df.groupBy("dataset").agg(F.count_distinct("cluster").alias(f"{c}_k"), F.count("*").alias(f"{c}_n"))
    ends = a.select("dataset", "entity").distinct().withColumn("_a", F.lit(1)).join(b.select("dataset", "entity").distinct().withColumn("_b", F.lit(1)), ["dataset", "entity"], "full_outer")
    ends = ends.groupBy("dataset").agg(F.count(F.when(F.col("_a").isNull(), 1)).alias("added"), F.count(F.when(F.col("_b").isNull(), 1)).alias("removed"))
    # symmetric differences need the sizes of the clusters over common entities only
    both = a.select("dataset", "entity").intersect(b.select("dataset", "entity"))
    sa, sb = (x.join(both, ["dataset", "entity"], "left_semi") for x in (a, b))
    cross = sa.withColumnRenamed("cluster", "a").join(sb.withColumnRenamed("cluster", "b"), ["dataset", "entity"]).groupBy("dataset", "a", "b").agg(F.count("*").alias("n"))
    one = lambda df, c: df.groupBy("dataset", "cluster").agg(F.count("*").alias("n")).select("dataset", *[F.col("cluster").alias(x) if x == c else F.lit(None).cast(df.schema["cluster"].dataType).alias(x) for x in ("a", "b")], "n")
    rows = cross.unionByName(one(sa, "a")).unionByName(one(sb, "b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {c: pdf[pdf[c].notna() & pdf["b" if c == "a" else "a"].isna()].set_index(c)["n"] for c in "ab"}
        at = {c: {k: i for i, k in enumerate(side[c].index)} for c in "ab"}
        n = max(len(side["a"]), len(side["b"]))
        size = [np.zeros(n), np.zeros(n)]
        size[0][: len(side["a"])], size[1][: len(side["b"])] = side["a"].to_numpy(), side["b"].to_numpy()
        shared = np.zeros((n, n))
        inner = pdf[pdf["a"].notna() & pdf["b"].notna()]
        for x, y, c in zip(inner["a"], inner["b"], inner["n"], strict=True):
            shared[at["a"][x], at["b"][y]] = c
        cost = size[0][:, None] + size[1][None] - 2 * shared
        i, j = kernels.assignment(cost) if n else ([], [])
        return pd.DataFrame([{"dataset": pdf["dataset"].iloc[0], "moved": float(cost[i, j].sum()) / 2 if n else 0.0}])

    moved = rows.groupBy("dataset").applyInPandas(run, "dataset string, moved double")
    row = ends.join(moved, "dataset", "left").join(sizes(a, "p"), "dataset", "left").join(sizes(b, "g"), "dataset", "left").na.fill(0)
    cost = F.abs(F.col("p_k") - F.col("g_k")) + 2 * F.col("added") + 2 * F.col("removed") + F.col("moved")
    return row.select("dataset", ((1 - cost / (F.col("p_k") + F.col("g_k") + 2 * F.col("p_n") + 2 * F.col("g_n"))) * 100).alias("a2a"))


def turbomq_clusters(assigned: DataFrame, deps: DataFrame, loops: bool = False) -> DataFrame:
    """``dataset, cluster, intra, inter, cf`` of every cluster; dependencies need both ends assigned.

    Parallel rows are summed before the lookups, so what is joined is one row for each pair of files.
    """
    if "Dependency_Count" not in deps.columns:
        raise ValueError("the dependency table needs Dependency_Count")
    pairs = deps.groupBy("dataset", "Source_File", "Target_File").agg(F.coalesce(F.sum("Dependency_Count"), F.lit(0)).cast("double").alias("w"))
    if not loops:
        pairs = pairs.where("Source_File <> Target_File")
    side = lambda e, c: assigned.select("dataset", F.col("entity").alias(e), F.col("cluster").alias(c))
    met = pairs.join(side("Source_File", "c"), ["dataset", "Source_File"]).join(side("Target_File", "d"), ["dataset", "Target_File"])
    between = met.groupBy("dataset", "c", "d").agg(F.sum("w").alias("w"))
    touched = between.select("dataset", F.explode(F.when(F.col("c") == F.col("d"), F.array(F.struct(F.col("c").alias("cluster"), F.col("w").alias("u"), F.lit(0.0).alias("x")))).otherwise(F.array(F.struct(F.col("c").alias("cluster"), F.lit(0.0).alias("u"), F.col("w").alias("x")), F.struct(F.col("d").alias("cluster"), F.lit(0.0).alias("u"), F.col("w").alias("x"))))).alias("t"))
    sums = touched.groupBy("dataset", "t.cluster").agg(F.sum("t.u").alias("intra"), F.sum("t.x").alias("inter"))
    every = assigned.select("dataset", "cluster").distinct().join(sums, ["dataset", "cluster"], "left").na.fill(0.0, ["intra", "inter"])
    return every.withColumn("cf", F.coalesce(F.try_divide("intra", F.col("intra") + F.col("inter") / 2), F.lit(0.0)))


def turbomq(assigned: DataFrame, deps: DataFrame) -> DataFrame:
    """``dataset, turbomq, normalized_turbomq``: sum of the cluster factors, and their mean in percent."""
    sums = turbomq_clusters(assigned, deps).groupBy("dataset").agg(F.sum("cf").alias("turbomq"), F.count("*").alias("k"))
    return sums.select("dataset", "turbomq", (F.col("turbomq") / F.col("k") * 100).alias("normalized_turbomq"))


def evaluate(recovered: DataFrame, truth: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """The nine metrics of each data set (TurboMQ only with dependencies); a null label is an error of the caller."""
    out = table_metrics(contingency(align(recovered, truth))).drop("mojo_cost", "weight")
    return out.join(turbomq(recovered, deps), "dataset", "left") if deps is not None else out
