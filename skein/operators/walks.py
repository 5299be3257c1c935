"""Random walks as DataFrames, and skip-gram embeddings with negative sampling.

A walk is one array row that grows by a join with the edges in each step. Draws follow from hashes of the seed, the
walk and the step, so a rerun gives the same walks whatever the partitioning.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import discard, materialize
from .ranks import rank_in_group


def _draw(*parts):
    """A number in (0, 1] from hashes."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 1).cast("double") / float(1 << 52)


def _indexed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with their rank among those of the same ``keys``, and how many there are."""
    w = Window.partitionBy(*keys)
    return edges.withColumn("_k", F.row_number().over(w.orderBy("dst")) - 1).withColumn("_n", F.count("*").over(w))


def random_walks(vertices: DataFrame, edges: DataFrame, per_node: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 0, cut: int = 5) -> DataFrame:
    """``walk, path``: ``per_node`` walks of ``length`` nodes from every vertex; a walk ends early at a dead end.

    With ``p = q = 1`` a step is one uniform pick. Otherwise neighbours are weighted by 1/p for going back, 1 for a
    common neighbour and 1/q for moving away, by the smallest exponential draw. Lineage is cut every ``cut`` steps.
    """
    start = vertices.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("r"))
    walks = start.select(F.xxhash64(F.lit(seed), "id", "r").alias("walk"), F.array("id").alias("path"))
    even = p == 1 and q == 1
    # written once: each cut of the lineage would else make the ranks anew
    hops = materialize(_indexed(edges.select("src", "dst"), ["src"]), "hops")
    degree = hops.where("_k = 0").select("src", "_n")
    pairs = hops.select(F.col("src").alias("prev"), F.col("dst").alias("dst"), F.lit(True).alias("near"))
    made = []
    for step in range(1, length):
        walks = walks.withColumn("src", F.element_at("path", -1))
        if even or step == 1:
            pick = walks.join(degree, "src", "left").withColumn("_k", F.floor(_draw(F.lit(seed), "walk", F.lit(step)) * F.col("_n")).cast("int"))
            pick = pick.withColumn("_k", F.least("_k", F.col("_n") - 1)).drop("_n")
            moved = pick.join(hops.drop("_n"), ["src", "_k"], "left").select("walk", "path", "dst")
        else:
            options = walks.withColumn("prev", F.try_element_at("path", F.lit(-2))).join(hops.select("src", "dst"), "src", "left").join(pairs, ["prev", "dst"], "left")
            weight = F.when(F.col("dst") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
            order = F.struct((-F.log(_draw(F.lit(seed), "walk", F.lit(step), "dst")) / weight).alias("e"), "dst")
            moved = options.groupBy("walk", "path").agg(F.min_by("dst", order).alias("dst"))
        walks = moved.select("walk", F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"))
        if step % cut == 0:
            made.append(materialize(walks, "walks"))
            walks = made[-1]
            discard(*made[:-1])
    return walks


def metapath_walks(edges: DataFrame, types: list[str], per_node: int, length: int, seed: int = 0, cut: int = 5) -> DataFrame:
    """``walk, path`` along a cycle of node types, e.g. file, folder, file, with a file-file step to close it.

    ``edges``: ``src_type, dst_type, src, dst``. A path is an array of ``type:id`` texts. A relation of the cycle
    without any edge is an error.
    """
    have = {(r[0], r[1]) for r in edges.select("src_type", "dst_type").distinct().collect()}  # one row for each relation
    cycle = list(zip(types, types[1:] + types[:1], strict=True))
    if lost := [c for c in cycle if c not in have]:
        raise ValueError(f"no edges for {lost}")
    starts = edges.where(F.col("src_type") == types[0]).select(F.col("src").alias("id")).distinct()
    walks = starts.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("r")).select(F.xxhash64(F.lit(seed), "id", "r").alias("walk"), F.array(F.concat(F.lit(types[0] + ":"), F.col("id").cast("string"))).alias("path"), F.col("id").alias("src"))
    for step in range(1, length):
        a, b = cycle[(step - 1) % len(cycle)]
        hops = _indexed(edges.where((F.col("src_type") == a) & (F.col("dst_type") == b)).select("src", "dst"), ["src"])
        degree = hops.groupBy("src").agg(F.max("_n").alias("_n"))
        pick = walks.join(degree, "src", "left").withColumn("_k", F.floor(_draw(F.lit(seed), "walk", F.lit(step)) * F.col("_n")).cast("int"))
        pick = pick.withColumn("_k", F.least("_k", F.col("_n") - 1)).drop("_n")
        moved = pick.join(hops.drop("_n"), ["src", "_k"], "left")
        # a walk whose last node has no such edge stops for good
        walks = moved.select("walk", F.when(F.col("dst").isNotNull(), F.concat("path", F.array(F.concat(F.lit(b + ":"), F.col("dst").cast("string"))))).otherwise(F.col("path")).alias("path"), F.col("dst").alias("src"))
        if step % cut == 0:
            walks = materialize(walks, "walks")
    return walks.select("walk", "path")


def sgns(paths: list[list[int]], n: int, dims: int, window: int, epochs: int, negative: int, seed: int, rate: float = 0.025, batch: int = 4096, steps_per_epoch: int = 200) -> np.ndarray:
    """Skip-gram vectors with negative sampling (frequency to the power of 3/4) by mini-batches of averaged steps."""
    rng = np.random.default_rng(seed)
    centre, context = rng.uniform(-0.5, 0.5, (n, dims)) / dims, np.zeros((n, dims))
    pairs = []
    for path in paths:
        path = np.asarray(path)
        for d in range(1, min(window, len(path) - 1) + 1):
            pairs += [np.stack([path[d:], path[:-d]]), np.stack([path[:-d], path[d:]])]
    if not pairs:
        return centre
    pairs = np.hstack(pairs)
    batch = min(batch, max(64, pairs.shape[1] // steps_per_epoch))  # small graphs need steps more than width
    share = np.bincount(pairs[1], minlength=n) ** 0.75
    table = np.cumsum(share / share.sum())
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    steps, done = epochs * -(-pairs.shape[1] // batch), 0
    for _ in range(epochs):
        order = rng.permutation(pairs.shape[1])
        for at in range(0, len(order), batch):
            u, v = pairs[:, order[at : at + batch]]
            lr = rate * max(1 - done / steps, 1e-3) * 20
            done += 1
            other = np.concatenate([v[:, None], np.searchsorted(table, rng.random((len(u), negative))).clip(0, n - 1)], 1)
            g = sig(np.einsum("bd,bkd->bk", centre[u], context[other]))
            g[:, 0] -= 1
            du, dv = np.einsum("bk,bkd->bd", g, context[other]), g[:, :, None] * centre[u][:, None]
            for target, index, grad in ((centre, u, du), (context, other.ravel(), dv.reshape(-1, dims))):
                total = np.zeros_like(target)
                np.add.at(total, index, grad)
                count = np.bincount(index, minlength=n)[:, None]
                target -= lr * total / np.maximum(count, 1)
    return centre


def walk_embeddings(walks: DataFrame, n_of: DataFrame, dims: int = 128, window: int = 15, epochs: int = 5, negative: int = 5, seed: int = 0) -> DataFrame:
    """``dataset, id, embedding`` of each system's walks (``dataset, path`` of ids; ``n_of``: ``dataset, n``)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        paths = sorted(map(list, pdf["path"]))
        x = sgns(paths, n, dims, window, epochs, negative, seed)
        return pd.DataFrame({"dataset": key[0], "id": np.arange(n), "embedding": list(x.astype(np.float32))})

    return walks.join(F.broadcast(n_of), "dataset").groupBy("dataset").applyInPandas(run, "dataset string, id long, embedding array<float>")


#: Neighbours that a walk proposes at once before they are looked at; twice as many in each further round.
PROPOSALS = 16


def biased_walks(vertices: DataFrame, edges: DataFrame, per_node: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """``walk, path`` as :func:`random_walks`, by rejection: a step costs a walk a few rows, however many neighbours a
    node has.

    A neighbour is proposed by its rank among the node's neighbours, drawn evenly, and accepted with its weight (1/p for
    going back, 1 for a common neighbour, 1/q else) over the largest of the three; ``PROPOSALS`` at once, the first that
    is accepted counts, and walks without one propose more. So accepted neighbours have exactly the biased law. A node
    with one neighbour needs no draw. Ranks are taken over ranges, and rows meet by (node, rank) or by (previous, next):
    neither a hub's neighbours nor the walks that stand on it meet in one task. A node that ``edges`` name twice as a
    neighbour counts once. ``vertices`` and ``edges`` may be empty; a walk of a node without edges is that node.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    in_order = rank_in_group(edges, ["src"], ["dst"], "k", "n")
    ranked = materialize(in_order, "ranked")
    discard(in_order)
    sizes = materialize(ranked.where("k = 0").select(F.col("src").alias("dst"), F.col("n").alias("m")), "sizes")
    # each neighbour with the number of its own ones, so a walk knows how many there are where it arrives
    hops = materialize(ranked.join(sizes, "dst", "left").select("src", "k", "dst", F.coalesce("m", F.lit(0)).alias("m")), "hops")
    discard(ranked)
    start = vertices.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("r"))
    first = start.join(sizes.withColumnRenamed("dst", "id"), "id", "left")
    now = materialize(first.select(F.xxhash64(F.lit(seed), "id", "r").alias("walk"), F.lit(None).cast("long").alias("prev"), F.col("id").alias("src"), F.coalesce("m", F.lit(0)).alias("n")), "walks")
    steps = [now.select("walk", F.lit(0).alias("step"), F.col("src").alias("node"))]
    even, top = p == 1 and q == 1, max(1 / p, 1.0, 1 / q)
    near = edges.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("near"))
    for step in range(1, length):
        moved, todo, base, many = [], now.where("n > 0"), 0, PROPOSALS
        while True:
            alone = (F.col("n") == 1) | F.lit(even or step == 1)
            tries = todo.withColumn("t", F.explode(F.when(alone, F.array(F.lit(base))).otherwise(F.sequence(F.lit(base), F.lit(base + many - 1)))))
            k = F.least(F.floor(_draw(F.lit(seed), "walk", F.lit(step), "t", F.lit("k")) * F.col("n")), F.col("n") - 1)
            found = tries.withColumn("k", k).join(hops, ["src", "k"])
            if not (even or step == 1):
                weight = F.when(F.col("dst") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
                found = found.join(near, ["prev", "dst"], "left").where(alone | (_draw(F.lit(seed), "walk", F.lit(step), "t", F.lit("u")) * top <= weight))
            picked = materialize(found.groupBy("walk").agg(F.min_by(F.struct(F.col("src").alias("prev"), F.col("dst").alias("src"), F.col("m").alias("n")), "t").alias("to")).select("walk", "to.*"), "steps")
            moved.append(picked)
            if even or step == 1:
                break
            rest, base = materialize(todo.join(picked.select("walk"), "walk", "left_anti"), "todo"), base + many
            discard(todo)
            todo, many = rest, min(2 * many, 256)
            if not todo.limit(1).count():
                break
        discard(todo)
        now = reduce(DataFrame.unionByName, moved)
        steps.append(now.select("walk", F.lit(step).alias("step"), F.col("src").alias("node")))
    discard(edges, hops, sizes)
    # a path has ``length`` nodes at most
    listed = reduce(DataFrame.unionByName, steps).groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("path"))
    return listed.select("walk", F.transform("path", lambda x: x["node"]).alias("path"))


#: Edges of a node and relation that stand in one list.
LISTED = 64


def sampled_neighbourhood(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """Bounded subgraphs of typed graphs for mini-batches: ``batch, hop, src_type, rel, dst_type, src, dst``.

    ``edges``: ``src_type, rel, dst_type, src, dst``; ``seeds``: ``batch, type, id``. Hop ``h`` gives each node that the
    hop before has reached (the seeds at first) up to ``fanouts[h]`` incoming edges of each relation: the edges of a node
    and relation stand in the order of a hash, and a batch takes so many in a row, from a place that a hash of batch and
    node names. A node's edges are all taken if they are no more. So a batch holds at most the seeds times the product of
    fan-outs and relations. Relations of a node with ``LISTED`` edges at most stand in one row of lists, which a batch that
    reaches the node meets once; of the others a hub costs its fan-out: rows meet by (node, relation, rank). Draws depend on
    the seed, the batch and the ids alone. An edge is listed once a batch and hop; a node reached again is not expanded again.
    """
    kinds = ["dst_type", "dst", "src_type", "rel"]
    mixed = edges.distinct().withColumn("h", F.xxhash64(F.lit(seed), *kinds, "src"))
    in_order = rank_in_group(mixed, kinds, ["h", "src"], "k", "n")
    ranked = materialize(in_order.drop("h"), "ranked")
    discard(in_order)
    dealt = ranked.where(F.col("n") <= LISTED).repartition("dst_type", "dst").groupBy(*kinds).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "src"))), lambda x: x["src"]).alias("srcs"))
    lists = materialize(dealt.groupBy("dst_type", "dst").agg(F.collect_list(F.struct("src_type", "rel", "srcs")).alias("lists")), "lists")
    hubs = ranked.where(F.col("n") > LISTED)
    groups = materialize(hubs.where("k = 0").select(*kinds, "n"), "groups")
    reached = materialize(seeds.select("batch", F.col("type").alias("dst_type"), F.col("id").alias("dst")).distinct(), "reached")
    front, out = reached, []
    for hop, fan in enumerate(fanouts):
        at = F.pmod(F.xxhash64(F.lit(seed), F.lit(hop), "batch", *kinds), F.col("n")).alias("at")
        met = front.join(lists, ["dst_type", "dst"]).select("batch", "dst_type", "dst", F.explode("lists").alias("of"))
        met = met.select("batch", "dst_type", "dst", "of.src_type", "of.rel", "of.srcs", F.size("of.srcs").cast("long").alias("n")).select("*", at)
        row = F.slice(F.concat("srcs", F.slice("srcs", 1, fan)), F.col("at").cast("int") + 1, F.least(F.lit(fan), F.col("n").cast("int")))
        met = met.select("batch", F.lit(hop).alias("hop"), "src_type", "rel", "dst_type", F.explode_outer(row).alias("src"), "dst")
        asked = front.join(groups, ["dst_type", "dst"]).select("*", at)
        asked = asked.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(fan), F.col("n").cast("int")) - 1)))
        taken = asked.withColumn("k", (F.col("at") + F.col("k")) % F.col("n")).join(hubs.drop("n"), [*kinds, "k"]).select("batch", F.lit(hop).alias("hop"), "src_type", "rel", "dst_type", "src", "dst")
        taken = met.unionByName(taken)
        out.append(taken)
        if hop == len(fanouts) - 1:  # the largest hop; nothing starts from it, so it is not written before the result is
            break
        taken = out[-1] = materialize(taken, "hop")
        front = taken.select("batch", F.col("src_type").alias("dst_type"), F.col("src").alias("dst")).distinct().join(reached, ["batch", "dst_type", "dst"], "left_anti")
        front = materialize(front, "front")
        reached = reached.unionByName(front)
    return reduce(DataFrame.unionByName, out) if out else edges.limit(0).select(F.lit(0).alias("batch"), F.lit(0).alias("hop"), "src_type", "rel", "dst_type", "src", "dst")
