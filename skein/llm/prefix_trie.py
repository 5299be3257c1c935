"""Prefix trie of conversations by chained digests.

1. A turn becomes a digest of its role and text and its length, so no text is shuffled.
2. The turns of a conversation pass in order through a task, which chains the digests: the digest of a prefix is that of
   the shorter prefix's digest and the turn's. A task holds one turn and one digest at a time.
3. Prefixes are grouped by depth and digest: a node, its members' number and smallest id, whether any member goes on.
4. Subtree sums: what a node adds goes to all its ancestors. A node's ancestors are the shorter prefixes of its smallest
   member, so the additions of the nodes with one smallest member are summed along its path from the end, and one row
   for each prefix, instead of one for each node and ancestor, is grouped by digest.
5. The ids of the conversations that end at a node are put in order by ranges of (digest, id), packed into strings of
   4,096 ids at most, and passed in order through the hash.

Groupings and sums are combined before they are shuffled, so a first turn that a third of all conversations share costs
what their rows cost; the join with the parent is split by adaptive execution where a parent has very many children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Ids in one packed string.
PACKED = 4096
#: Prefix digest of the root.
ROOT = b""

_PATH = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])
_PACK = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])


def turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, key, chars``: turns with their place from 1 in their conversation, digest and code points.

    Turns are ordered by ``turn_col``, null first, then by digest. A null role or text is the empty one. Rows without
    conversation are left out.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "key", "chars")


def regrafted(rows: DataFrame, leader: Column, shared: Column, most: int) -> DataFrame:
    """Rows of :func:`turn_rows` in which each conversation starts with the first ``shared`` turns of its ``leader``.

    Both columns are of ``conv_id``; ``shared`` is ``most`` at most. A conversation's own first ``shared`` turns go; those
    of its leader, as many as there are, stand in for them. Conversations without any turn left have one row without key.
    """
    own = rows.where(F.col("place") > shared)
    convs = rows.select("conv_id").distinct().select("conv_id", leader.alias("leader"), shared.alias("shared"))
    heads = rows.where(F.col("place") <= most).where(leader == F.col("conv_id")).select(F.col("conv_id").alias("leader"), "place", "key", "chars")
    given = convs.join(heads, "leader").where(F.col("place") <= F.col("shared")).select("conv_id", "place", "key", "chars")
    # the leader's first turns stand before the conversation's own; each conversation has a row of its own, for the root
    mark = convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(given).unionByName(mark)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations whose rows come in order. A row is given out when the next one tells if it is the last."""
    out: list[tuple] = []
    conv, row = None, None
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PATH, strict=True)], schema=_PATH)
    for batch in batches:
        for c, key, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "chars")), strict=True):
            if c != conv:
                if row:
                    out.append((*row, True))
                conv, row = c, (c, 0, ROOT, None, 0)
            if key is not None:
                out.append((*row, False))
                row = (c, row[1] + 1, hashlib.sha256(row[2] + key).digest(), row[2], chars)
            if len(out) >= 4096:
                yield pack()
                out.clear()
    if row:
        out.append((*row, True))
    if out:
        yield pack()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of ids of one digest, from rows in the order of digest and id."""
    digest, ids, done = None, [], []
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _PACK, strict=True)], schema=_PACK)
    for batch in batches:
        for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (d != digest or len(ids) == PACKED):
                done.append((digest, ids[0], ",".join(map(str, ids))))
                ids = []
            digest = d
            ids.append(c)
            if len(done) >= 256:
                yield give()
                done.clear()
    if ids:
        done.append((digest, ids[0], ",".join(map(str, ids))))
    if done:
        yield give()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's packed ids, from rows in the order of node and first id."""
    node, state, done = None, None, []
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _ENDS, strict=True)], schema=_ENDS)
    for batch in batches:
        for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if d != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = d, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
            if len(done) >= 1024:
                yield give()
                done.clear()
    if state:
        done.append((node, state.hexdigest()))
    if done:
        yield give()


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (see :func:`turn_rows`; rows without key only say that a conversation exists).

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (long), ``ends_sha256``.
    """
    dealt = rows.select("conv_id", "place", "key", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    paths = materialize(dealt.mapInArrow(_chain, "conv_id long, depth long, digest binary, parent binary, chars long, last boolean"), "paths")
    nodes = paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.min("last").alias("leaf"))
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    adds = nodes.where("leaf or saved > 0").select("conv_id", "depth", F.col("leaf").cast("long").alias("leaves"), "saved")
    # along the path of a node's smallest member, from the end: what all nodes of that member below a prefix add
    upto = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    along = paths.select("conv_id", "depth", "digest").join(adds, ["conv_id", "depth"], "left")
    along = along.select("digest", F.sum("leaves").over(upto).alias("leaves"), F.sum("saved").over(upto).alias("saved")).where("leaves > 0 or saved > 0")
    children = nodes.where("depth > 0").select(F.col("parent").alias("digest"), F.lit(1).cast("long").alias("children"))
    sums = along.unionByName(children, allowMissingColumns=True).groupBy("digest").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("leaves", "saved", "children")])
    ended = paths.where("last").select("digest", "conv_id")
    packed = ended.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pack, "digest binary, first long, ids string")
    ends = packed.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hash, "digest binary, ends_sha256 string")
    full = nodes.drop("saved").join(sums, "digest", "left").join(ends, "digest", "left")
    full = materialize(full, "summed")
    above = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(0)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of all conversations of ``turns``; one row a node, as :func:`trie` tells.

    Two prefixes are one node if their turns agree in role and text, one by one. Turns are ordered by ``turn_col``, null
    first; those that tie, by a digest of role and text; a repeated row is a turn of its own. A null role or text is the
    empty one, and the empty text has the length 0. Rows without conversation are left out. An empty table gives no rows;
    further columns, whatever their names, are not read.
    """
    return trie(materialize(turn_rows(turns, conv_col, turn_col, role_col, text_col), "turns"))
