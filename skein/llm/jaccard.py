"""Exact set-similarity join of documents on word shingles, with set-relation skipping.

1. A pass over the texts gives each document's set of shingles (64-bit hashes), a hash and a parity bitmap of the
   whole set, and a table of shingle frequencies in a fixed number of buckets. Equal sets become one set.
2. Shingles have one global order: rare buckets first, then by hash. Two sets that are similar enough share a shingle
   in their prefixes under any such order. Index lists of prefix shingles are read by size: a set meets the sets of a
   fitting size and position only. Where few meet, pairs are kept if their bitmaps leave room for the overlap; where
   many meet, the list is chained (never paired). The connected groups of both hold every link.
3. Inside a group all sets are first verified against the group's leader; those that link to it are one class, whose
   members need no answers about each other. The rest is verified in bounded blocks against all sets of the group.
   In a block, index lists are kept by position and skipped as a whole where position and sizes rule a link out, and
   a set that is linked to a processed set takes over the answers of that set's class without verifying them again.
4. Links become components; every document gets the smallest id of its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import bitmap_filter, discard, materialize

#: Words of a shingle; most sets, and most shingles, of a block's side.
SIZE, BLOCK_SETS, BLOCK_SHINGLES = 5, 1024, 1_500_000
#: Buckets of the frequency table, sent in chunks of so many; bits of a set's parity bitmap.
BUCKETS, CHUNK, BITS = 1 << 20, 1 << 12, 2048
#: An index list pairs a set with at most so many others of a fitting size; beyond that the list is chained.
PAIRED = 64

_P = 0x9E3779B97F4A7C15 | 1


class Shingler:
    """Distinct shingle hashes of a text, sorted. Hashes follow from the words alone, whatever lies between them."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)
        rng = np.random.default_rng(5)
        self.weights = rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 1 << 16)
            step = np.full(n, _P, np.uint64)
            step[0] = 1
            self.power = np.cumprod(step)
            step = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
            step[0] = 1
            self.inverse = np.cumprod(step)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))

    def words(self, text: str) -> np.ndarray:
        """One hash for each word, A-Z lowered."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        gap = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        self._grow(len(raw) + 1)
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64) + np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * self.power[: len(raw)])))
        return self._mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text) if text else np.zeros(0, np.uint64)
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        if n < SIZE:
            key = (words * self.weights[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
        else:
            key = np.full(n - SIZE + 1, SIZE, np.uint64)
            for k in range(SIZE):
                key += words[k : n - SIZE + 1 + k] * self.weights[k]
        return np.unique(self._mix(key).view(np.int64))


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - 20)).astype(np.int64)


def bitmap_of(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles that fall on each bit; two bitmaps differ in no more bits than the sets
    differ in shingles."""
    return np.packbits(np.bincount((shingles.view(np.uint64) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    """So many first shingles of a set of ``n`` meet the prefix of every set that is similar enough (0.8)."""
    return n - (4 * n + 4) // 5 + 1


def linked(i: int, a: int, b: int) -> bool:
    return 100 * i >= 80 * (a + b - i)


def describe_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (id, ``n``, ``sid``, ``bits``) and, for each task, chunks of its frequency table (``chunk``)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts, first = Shingler(), np.zeros(BUCKETS, np.uint32), None
        names = [id_col, "n", "sid", "bits", "chunk"]
        for batch in batches:
            first = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part, n, sid, bits = batch.slice(at, 512), [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle(text)
                    np.add.at(counts, bucket_of(s), 1)
                    n.append(len(s))
                    sid.append(set_id(s) if len(s) else None)
                    bits.append(bitmap_of(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int64())], names=names)
        if first is not None:
            for k in range(BUCKETS // CHUNK):
                part = counts[k * CHUNK : (k + 1) * CHUNK]
                if part.any():
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, first), none, none, pa.array([part.tobytes()], pa.binary()), pa.array([k], pa.int64())], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n long, sid long, bits binary, chunk long")


def frequencies(described: DataFrame) -> np.ndarray:
    """The summed frequency table; a group is one chunk of all tasks, and the driver gets ``BUCKETS`` numbers."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x, wide in zip(table.column("bits").to_pylist(), table.column("wide").to_pylist(), strict=True):
            total += np.frombuffer(x, np.int64 if wide else np.uint32)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int64()), "bits": pa.array([total.tobytes()], pa.binary())})

    own = described.where("chunk is not null").select("chunk", "bits", F.lit(False).alias("wide"))
    part = own.groupBy("chunk", F.pmod(F.xxhash64("bits"), F.lit(64)).alias("salt")).applyInArrow(add, "chunk long, bits binary")  # 64 groups share a chunk
    whole = part.withColumn("wide", F.lit(True)).groupBy("chunk").applyInArrow(add, "chunk long, bits binary")
    out = np.zeros(BUCKETS, np.int64)
    for k, x in whole.collect():
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(x, np.int64)
    return out


def meetings(n: np.ndarray, at: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs and chain links (places) of one index list, sorted by set size; ``at``: place of the shingle in each set.

    A pair can only link if the larger set is at most 5/4 of the smaller one and if enough shingles follow in both.
    """
    end = np.searchsorted(n, n * 5 // 4, "right")
    pairs, chain, done, centre = [], [], 0, 0
    for i in range(len(n) - 1):
        if end[i] - i - 1 > PAIRED:
            if i > done:
                centre = done = i  # else the run goes on, with the centre that it has
            chain += [(centre, k) for k in range(max(done, centre) + 1, end[i])]
            done = max(done, end[i] - 1)
        else:
            for k in range(i + 1, end[i]):
                if 9 * min(n[i] - at[i], n[k] - at[k]) >= 4 * (n[i] + n[k]):
                    pairs.append((i, k))
    return pairs, chain


def candidate_edges(docs: DataFrame, sets: DataFrame, frequency: np.ndarray, text_col: str) -> DataFrame:
    """Edges ``a, b`` whose connected groups hold every link; one shuffle of prefixes, then one of candidate pairs."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequency)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, rank, seen = Shingler(), shipped.value, set()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                key, sid, size, place = [], [], [], []
                for text in batch.column(0).slice(k, 64).to_pylist():
                    s = shingle(text)
                    if not len(s) or (own := set_id(s)) in seen:
                        continue  # an equal set has been sent
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(own)
                    head = s[np.lexsort((s, rank[bucket_of(s)]))[: prefix_length(len(s))]]
                    key.append(head)
                    sid.append(np.full(len(head), own))
                    size.append(np.full(len(head), len(s), np.int32))
                    place.append(np.arange(len(head), dtype=np.int32))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, sid, size, place)], names=["key", "sid", "n", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]

        def lists(key: np.ndarray, sid: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            found: set[tuple[int, int, bool]] = set()
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
            stop = np.append(start[1:], len(key))
            for a, b in zip(start[stop - start > 1].tolist(), stop[stop - start > 1].tolist(), strict=True):
                own = np.concatenate(([True], sid[a + 1 : b] != sid[a : b - 1]))  # one set, sent by several tasks
                x = sid[a:b][own].tolist()
                if len(x) > 1:
                    pairs, chain = meetings(n[a:b][own].astype(np.int64), at[a:b][own].astype(np.int64))
                    found |= {(max(x[i], x[k]), min(x[i], x[k]), False) for i, k in pairs} | {(max(x[i], x[k]), min(x[i], x[k]), True) for i, k in chain}
            out = list(found)
            for k in range(0, len(out), 8192):
                part = out[k : k + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "chained"])

        for batch in batches:
            cols = [np.concatenate((r, batch.column(i).to_numpy())) for i, r in enumerate(rest)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if batch.num_rows else 0  # the last list may go on
            rest = [c[cut:] for c in cols]
            yield from lists(*[c[:cut] for c in cols])
        yield from lists(*rest)

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("x", "y"))
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(9 * (both - differ) >= 8 * both))

    heads = docs.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(prefixes, "key long, sid long, n int, at int")
    met = materialize(heads.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(meet, "a long, b long, chained boolean").distinct(), "met")
    side = lambda c, x: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(x))
    fit = met.where("not chained").select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(fitting, "a long, b long")
    return fit.unionByName(met.where("chained").select("a", "b")).distinct()


def block_links(sets: list[frozenset[int]], sides: list[int]) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that span the components of a block; two sets of side 1 are never compared.

    Sets go by size. Index lists hold, by position, the sets seen so far; a position is skipped as a whole if no size
    in it can reach the overlap from there. A set that has found a link belongs to that set's class and takes its
    answers over, so candidates of a class that it has joined are not verified.
    """
    count: dict[int, int] = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    index: dict[int, dict[int, list[int]]] = {}
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    ones = -1
    for i, side in enumerate(sides):  # side 1 is one class already
        if side:
            if ones < 0:
                ones = i
            parent[i] = ones
    for i in order:
        mine, n = sets[i], len(sets[i])
        head = sorted((x for x in mine if count[x] > 1), key=lambda x: (count[x], x))
        alone = n - len(head)  # shingles of no other set come first in the order
        head = head[: max(0, prefix_length(n) - alone)]
        tried: set[int] = set()
        for j, x in enumerate(head, alone):
            for at, found in index.get(x, {}).items():
                small, large = len(sets[found[0]]), len(sets[found[-1]])
                if 5 * large < 9 * at + 4 * n or 4 * small > 9 * (n - j) - 4 * n:
                    continue
                for k in found:
                    if k in tried:
                        continue
                    size = len(sets[k])
                    if 5 * size < 4 * n or (a := find(k)) == find(i):
                        continue
                    tried.add(k)
                    if linked(len(mine & sets[k]), n, size):
                        parent[a] = find(i)
                        out.append((i, k))
        for j, x in enumerate(head, alone):
            index.setdefault(x, {}).setdefault(j, []).append(i)
    return out


def _own_sets(pdf: pd.DataFrame) -> list[tuple[int, int, frozenset[int]]]:
    """``sid, side, set`` of the rows, once for each sid; a text that belongs to another set (a repeated id) goes."""
    shingle, out = Shingler(), {}
    for sid, side, text in zip(pdf["sid"].tolist(), pdf["side"].tolist(), pdf["text"], strict=True):
        if sid not in out and set_id(s := shingle(text)) == sid:
            out[sid] = (sid, side, frozenset(s.tolist()))
    return list(out.values())


def _verify(blocks: DataFrame) -> DataFrame:
    """Links ``a, b`` inside each block (columns block, sid, side, text)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _own_sets(pdf)
        sid, side = [x for x, _, _ in found], [x for _, x, _ in found]
        pairs = block_links([x for _, _, x in found], side)
        return pd.DataFrame({"a": np.array([sid[i] for i, _ in pairs], np.int64), "b": np.array([sid[k] for _, k in pairs], np.int64)})

    return blocks.groupBy("block").applyInPandas(run, "a long, b long")


def _leader_links(stars: DataFrame) -> DataFrame:
    """Links of each set with the leader of its group (columns block, sid, lead, text); the leader is in every block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, lead = _own_sets(pdf.assign(side=0)), int(pdf["lead"].iloc[0])
        top = next((x for sid, _, x in found if sid == lead), frozenset())
        out = [sid for sid, _, x in found if sid != lead and linked(len(x & top), len(x), len(top))]
        return pd.DataFrame({"a": np.array(out, np.int64), "b": np.full(len(out), lead, np.int64)})

    return stars.groupBy("block").applyInPandas(run, "a long, b long")


def set_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified links ``a, b`` among the sets (``sid, rep, n``) of each candidate group (``node, root``)."""
    rows = groups.join(sets, groups["node"] == sets["sid"]).select("root", "sid", "rep", "n")
    near = bitmap_filter(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), F.xxhash64(F.col("rep").cast("string")), rows, F.xxhash64(F.col("rep").cast("string")))
    # repeated ids may carry different texts: the text must give the set
    member = materialize(near.join(rows, "rep").select("root", "sid", "n", "text"), "members")
    sized = member.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    # comparing with one leader is linear, so its blocks are small and spread well
    salts = F.greatest(F.ceil(F.col("m") * 8 / BLOCK_SETS), F.ceil(F.col("w") * 8 / BLOCK_SHINGLES)).cast("int")
    member_s = member.join(sized.select("root", salts.alias("salts")), "root")
    # 1. everything against the group's leader, which goes to all of its salts
    lead = member_s.where("sid = root").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rest = member_s.where("sid <> root").withColumn("salt", F.pmod(F.hash("sid"), F.col("salts")))
    stars = lead.unionByName(rest).select(F.xxhash64("root", "salt").alias("block"), "sid", F.col("root").alias("lead"), "text")
    first = materialize(_leader_links(stars), "links")
    # 2. what is not linked to the leader, against all sets of the group of a fitting size
    marked = member.join(first.select(F.col("a").alias("sid"), F.lit(1).alias("hit")).distinct(), "sid", "left").withColumn("side", F.when((F.col("hit") == 1) | (F.col("sid") == F.col("root")), 1).otherwise(0)).drop("hit")
    level = F.floor(F.log("n") / F.log(F.lit(1.12))).cast("int")  # a link spans two levels at most
    open_roots = marked.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.sum(1 - F.col("side")).alias("free")).where("free > 0")
    one = (F.col("m") <= BLOCK_SETS) & (F.col("w") <= BLOCK_SHINGLES)
    placed = marked.join(open_roots, "root").withColumn("level", F.when(one, F.lit(-9)).otherwise(level))
    cells = placed.groupBy("root", "level", "side").agg(F.count("*").alias("c"), F.sum("n").alias("w")).withColumn("parts", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")).drop("c", "w")
    # a group that fits is one cell with both sides
    keyed = placed.join(cells, ["root", "level", "side"]).withColumn("cell", F.when(F.col("level") == -9, F.struct(F.lit(-9).alias("level"), F.lit(0).alias("side"), F.lit(0).alias("part"))).otherwise(F.struct("level", "side", F.pmod(F.hash("sid"), F.col("parts")).alias("part"))))
    cell = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", F.when(F.col("level") == -9, F.struct(F.lit(-9).alias("level"), F.lit(0).alias("side"), F.lit(0).alias("part"))).otherwise(F.struct("level", "side", "part")).alias("cell")).distinct()
    x, y = cell.select("root", F.col("cell").alias("x")), cell.select("root", F.col("cell").alias("y"))
    meet = x.join(y, "root").where((F.col("x") <= F.col("y")) & (F.abs(F.col("x.level") - F.col("y.level")) <= 2) & (F.col("x.side") * F.col("y.side") == 0)).withColumn("block", F.xxhash64("root", "x", "y"))
    ways = meet.select("root", "block", F.col("x").alias("cell")).unionByName(meet.select("root", "block", F.col("y").alias("cell"))).distinct()
    blocks = keyed.select("root", "cell", "sid", "side", "text").join(ways, ["root", "cell"]).select("block", "sid", "side", "text")
    return first.unionByName(_verify(blocks))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Sets are the distinct 5-word shingles of the text (A-Z lowered); with fewer words the whole sequence is one.
    Two documents link when 100 * intersection >= 80 * union. Exact: every link is found, whatever the size of a
    group. Null and empty texts, and texts without words, have size 0 and are their own component. Rows with a
    repeated id are told apart by their sets. A row without id has its size, but no component and no link. An empty
    table gives no rows. Further columns are not read.
    """
    described = materialize(describe_sets(docs, id_col, text_col), "sets")
    docs = docs.where(F.col(id_col).isNotNull())
    rows = described.where("chunk is null").select(id_col, "n", F.when(F.col(id_col).isNotNull(), F.col("sid")).alias("sid"))
    sets = rows.where("sid is not null").groupBy("sid").agg(F.min(id_col).alias("rep"), F.max("n").alias("n"))
    bitmaps = described.where(F.col("sid").isNotNull() & F.col(id_col).isNotNull()).groupBy("sid").agg(F.max("n").alias("n"), F.first("bits").alias("bits"))
    edges = materialize(candidate_edges(docs, bitmaps, frequencies(described), text_col), "candidates")
    groups = materialize(components(edges), "groups")
    discard(edges)
    links = materialize(set_links(docs, sets, groups, id_col, text_col), "links")
    roots = components(links)
    named = sets.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = named.join(smallest, "root").select("sid", "component_id")
    return rows.join(of_set, "sid", "left").select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with all their columns.

    Rows that repeat an id and a text count as one document, of which one row stays. Rows without id all stay.
    """
    classes = materialize(jaccard_components(docs, id_col, text_col), "classes")
    keep = classes.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("n"))
    kept = docs.join(keep.select(id_col), id_col, "left_semi").select(docs.columns)
    if keep.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
