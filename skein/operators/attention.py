"""Variational graph-attention encoders with a dot-product decoder: homogeneous, heterogeneous, and mini-batch.

A group (system, method, run) is trained where its rows lie; groups run side by side. Graphs beyond ``batch_files``
files are trained on batches of edges with sampled neighbourhoods and encoded in full at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import autograd as ad
from . import kernels


@dataclass(frozen=True)
class Settings:
    """Hyper-parameters; the defaults are those of the homogeneous encoder."""

    lpe_dim: int = 16
    file_emb_dim: int = 128
    folder_emb_dim: int = 128
    hidden_channels: int = 256
    out_channels: int = 128
    num_layers: int = 2
    heads: int = 2
    variational: bool = True
    beta_kl: float = 0.1
    neg_ratio: float = 5.0
    epochs: int = 100
    lr: float = 0.001
    dropout: float = 0.0
    batch_files: int = 5000
    batch_size: int = 1024
    fanout: int = 10

    def updated(self, settings: dict) -> Settings:
        return replace(self, **{k: v for k, v in settings.items() if k in self.__dataclass_fields__ and v is not None})


class Attention:
    """One attention layer: heads averaged; ``loops`` adds every node to its own neighbours; ``edge`` uses weights."""

    def __init__(self, rng: np.random.Generator, a: int, b: int, heads: int, edge: bool, loops: bool) -> None:
        init = lambda *s: ad.Var(rng.normal(0, np.sqrt(2 / (s[0] + s[-1])), s))
        self.w, self.s, self.t = ([init(a, b) for _ in range(heads)], [init(b, 1) for _ in range(heads)], [init(b, 1) for _ in range(heads)])
        self.e = [init(1, 1) for _ in range(heads)] if edge else []
        self.bias, self.loops = ad.Var(np.zeros(b)), loops

    @property
    def params(self) -> list[ad.Var]:
        return [*self.w, *self.s, *self.t, *self.e, self.bias]

    def __call__(self, x: ad.Var, y: ad.Var, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None) -> ad.Var:
        """Messages from ``x`` (rows ``src``) to ``y`` (rows ``dst``)."""
        n = len(y.value)
        if self.loops:
            mean = 1.0 if weight is None or not len(weight) else float(weight.mean())
            src, dst = np.concatenate([src, np.arange(n)]), np.concatenate([dst, np.arange(n)])
            weight = None if weight is None else np.concatenate([weight, np.full(n, mean)])
        out = None
        for h, w in enumerate(self.w):
            a, b = x @ w, (x @ w if y is x else y @ w)
            score = ad.gather(a @ self.s[h], src) + ad.gather(b @ self.t[h], dst)
            if self.e and weight is not None:
                score = score + ad.lift(weight[:, None]) * self.e[h]
            part = ad.segment_softmax(ad.leaky(score), dst, n)
            z = ad.segment_sum(ad.gather(a, src) * part, dst, n)
            out = z if out is None else out + z
        return out * (1 / len(self.w)) + self.bias


class Encoder:
    """Layers over one or several relations ``(src_type, dst_type)``; the last gives mean and log-deviation."""

    def __init__(self, rng: np.random.Generator, c: Settings, sizes: dict[str, int], dims: dict[str, int], relations: list[tuple[str, str]], edge: bool, loops: bool) -> None:
        self.c, self.relations = c, relations
        self.table = {t: ad.Var(rng.normal(0, 0.1, (n, c.file_emb_dim if t == "file" else c.folder_emb_dim))) for t, n in sizes.items()}
        self.fixed: dict[str, ad.Var] = {}
        widths = {t: self.table[t].value.shape[1] + dims.get(t, 0) for t in sizes}
        # types may differ in width, or keep it where no relation leads to them: one projection each brings them to the hidden width
        same = len(set(widths.values())) == 1 and (set(sizes) <= {b for _, b in relations} or set(widths.values()) == {c.hidden_channels})
        self.project = {} if same else {t: ad.Var(rng.normal(0, np.sqrt(1 / w), (w, c.hidden_channels))) for t, w in widths.items()}
        width = next(iter(widths.values())) if same else c.hidden_channels
        make = lambda a, b: [Attention(rng, a, b, c.heads, edge, loops) for _ in relations]
        self.layers = [make(width if i == 0 else c.hidden_channels, c.hidden_channels) for i in range(max(0, c.num_layers - 1))]
        last = width if not self.layers else c.hidden_channels
        self.mean, self.spread = make(last, c.out_channels), make(last, c.out_channels)

    @property
    def params(self) -> list[ad.Var]:
        free = [v for v in self.fixed.values() if getattr(v, "free", False)]
        return [*self.table.values(), *self.project.values(), *free, *[p for layer in [*self.layers, self.mean, self.spread] for a in layer for p in a.params]]

    def _layer(self, layer: list[Attention], x: dict[str, ad.Var], edges) -> dict[str, ad.Var]:
        out: dict[str, ad.Var] = {}
        for conv, (a, b), (src, dst, w) in zip(layer, self.relations, edges, strict=True):
            z = conv(x[a], x[b], src, dst, w)
            out[b] = out[b] + z if b in out else z
        return out

    def __call__(self, edges: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], pick: dict[str, np.ndarray] | None = None) -> tuple[ad.Var, ad.Var]:
        """Mean and log-deviation of the files; ``pick``: a batch's nodes by type, whose edges use places in them."""
        x = {}
        part = lambda v, t: ad.gather(v, pick[t]) if pick is not None else v
        for t, v in self.table.items():
            v = part(v, t)
            if t in self.fixed:
                v = ad.concat([part(self.fixed[t], t), v])
            x[t] = v @ self.project[t] if self.project else v
        for layer in self.layers:
            x = {**x, **{t: ad.elu(v) for t, v in self._layer(layer, x, edges).items()}}
        return ad.clamp(self._layer(self.mean, x, edges)["file"], 10), ad.clamp(self._layer(self.spread, x, edges)["file"], 10)


def kl_gaussian(mean: ad.Var, spread: ad.Var) -> ad.Var:
    """Half the mean over nodes of the summed divergence from the standard normal."""
    return ad.total(ad.exp(spread * 2) + mean * mean - 1.0 - spread * 2) * (0.5 / len(mean.value))


def decode_loss(z: ad.Var, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> ad.Var:
    """Mean log-loss of the dot products of pairs."""
    dot = ad.total(ad.gather(z, a) * ad.gather(z, b), 1)
    return ad.total(ad.softplus(dot * (1 - 2 * label))) * (1 / len(a))


def _negatives(rng: np.random.Generator, ids: np.ndarray, n: int, count: int, known: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of places in ``ids`` (of ``n`` nodes) that are no edges and no loops, ``count`` at most."""
    a, b = rng.integers(0, len(ids), 2 * count), rng.integers(0, len(ids), 2 * count)
    ok = np.array([i != j and i * n + j not in known for i, j in zip(ids[a].tolist(), ids[b].tolist(), strict=True)], bool)
    return a[ok][:count], b[ok][:count]


class Neighbours:
    """Incoming edges by relation, of which a batch takes a bounded sample."""

    def __init__(self, edges: list, relations: list[tuple[str, str]], sizes: dict[str, int]) -> None:
        self.edges, self.relations, self.sizes = edges, relations, sizes
        self.order = [np.argsort(dst, kind="stable") for _, dst, _ in edges]
        self.start = [np.searchsorted(dst[o], np.arange(sizes[b] + 1)) for (_, dst, _), o, (_, b) in zip(edges, self.order, relations, strict=True)]

    def sample(self, rng: np.random.Generator, files: np.ndarray, hops: int, fanout: int) -> tuple[dict[str, np.ndarray], list]:
        """Nodes by type that ``hops`` steps back from ``files`` reach, and the edges among their places.

        Each node takes part with ``fanout`` edges of each relation at most. A type that is not reached has its first
        node, without edges, so that every type has a row.
        """
        seen = {t: np.zeros(0, int) for t in self.sizes} | {"file": files}
        front, used = {"file": files}, [[np.zeros(0, int)] for _ in self.edges]
        for _ in range(hops):
            found: dict[str, list[np.ndarray]] = {}
            for r, (a, b) in enumerate(self.relations):
                for i in front.get(b, ()):
                    got = self.order[r][self.start[r][i] : self.start[r][i + 1]]
                    got = got if len(got) <= fanout else rng.choice(got, fanout, replace=False)
                    used[r].append(got)
                    found.setdefault(a, []).append(self.edges[r][0][got])
            front = {t: np.setdiff1d(np.concatenate(x), seen[t]) for t, x in found.items()}
            seen |= {t: np.union1d(seen[t], x) for t, x in front.items()}
        out = []
        for (src, dst, w), (a, b), parts in zip(self.edges, self.relations, used, strict=True):
            e = np.unique(np.concatenate(parts))
            out.append((np.searchsorted(seen[a], src[e]), np.searchsorted(seen[b], dst[e]), None if w is None else w[e]))
        return {t: x if len(x) else np.zeros(1, int) for t, x in seen.items()}, out


def train(n: int, pairs: np.ndarray, edges: list, relations: list, sizes: dict[str, int], lpe: np.ndarray | None, free_lpe: bool, c: Settings, seed: int, loops: bool = True) -> np.ndarray:
    """Embeddings of the files: ``pairs`` (2 x m, undirected once) are decoded, ``edges`` carry messages."""
    rng = np.random.default_rng(seed)
    dims = {"file": lpe.shape[1]} if lpe is not None else {}
    net = Encoder(rng, c, sizes, dims, relations, any(w is not None for _, _, w in edges), loops)
    if lpe is not None:
        net.fixed["file"] = ad.Var(lpe)
        net.fixed["file"].free = free_lpe
    opt, known = ad.Adam(net.params, c.lr), set()
    for i, j in pairs.T.tolist():
        known |= {i * n + j, j * n + i}

    def step(batch: np.ndarray, use: list, pick: dict[str, np.ndarray] | None) -> None:
        mean, spread = net(use, pick)
        z = mean + ad.exp(spread) * rng.normal(size=mean.value.shape) if c.variational else mean
        a, b = _negatives(rng, np.arange(n) if pick is None else pick["file"], n, max(1, int(batch.shape[1] * c.neg_ratio)), known)
        label = np.concatenate([np.ones(batch.shape[1]), np.zeros(len(a))])
        loss = decode_loss(z, np.concatenate([batch[0], a]), np.concatenate([batch[1], b]), label)
        if c.variational:
            loss = loss + kl_gaussian(mean, spread) * (c.beta_kl / n)
        ad.backward(loss)
        opt.update()

    if not pairs.shape[1]:
        return net(edges)[0].value
    near = Neighbours(edges, relations, sizes)
    for _ in range(c.epochs):
        if n <= c.batch_files:
            step(pairs, edges, None)
            continue
        for part in np.array_split(rng.permutation(pairs.shape[1]), max(1, pairs.shape[1] // c.batch_size)):
            pick, use = near.sample(rng, np.unique(pairs[:, part]), c.num_layers, c.fanout)
            step(np.searchsorted(pick["file"], pairs[:, part]), use, pick)
    return net(edges)[0].value


def homogeneous(n: int, src: np.ndarray, dst: np.ndarray, c: Settings, seed: int, gdc: dict | None = None) -> np.ndarray:
    """Embeddings from the undirected file graph (``src``, ``dst``: both directions), diffused if ``gdc`` says so."""
    once = src < dst
    lpe = np.hstack([np.ones((n, 1)), kernels.laplacian_features(n, src, dst, c.lpe_dim)])
    edges = [(src, dst, None)]
    if gdc:
        a, b, w = kernels.diffusion(n, src, dst, gdc.get("method", "ppr"), gdc.get("alpha", 0.15), gdc.get("k", 64))
        edges = [(a, b, w)]
    return train(n, np.stack([src[once], dst[once]]), edges, [("file", "file")], {"file": n}, lpe, False, c, seed)


def heterogeneous(n: int, folders: int, rels: dict[tuple[str, str, str], tuple[np.ndarray, np.ndarray]], c: Settings, seed: int) -> np.ndarray:
    """Embeddings from typed relations ``(src_type, rel, dst_type)``; file edges, undirected, are decoded."""
    file_edges = [x for (a, _, b), x in rels.items() if a == b == "file"]
    src, dst = (np.concatenate([e[i] for e in file_edges]) if file_edges else np.zeros(0, int) for i in (0, 1))
    pairs = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)])[:, src != dst], axis=1)
    lpe = kernels.laplacian_features(n, pairs[0], pairs[1], c.lpe_dim) if c.lpe_dim else None
    sizes = {"file": n} | ({"folder": folders} if folders else {})
    used = {k: v for k, v in rels.items() if k[0] in sizes and k[2] in sizes}
    return train(n, pairs, [(a, b, None) for a, b in used.values()], [(k[0], k[2]) for k in used], sizes, lpe, True, c, seed, loops=False)


def embed(graphs: DataFrame, method: str, settings: dict, seed: int = 0) -> DataFrame:
    """``dataset, id, embedding`` of each system's typed edges.

    ``graphs``: ``dataset, n, folders, src_type, rel, dst_type, src, dst``; for the homogeneous method the rows are the
    undirected file edges. Each system is one group.
    """
    c = Settings().updated(settings)
    gdc = {"method": settings.get("gdc_method", "ppr"), "alpha": settings.get("gdc_alpha", 0.15), "k": settings.get("gdc_k", 64)} if settings.get("use_gdc") else None
    if method not in ("homogeneous_gat", "heterogeneous_gat", "structural_gat"):
        raise ValueError(f"unknown method {method!r}")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, folders = int(pdf["n"].iloc[0]), int(pdf["folders"].iloc[0])
        pdf = pdf.sort_values(["src_type", "rel", "dst_type", "src", "dst"])
        if method == "homogeneous_gat":
            x = homogeneous(n, pdf["src"].to_numpy(), pdf["dst"].to_numpy(), c, seed, gdc)
        else:
            rels = {k: (g["src"].to_numpy(), g["dst"].to_numpy()) for k, g in pdf.groupby(["src_type", "rel", "dst_type"])}
            x = heterogeneous(n, folders, rels, c, seed)
        return pd.DataFrame({"dataset": key[0], "id": np.arange(n), "embedding": list(x.astype(np.float32))})

    columns = ["dataset", "n", "folders", "src_type", "rel", "dst_type", "src", "dst"]
    return graphs.select([F.col(x) for x in columns]).groupBy("dataset").applyInPandas(run, "dataset string, id long, embedding array<float>")
