"""Kernels and metrics against brute force, invariants, and the hand-sized case."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from skein.operators import attention, clustering, kernels, metrics, walks
from skein.operators import autograd as ad

labels = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=7)


def table_of(pairs):
    a, b = (np.unique(x, return_inverse=True)[1] for x in zip(*pairs, strict=True))
    t = np.zeros((a.max() + 1, b.max() + 1), int)
    np.add.at(t, (a, b), 1)
    return t


@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_assignment(n, m, r):
    cost = np.array([[r.randint(-9, 9) for _ in range(m)] for _ in range(n)], float)
    rows, cols = kernels.assignment(cost)
    small, large = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), len(small)))
    assert len(rows) == min(n, m) == len(set(cols.tolist())) and cost[rows, cols].sum() == best


@given(st.lists(st.lists(st.integers(0, 5), max_size=4, unique=True), max_size=6))
@settings(max_examples=80, deadline=None)
def test_matching(links):
    best = max((sum(1 for _ in c) for k in range(len(links) + 1) for s in itertools.combinations(range(len(links)), k) for c in [s] if any(len(set(p)) == k for p in itertools.product(*[links[i] for i in s]))), default=0)
    assert kernels.matching_size(links) == best


def moves_brute(a, b):
    """Least moves and joins from partition ``a`` to ``b``: each group goes whole into one target group."""
    groups = sorted(set(a))
    best = len(a) * 2
    for tags in itertools.product(sorted(set(b)), repeat=len(groups)):
        tag = dict(zip(groups, tags, strict=True))
        moved = sum(tag[x] != y for x, y in zip(a, b, strict=True))
        best = min(best, moved + len(groups) - len(set(tags)))
    return best


@given(labels)
@settings(max_examples=120, deadline=None)
def test_mojo(pairs):
    a, b = zip(*pairs, strict=True)
    assert kernels.mojo_cost(table_of(pairs)) == moves_brute(a, b)


@given(labels)
@settings(max_examples=80, deadline=None)
def test_metric_invariants(pairs):
    t, same = table_of(pairs), table_of([(a, a) for a, _ in pairs])
    r = random.Random(1)
    mixed = t[r.sample(range(len(t)), len(t))][:, r.sample(range(t.shape[1]), t.shape[1])]
    for f in (kernels.mojofm, kernels.a2a, kernels.adjusted_rand, lambda x: kernels.coverage(x, 0.5)):
        assert f(t) == pytest.approx(f(mixed))
    assert kernels.a2a(same) == kernels.coverage(same, 0.8) == 100 and kernels.adjusted_rand(same) == 1
    # half the symmetric differences of a best assignment, padded square, are the moves
    n = max(t.shape)
    p = np.zeros((n, n))
    p[: t.shape[0], : t.shape[1]] = t
    cost = p.sum(1)[:, None] + p.sum(0)[None] - 2 * p
    i, j = kernels.assignment(cost)
    assert cost[i, j].sum() / 2 == t.sum() - kernels.best_weight(t)


def test_hand_case(spark):
    a, b = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 1]
    t = table_of(list(zip(a, b, strict=True)))
    assert kernels.mojofm(t) == 50.0 and kernels.mojo_cost(t) == 2 and kernels.most_moves(t.sum(0)) == 4
    assert kernels.a2a(t) == pytest.approx(89.655172, abs=1e-6) and kernels.adjusted_rand(t) == pytest.approx(0.036697, abs=1e-6)
    assert [round(kernels.coverage(t, x), 6) for x in (0.33, 50, 0.66, 80)] == [66.666667, 66.666667, 33.333333, 0]
    part = lambda x: spark.createDataFrame([("d", f"f{i}", c) for i, c in enumerate(x)], "dataset string, entity string, cluster int")
    deps = spark.createDataFrame([("d", "f0", "f1", 3), ("d", "f1", "f0", 1), ("d", "f0", "f3", 2), ("d", "f3", "f4", 5), ("d", "f5", "f5", 9), ("d", "f2", "zz", 4)], "dataset string, Source_File string, Target_File string, Dependency_Count long")
    row = metrics.evaluate(part(a), part(b), deps).first().asDict()
    want = {"mojofm": 50.0, "a2a": 89.655172, "c2c_cvg_33": 66.666667, "c2c_cvg_50": 66.666667, "c2c_cvg_66": 33.333333, "c2c_cvg_80": 0.0, "ari": 0.036697, "turbomq": 1.633333, "normalized_turbomq": 54.444444}
    assert {k: round(row[k], 6) for k in want} == want
    table = metrics.contingency(metrics.align(part(a), part(b)))
    assert metrics.ari(table).first()["ari"] == pytest.approx(0.036697, abs=1e-6)
    assert metrics.c2c(table, base="truth").first()["c2c_cvg_50"] == 100
    assert metrics.a2a_files(part(a), part(b)).first()["a2a"] == pytest.approx(89.655172, abs=1e-6)
    with pytest.raises(ValueError):
        metrics.turbomq(part(a), deps.drop("Dependency_Count"))
    inner = spark.createDataFrame([("d", "f0", "f1", None), ("d", "f0", "f2", 2)], deps.schema)
    assert metrics.turbomq(part([0] * 6), inner).first()["normalized_turbomq"] == 100


def test_ward_and_silhouette():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (20, 3)) for c in (0, 3, 7)])
    truth = np.repeat([0, 1, 2], 20)
    tree = kernels.ward_tree(x)
    assert (np.diff(tree[:, 2]) >= -1e-9).all() and kernels.adjusted_rand(table_of(list(zip(kernels.cut_tree(tree, 60, 3), truth, strict=True)))) == 1
    assert [len(set(kernels.cut_tree(tree, 60, k).tolist())) for k in (1, 5, 60)] == [1, 5, 60]
    small = rng.normal(size=(14, 2))
    groups = [[i] for i in range(14)]
    for k in range(13, 3, -1):  # plain Ward: the cheapest merge each time
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((small[a].mean(0) - small[b].mean(0)) ** 2).sum()
        a, b = min(itertools.combinations(groups, 2), key=lambda p: cost(*p))
        groups = [g for g in groups if g is not a and g is not b] + [a + b]
        lab = kernels.cut_tree(kernels.ward_tree(small), 14, k)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(lab == v).tolist()) for v in set(lab.tolist())}
    lab = np.array([0, 0, 0, 1, 1, 1, 1, 2, 1, 0, 0, 1, 1, 0])
    d, s = np.sqrt(((small[:, None] - small[None]) ** 2).sum(2)), []
    for i in range(14):
        own = (lab == lab[i]) & (np.arange(14) != i)
        a = d[i][own].mean() if own.any() else 0
        b = min(d[i][lab == v].mean() for v in set(lab.tolist()) - {lab[i]})
        s.append((b - a) / max(a, b) if own.any() else 0)
    assert kernels.silhouette(small, lab, block=5) == pytest.approx(np.mean(s))
    assert clustering.search_k(x, 2, 6, "agglomerative")[0] == clustering.search_k(x, 2, 6, "kmeans")[0] == 3
    with pytest.raises(ValueError):
        kernels.ward_tree(np.zeros((kernels.WARD_POINTS + 1, 1)))


def test_algorithm_names():
    assert clustering.algorithm(None, "paper", "K-Means") == "kmeans" and clustering.algorithm("auto") == "agglomerative"
    with pytest.raises(ValueError):
        clustering.algorithm("dbscan")


def test_spectra():
    src, dst = np.array([0, 1, 2, 3, 4]), np.array([1, 2, 0, 4, 5])
    x = kernels.laplacian_features(6, src, dst, 3)
    lap = np.eye(6) - kernels.normal_adjacency(6, src, dst)
    for v in x.T:
        assert np.allclose(lap @ v, (v @ lap @ v) * v)
    t = kernels.normal_adjacency(6, src, dst, 1.0)
    exact = 0.15 * np.linalg.inv(np.eye(6) - 0.85 * t)
    a, b, w = kernels.diffusion(6, src, dst, "ppr", 0.15, 6)
    got = np.zeros((6, 6))
    got[a, b] = w
    assert np.allclose(got, exact / exact.sum(0), atol=1e-9)
    series, term = np.eye(6), np.eye(6)
    for k in range(1, 40):
        term = term @ (2.0 * (t - np.eye(6))) / k
        series += term
    a, b, w = kernels.diffusion(6, src, dst, "heat", 2.0, 6)
    got[a, b] = w
    assert np.allclose(got, series / series.sum(0), atol=1e-9)
    with pytest.raises(ValueError):
        kernels.diffusion(6, src, dst, "other", 1, 2)


def test_gradients():
    rng = np.random.default_rng(1)
    src, dst, n = rng.integers(0, 5, 12), rng.integers(0, 5, 12), 5
    weight = rng.random(12)
    layer = attention.Attention(rng, 3, 4, 2, True, True)
    x = ad.Var(rng.normal(size=(n, 3)))

    def loss():
        z = ad.elu(layer(x, x, src, dst, weight))
        return attention.decode_loss(z, src[:4], dst[:4], np.array([1, 0, 1, 0.0])) + attention.kl_gaussian(z, ad.clamp(z, 10)) * 0.1

    ad.backward(loss())
    for p in [x, *layer.params]:
        g = p.grad.copy()
        for at in list(np.ndindex(p.value.shape))[:4]:
            old = p.value[at]
            p.value[at] = old + 1e-5
            up = float(loss().value)
            p.value[at] = old - 1e-5
            down = float(loss().value)
            p.value[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def planted(n=60, k=3, seed=0):
    rng = np.random.default_rng(seed)
    truth = np.repeat(np.arange(k), n // k)
    p = np.where(truth[:, None] == truth[None], 0.5, 0.02)
    a = np.triu(rng.random((n, n)) < p, 1)
    i, j = np.nonzero(a)
    return truth, np.concatenate([i, j]), np.concatenate([j, i])


def recovers(x, truth):
    lab = kernels.cut_tree(kernels.ward_tree(x), len(truth), 3)
    return kernels.adjusted_rand(table_of(list(zip(lab, truth, strict=True))))


def test_planted_partition():
    truth, src, dst = planted()
    c = attention.Settings(lpe_dim=4, file_emb_dim=16, folder_emb_dim=16, hidden_channels=32, out_channels=16, num_layers=1, epochs=80, lr=0.01, neg_ratio=1.0)
    x = attention.homogeneous(60, src, dst, c, 1)
    assert x.shape == (60, 16) and np.isfinite(x).all() and np.array_equal(x, attention.homogeneous(60, src, dst, c, 1))
    assert recovers(x, truth) >= 0.9
    assert recovers(attention.homogeneous(60, src, dst, c, 1, {"method": "ppr", "alpha": 0.15, "k": 16}), truth) >= 0.9
    small = c.updated({"batch_files": 10, "batch_size": 128, "epochs": 30})
    assert np.isfinite(attention.homogeneous(60, src, dst, small, 1)).all()
    rels = {("folder", "contains", "file"): (truth, np.arange(60)), ("file", "depends_on", "file"): (src[: len(src) // 2], dst[: len(src) // 2])}
    assert recovers(attention.heterogeneous(60, 3, rels, c, 1), truth) >= 0.9


def test_walks(spark):
    truth, src, dst = planted(45, 3, 2)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(src, dst, strict=True)], "src long, dst long")
    vertices = spark.createDataFrame([(i,) for i in range(46)], "id long")  # 45 has no edge
    known = {(int(a), int(b)) for a, b in zip(src, dst, strict=True)}
    for p, q in ((1.0, 1.0), (0.5, 2.0)):
        got = sorted(tuple(r["path"]) for r in walks.random_walks(vertices, edges, 3, 6, p, q, seed=4, cut=3).collect())
        assert got == sorted(tuple(r["path"]) for r in walks.random_walks(vertices.repartition(3), edges.repartition(5), 3, 6, p, q, seed=4, cut=2).collect())
        assert len(got) == 46 * 3 and all(len(w) == (1 if w[0] == 45 else 6) for w in got)
        assert all((a, b) in known for w in got for a, b in zip(w, w[1:], strict=False))
    x = walks.sgns([list(w) for w in got for _ in range(4)], 46, 16, 3, 8, 5, 0)
    assert recovers(x[:45], truth) >= 0.8
    typed = spark.createDataFrame([("file", "folder", i, i % 3) for i in range(9)] + [("folder", "file", i % 3, i) for i in range(9)] + [("file", "file", 0, 1), ("file", "file", 1, 0)], "src_type string, dst_type string, src long, dst long")
    for r in walks.metapath_walks(typed, ["file", "folder", "file"], 2, 7, seed=1).collect():
        kinds = [x.split(":")[0][1] for x in r["path"]]  # i: file, o: folder
        assert "".join(kinds) == "ioiioii"[: len(kinds)] and (len(kinds) == 7 or r["path"][-1] not in ("file:0", "file:1"))
    with pytest.raises(ValueError):
        walks.metapath_walks(typed.where("dst_type = 'folder'"), ["file", "folder", "file"], 1, 3)


def test_large_graphs_give_the_same_features_and_diffusion(monkeypatch):
    """Iterations above ``DENSE_NODES`` nodes agree with the dense kernels by value."""
    rng = np.random.default_rng(4)
    n = 150
    src = np.concatenate([np.arange(n - 5), rng.integers(0, n - 5, 300)])
    dst = np.concatenate([(np.arange(n - 5) * 7 + 1) % (n - 5), rng.integers(0, n - 5, 300)])
    src, dst = src[src != dst], dst[src != dst]
    dense = kernels.laplacian_features(n, src, dst, 6), [kernels.diffusion(n, src, dst, kind, alpha, 20) for kind, alpha in (("ppr", 0.15), ("heat", 3.0))]
    monkeypatch.setattr(kernels, "DENSE_NODES", 10)
    own = kernels.laplacian_features(n, src, dst, 6)
    a = kernels.SparseAdjacency(n, src, dst)
    value = ((a @ own) * own).sum(0)
    assert np.abs(a @ own - own * value).max() < 1e-4 and np.abs(value - ((a @ dense[0]) * dense[0]).sum(0)).max() < 1e-6
    for (kind, alpha), want in zip((("ppr", 0.15), ("heat", 3.0)), dense[1], strict=True):
        got = kernels.diffusion(n, src, dst, kind, alpha, 20)
        x, y = np.zeros((n, n)), np.zeros((n, n))
        x[want[0], want[1]], y[got[0], got[1]] = want[2], got[2]
        assert np.abs(x - y).max() < 1e-6 or (np.abs(x - y) > 1e-6).mean() < 0.001
