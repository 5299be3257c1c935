"""Range-parallel CSV, pattern automaton, ranks over ranges, rejection walks and bounded neighbourhoods."""

import csv
import io
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.operators import attention, clustering, diffusion, kernels, prepare, ranks, rules, walks
from skein.plans import fixtures as fx
from skein.plans import store
from skein.sources import csv_ranges, tables


@pytest.fixture
def ranges_of(spark):
    """Sets the bytes of a range, and puts the settings back."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield put
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def written(folder, rows_of, head, ending="\n"):
    for name, rows in rows_of.items():
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=ending)
        w.writerow(head)
        w.writerows(rows)
        (folder / name).write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [150, 1 << 20])
def test_csv_ranges(spark, tmp_path, ranges_of, monkeypatch, size, ending):
    r = random.Random(size)
    field = lambda: "".join(r.choice('ab",\n é') for _ in range(r.choice([0, 2, 9, 40, 500 if r.random() < 0.1 else 3])))
    rows_of = {f"{k}.csv": [[str(i), field(), r.choice(["5' disk", "x", 'q"uote'])] for i in range(15)] for k in range(2)}
    written(tmp_path, rows_of, ["a", "b, x", "c\nd"], ending)
    ranges_of(size)
    want = [[v or None for v in row] for k in sorted(rows_of) for row in rows_of[k]]
    for few in (0, 100_000):
        monkeypatch.setattr(csv_ranges, "FEW_RANGES", few)
        got = csv_ranges.read_csv_ranges(spark, str(tmp_path)).orderBy("row_id").collect()
        assert [[v or None for v in x[:3]] for x in got] == want and [x["row_id"] for x in got] == list(range(len(want)))
    assert csv_ranges.read_csv_ranges(spark, str(tmp_path)).columns == ["a", "b, x", "c\nd", "row_id"]


def test_csv_odd_files(spark, tmp_path, ranges_of):
    ranges_of(16)
    text = 'a,b\n\n1,5" disk\n2,"x ""y"" z"tail\n\n3\n4,"two\n\nlines",more\n"",NA\n'
    (tmp_path / "x.csv").write_text(text)
    got = tables.read_csv(spark, str(tmp_path / "x.csv"), "a long").orderBy("row_id").collect()
    assert [tuple(x) for x in got if x["a"] != 2] == [(1, '5" disk', 0), (3, None, 2), (4, "two\n\nlines", 3), (None, None, 4)]
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed\n')
    with pytest.raises(ValueError, match="not closed"):
        csv_ranges.csv_records(spark, str(tmp_path / "open.csv"))
    (tmp_path / "empty.csv").write_text("")
    assert csv_ranges.csv_records(spark, str(tmp_path / "empty.csv")).count() == 0
    assert csv_ranges.read_csv_ranges(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "other.csv").write_text("z\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        csv_ranges.read_csv_ranges(spark, f"{tmp_path}/{{x,other}}.csv")


def test_line_states():
    def slow(line, inside):
        start, quoted = not inside, False
        k = 0
        while k < len(line):
            ch = line[k]
            if inside:
                if ch == '"' and line[k + 1 : k + 2] == '"':
                    k += 1
                elif ch == '"':
                    inside = False
            elif ch == '"' and start:
                inside = True
            start = not inside and ch == ","
            k += 1
        return inside

    r = random.Random(3)
    for _ in range(4000):
        line = "".join(r.choice('a",') for _ in range(r.randint(0, 9)))
        for inside in (False, True):
            assert csv_ranges.inside_after(line, inside) == slow(line, inside), (line, inside)


PATTERNS = [r"\.b1[0-9]\.", r"core/(net|io|db)/.*Impl", r"^x+y", r"[abc]", r"(?i)Util", r"(foo)?bar", r"a{2,}b", r"(?:ab|cd)+e", r"é.ü", r"z*", r"q(?=rs)t", r"(?!no)yes", r"\bword\b", r"(?i:up)down"]


def test_matcher():
    r = random.Random(2)
    made = rules.Matcher([(f"m{k % 9}", p) for k, p in enumerate(PATTERNS)])
    pieces = ["core/", "net/", "Impl", ".b12.", "xxy", "UTIL", "bar", "aaab", "abcde", "é-ü", "qrst", "yes", "word ", "UPdown", "no", "7"]
    for _ in range(2000):
        v = "".join(r.choices(pieces, k=r.randint(0, 4)))
        want = list(dict.fromkeys(f"m{k % 9}" for k, p in enumerate(PATTERNS) if re.search(p, v))) if v else []
        assert made(v) == want, v
    assert rules.needed_texts(r"\.b1[0-9]\.") == {".b1"} and rules.needed_texts("core/(net|io)/x") == {"core/"} and rules.needed_texts("(net|io)") == {"net", "io"}
    assert rules.needed_texts("(?i)abc") is None and rules.needed_texts("a?") is None and rules.needed_texts("(?:abc)*x") == {"x"}
    many = rules.Matcher([(f"n{k}", rf"/part{k:04d}/\w+") for k in range(3000)])
    assert many("src/part0042/a") == ["n42"] and many.tried == 1


def test_modules_found(spark):
    df = spark.createDataFrame([(1, "a.b12.c"), (2, None), (3, ""), (4, "zz")], "id long, v string")
    got = {x["id"]: x["m"] for x in df.select("id", rules.modules_found(F.col("v"), [("low", r"\.b1"), ("z", "z+$")]).alias("m")).collect()}
    assert got == {1: ["low"], 2: [], 3: [], 4: ["z"]}


def test_ranks(spark):
    r = random.Random(7)
    names = list({"the/same/long/prefix/of/all/" + "".join(r.choice("ab/é") for _ in range(12)) for _ in range(3000)})
    got = {x["name"]: x["at"] for x in ranks.global_rank(spark.createDataFrame([(n,) for n in names], "name string").repartition(5), ["name"], "at").collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=lambda n: n.encode()))}
    rows = [("hot", k) for k in range(2000)] + [(r.choice("abc"), k) for k in range(300)] + [(None, k) for k in range(5)]
    got = ranks.rank_in_group(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], ["v"], "at", "n").collect()
    of = defaultdict(list)
    for g, v in rows:
        of[g].append(v)
    assert {(x["g"], x["v"]): (x["at"], x["n"]) for x in got} == {(g, v): (k, len(vs)) for g, vs in of.items() for k, v in enumerate(sorted(vs))}
    assert ranks.global_rank(spark.createDataFrame([], "name string"), ["name"], "at").count() == 0


def test_biased_walks(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    vertices = spark.createDataFrame([(k,) for k in range(7)], "id long")
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    p, q = 0.25, 2.0
    got = walks.biased_walks(vertices, edges, 700, 4, p, q, seed=3)
    paths = [x["path"] for x in got.collect()]
    assert len(paths) == 7 * 700 and all(x[k + 1] in near[x[k]] for x in paths for k in range(len(x) - 1))
    assert all(len(x) == (1 if x[0] == 6 else 4) for x in paths)
    seen = defaultdict(Counter)
    for x in paths:
        for k in range(1, len(x) - 1):
            seen[x[k - 1], x[k]][x[k + 1]] += 1
    for (t, v), count in seen.items():
        weight = {x: 1 / p if x == t else 1.0 if x in near[t] else 1 / q for x in near[v]}
        total, n = sum(weight.values()), sum(count.values())
        for x, w in weight.items():
            share = w / total
            assert abs(count[x] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-9, (t, v, x)
    again = walks.biased_walks(vertices.repartition(3), edges.repartition(5), 3, 4, p, q, seed=9)
    assert sorted(map(str, again.collect())) == sorted(map(str, walks.biased_walks(vertices, edges, 3, 4, p, q, seed=9).collect()))
    assert walks.biased_walks(vertices.limit(0), edges, 2, 3, p, q).count() == 0


def test_sampled_neighbourhood(spark):
    r = random.Random(4)
    rows = [("folder", "contains", "file", r.randrange(6), f) for f in range(40)] + [("file", "calls", "file", r.randrange(40), 0) for _ in range(200)] + [("file", "calls", "file", r.randrange(40), r.randrange(40)) for _ in range(60)]
    edges = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, src long, dst long")
    seeds = spark.createDataFrame([(b, "file", i) for b in range(3) for i in (0, 5 + b, 39)], "batch long, type string, id long")
    fan = [4, 3]
    got = [tuple(x) for x in walks.sampled_neighbourhood(edges, seeds, fan, seed=1).collect()]
    assert len(set(got)) == len(got) and {x[2:] for x in got} <= set(rows)
    into = defaultdict(set)
    for a, rel, b, src, dst in rows:
        into[b, dst, a, rel].add(src)
    took = defaultdict(set)
    for batch, hop, a, rel, b, src, dst in got:
        took[batch, hop, b, dst, a, rel].add(src)
    for batch in range(3):
        front, reached = {("file", 0), ("file", 5 + batch), ("file", 39)}, set()
        for hop, most in enumerate(fan):
            reached |= front
            for (b, dst, a, rel), srcs in into.items():
                assert len(took[batch, hop, b, dst, a, rel]) == (min(most, len(srcs)) if (b, dst) in front else 0)
            front = {(a, src) for (x, h, _, _, a, _), srcs in took.items() if x == batch and h == hop for src in srcs} - reached
    assert sorted(got) == sorted(tuple(x) for x in walks.sampled_neighbourhood(edges.repartition(7), seeds, fan, seed=1).collect())
    assert walks.sampled_neighbourhood(edges, seeds.limit(0), fan).count() == 0


def test_batches_of_typed_graphs():
    rng = np.random.default_rng(1)
    sizes = {"file": 60, "folder": 5, "other": 3}
    relations = [("file", "file"), ("folder", "file"), ("file", "other")]
    edges = [(rng.integers(0, sizes[a], 300), rng.integers(0, sizes[b], 300), None) for a, b in relations]
    near = attention.Neighbours(edges, relations, sizes)
    pick, use = near.sample(rng, np.array([3, 9]), 2, 4)
    assert all(np.array_equal(x, np.unique(x)) for x in pick.values()) and set(pick) == set(sizes)
    for (src, dst, _), (a, b), (s, d, _) in zip(edges, relations, use, strict=True):
        whole = set(zip(src.tolist(), dst.tolist(), strict=True))
        assert all((int(pick[a][i]), int(pick[b][j])) in whole for i, j in zip(s, d, strict=True))
        assert Counter(d.tolist()).most_common(1)[0][1] <= 4 if len(d) else True
    assert len(use[2][0]) == 0  # no hop back from files reaches the third type
    a, b = attention._negatives(rng, np.array([3, 9, 20]), 60, 50, {3 * 60 + 9, 9 * 60 + 3})
    ids = np.array([3, 9, 20])
    assert len(a) and all(x != y and {int(ids[x]), int(ids[y])} != {3, 9} for x, y in zip(a, b, strict=True))
    pairs = np.unique(np.sort(np.stack([edges[0][0], edges[0][1]]), 0), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    settings = attention.Settings().updated({"epochs": 2, "batch_files": 10, "batch_size": 64})
    out = attention.train(60, pairs, edges, relations, sizes, None, False, settings, 1, loops=False)
    assert out.shape[0] == 60 and np.isfinite(out).all()


def test_large_systems_are_clustered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(clustering, "LARGE", 50)
    r = random.Random(1)
    rows = [(d, i, [float(10 * (i % 3)) + r.random(), float(i % 3) + r.random()]) for d, n in (("big", 90), ("small", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, id long, embedding array<double>")
    got = clustering.cluster(df, "kmeans", k=3)
    of = defaultdict(set)
    for x in got.collect():
        of[x["dataset"], x["id"] % 3].add(x["cluster"])
    assert got.columns == ["dataset", "id", "cluster", "k", "silhouette"] and all(len(v) == 1 for v in of.values())
    assert all(len({min(of[d, k]) for k in range(3)}) == 3 for d in ("big", "small")) and got.count() == 120


@pytest.mark.parametrize("kind", ["ppr", "heat"])
def test_diffusion_by_columns(spark, monkeypatch, kind):
    r = random.Random(2)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(50), r.randrange(50)) for _ in range(120)) if a != b})
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    vertices = spark.createDataFrame([(k,) for k in range(53)], "id long")  # three without edges
    rows = lambda df: {(x["src"], x["dst"]): x["weight"] for x in df.collect()}
    want = rows(diffusion.gdc_exact(vertices, edges, kind, 0.3, 6))
    monkeypatch.setattr(kernels, "DENSE_NODES", 10)
    monkeypatch.setattr(diffusion, "COLUMNS", 7)
    monkeypatch.setattr(kernels, "PRODUCT", 40)
    got = rows(diffusion.gdc(vertices, edges, kind, 0.3, 6))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    monkeypatch.setattr(diffusion, "SENT_EDGES", 10)
    with pytest.raises(ValueError, match="edges"):
        diffusion.gdc_columns(vertices, edges, kind)
    if kind == "ppr":  # by pushes
        pushed = rows(diffusion.gdc(vertices, edges, kind, 0.3, 53, 1e-5))
        monkeypatch.setattr(kernels, "DENSE_NODES", 5000)
        assert all(abs(pushed.get(k, 0) - w) < 2e-3 for k, w in rows(diffusion.gdc_exact(vertices, edges, kind, 0.3, 53)).items())


def test_neighbourhood_by_lists(spark, tmp_path, monkeypatch):
    """Lists and ranks give the same edges; the last hop starts nothing, so no front of it is written."""
    r = random.Random(6)
    rows = [("file", rel, "file", r.randrange(90), dst) for rel in ("calls", "uses") for dst in (0, 1, *range(20)) for _ in range(40 if dst < 2 else 3)]
    edges = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, src long, dst long")
    seeds = spark.createDataFrame([(b, "file", i) for b in range(4) for i in (0, 1, 7 + b)], "batch long, type string, id long")
    got = []
    for most in (0, 8, 1000):
        monkeypatch.setattr(walks, "LISTED", most)
        names = iter(range(100))
        monkeypatch.setattr(store, "shared_path", lambda spark, tag, at=tmp_path / str(most), names=names: f"{at}/{tag}-{next(names)}")
        got.append(sorted(map(tuple, walks.sampled_neighbourhood(edges, seeds, [5, 3], seed=2).collect())))
        assert sum(x.name.startswith(("front-", "hop-")) for x in (tmp_path / str(most)).iterdir()) == 2
    assert got[0] == got[1] == got[2] and len(got[0]) > 60


def _shuffles(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_written_tables_leave_no_shuffles(spark):
    before = _shuffles(spark)
    made = store.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert _shuffles(spark) <= before and made.count() == 7 and spark.conf.get(store.CLEANED) == "false"
    path = made._skein_path
    store.discard(made)
    assert not os.path.exists(path.removeprefix("file:"))


def test_pairs_send_items_once(spark, tmp_path):
    """The window pairs as the view's join does, with null keys and a null part, and the items are sent once."""
    rows = [(1, 5, 1, 1, 2, 1.0, "R"), (1, 6, 1, 2, 3, 1.0, "A"), (1, None, 1, 3, 4, 1.0, "N"), (1, 5, 1, 4, 1, 1.0, "R"), (1, 6, 1, 5, 9, 1.0, "R"), (None, 5, 1, 1, 2, 1.0, "R"), (None, 6, 1, 2, 2, 1.0, "R"), (2, 7, 1, 1, 2, 1.0, None)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity int, l_extendedprice double, l_returnflag string")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fx.pairs(spark, str(tmp_path))
    want = spark.sql(fx.VIEWS["fx_pairs"].replace("from lineitem", "from {lineitem}"), lineitem=items)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window") == 1


def test_model_of_many_rows(spark):
    """Variables that stand in several rows get the ids of one row."""
    kind = "variables array<string>, first long, cells array<struct<src:long,dest:long,values:map<string,long>,details:array<struct<type:string,src:struct<file:string,object:string,type:string>,dest:struct<file:string,object:string,type:string>>>>>"
    names = [f"a/F{k}.java" for k in range(7)]
    one = prepare.extract_entities(spark.createDataFrame([(names, 0, None)], kind).drop("first"), "java")
    many = prepare.extract_entities(spark.createDataFrame([(names[:3], 0, None), (names[3:6], 3, None), (names[6:], 6, None)], kind), "java")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.select(one.columns).collect()))
    assert {x["ID"] for x in many.collect()} == set(range(7))


def test_diffusion_by_source(spark, monkeypatch):
    """Tasks that hold the neighbour lists and joins over blocks of sources give the rows of the plain joins."""
    r = random.Random(12)
    pairs = {tuple(sorted((r.randrange(60), r.randrange(60)))) for _ in range(150)} | {(0, k) for k in range(1, 40)}
    v = spark.range(62)  # two without edges
    e = spark.createDataFrame([x for a, b in pairs if a != b for x in ((a, b), (b, a))], "src long, dst long").cache()
    rows = lambda df: {(x["source"], x["node"]): x["p"] for x in df.collect()}
    walked = rows(diffusion.top_k(diffusion.ppr(v, e), 5))
    pushed = rows(diffusion.top_k(diffusion.symmetric(diffusion.push(v, e, 0.15, 0.05), v, e), 5))
    for sent in (10_000, 0):
        monkeypatch.setattr(diffusion, "SENT_LISTS", sent)
        monkeypatch.setattr(diffusion, "AT_ONCE", 40)
        assert rows(diffusion.ppr_top(v, e, 5)) == pytest.approx(walked, abs=1e-12)
        assert rows(diffusion._pushed_top(v, e, 0.15, 0.05, 5)) == pytest.approx(pushed, abs=1e-12)
    assert rows(diffusion.ppr(v, e, rounds=2, sources=v.where("id % 20 = 0"))) == pytest.approx({k: p for k, p in rows(diffusion.ppr(v, e, rounds=2)).items() if k[0] % 20 == 0}, abs=1e-12)


def test_silhouette_by_blocks(spark, monkeypatch):
    """Pairs of blocks give the silhouette of one group, also with a point alone in its cluster."""
    rng = np.random.default_rng(3)
    x, label = rng.standard_normal((150, 6)), [k % 4 for k in range(149)] + [9]
    x[::4] += 3
    df = spark.createDataFrame([(k, row.tolist(), lab) for k, (row, lab) in enumerate(zip(x, label, strict=True))], "id long, embedding array<float>, label int")
    monkeypatch.setattr(clustering, "BLOCK", 16)
    monkeypatch.setattr(clustering, "BLOCKS", 3)
    assert clustering.silhouette(df, sample=None).first()[0] == pytest.approx(kernels.silhouette(x.astype(np.float32), np.array(label)), abs=1e-9)


def test_search_of_dealt_rows(spark, monkeypatch):
    """A large system's k is that of the same sample, and its rows are dealt."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(8 * c, 0.3, (30, 3)) for c in range(3)])
    df = spark.createDataFrame([("a", k, row.tolist()) for k, row in enumerate(x)], "dataset string, id long, embedding array<double>")
    monkeypatch.setattr(clustering, "SAMPLE", 40)
    k, score = clustering.search_k(x, 2, 4, "kmeans", 1)
    monkeypatch.setattr(clustering, "LARGE", 50)
    out = clustering.cluster(df, "kmeans", None, 2, 4, seed=1)
    rows = out.collect()
    assert {(r["k"], r["silhouette"]) for r in rows} == {(k, score)} and k == 3
    assert len(rows) == 90 and len({(r["id"] // 30, r["cluster"]) for r in rows}) == 3
