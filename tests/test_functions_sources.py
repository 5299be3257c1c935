"""Column functions, ground-truth parsers, catalogs and sinks on hand-made edge cases."""

import json

import pytest
from pyspark.sql import functions as F
from skein.functions import text as T
from skein.sources import catalog, labels, manifests, results, tables


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("raw", [" a\\b ", "org.x/src/org/x/A.java", "org.x/lib/A.java", "noslash.java", "a/b", "", None, " a/b "])
def test_clean_path(spark, raw):
    assert one(spark, T.clean_path, raw) == labels.clean(raw)


def test_names(spark):
    assert one(spark, T.java_entity, "a/b$C.run(x.Y)", "function") == "a.b.C"
    assert one(spark, T.java_entity, "A.java", "class") == "A" and one(spark, T.java_entity, "run", "var") == "run"
    assert one(spark, T.java_member, "a/b$C.run(x.Y)") == "run"
    assert [one(spark, T.path_stem, x) for x in ("d/a.tar.gz", ".hidden", "x/noext", "d/e/")] == ["a.tar", ".hidden", "noext", "e"]
    assert one(spark, lambda p: T.plain_member(p, F.lit("ns.f(int)"), F.lit(None)), "a.c") == "f"
    assert one(spark, T.slug, "_a b/ç-1_") == "a_b_ç-1"


@pytest.mark.parametrize(("raw", "want"), [("['A', \"b\", 'a']", ["a", "b"]), ('["X"]', ["x"]), ("('p','q',)", ["p", "q"]), (" Solo ", ["solo"]), ("nan", []), ("", []), (None, []), ("['none', 'k']", ["k"]), ("[broken", ["[broken"])])
def test_module_lists(spark, raw, want):
    assert one(spark, T.normalize_modules, raw) == want


def test_scopes_and_scores(spark):
    assert [one(spark, T.is_test_path, x) for x in ("a/Test/b", "tests/x", "contest/x", None)] == [True, True, False, False]
    best = lambda path, entity, mods: one(spark, lambda p, e: T.best_module(p, e, F.array(*map(F.lit, mods))), path, entity)
    assert best("src/net/http/A.java", "net.http.A", ["ui.core", "net.http"]) == "net.http"
    assert best("x/A.c", "", ["only"]) == "only" and best("x/A.c", "", ["aa", "bb"]) == "bb"
    assert best("lib/01a__core/x", "", ["01a__core", "zz"]) == "01a__core"


def test_json_truth():
    text = json.dumps({"root_packages": ["a/b", " "], "structure": [{"name": "G", "nested": [{"name": "x/A"}, {"name": "H", "nested": [{"name": "x/A"}, {"name": "y/B"}]}, 3]}, {"nested": [{"name": "z"}]}]})
    got = labels.parse_json(text)
    assert got.entities == {"x/A": ["g", "h"], "y/B": ["h"], "z": ["root"]} and got.roots == ["a.b"] and got.multi and got.raw_count == 4


def test_rule_truth():
    got = labels.parse_rules("# root-package\norg/app/ x\n# mapping\nCore org\\.app\\.core\\..*\nbad [unclosed\nname skip\nsolo\n# Modules\nignored line\n")
    assert got.roots == ["org.app"] and got.rules == [("core", "org\\.app\\.core\\..*")]
    assert labels.parse_rules("A org\\.x\\.a.*\nB org\\.x\\.b").roots == ["org.x"]
    assert labels.parse_rules("A org.x.y.z\nB com.k.l.m").roots == ["com.k.l", "org.x.y"]


def test_rsf_truth(spark, tmp_path):
    got = labels.parse_rsf("# c\ncontain M a b.c\nCONTAIN m2 a b.c\nhas x y\ncontain z\n")
    assert got.entities == {"a b.c": ["m", "m2"]}
    f = tmp_path / "x.rsf"
    f.write_text("contain A e1\ncontain B e1\ncontain A e2\n")
    assert sorted(map(tuple, labels.rsf_pairs(spark, str(f)).collect())) == [("A", "e1"), ("A", "e2"), ("B", "e1")]
    assert sorted(map(tuple, labels.rsf_pairs(spark, str(f), last_wins=True).collect())) == [("A", "e2"), ("B", "e1")]
    f.write_text("has A e1\n")
    with pytest.raises(ValueError):
        labels.rsf_pairs(spark, str(f), strict=True)
    assert [tuple(r) for r in labels.json_pairs(spark, json.dumps({"structure": [{"@type": "group", "name": "g", "nested": [{"@type": "item", "name": "i"}, {"name": "untyped"}]}]})).collect()] == [("g", "i")]


def test_catalog():
    common = {"custom_datasets": {"Own": {"nodes": "n.csv", "dependencies": "d.csv"}, "Two": ["a", "b"]}, "datasets": ["Bash", "Own"], "exclude_datasets": ["Bash"]}
    assert catalog.datasets(common)["Own"] == ("n.csv", "d.csv") and catalog.datasets({})["Chrome"] == ("chromium.csv", "chromium_deps.csv")
    assert catalog.select(common) == ["Own"] and catalog.select(common, ["Ant"]) == ["Ant"]
    with pytest.raises(ValueError):
        catalog.select(common, ["Nope"])
    with pytest.raises(ValueError):
        catalog.datasets({"custom_datasets": {"X": {"nodes": "n"}}})


def test_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text(' File ,Module,ID,Extra\n" a\\b.java ",1,3.0,x\n"c,\nd.java",NA,,\n')
    (tmp_path / "d.csv").write_text("Source_File,Target_File,Dependency_Type,Dependency_Count\na/b.java,c.java, Call ,2\n")
    nodes, deps = tables.load_dataset(spark, str(tmp_path), ("n.csv", "d.csv"), "own")
    rows = [r.asDict() for r in nodes.orderBy("row_id").collect()]
    assert [(r["File"], r["Module"], r["ID"], r["dataset"]) for r in rows] == [("a/b.java", "1", 3, "own"), ("c,\nd.java", None, None, "own")]
    assert deps.first()["Dependency_Type"] == "Call" and dict(deps.dtypes)["Dependency_Count"] == "bigint"


def test_results(spark, tmp_path):
    old = spark.createDataFrame([("m", "d", 1, 0.5, 9)], "Model string, Dataset string, run_id int, ari double, epochs int")
    new = spark.createDataFrame([("m", "d", 2, 0.7, "x")], "Model string, Dataset string, run_id int, turbomq double, note string")
    got = results.merge_results(old, new)
    assert got.columns == ["Model", "Dataset", "run_id", "ari", "turbomq", "note"] and got.count() == 2
    path = str(tmp_path / "r")
    results.append_results(old, path)
    results.append_results(new, path)
    back = results.read_results(spark, path)
    assert back.count() == 2 and set(back.columns) == set(got.columns)
    assert {r["run_id"] for r in results.completed_runs(back, 1).collect()} == {1, 2} and results.completed_runs(back, 2).count() == 0
    assert results.cache_key("a", "d", 1, {"x": 1, "y": {}}) == results.cache_key("a", "d", 1, {"x": 1}) != results.cache_key("a", "d", 2, {"x": 1})
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert results.cached_embedding(spark, str(tmp_path / "c"), "k", build).count() == 3
    assert len(calls) == 1


def test_rule_sections():
    text = "early e\\.x\n# notes of nothing known\nalso a\\.y\n# mapping\nin i\\.z\n# relations\nnot n\\.q\n# root-package\n/a/b/ tail\n# <regular_expression>\nlate l\n"
    got = labels.parse_rules(text)
    assert [m for m, _ in got.rules] == ["early", "also", "in", "late"] and got.roots == ["a.b"]
    assert labels.parse_rules("# mapping\n# modules\nx y\n").rules == [] and labels.parse_rules("").roots == []
    heads = {r"org\.app\.core\..*": "org.app.core.", r"^a.b(c|d)": "a.b", r"ab|cd": "ab", r"x\.yz*w": "x.yz", r"[ab]c": "", r"a\.b?c": "a.b", ".*": ""}
    assert {p: labels.literal_head(p) for p in heads} == heads
    assert labels.roots_of([r"a\.b\.c\.d", r"a\.b\.e"]) == ["a.b"] and labels.roots_of([r"a\.b\.c\.d", r"x\.y"]) == ["a.b.c"] and labels.roots_of(["(.*)"]) == []


def test_nested_items(spark):
    deep = {"name": "leaf"}
    for k in range(12):
        deep = {"name": f"g{k}" if k % 2 else "", "nested": [{"name": f"i{k}"}, deep]}
    whole = {"structure": [deep, {"name": "alone"}, {"name": "", "nested": [{"name": "x"}, {"name": ""}, {"name": "y", "nested": []}, {"nested": [{"name": "z"}]}]}]}
    rows = [(1, json.dumps(whole)), (2, None), (3, "no json"), (4, json.dumps({"structure": []})), (5, json.dumps({"other": 1}))]
    got = labels.nested_items(spark.createDataFrame(rows, "id long, text string")).orderBy("id", "place").collect()
    want = labels.parse_json(json.dumps(whole)).entities
    assert [(x["item"], x["module"].lower()) for x in got] == [(k, m) for k, ms in want.items() for m in ms] and {x["id"] for x in got} == {1}
    assert labels.nested_items(spark.createDataFrame([], "id long, text string")).count() == 0


def test_manifests(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    row = lambda **x: spark.createDataFrame([tuple(x.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in x.items()))
    assert manifests.read(spark, path).columns == []
    assert manifests.append(row(run=1, a="x"), path, "r1") and not manifests.append(row(run=1, a="again"), path, "r1")
    assert manifests.append(row(b="y", run=2), path, "r2")
    with pytest.raises(ValueError, match="another type"):
        manifests.append(row(run="text"), path, "r3")
    want = {(1, "x", None), (2, None, "y")}
    assert manifests.read(spark, path).columns == ["run", "a", "b"] and set(map(tuple, manifests.read(spark, path).collect())) == want
    # another writer takes the number that this one was about to take, once with another run and once with the same
    put, rivals = manifests._put, [("r4", row(run=4, c="z")), ("r5", row(run=5, a="twice"))]

    def slow(spark, at, number, content):
        if rivals:
            key, df = rivals.pop(0)
            monkeypatch.setattr(manifests, "_put", put)
            assert manifests.append(df, path, key)
            monkeypatch.setattr(manifests, "_put", slow)
        return put(spark, at, number, content)

    monkeypatch.setattr(manifests, "_put", slow)
    assert manifests.append(row(run=3, a="late"), path, "r3")
    assert not manifests.append(row(run=5, a="mine"), path, "r5")
    monkeypatch.setattr(manifests, "_put", put)
    want |= {(3, "late", None), (5, "twice", None)}
    got = manifests.read(spark, path)
    assert got.columns == ["run", "a", "b", "c"] and {x[:3] for x in map(tuple, got.collect())} == want | {(4, None, None)}
    assert manifests.compact(spark, path) == 5 and manifests.compact(spark, path) == 0
    assert sorted(map(str, manifests.read(spark, path).collect())) == sorted(map(str, got.collect()))
    assert len(manifests.latest(spark, path)[1]["parts"]) == 1 and not manifests.append(row(run=3, a="late"), path, "r3")
