"""Preparation, graphs, diffusion, and the two plans end to end on small systems; queries against their SQL."""

import glob
import json
import os

import duckdb
import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.operators import clustering, diffusion, graphs, prepare
from skein.plans import experiments, fixtures, preparation, queries
from skein.sources import schema
from skein.sources.labels import Labels

SF = "/root/testdata/sf0.001"


def model(spark):
    end = lambda f, o, t: {"file": f, "object": o, "type": t}
    rows = [{
        "variables": ["src\\a\\A.java", "src/a/B.java", "src/test/C.java"],
        "cells": [{"src": 7, "dest": 8, "values": {"Call": 4}, "details": [
            {"type": "Call", "src": end("src/a/A.java", "src.a.A.run(int)", "function"), "dest": end("src/a/B.java", "src.a.B", "class")},
            {"type": "Possible Call", "src": end("src/a/A.java", "x.Y", "class"), "dest": end("src/a/B.java", "z", "class")},
            {"type": "Use", "src": end("src/a/A.java", None, None), "dest": end("src/a/B.java", "src.a.B.f", "function")},
            {"type": "Call", "src": end("src/a/A.java", "q", "var"), "dest": end("src/a/A.java", "q", "var")},
            {"type": "Call", "src": end("gone.java", "q", "var"), "dest": end("src/a/A.java", "A.java", "file")},
        ]}, {"src": 1, "dest": 2, "values": {}, "details": None}],
    }]
    return spark.createDataFrame(pd.DataFrame({"j": [json.dumps(rows[0])]})).select(F.from_json("j", schema.MODEL).alias("m")).select("m.*")


def test_extract(spark):
    rows = prepare.extract_entities(model(spark), "java")
    got = {(r["File"], r["Member_Type"], r["Member_Name"], r["Entity"]): r["Member_ID"] for r in rows.collect()}
    assert ("src/a/A.java", "function", "run", "src.a.A") in got and ("src/a/A.java", "file", "A", "src.a.A") in got
    assert sorted(got.values()) == [sorted({f"{k[0]}::{k[1]}::{k[2]}" for k in got}).index(f"{k[0]}::{k[1]}::{k[2]}") for k in sorted(got, key=got.get)]
    deps = {(r["Dependency_Type"], r["Is_Member_Level"]): r.asDict() for r in prepare.extract_dependencies(model(spark), rows).collect()}
    # an object that equals its file's dotted name is the file, so the first dependency is between files
    assert set(deps) == {("Call", False), ("Use", False)}
    assert deps["Call", False]["Dependency_Count"] == 4 and deps["Use", False]["Dependency_Count"] == 1 and deps["Use", False]["Source_ID"] == 0
    assert prepare.in_scope(rows, True).where("File like '%test%'").count() == 0 and prepare.in_scope(rows, False).count() == rows.count()


def test_clean(spark):
    labels = Labels(entities={"a.X": ["m1", "m2"], "f/Y.c": ["m3"]})
    df = spark.createDataFrame([(0, "f\\X.c", "a.X", "p", None), (1, "f/X.c", "a.X", "p", None), (2, "f/Y.c", "zz", "p", None), (3, "f/Z.c", "zz", "p", None), (4, "f/W.c", "zz", "p", "Own")], "row_id long, File string, Entity string, Member_Name string, Module string")
    rows, stats = prepare.clean_entities(df, labels)
    got = {r["File"]: (r["Module"], json.loads(r["Module_List"]), r["is_duplicated"], r["row_id"]) for r in rows.collect()}
    assert got == {"f/X.c": ("m1", ["m1", "m2"], True, 0), "f/Y.c": ("m3", ["m3"], False, 2), "f/W.c": ("own", ["own"], False, 4)}
    s = stats.first()
    assert (s["data_rows_in"], s["data_rows_out"], s["data_rows_dropped_unlabeled"], s["multi_label_rows"], s["multi_label_gt"]) == (5, 3, 2, 1, True)
    deps = spark.createDataFrame([("f/X.c", "f/Y.c", 1), ("f\\X.c", "f/Y.c", 1), ("f/X.c", "f/Z.c", 1)], "Source_File string, Target_File string, n int")
    out, st = prepare.clean_dependencies(deps, rows)
    r = out.first()
    assert out.count() == 1 and (r["Source_Module"], r["Target_Module"], r["Source_is_duplicated"]) == ("m1", "m3", True) and st.first()["dep_rows_dropped_unlabeled"] == 2
    truth = {r["Entity"]: r["Matched_In_Data"] for r in prepare.truth_table(labels, rows).collect()}
    assert truth == {"a.X": True, "f/Y.c": True}
    text = json.loads(prepare.truth_json("s", labels, rows).first()["value"])
    assert [g["name"] for g in text["structure"]] == ["m1", "m2", "m3"] and text["structure"][0]["nested"] == [{"@type": "item", "name": "a.X"}]
    assert prepare.clean_entities(df.limit(0), labels)[0].count() == 0
    collapsed, _ = prepare.clean_entities(df.where("row_id = 0"), Labels(entities={"a.X": ["q", "f"]}, collapse=True))
    assert collapsed.first()["Module"] == "f" and "Module_List" not in collapsed.columns


def test_roots(spark):
    df = spark.createDataFrame([("a/b/X.java",), ("a/bc/X.java",), ("src/main/java/k/X.java",), ("k/Y.java",)], "File string")
    assert [r["File"] for r in prepare.in_roots(df, ["a.b"]).collect()] == ["a/b/X.java"]
    assert {r["File"] for r in prepare.in_roots(df, ["main/k"]).collect()} == {"src/main/java/k/X.java", "k/Y.java"}
    assert prepare.in_roots(df, []).count() == 4


def test_graph_labels(spark):
    df = spark.createDataFrame([(5, "b.c", "M"), (6, "b.c", "m"), (7, "b.c", "k"), (9, "a.c", None), (8, "a.c", "Nan")], "row_id long, File string, Module string")
    first = {r["File"]: (r["id"], r["Module"]) for r in graphs.files(df).collect()}
    assert first == {"b.c": (0, "M"), "a.c": (1, None)}
    assert {r["File"]: r["Module"] for r in graphs.files(df, "majority").collect()} == {"b.c": "m", "a.c": None}
    assert {r["label"] for r in graphs.label_ids(graphs.files(df)).collect()} == {None}
    assert {r["label"] for r in graphs.label_ids(graphs.files(df.where("row_id < 8"))).collect()} == {0}
    with pytest.raises(ValueError):
        graphs.files(df.drop("File"))
    big = spark.range(0, 5000, 7).withColumnRenamed("id", "v")
    assert [tuple(r) for r in graphs.gapless(big, "v", chunk=100).orderBy("v").collect()] == [(v, i) for i, v in enumerate(range(0, 5000, 7))]


def test_ppr_all_neighbours(spark, monkeypatch):
    edges = [(0, 1), (0, 2), (0, 3), (3, 4), (1, 2)]
    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    monkeypatch.setattr(queries, "_vertices", lambda *_: v)
    monkeypatch.setattr(queries, "_rows", lambda *_: e)
    monkeypatch.setattr(queries.graphs, "undirected", lambda x: x)
    got = {(r["source"], r["node"]): r["p"] for r in queries.QUERIES["ppr_all_neighbours"](spark, "").collect()}
    t = np.eye(6)
    for a, b in edges:
        t[a, b] = t[b, a] = 1
    t = t / np.sqrt(np.outer(t.sum(0), t.sum(0)))
    p = np.eye(6)
    for _ in range(3):
        p = 0.15 * np.eye(6) + 0.85 * p @ t
    assert got == {(i, j): pytest.approx(p[i, j], abs=1e-6) for i in range(6) for j in range(6) if p[i, j] > 0}


def test_push_is_symmetric(spark, monkeypatch):
    edges = [(0, 1), (0, 2), (0, 3), (0, 4), (4, 5), (1, 2)]  # a hub and leaves: degrees differ
    v = spark.createDataFrame([(i,) for i in range(7)], "id long")
    e = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    rows = lambda df: {(r["src"], r["dst"]): r["weight"] for r in df.collect()}
    exact = rows(diffusion.gdc_exact(v, e, "ppr", 0.5, 7))
    monkeypatch.setattr(diffusion.kernels, "DENSE_NODES", 3)
    got = rows(diffusion.gdc(v, e, "ppr", 0.5, 7, 1e-4))
    assert all(got.get(k, 0) == pytest.approx(w, abs=2e-3) for k, w in exact.items()) and set(got) <= set(exact)
    with pytest.raises(RuntimeError):
        diffusion.push(v, e, 0.5, 1e-4, 2)


def test_push_meets_exact(spark):
    edges = [(0, 1), (1, 2), (2, 0), (3, 4), (2, 3)]
    v = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    p = {(r["source"], r["node"]): r["p"] for r in diffusion.push(v, e, 0.2, 1e-4, 200).collect()}
    for s in range(6):
        assert 0.97 < sum(x for (a, _), x in p.items() if a == s) <= 1.0001
    kept = diffusion.sparsify(diffusion.ppr(v, e, rounds=4), k=2)
    assert kept.groupBy("source").count().agg(F.max("count")).first()[0] <= 2 and abs(kept.groupBy("source").agg(F.sum("weight").alias("w")).agg(F.min("w")).first()[0] - 1) < 1e-9
    x = diffusion.laplacian(v, e, 2).collect()
    assert all(len(r["features"]) == 3 and r["features"][0] == 1 for r in x)
    assert diffusion.gdc(v, e, "heat", 2.0, 3).count() == 18
    n = graphs.negatives(v, e, 4, 1)
    assert n.join(e, ["src", "dst"]).count() == 0 and n.where("src = dst").count() == 0


def write_system(folder, modules=True):
    os.makedirs(folder, exist_ok=True)
    files = [(f"src/m{i // 8}/p/F{i}.c", f"m{i // 8}") for i in range(24)]
    with open(f"{folder}/n.csv", "w") as f:
        f.write("File,Module\n" + "".join(f"{a},{b if modules else ''}\n" for a, b in files))
    deps = [(i, j) for i in range(24) for j in range(24) if i != j and (i // 8 == j // 8 and (i + j) % 2 or (i * 7 + j) % 31 == 0)]
    with open(f"{folder}/d.csv", "w") as f:
        f.write("Source_File,Target_File,Dependency_Type,Dependency_Count\n" + "".join(f"{files[i][0]},{files[j][0]},Call,{1 + i % 3}\n" for i, j in deps))


def config(data, out, **common):
    small = {"lpe_dim": 4, "file_emb_dim": 8, "folder_emb_dim": 8, "hidden_channels": 16, "out_channels": 8, "epochs": 15, "lr": 0.01}
    return {
        "common": {"data_dir": data, "out_dir": out, "custom_datasets": {"Own": ["n.csv", "d.csv"]}, "datasets": ["Own"], "k_min": 2, "k_max": 5, "random_state": 3, **common},
        "experiments": [
            {"name": "n2v", "method": "negar", "clustering_algorithm": "kmeans", "output_path": ["N2V"], "settings": {"Method": "N2V", "num_walks": 6, "walk_length": 8, "dimensions": 8, "window": 3, "epochs": 2, "negative": 2}},
            {"name": "m2v", "method": "metapath2vec", "output_path": ["M2V"], "settings": {"Method": "M2V", "walks_per_node": 3, "walk_length": 6, "embedding_dim": 8, "context_size": 2, "epochs": 1}},
            {"name": "gdc", "method": "homogeneous_gat", "output_path": ["GDC"], "settings": {"Method": "GAT_GDC", "use_gdc": True, "gdc_k": 8, **small}},
            {"name": "hgat", "method": "heterogeneous_gat", "output_path": ["HGAT"], "settings": {"Method": "HGAT", **small}},
        ],
    }


def test_experiments(spark, tmp_path):
    write_system(str(tmp_path / "data"))
    c = config(str(tmp_path / "data"), str(tmp_path / "out"))
    paths = experiments.run(spark, c)
    assert len(paths) == 4 and experiments.run(spark, c) == []  # done: nothing is run again
    for p in paths:
        rows = [r.asDict() for r in spark.read.parquet(p).collect()]
        assert len(rows) == 2 and {r["search_range"] for r in rows} == {None, "2_to_5"}
        assert all(0 <= r["mojofm"] <= 100 and r["turbomq"] is not None and r["n_clusters"] >= 2 for r in rows)
    with pytest.raises(ValueError):
        experiments.run(spark, c, only=["nope"])


def test_assignments(spark, tmp_path):
    write_system(str(tmp_path / "data"), modules=False)
    c = config(str(tmp_path / "data"), str(tmp_path / "out"), evaluate=False)
    assert experiments.run(spark, c, only=["N2V"]) and not experiments.run(spark, c, only=["N2V"])
    rows = spark.read.json(str(tmp_path / "out/N2V/assignments"))
    assert rows.count() == 24 and rows.select("file").distinct().count() == 24
    with pytest.raises(ValueError):
        experiments.run(spark, config(str(tmp_path / "data"), str(tmp_path / "o2")), only=["N2V"])


def test_settings():
    assert experiments.exact_k({"exact_k": None, "n_clusters": {"default": 4, "B": 5}}, "B") == 5 and experiments.exact_k({}, "B") is None
    assert experiments.k_range({"k_min": 1, "k_range_overrides": {"A": {"k_max": 9}}}, "A") == (1, 9)
    assert experiments.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    use = lambda s, over, custom, f=(600, 12): experiments.resolved(s, "homogeneous_gat", "Bash", over, lambda: f, custom, lambda: "HDC")
    assert use({"use_gdc": True, "gdc_k": 5}, {}, True) == {"use_gdc": True, "gdc_k": 64, "num_layers": 1}
    assert use({"use_gdc": True, "gdc_k": 5}, {"gdc_k": 5}, True, (299, 3)) == {"use_gdc": True, "gdc_k": 5, "num_layers": 2}
    assert use({"use_gdc": True, "gdc_k": "auto"}, {}, False)["gdc_k"] == 64 and use({"use_gdc": True, "gdc_k": 7}, {}, False)["gdc_k"] == 7
    assert experiments.slug(" a b/é ") == "a_b_é"


def test_preparation(spark, tmp_path):
    root = tmp_path / "d"
    os.makedirs(root / "processed")
    os.makedirs(root / "raw/bash")
    (root / "processed/bash.csv").write_text("File,Entity,Member_Name,Member_Type\na/x.c,a/x.c,x,file\na/x.c,a/x.c,x,file\nb/y.c,b/y.c,y,file\nz.c,z.c,z,file\n")
    (root / "processed/bash_deps.csv").write_text("Source_File,Target_File,Dependency_Type,Dependency_Count\na/x.c,b/y.c,Call,2\na/x.c,z.c,Call,1\n")
    (root / "raw/bash/bash_gt.json").write_text(json.dumps({"structure": [{"name": "A", "nested": [{"name": "a/x.c"}, {"name": "gone.c"}]}, {"name": "B", "nested": [{"name": "b/y.c"}]}]}))
    r = preparation.run(spark, str(root), str(tmp_path / "o"), ["bash"]).first()
    assert (r["dataset"], r["data_rows_in"], r["data_rows_out"], r["dep_rows_out"], r["gt_rows_out"], r["gt_raw_items"]) == ("bash", 4, 2, 1, 3, 3)
    assert spark.read.option("header", True).csv(str(tmp_path / "o/processed/bash.csv")).count() == 2
    raw = root / "raw/bash/bash-file.json"
    raw.write_text(model(spark).toJSON().first())
    (root / "raw/bash/bash_gt.json").write_text(json.dumps({"structure": [{"name": "A", "nested": [{"name": "src/a/A.java"}, {"name": "src/a/B.java"}]}]}))
    r = preparation.run(spark, str(root), str(tmp_path / "p"), ["bash"], rebuild=True).first()
    assert r["dep_rows_out"] >= 1 and r["unique_files_out"] == 2


def test_clustering(spark):
    rows = fixtures.partitions(spark, SF)
    assert rows[0].count() == rows[1].count() == 197
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.lit("d").alias("dataset"), F.col("vec_id").alias("id"), "embedding", "label")
    got = clustering.cluster(e, "kmeans", 6, seed=2)
    assert got.count() == e.count() and got.select("cluster").distinct().count() == 6
    assert clustering.kmeans_large(e, 4, starts=2).select("cluster").distinct().count() == 4
    scores = spark.createDataFrame([("d", 3, 0.5), ("d", 2, 0.5), ("d", 4, 0.1)], "dataset string, k int, score double")
    assert clustering.best_k(scores).first()["k"] == 2


#: Queries whose SQL is compared here; the driver compares all of them.
COMPARED = ["normalize_paths", "module_labels_majority", "edges_undirected", "folder_parent", "metapath_edges", "contingency", "ari", "c2c_coverage", "turbomq", "dep_file_modules", "ppr_top_neighbours"]


@pytest.mark.parametrize("name", COMPARED)
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()), key=str)
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_anchors(spark):
    r = queries.QUERIES["metric_row"](spark, SF).first().asDict()
    want = {"mojofm": 73.12, "a2a": 93.779904, "c2c_cvg_50": 91.304348, "c2c_cvg_80": 39.130435, "ari": 0.603423, "turbomq": 0.867714, "normalized_turbomq": 3.772669}
    assert {k: round(r[k], 6) for k in want} == want
