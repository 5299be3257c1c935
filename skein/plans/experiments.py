"""Experiments: (method x system x run) from tables to metric rows or assignments, with resume.

    python -m skein.plans.experiments --config FILE [--only NAME,...] [--datasets NAME,...]
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attention, clustering, graphs, metrics, walks
from ..session import session
from ..sources import catalog, results, schema
from ..sources.tables import load_dataset
from .store import materialize

#: Neighbours kept by diffusion for known systems.
GDC_K = {"HDC": 16, "HDF": 16, "Bash": 64, "C.Img": 32, "AS4": 64, "Hadoop": 64, "JabRef": 64, "A.UML": 128, "TeamMates": 128, "Chrome": 32}
METHODS = ("negar", "metapath2vec", "homogeneous_gat", "heterogeneous_gat", "structural_gat")


def slug(name: object) -> str:
    return "".join(c if c.isalnum() or c in "_-" else "_" for c in str(name)).strip("_")


def merged(base: dict, over: dict | None) -> dict:
    """``base`` with ``over`` laid over it, dictionaries entry by entry."""
    out = dict(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def chosen_experiments(config: dict, only: list[str] | None) -> list[dict]:
    """Experiments whose name or display name is asked for; an unknown one raises."""
    found = config.get("experiments", [])
    if not only:
        return found
    names = lambda e: {slug(e["name"]).lower(), str(e.get("settings", {}).get("Method", "")).lower()}
    want = {slug(x).lower() for x in only}
    if lost := want - set().union(*map(names, found)):
        raise ValueError(f"unknown experiments: {', '.join(sorted(lost))}")
    return [e for e in found if names(e) & want]


def exact_k(common: dict, dataset: str) -> int | None:
    """Fixed number of clusters, or null for as many as true modules. A null entry counts as absent."""
    for key in ("exact_k", "n_clusters"):
        value = common.get(key)
        if isinstance(value, dict):
            value = value.get(dataset, value.get("default"))
        if value is not None:
            return int(value)
    return None


def k_range(common: dict, dataset: str) -> tuple[int, int]:
    over = (common.get("k_range_overrides") or {}).get(dataset) or {}
    return int(over.get("k_min", common.get("k_min", 5))), int(over.get("k_max", common.get("k_max", 20)))


def resolved(settings: dict, method: str, dataset: str, over: dict, profile: Callable[[], tuple[int, int]], custom: bool, nearest: Callable[[], str] | None = None) -> dict:
    """Settings with the diffusion rules applied: ``profile()`` gives files and modules, ``nearest()`` a known system."""
    out = dict(settings)
    if method != "homogeneous_gat" or not out.get("use_gdc"):
        return out
    if custom:
        files, modules = profile()
        rule = {"num_layers": 1 if files > 500 and modules > 10 else 2, "gdc_k": 16 if files < 300 else 32 if files <= 432 else 64}
        return out | {k: v for k, v in rule.items() if k not in over}
    if str(out.get("gdc_k") if out.get("gdc_k") is not None else "auto").strip().lower() in ("", "auto", "best"):
        out["gdc_k"] = GDC_K[dataset] if dataset in GDC_K else GDC_K[nearest()]
    return out


class System:
    """A system's tables and graphs, each made once."""

    def __init__(self, spark: SparkSession, name: str, nodes: DataFrame, deps: DataFrame) -> None:
        self.spark, self.name, self.deps = spark, name, deps
        self.vertices = materialize(graphs.files(nodes), "vertices")
        self.majority = materialize(graphs.files(nodes, "majority"), "labels")
        self.rows = materialize(graphs.dependencies(deps, self.vertices, loops=True), "rows")
        done = graphs.completeness(self.vertices).first()
        self.files, self.modules, self.complete = done["files"], done["modules"], done["complete"]
        self._edges: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = materialize(graphs.undirected(self.rows), "edges")
        return self._edges

    def truth(self) -> DataFrame:
        return self.vertices.select(F.lit(self.name).alias("dataset"), F.col("File").alias("entity"), F.col("Module").alias("cluster"))

    def sized(self, df: DataFrame, folders: int = 0) -> DataFrame:
        return df.withColumn("dataset", F.lit(self.name)).withColumn("n", F.lit(self.files)).withColumn("folders", F.lit(folders))


def embed(system: System, method: str, s: dict, seed: int, collapse: bool = True) -> DataFrame:
    """``dataset, id, embedding`` of a system by one of :data:`METHODS`."""
    if s.get("file_feature_init") == "negar":
        raise ValueError("walk embeddings as initial features are not supported")
    n_of = system.spark.createDataFrame([(system.name, system.files)], "dataset string, n long")
    named = lambda df: df.withColumn("dataset", F.lit(system.name))
    if method == "negar":
        w = walks.random_walks(system.vertices.select("id"), system.edges, s.get("num_walks", 100), s.get("walk_length", 30), s.get("p", 1.0), s.get("q", 1.0), seed)
        return walks.walk_embeddings(named(w.select("path")), n_of, s.get("dimensions", 128), s.get("window", 15), s.get("epochs", 5), s.get("negative", 5), seed)
    if method == "metapath2vec":
        e = graphs.metapath(system.vertices, system.rows)
        w = walks.metapath_walks(e, ["file", "folder", "file"], s.get("walks_per_node", 40), s.get("walk_length", 15), seed)
        # folders get ids after the files
        part = lambda x: F.split(x, ":")
        ids = w.select(F.transform("path", lambda x: part(x)[1].cast("long") + F.when(part(x)[0] == "folder", F.lit(system.files)).otherwise(F.lit(0))).alias("path"))
        n = e.where("dst_type = 'folder'").agg(F.coalesce(F.max("dst") + 1, F.lit(0))).first()[0]
        both = system.spark.createDataFrame([(system.name, system.files + n)], "dataset string, n long")
        out = walks.walk_embeddings(named(ids), both, s.get("embedding_dim", 64), s.get("context_size", 5), s.get("epochs", 20), s.get("num_negative_samples", 1), seed)
        return out.where(F.col("id") < system.files)
    if method == "homogeneous_gat":
        e = system.edges.select(F.lit("file").alias("src_type"), F.lit("e").alias("rel"), F.lit("file").alias("dst_type"), "src", "dst")
        return attention.embed(system.sized(e), method, s, seed)
    if method in ("heterogeneous_gat", "structural_gat"):
        e = graphs.heterogeneous(system.vertices, system.rows, s.get("collapse_dependency_types", collapse))
        return attention.embed(system.sized(e, graphs.folders(system.vertices).count()), method, s, seed)
    raise ValueError(f"unknown method {method!r}")


def clusterings(how: str, fixed: bool) -> list[str]:
    """Names of the clusterings of a run: at the fixed k if there is one, and at the searched k."""
    return [f"{how}_exact_k"] * fixed + [f"{how}_search"]


def run(spark: SparkSession, config: dict, only: list[str] | None = None, datasets: list[str] | None = None) -> list[str]:
    """Run what is not done yet; returns the folders that got rows. Rows go out after each run."""
    common = config.get("common", {})
    names, known, out_dir = catalog.select(common, datasets), catalog.datasets(common), common.get("out_dir", "Results").replace("\\", "/")
    evaluate, written, systems = common.get("evaluate", True), [], {}

    def system(name: str) -> System:
        if name not in systems:
            systems[name] = System(spark, name, *load_dataset(spark, common.get("data_dir", "."), known[name], name))
            if evaluate and not systems[name].complete:
                raise ValueError(f"{name} has files without a module; set evaluate to false")
        return systems[name]

    for e in chosen_experiments(config, only):
        method = e["method"]
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        model = e.get("settings", {}).get("Method", e["name"])
        path = f"{out_dir}/{'/'.join(e.get('output_path', [slug(e['name'])]))}/{'results' if evaluate else 'runtimes'}"
        for name in names:
            over = (e.get("dataset_overrides") or {}).get(name) or {}
            began = time.perf_counter()
            sys_ = system(name)
            built = time.perf_counter() - began
            s = resolved(merged(e.get("settings", {}), over), method, name, over, lambda sys_=sys_: (sys_.files, sys_.modules), name not in catalog.SYSTEMS, lambda sys_=sys_: _nearest(spark, sys_, known, common))
            how = clustering.algorithm(e.get("clustering_algorithm"), s.get("clustering_algorithm"), common.get("clustering_algorithm"))
            k = exact_k(common, name) or (sys_.modules if sys_.complete else 0)
            kinds = clusterings(how, k > 0)
            planned = spark.createDataFrame([(model, name, i + 1) for i in range(common.get("num_runs", 1))], "Model string, Dataset string, run_id int")
            done = results.read_results(spark, path) if _exists(spark, path) else spark.createDataFrame([], schema.RUNTIMES)
            for run_id in sorted(r["run_id"] for r in results.open_runs(planned, done, len(kinds)).collect()):
                seed, began = int(common.get("random_state") or 0) + run_id - 1, time.perf_counter()
                key = results.cache_key(method, name, run_id, s | {"seed": seed})
                folder = common.get("embedding_cache_dir") if common.get("use_embedding_cache") else None
                x = results.cached_embedding(spark, folder, key, lambda s=s, seed=seed: materialize(embed(sys_, method, s, seed, common.get("collapse_hgat_dependencies", True)), "embedding"))
                spent, rows = built + time.perf_counter() - began, None
                low, high = k_range(common, name)
                for kind in kinds:
                    began = time.perf_counter()
                    lab = materialize(clustering.cluster(x, how, k, seed=seed) if kind.endswith("exact_k") else clustering.cluster(x, how, None, low, high, seed), "clusters")
                    assigned = lab.join(sys_.vertices.select("id", "File"), "id").select("dataset", F.col("File").alias("entity"), "cluster")
                    row = metrics.evaluate(assigned, sys_.truth(), sys_.deps) if evaluate else spark.createDataFrame([(name,)], "dataset string")
                    row = materialize(row, "row") if evaluate else row
                    head = {"Model": model, "Dataset": name, "run_id": run_id, "clustering": kind, "algorithm": how, "n_clusters": int(lab.first()["k"]), "search_range": None if kind.endswith("exact_k") else f"{low}_to_{high}"}
                    if not evaluate:
                        results.append_assignments(assigned.select(*[F.lit(v).alias(c) for c, v in head.items() if c in ("Model", "Dataset", "run_id", "clustering")], F.col("entity").alias("file"), "cluster"), f"{out_dir}/{'/'.join(e.get('output_path', [slug(e['name'])]))}/assignments")
                    row = row.withColumns({c: F.lit(v).cast("int" if c in ("run_id", "n_clusters") else "string") for c, v in head.items()}).withColumn("total_pipeline_seconds", F.lit(round(spent + time.perf_counter() - began, 4)))
                    rows = row if rows is None else rows.unionByName(row)
                results.append_results(rows, path)
                written.append(path)
    return list(dict.fromkeys(written))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def _nearest(spark: SparkSession, system: System, known: dict, common: dict) -> str:
    """The known system whose size and degree are nearest."""
    rows = []
    for name in GDC_K:
        nodes, deps = load_dataset(spark, common.get("data_dir", "."), known[name], name)
        p = graphs.profile(nodes, deps).first()
        rows.append((name, p["files"], p["avg_degree"]))
    edges = system.deps.select("Source_File", "Target_File").distinct().count()
    mine = spark.createDataFrame([(system.files, edges / max(system.files, 1))], "files long, avg_degree double")
    return graphs.nearest_profile(mine, spark.createDataFrame(rows, "dataset string, files long, avg_degree double")).first()["nearest"]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--only", default="")
    p.add_argument("--datasets", default="")
    a = p.parse_args(argv)
    with open(a.config, encoding="utf-8") as f:
        config = json.load(f)
    base = os.path.dirname(os.path.abspath(a.config))
    for key in ("data_dir", "out_dir"):  # either separator, relative to the configuration
        if value := config.get("common", {}).get(key):
            value = value.replace("\\", "/")
            config["common"][key] = value if "://" in value else os.path.join(base, value)
    listed = lambda x: [v for v in x.split(",") if v] or None
    print("\n".join(run(session("experiments"), config, listed(a.only), listed(a.datasets))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
