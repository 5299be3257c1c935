"""Preparation of systems: ``clean-existing`` tables or ``rebuild-raw`` models into a clean copy with a report.

    python -m skein.plans.preparation --mode clean-existing --data DIR --out DIR [--systems a,b]
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare
from ..session import session
from ..sources import catalog, schema
from ..sources.labels import Labels, load_labels
from ..sources.tables import find_model, read_csv, read_model
from .store import materialize


def from_model(spark: SparkSession, root: str, name: str, labels: Labels) -> tuple[DataFrame, DataFrame]:
    """Entity and dependency rows of a system's raw model, in scope."""
    how = catalog.PREPARATIONS[name]
    paths = [p for base in (f"{root}/raw", f"{root}/Raw_Data", root) if (p := find_model(spark, f"{base}/{how.folder}", name))]
    if not paths:
        raise FileNotFoundError(f"no model of {name} under {root}")
    model = read_model(spark, paths[0])
    rows = prepare.in_scope(prepare.in_roots(prepare.extract_entities(model, how.language), labels.roots), how.exclude_tests)
    if how.add_truth_files and labels.entities:
        rows = prepare.add_truth_files(rows, labels.entity_frame(spark), how.language)
    return rows.withColumn("row_id", F.col("Member_ID")), model


def prepare_system(spark: SparkSession, root: str, out: str, name: str, rebuild: bool = False) -> DataFrame:
    """Clean tables, exported truth and one report row of a system."""
    how, labels = catalog.PREPARATIONS[name], load_labels(spark, root, name)
    if rebuild or how.rebuild:
        rows, model = from_model(spark, root, name, labels)
        entities, data_stats = prepare.clean_entities(materialize(rows, "entities"), labels)
        raw = prepare.extract_dependencies(model, entities)
    else:
        rows = read_csv(spark, f"{root}/processed/{name}.csv", schema.ENTITIES)
        entities, data_stats = prepare.clean_entities(prepare.in_scope(prepare.in_roots(rows, labels.roots), how.exclude_tests), labels)
        raw = read_csv(spark, f"{root}/processed/{name}_deps.csv", schema.DEPENDENCIES)
    entities = materialize(entities, "entities")
    deps, dep_stats = prepare.clean_dependencies(raw, entities)
    write = lambda df, path: df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    write(entities.orderBy("row_id").drop("row_id"), f"{out}/processed/{name}.csv")
    deps.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out}/processed/{name}_deps.csv")
    truth = prepare.truth_table(labels, entities)
    write(truth, f"{out}/GT/{name}_gt.csv")
    prepare.truth_json(name, labels, entities).coalesce(1).write.mode("overwrite").text(f"{out}/GT/{name}_gt.json")
    head = spark.createDataFrame([(name, how.language, how.kind, labels.raw_count)], "dataset string, language string, gt_type string, gt_raw_items long")
    gt = truth.agg(F.count("*").alias("gt_rows_out"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [data_stats, dep_stats, gt], head)  # one row each


def run(spark: SparkSession, root: str, out: str, names: list[str], rebuild: bool = False) -> DataFrame:
    """Report of all systems, by name, also written as CSV."""
    rows = [materialize(prepare_system(spark, root, out, n, rebuild), "report") for n in names]
    report = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).orderBy("dataset")
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/validation_report.csv")
    return report


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--mode", choices=["clean-existing", "rebuild-raw"], default="clean-existing")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--systems", default="")
    a = p.parse_args(argv)
    names = [n for n in a.systems.split(",") if n] or list(catalog.PREPARATIONS)
    if wrong := [n for n in names if n not in catalog.PREPARATIONS]:
        p.error(f"unknown systems: {', '.join(wrong)}")
    run(session("prepare"), a.data, a.out, names, a.mode == "rebuild-raw").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
