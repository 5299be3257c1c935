"""Schemas of the entity, dependency, metric and runtime tables, and of the raw extractor model."""

from __future__ import annotations

#: Column names and order of the files that are exchanged.
ENTITIES = "File string, ID long, Member_Name string, Member_Type string, Entity string, Member_ID long, Module string"
DEPENDENCIES = (
    "Source_ID long, Target_ID long, Source_File string, Target_File string, Source_Member string, Target_Member string, "
    "Source_Member_Type string, Target_Member_Type string, Dependency_Type string, Dependency_Count long, Is_Member_Level boolean, "
    "Source_Module string, Target_Module string"
)
METRICS = (
    "Model string, Dataset string, run_id int, clustering string, algorithm string, n_clusters int, search_range string, mojofm double, "
    "a2a double, c2c_cvg_33 double, c2c_cvg_50 double, c2c_cvg_66 double, c2c_cvg_80 double, ari double, normalized_turbomq double, "
    "turbomq double, total_pipeline_seconds double"
)
RUNTIMES = "Model string, Dataset string, run_id int, clustering string, algorithm string, n_clusters int, search_range string, total_pipeline_seconds double, assignments int"
MODEL = (
    "variables array<string>, cells array<struct<src: bigint, dest: bigint, values: map<string, bigint>, details: array<struct<type: string, "
    "src: struct<file: string, object: string, type: string>, dest: struct<file: string, object: string, type: string>>>>>"
)
