"""Preparation: entities and dependencies from a raw model, scope filters, labelling, clean tables, exports, reports.

All functions take and return DataFrames. Where the first of several rows counts, the order is that of ``row_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.store import materialize
from ..sources.labels import Labels
from .ranks import global_rank
from .rules import modules_found

#: Columns that tell two entity rows apart.
ENTITY_KEY = ("File", "Entity", "Member_ID", "Member_Name", "Member_Type")


def in_scope(df: DataFrame, exclude_tests: bool) -> DataFrame:
    """Rows outside test folders, where the system leaves tests out."""
    return df.where(~T.is_test_path(F.col("File"))) if exclude_tests and "File" in df.columns else df


def root_candidates(roots: list[str]) -> tuple[list[str], list[str]]:
    """Dotted names and slashed paths that count as a root or lie below it."""
    dotted, slashed = [], []
    for root in (r.strip().replace("/", ".").rstrip(".") for r in roots):
        head, mark, rest = root.partition(".")
        special = bool(mark) and head in ("main", "test", "client")
        dotted += [root, rest] if special else [root]
        path = root.replace(".", "/")
        slashed += [path, f"src/{head}/java/{path[len(head) + 1 :]}", path[len(head) + 1 :]] if special else [path]
    return sorted(set(dotted)), sorted(set(slashed))


def _below(c: Column, roots: list[str], mark: str) -> Column:
    out = F.lit(False)
    for r in roots:
        out = out | (c == r) | c.startswith(r + mark)
    return out


def in_roots(df: DataFrame, roots: list[str]) -> DataFrame:
    """Rows whose entity or file lies in a root package; all rows without roots."""
    if not roots:
        return df
    dotted, slashed = root_candidates(roots)
    keep = F.lit(False)
    if "Entity" in df.columns:
        keep = keep | _below(F.regexp_replace(F.replace(T.clean_path(F.col("Entity")), F.lit("/"), F.lit(".")), r"\.java$", ""), dotted, ".")
    if "File" in df.columns:
        keep = keep | _below(T.clean_path(F.col("File")), slashed, "/")
    return df.where(keep)


def extract_entities(model: DataFrame, language: str) -> DataFrame:
    """One ``file`` row for each variable and one row for each end of a detail whose file is known; distinct.

    ``Member_ID`` is the rank of ``File::Type::Name`` among the distinct ones. A variable's ``ID`` is its place. A model of
    many rows, so that no task holds all variables, also says in ``first`` which place a row's variables begin at.
    """
    first = F.col("first") if "first" in model.columns else F.lit(0)
    files = model.select(first.alias("first"), F.posexplode("variables").alias("ID", "File")).select((F.col("first") + F.col("ID")).cast("long").alias("ID"), T.clean_path(F.col("File")).alias("File"))
    files = files.groupBy("File").agg(F.max("ID").alias("ID"))  # of equal paths the last counts
    java = language == "java"
    own = files.select("File", "ID", T.path_stem(F.col("File")).alias("Member_Name"), F.lit("file").alias("Member_Type"), (T.java_file_entity(F.col("File")) if java else F.col("File")).alias("Entity"))
    detail = model.select(F.explode("cells").alias("c")).select(F.explode("c.details").alias("d"))
    ends = detail.select(F.explode(F.array("d.src", "d.dest")).alias("e")).select(T.clean_path(F.col("e.file")).alias("File"), F.col("e.object").alias("object"), F.col("e.type").alias("Member_Type")).where(F.col("object").isNotNull())
    if java:
        member = T.java_member(F.col("object"))
        member, entity = F.when(F.lower(member) == "java", T.path_stem(F.col("File"))).otherwise(member), T.java_entity(F.col("object"), F.col("Member_Type"))
    else:
        member, entity = T.plain_member(F.col("File"), F.col("object"), F.col("Member_Type")), F.col("File")
    # a file is an end of many details: made distinct before anything is joined
    ends = ends.select("File", member.alias("Member_Name"), "Member_Type", entity.alias("Entity")).distinct()
    rows = own.unionByName(ends.join(files, "File").select(own.columns)).distinct()
    named = rows.withColumn("_key", F.concat_ws("::", "File", F.coalesce("Member_Type", F.lit("None")), "Member_Name"))
    ids = member_ids(named.select("_key").distinct(), "_key")
    return named.join(ids, "_key").drop("_key")


def member_ids(keys: DataFrame, key: str) -> DataFrame:
    """Rank of distinct texts from 0, as ``Member_ID``."""
    return global_rank(keys.select(key), [key], "Member_ID")


def extract_dependencies(model: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each detail whose two files are known and differ; types that are only possible are left out.

    A dependency is between members if both ends name an object and neither object is its file.
    """
    known = entities.groupBy("File").agg(F.max("ID").alias("ID"))
    cell = model.select(F.explode("cells").alias("c")).select("c.src", "c.dest", "c.values", F.explode("c.details").alias("d"))
    rows = cell.select("src", "dest", "values", "d", T.clean_path(F.col("d.src.file")).alias("Source_File"), T.clean_path(F.col("d.dest.file")).alias("Target_File")).where("Source_File <> Target_File")
    dotted = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(".java"), F.lit("")), F.lit("/"), F.lit("."))
    src, dst, kind = F.col("d.src.object"), F.col("d.dest.object"), F.col("d.type")
    filled = (F.coalesce(src, F.lit("")) != "") & (F.coalesce(dst, F.lit("")) != "")
    member = filled & (dotted(src) != dotted(F.col("Source_File"))) & (dotted(dst) != dotted(F.col("Target_File")))
    named = lambda c: F.when(member, T.last_part(c, ".")).otherwise("")
    # before the lookups, so that they send no objects and counts
    told = rows.where(~F.coalesce(kind.ilike("%possible%"), F.lit(False))).select(
        F.when(member, F.col("src")).alias("Source_ID"), F.when(member, F.col("dest")).alias("Target_ID"),
        "Source_File", "Target_File", named(src).alias("Source_Member"), named(dst).alias("Target_Member"),
        F.col("d.src.type").alias("Source_Member_Type"), F.col("d.dest.type").alias("Target_Member_Type"), kind.alias("Dependency_Type"),
        F.coalesce(F.try_element_at("values", kind), F.lit(1)).cast("long").alias("Dependency_Count"), member.alias("Is_Member_Level"),
    )
    for end in ("Source", "Target"):
        told = told.join(known.select(F.col("File").alias(f"{end}_File"), F.col("ID").alias(f"_{end}")), f"{end}_File")
        told = told.withColumn(f"{end}_ID", F.when(F.col("Is_Member_Level"), F.col(f"{end}_ID")).otherwise(F.col(f"_{end}"))).drop(f"_{end}")
        told = materialize(told, "ends") if end == "Source" else told  # so that the names are not in the shuffles of both lookups at once
    return told.select("Source_ID", "Target_ID", "Source_File", "Target_File", "Source_Member", "Target_Member", "Source_Member_Type", "Target_Member_Type", "Dependency_Type", "Dependency_Count", "Is_Member_Level").distinct()


def add_truth_files(entities: DataFrame, truth: DataFrame, language: str) -> DataFrame:
    """Labelled entities (``entity``) that are no file or entity yet as ``file`` rows with the next ids, by name."""
    have = entities.select(T.clean_path(F.col("File")).alias("entity")).unionByName(entities.select(T.clean_path(F.col("Entity")).alias("entity"))).distinct()
    more = truth.select(T.clean_path(F.col("entity")).alias("entity")).distinct().join(have, "entity", "left_anti")
    top = entities.agg(F.coalesce(F.max("ID") + 1, F.lit(0)).alias("_i"), F.coalesce(F.max("Member_ID") + 1, F.lit(0)).alias("_m"))
    ranked = member_ids(more, "entity").join(F.broadcast(top))  # one row
    path = F.col("entity")
    new = ranked.select(path.alias("File"), (F.col("_i") + F.col("Member_ID")).alias("ID"), T.path_stem(path).alias("Member_Name"), F.lit("file").alias("Member_Type"), (T.java_file_entity(path) if language == "java" else path).alias("Entity"), (F.col("_m") + F.col("Member_ID")).alias("Member_ID"))
    return entities.unionByName(new, allowMissingColumns=True)


def match_entities(df: DataFrame, truth: DataFrame) -> DataFrame:
    """``_truth``: the modules of the row's entity, else of its file (``truth``: entity, modules)."""
    side = lambda name, c: truth.select(F.col("entity").alias(name), F.col("modules").alias(c))
    keyed = df.withColumn("_e", T.clean_path(F.col("Entity"))).withColumn("_f", T.clean_path(F.col("File")))
    found = keyed.join(side("_e", "_me"), "_e", "left").join(side("_f", "_mf"), "_f", "left")
    return found.withColumn("_truth", first_filled(F.col("_me"), F.col("_mf"))).drop("_e", "_f", "_me", "_mf")


def match_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``_truth``: modules of all rules whose pattern is found in the entity, else in the file; in rule order.

    Rules are a stated set that each task holds (see :mod:`skein.operators.rules`): no join, and nothing is shuffled.
    """
    if not rules:
        return df.withColumn("_truth", F.array().cast("array<string>"))
    return df.withColumn("_truth", first_filled(*[modules_found(T.clean_path(F.col(c)), rules) for c in ("Entity", "File")]))


def first_filled(*lists: Column) -> Column:
    """The first list that is not empty, else the empty list; each is evaluated once."""
    filled = F.filter(F.array(*lists), lambda x: F.coalesce(F.size(x) > 0, F.lit(False)))
    return F.coalesce(F.get(filled, F.lit(0)), F.array().cast("array<string>"))


def infer_modules(df: DataFrame, labels: Labels, prefer_truth: bool = False) -> DataFrame:
    """``_modules``: those that the row states (``Module_List``, ``Modules``, ``Module``), else those of the truth."""
    spark = df.sparkSession
    matched = match_entities(df, labels.entity_frame(spark)) if labels.entities else match_rules(df, labels.rules)
    stated = [T.normalize_modules(F.col(c)) for c in ("Module_List", "Modules", "Module") if c in df.columns]
    order = [F.col("_truth"), *stated] if prefer_truth else [*stated, F.col("_truth")]
    out = matched.withColumn("_modules", first_filled(*order))
    if labels.collapse:
        out = out.withColumn("_modules", F.when(F.size("_modules") > 1, F.array(T.best_module(F.col("File"), F.col("Entity"), F.col("_modules")))).otherwise(F.col("_modules")))
    return out.drop("_truth")


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row, by ``row_id``, of each combination of ``keys``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))).where("_n = 1").drop("_n")


def clean_entities(df: DataFrame, labels: Labels, prefer_truth: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labelled, distinct entity rows, and one row of statistics. Needs ``row_id`` for which copy stays."""
    if "row_id" not in df.columns:
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    rows = df.withColumn("File", T.clean_path(F.col("File")))
    if "Entity" not in rows.columns:
        rows = rows.withColumn("Entity", F.col("File"))
    rows = infer_modules(rows, labels, prefer_truth).where(F.size("_modules") > 0)
    rows = first_rows(rows, [c for c in ENTITY_KEY if c in rows.columns])
    stats = rows.agg(F.count("*").alias("data_rows_out"), F.count_distinct("File").alias("unique_files_out"), F.count_distinct("Entity").alias("unique_entities_out"), F.coalesce(F.sum((F.size("_modules") > 1).cast("long")), F.lit(0)).alias("multi_label_rows"))
    stats = df.agg(F.count("*").alias("data_rows_in")).join(F.broadcast(stats)).withColumn("data_rows_dropped_unlabeled", F.col("data_rows_in") - F.col("data_rows_out")).withColumn("multi_label_gt", F.lit(labels.multi))
    rows = rows.drop("Module_List", "Modules", "is_duplicated", "Duplicated").withColumn("Module", F.element_at("_modules", 1))
    if labels.multi:
        rows = rows.withColumn("Module_List", F.to_json("_modules")).withColumn("Modules", F.col("Module_List")).withColumn("is_duplicated", F.size("_modules") > 1)
    return rows.drop("_modules"), stats


def file_modules(entities: DataFrame) -> DataFrame:
    """``File, modules``: the distinct modules of a file's rows in their order."""
    column = "Module_List" if "Module_List" in entities.columns else "Module"
    listed = entities.select("File", "row_id", F.posexplode(T.normalize_modules(F.col(column))).alias("_p", "m"))
    firsts = listed.groupBy("File", "m").agg(F.min(F.struct("row_id", "_p")).alias("at"))  # pre-aggregated: one row a module
    return firsts.groupBy("File").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("modules"))


def clean_dependencies(df: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct dependencies between labelled files with both modules, and one row of statistics."""
    rows = df.withColumn("Source_File", T.clean_path(F.col("Source_File"))).withColumn("Target_File", T.clean_path(F.col("Target_File"))).drop("row_id")
    known = file_modules(entities).where(F.size("modules") > 0)
    for end in ("Source", "Target"):
        rows = rows.join(known.select(F.col("File").alias(f"{end}_File"), F.col("modules").alias(f"_{end}")), f"{end}_File")
    lists = [f"{e}_{c}" for e in ("Source", "Target") for c in ("Module_List", "Modules", "is_duplicated")]
    rows = rows.drop(*lists)
    for end in ("Source", "Target"):
        rows = rows.withColumn(f"{end}_Module", F.element_at(f"_{end}", 1))
        if "Module_List" in entities.columns:
            rows = rows.withColumn(f"{end}_Module_List", F.to_json(f"_{end}")).withColumn(f"{end}_Modules", F.to_json(f"_{end}")).withColumn(f"{end}_is_duplicated", F.size(f"_{end}") > 1)
    rows = rows.drop("_Source", "_Target").distinct()
    stats = df.agg(F.count("*").alias("dep_rows_in")).join(F.broadcast(rows.agg(F.count("*").alias("dep_rows_out")))).withColumn("dep_rows_dropped_unlabeled", F.col("dep_rows_in") - F.col("dep_rows_out"))
    return rows, stats


def truth_table(labels: Labels, entities: DataFrame) -> DataFrame:
    """Exported truth: entities with their modules and whether the data hold them, or the rules."""
    spark = entities.sparkSession
    if not labels.entities:
        return labels.rule_frame(spark).orderBy("rule_no").select(F.col("module").alias("Module"), F.col("pattern").alias("Pattern"))
    keys = entities.select(T.clean_path(F.col("Entity")).alias("entity")).unionByName(entities.select(T.clean_path(F.col("File")).alias("entity"))).distinct().withColumn("_hit", F.lit(True))
    rows = labels.entity_frame(spark).join(keys, "entity", "left").orderBy("pos")
    return rows.select(F.col("entity").alias("Entity"), F.to_json("modules").alias("Module_List"), F.element_at("modules", 1).alias("Module"), (F.size("modules") > 1).alias("is_duplicated"), F.coalesce("_hit", F.lit(False)).alias("Matched_In_Data"))


def truth_groups(labels: Labels, entities: DataFrame) -> DataFrame:
    """``module, items`` (sorted): the groups of the exported JSON."""
    if labels.entities:
        pairs = labels.entity_frame(entities.sparkSession).select(F.explode("modules").alias("module"), F.col("entity").alias("item"))
    else:
        item = F.coalesce(F.when(T.clean_path(F.col("Entity")) != "", T.clean_path(F.col("Entity"))), T.clean_path(F.col("File")))
        pairs = entities.select(T.normalize_module(F.col("Module")).alias("module"), item.alias("item")).where("item <> ''")
    return pairs.distinct().groupBy("module").agg(F.sort_array(F.collect_list("item")).alias("items"))


def truth_json(dataset: str, labels: Labels, entities: DataFrame) -> DataFrame:
    """One row with the exported JSON text: schema version, name, roots, groups in order of their names."""
    group = F.struct(F.lit("group").alias("@type"), F.col("module").alias("name"), F.transform("items", lambda x: F.struct(F.lit("item").alias("@type"), x.alias("name"))).alias("nested"))
    groups = truth_groups(labels, entities).agg(F.array_sort(F.collect_list(F.struct("module", group.alias("g")))).alias("all"))
    roots = F.array(*[F.lit(r) for r in labels.roots]) if labels.roots else F.array().cast("array<string>")
    return groups.select(F.to_json(F.struct(F.lit("1.0").alias("@schemaVersion"), F.lit(dataset).alias("name"), roots.alias("root_packages"), F.lit(labels.collapse).alias("collapse_multi_by_path"), F.transform("all", lambda x: x["g"]).alias("structure"))).alias("value"))


def nearest_root(paths: DataFrame, roots: DataFrame, path: str = "File", root: str = "root", mark: str = "/") -> DataFrame:
    """``path`` and ``root`` for each distinct path: the longest root that is the path or a folder above it; null if none.

    A path's prefixes are exploded once and meet the roots by equality, so the cost grows with the depth of the paths and
    not with the number of roots. Prefixes that no root has are gone before the paths are grouped. Null paths are left out.
    """
    known = roots.select(F.col(root).alias("_root")).where("_root is not null").distinct()
    each = paths.select(F.col(path)).where(F.col(path).isNotNull()).distinct()
    parts = F.split(F.col(path), "\\Q" + mark + "\\E", -1)
    cut = each.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), mark))).alias("_root"))
    found = cut.join(known, "_root").groupBy(path).agg(F.max_by("_root", F.length("_root")).alias(root))
    return each.join(found, path, "left")


def set_relations(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """``keys`` and a boolean ``in_<name>`` for each table: in which of them a key occurs.

    One tagged pass: rows are bits, which are merged before they are shuffled, so that equality, union, intersection and
    both differences of any two tables come from one grouping. Null is a key like any other.
    """
    tagged = [df.select(*[F.col(k) for k in keys], F.lit(1 << n).alias("_bit")) for n, df in enumerate(tables.values())]
    merged = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.bit_or("_bit").alias("_bits"))
    return merged.select(*keys, *[(F.col("_bits").bitwiseAND(F.lit(1 << n)) != 0).alias(f"in_{name}") for n, name in enumerate(tables)])
