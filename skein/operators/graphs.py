"""Graph construction: vertices with gapless ids, labels, file-file edges, folder trees, metapath graphs, profiles.

Tables: vertices ``id, File, Module``; edges ``src, dst`` (ids). Relations are a column, never a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.store import materialize
from ..sources.tables import normalize_columns
from .ranks import global_rank

#: Fixed value: folder of files that lie in no other folder.
ROOT_FOLDER = "__m2v_root__"
#: Path tokens that are never folders.
PLAIN_TOKENS = ("src", "main", "java")


def gapless(df: DataFrame, order: str, out: str = "id", chunk: int = 1 << 18) -> DataFrame:
    """``out``: rank of ``order`` (a distinct non-negative long) from 0.

    Rows are ranked in chunks of the order's values; only the chunks' counts are summed in one task, so that no task
    ever sorts the whole table.
    """
    marked = df.withColumn("_c", F.floor(F.col(order) / chunk).cast("long"))
    before = marked.groupBy("_c").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = marked.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(order)) - 1)
    return inside.join(before, "_c").withColumn(out, (F.col("_b") + F.col("_r")).cast("long")).drop("_c", "_r", "_b")


def files(nodes: DataFrame, label: str = "first") -> DataFrame:
    """``id, File, Module, first_row``: one row for each file in the order of first rows.

    ``label``: ``first`` takes the module of the first row; ``majority`` the most frequent labelled one, lower-cased,
    the smaller name of a tie; a file without labelled row has null.
    """
    if "File" not in nodes.columns:
        raise ValueError("the entity table needs a File column")
    rows = normalize_columns(nodes)
    if "Module" not in rows.columns:
        rows = rows.withColumn("Module", F.lit(None).cast("string"))
    first = rows.groupBy("File").agg(F.min("row_id").alias("first_row"), F.min_by(F.coalesce("Module", F.lit("")), "row_id").alias("Module"))
    if label == "majority":
        votes = rows.where(T.is_labelled(F.col("Module"))).groupBy("File", F.lower(T.trimmed(F.col("Module"))).alias("m")).agg(F.count("*").alias("n"))
        best = votes.groupBy("File").agg(F.min_by("m", F.struct(-F.col("n"), "m")).alias("Module"))
        first = first.drop("Module").join(best, "File", "left")
    first = first.withColumn("Module", F.when(T.is_labelled(F.col("Module")), F.col("Module")))
    return gapless(first, "first_row").select("id", "File", "Module", "first_row")


def label_ids(vertices: DataFrame) -> DataFrame:
    """``id, label``: rank of the module among the sorted ones; all null unless every file is labelled."""
    names = vertices.select("Module").where("Module is not null").distinct()
    ranked = names.withColumn("label", F.row_number().over(Window.orderBy("Module")) - 1)  # one row for each module
    whole = vertices.agg(F.coalesce(F.bool_and(F.col("Module").isNotNull()), F.lit(False)).alias("_whole"))
    out = vertices.join(F.broadcast(ranked), "Module", "left").join(F.broadcast(whole))
    return out.select("id", F.when(F.col("_whole"), F.col("label")).cast("int").alias("label"))


def completeness(vertices: DataFrame) -> DataFrame:
    """One row: files, labelled files, modules, and whether all files are labelled."""
    out = vertices.agg(F.count("*").alias("files"), F.count("Module").alias("labelled"), F.count_distinct("Module").alias("modules"))
    return out.withColumn("complete", F.col("files") == F.col("labelled"))


def dependencies(deps: DataFrame, vertices: DataFrame, loops: bool = False, key: str = "File") -> DataFrame:
    """``src, dst, Dependency_Type, Dependency_Count``: rows between known files as ids, self loops on request.

    Both lookups are equi joins on the file name; Spark broadcasts the vertex table while it is small. Where both tables
    have another ``key`` (``Source_<key>``, ``Target_<key>`` of the rows), such as a number, that is sent and no name.
    """
    rows = normalize_columns(deps) if key == "File" else deps
    ids = vertices.select("id", key)
    a, b = f"Source_{key}", f"Target_{key}"
    out = rows.join(ids.select(F.col(key).alias(a), F.col("id").alias("src")), a).join(ids.select(F.col(key).alias(b), F.col("id").alias("dst")), b)
    return (out if loops else out.where("src <> dst")).select("src", "dst", *[c for c in ("Dependency_Type", "Dependency_Count") if c in rows.columns])


def directed(rows: DataFrame) -> DataFrame:
    """Distinct ``src, dst``."""
    return rows.select("src", "dst").distinct()


def undirected(rows: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of both directions, sent once: each pair is made distinct before it is mirrored."""
    pairs = rows.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")


def weighted(rows: DataFrame) -> DataFrame:
    """``src, dst, weight, n``: summed counts and number of parallel rows."""
    return rows.groupBy("src", "dst").agg(F.coalesce(F.sum("Dependency_Count"), F.lit(0)).alias("weight"), F.count("*").alias("n"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, neighbours`` (sorted, distinct)."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def edge_list(adjacent: DataFrame) -> DataFrame:
    """``src, dst`` of adjacency lists."""
    return adjacent.select("src", F.explode("neighbours").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def relations(rows: DataFrame, collapse: bool = True) -> DataFrame:
    """Typed directed edges ``rel, src, dst``: one relation, or one for each dependency type; self loops as given."""
    rel = F.lit("depends_on") if collapse else F.col("Dependency_Type")
    return rows.select(rel.alias("rel"), "src", "dst").distinct()


def _tokens(vertices: DataFrame) -> DataFrame:
    """``id, tokens``: directory tokens without plain ones and without those that occur as often as there are files."""
    cut = vertices.select("id", T.path_tokens(F.col("File")).alias("all"))
    counts = common_tokens(vertices).agg(F.collect_list("token").alias("common"))  # a common token is in every path: few
    kept = cut.join(F.broadcast(counts))
    return kept.select("id", F.filter("all", lambda x: ~F.array_contains("common", x) & ~x.isin(*PLAIN_TOKENS)).alias("tokens"))


def token_counts(vertices: DataFrame) -> DataFrame:
    """``token, n``: occurrences of each directory token."""
    return vertices.select(F.explode(T.path_tokens(F.col("File"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def common_tokens(vertices: DataFrame) -> DataFrame:
    """Tokens whose occurrences (not files) are as many as the files."""
    total = vertices.agg(F.count("*").alias("files"))
    return token_counts(vertices).join(F.broadcast(total)).where("n = files").select("token")


def folders(vertices: DataFrame) -> DataFrame:
    """``folder_id, folder``: every prefix of a file's tokens, ranked by name."""
    return _folders(_tokens(vertices))


def _folders(tokens: DataFrame) -> DataFrame:
    names = tokens.select(F.explode(T.prefixes(F.col("tokens"))).alias("folder")).distinct()
    return global_rank(names, ["folder"], "folder_id").select("folder_id", "folder")


def contains(vertices: DataFrame, folder: DataFrame) -> DataFrame:
    """``src`` (folder), ``dst`` (file): the deepest folder of each file; files in none have no edge."""
    return _contains(_tokens(vertices), folder)


def _contains(tokens: DataFrame, folder: DataFrame) -> DataFrame:
    deepest = tokens.where(F.size("tokens") > 0).select(F.col("id").alias("dst"), F.array_join("tokens", "/").alias("folder"))
    return deepest.join(folder, "folder").select(F.col("folder_id").alias("src"), "dst")


def parent_of(folder: DataFrame) -> DataFrame:
    """``src`` (parent), ``dst`` (child) among folders."""
    child = folder.where(F.contains("folder", F.lit("/"))).select(F.regexp_replace("folder", "/[^/]*$", "").alias("parent"), F.col("folder_id").alias("dst"))
    return child.join(folder.select(F.col("folder").alias("parent"), F.col("folder_id").alias("src")), "parent").select("src", "dst")


def heterogeneous(vertices: DataFrame, rows: DataFrame, collapse: bool = True) -> DataFrame:
    """``src_type, rel, dst_type, src, dst``: folder tree, folder to file, and file relations (self loops kept)."""
    tokens = materialize(_tokens(vertices), "tokens")
    folder = materialize(_folders(tokens), "folders")
    typed = lambda df, a, rel, b: df.select(F.lit(a).alias("src_type"), rel.alias("rel"), F.lit(b).alias("dst_type"), "src", "dst")
    return typed(_contains(tokens, folder), "folder", F.lit("contains"), "file").unionByName(typed(parent_of(folder), "folder", F.lit("parent_of"), "folder")).unionByName(typed(relations(rows, collapse), "file", F.col("rel"), "file"))


def metapath(vertices: DataFrame, rows: DataFrame) -> DataFrame:
    """``src_type, dst_type, src, dst``: file-folder edges in both directions and undirected file edges.

    Files in no folder hang on one made up for them. Folder ids are ranks by name.
    """
    tokens = materialize(_tokens(vertices), "tokens")
    place = tokens.select("id", F.when(F.size("tokens") > 0, F.array_join("tokens", "/")).otherwise(F.lit(ROOT_FOLDER)).alias("folder"))
    names = tokens.select(F.explode(T.prefixes(F.col("tokens"))).alias("folder")).unionByName(place.where(F.col("folder") == ROOT_FOLDER).select("folder")).distinct()
    ids = global_rank(names, ["folder"], "folder_id")
    held = materialize(place.join(ids, "folder").select("id", "folder_id"), "places")
    typed = lambda df, a, b, x, y: df.select(F.lit(a).alias("src_type"), F.lit(b).alias("dst_type"), F.col(x).alias("src"), F.col(y).alias("dst"))
    return typed(held, "file", "folder", "id", "folder_id").unionByName(typed(held, "folder", "file", "folder_id", "id")).unionByName(typed(undirected(rows), "file", "file", "src", "dst"))


def profile(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """One row: distinct files, distinct directed edges of any ends, edges for each file."""
    a = normalize_columns(nodes).agg(F.count_distinct("File").alias("files"))
    b = normalize_columns(deps).select("Source_File", "Target_File").distinct().agg(F.count("*").alias("edges"))
    out = a.join(F.broadcast(b))
    return out.withColumn("avg_degree", F.when(F.col("files") > 0, F.col("edges").cast("double") / F.col("files")).otherwise(0.0))


def nearest_profile(target: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile (``dataset, files, avg_degree``, a small stated set) nearest to each target row, the first of a tie.

    Squared distance of the binary logarithm of the size over 4 and of the degree over 3.
    """
    size = lambda c: F.log2(F.greatest(F.col(c), F.lit(2)))
    p = profiles.select(F.col("dataset").alias("nearest"), F.col("files").alias("_f"), F.col("avg_degree").alias("_d"))
    far = F.pow((size("files") - size("_f")) / 4, 2) + F.pow((F.col("avg_degree") - F.col("_d")) / 3, 2)
    pairs = target.join(F.broadcast(p), F.lit(True)).withColumn("distance", far)
    keys = target.columns
    return pairs.groupBy(*keys).agg(F.min_by("nearest", F.struct("distance", "nearest")).alias("nearest"), F.min("distance").alias("distance"))


def gdc_rule(vertices: DataFrame) -> DataFrame:
    """One row: files, modules, and the number of layers and of neighbours kept for a system of that size."""
    counts = vertices.agg(F.count("*").alias("files"), F.count_distinct(F.lower("Module")).alias("modules"))
    return counts.select("files", "modules", F.when((F.col("files") > 500) & (F.col("modules") > 10), 1).otherwise(2).alias("num_layers"), F.when(F.col("files") < 300, 16).when(F.col("files") <= 432, 32).otherwise(64).alias("gdc_k"))


def negatives(vertices: DataFrame, edges: DataFrame, per_node: int, seed: int) -> DataFrame:
    """Random pairs that are no edges: ``per_node`` draws by hash for each vertex, known edges and loops taken out."""
    total = vertices.agg(F.count("*").alias("_n"))
    draws = vertices.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("k")).join(F.broadcast(total))
    drawn = draws.select("src", F.pmod(F.xxhash64(F.lit(seed), "src", "k"), F.col("_n")).alias("dst")).where("src <> dst").distinct()
    return drawn.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
