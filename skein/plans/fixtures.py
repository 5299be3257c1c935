"""Adapter views: entity and dependency tables of one system, derived from the test tables ``part`` and ``lineitem``.

The same SQL text runs on Spark and DuckDB, so the queries' oracles start from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIEWS = {
    "fx_nodes": """with p as (select p_partkey k, cast(replace(p_brand,'Brand#','') as int) b, p_type ty, p_name nm from part where p_partkey % 97 <> 0),
m as (select 0 as j union all select 1 union all select 2),
f as (select k, b, j,
  case when k % 50 = 0 then concat('src/main/java/app/P', cast(k as varchar(20)), '.java')
       else concat('src/main/java/app/', ty, '/b', cast(b as varchar(20)), '/', replace(nm,' ','/'), '/P', cast(k as varchar(20)), '.java') end as path from p cross join m)
select k*3+j as row_id,
  case when k % 7 = 0 then concat(' ', replace(path,'/',chr(92)), ' ') else path end as File,
  concat('M', cast(case when j>0 and k % 11 = 0 then (b % 25)+1 else b end as varchar(20))) as Module,
  k*3+j as Member_ID, case when j=0 then 'file' else 'function' end as Member_Type, k as part_id,
  concat('C', cast((b + case when k % 5 = 0 then 1 else 0 end) % 23 as varchar(20))) as Pred from f""",
    "fx_pairs": """with l as (select l_orderkey o, l_partkey p, l_returnflag r, l_quantity q, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_returnflag) rn from lineitem)
select a.p s, b.p t, case a.r when 'R' then 'Call' when 'A' then 'Import' else 'Extend' end as Dependency_Type, cast(sum(a.q) as bigint) as Dependency_Count
from l a join l b on a.o=b.o and b.rn=a.rn+1 group by 1,2,3""",
    "fx_files": """select row_number() over (order by first_row) - 1 as id, File, Module, Pred, part_id from (
  select replace(trim(File), chr(92), '/') as File, min(row_id) as first_row, min_by(trim(Module), row_id) as Module,
         min_by(Pred, row_id) as Pred, min(part_id) as part_id from fx_nodes group by replace(trim(File), chr(92), '/')) g""",
    "fx_deps": """select coalesce(x.File, concat('gone/P', cast(d.s as varchar(20)), '.java')) as Source_File,
       coalesce(y.File, concat('gone/P', cast(d.t as varchar(20)), '.java')) as Target_File, d.Dependency_Type, d.Dependency_Count
from fx_pairs d left join fx_files x on x.part_id = d.s left join fx_files y on y.part_id = d.t""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it needs in front, for DuckDB."""
    needed = [v for v in VIEWS if v in sql]
    for v in list(VIEWS)[::-1]:
        if v in needed:
            needed += [u for u in VIEWS if u in VIEWS[v] and u not in needed]
    views = ", ".join(f"{v} as ({VIEWS[v]})" for v in VIEWS if v in needed)
    if not views:
        return sql
    head = sql.lstrip()
    return f"with {views}, {head[5:]}" if head.lower().startswith("with ") else f"with {views} {sql}"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rows (``row_id, File, Module, ...``)."""
    return spark.sql(VIEWS["fx_nodes"].replace("from part ", "from {part} "), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``File, Module, Pred, part_id`` of each file; the operators make ids."""
    path = F.replace(F.trim("File"), F.lit("\\"), F.lit("/"))
    return nodes(spark, sf_dir).groupBy(path.alias("File")).agg(F.min_by(F.trim("Module"), "row_id").alias("Module"), F.min_by("Pred", "row_id").alias("Pred"), F.min("part_id").alias("part_id"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s, t, Dependency_Type, Dependency_Count``: dependencies by the numbers of their parts, as the view ``fx_pairs`` has them.

    An item is paired with the next one of its order by a window, so that the items are sent once and not for each side.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey is not null")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    paired = items.select(F.col("l_partkey").alias("s"), F.lead(F.struct(F.col("l_partkey").alias("p"))).over(by).alias("next"), F.col("l_returnflag").alias("r"), F.col("l_quantity").alias("q")).where("next is not null")
    kind = F.when(F.col("r") == "R", "Call").when(F.col("r") == "A", "Import").otherwise("Extend")
    return paired.groupBy("s", F.col("next.p").alias("t"), kind.alias("Dependency_Type")).agg(F.sum("q").cast("long").alias("Dependency_Count"))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency rows, some with an end that is no known file."""
    known = files(spark, sf_dir).select("part_id", "File")
    end = lambda df, c, name: df.join(known.select(F.col("part_id").alias(c), F.col("File").alias(name)), c, "left").withColumn(name, F.coalesce(name, F.concat(F.lit("gone/P"), F.col(c).cast("string"), F.lit(".java"))))
    return reduce(lambda df, x: end(df, *x), [("s", "Source_File"), ("t", "Target_File")], pairs(spark, sf_dir)).select("Source_File", "Target_File", "Dependency_Type", "Dependency_Count")


def partitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recovered and true partition of the files (``dataset, entity, cluster``)."""
    rows = files(spark, sf_dir)
    return tuple(rows.select(F.lit("fx").alias("dataset"), F.col("File").alias("entity"), F.col(c).alias("cluster")) for c in ("Pred", "Module"))
