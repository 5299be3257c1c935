"""Further registered queries: sources, rules, set relations, walks and batches, and metrics of many small systems.

The systems of the metric queries are the parts of each size, of at most six clusters on either side, so that SQL can try
all assignments and matchings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, metrics, prepare, rules, walks
from ..sources import manifests
from ..sources.labels import nested_items
from ..sources.tables import MISSING, read_csv
from . import fixtures as fx
from .queries import _graph, _undirected, _vertices, query
from .store import discard, shared_path

_NONE = ", ".join(f"'{x}'" for x in MISSING)


@query(f"""select doc_id, case when lang not in ({_NONE}) then lang end as lang, case when source not in ({_NONE}) then source end as source, cast(n_chars as bigint) as n_chars,
  case when text not in ({_NONE}) then md5(text) end as text_md5 from documents""")
def csv_documents(spark, d):
    path = shared_path(spark, "csv")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs.select("doc_id", "lang", "source", "text", "n_chars").write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = read_csv(spark, path, "doc_id long, n_chars long")
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: Rules on the types and brands of parts: 150 of them, of which a row matches a few. The types of the table.
_TYPES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")
_RULES = [(f"{t}-{k}".lower(), rf"\.{t}\.b{b}[{k}-9]\.") for t in _TYPES for b in range(1, 6) for k in range(1, 6)]
_VALUES = ", ".join(f"({n}, '{m}', '{p}')" for n, (m, p) in enumerate(_RULES))


@query(f"""with r(rule_no, module, pattern) as (values {_VALUES}), p as (select id, regexp_replace(replace(File, '/', '.'), '\\.java$', '') as e from fx_files),
h as (select id, module, min(rule_no) as num from p join r on regexp_matches(e, pattern) group by 1, 2)
select cast(p.id as bigint) as id, coalesce(string_agg(module, ',' order by num), '') as modules from p left join h on h.id = p.id group by 1""")
def rule_modules(spark, d):
    entity = F.regexp_replace(F.replace("File", F.lit("/"), F.lit(".")), r"\.java$", "")
    return _vertices(spark, d).select("id", F.array_join(rules.modules_found(entity, _RULES), ",").alias("modules"))


@query("""with p as (select File from fx_files), roots as (select distinct concat('src/main/java/app/', p_type) as root from part union select distinct concat('src/main/java/app/', p_type, '/b', replace(p_brand, 'Brand#', '')) from part where p_size > 25)
select File, max_by(root, length(root)) as root from p left join roots on File = root or starts_with(File, concat(root, '/')) group by File""")
def nearest_roots(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    top = F.concat(F.lit("src/main/java/app/"), "p_type")
    roots = part.select(top.alias("root")).unionByName(part.where("p_size > 25").select(F.concat(top, F.lit("/b"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("root")))
    return prepare.nearest_root(fx.files(spark, d).select("File"), roots)


@query("""with k as (select File from fx_files union select Source_File from fx_deps union select Target_File from fx_deps)
select k.File, k.File in (select File from fx_files) as in_entities, k.File in (select Source_File from fx_deps) as in_sources, k.File in (select Target_File from fx_deps) as in_targets from k""")
def file_set_relations(spark, d):
    deps = fx.deps(spark, d)
    return prepare.set_relations({"entities": fx.files(spark, d).select("File"), "sources": deps.select(F.col("Source_File").alias("File")), "targets": deps.select(F.col("Target_File").alias("File"))}, ["File"])


@query("""select cast(r_regionkey as bigint) as region, case when n_nationkey % 3 = 0 then r_name else n_name end as module, s_name as item
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def nested_truth(spark, d):
    """Suppliers in nations in regions, one JSON text a region; every third nation has no name of its own."""
    t = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    item = F.struct(F.lit("item").alias("@type"), F.col("s_name").alias("name"))
    nation = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.collect_list(item).alias("nested"))
    group = F.struct(F.lit("group").alias("@type"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).otherwise("").alias("name"), "nested")
    region = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.collect_list(group).alias("nested"))
    texts = region.select(F.col("r_regionkey").alias("id"), F.to_json(F.struct(F.array(F.struct(F.lit("group").alias("@type"), F.col("r_name").alias("name"), "nested")).alias("structure"))).alias("text"))
    return nested_items(texts).select(F.col("id").cast("long").alias("region"), "module", "item")


@query("""select event_type as run, event_id, case when event_type = 'click' then user_id end as user_id, case when event_type <> 'click' then event_type end as kind from events""")
def widening_append(spark, d):
    """Events appended run by run, of which one has other columns than the rest; one run is repeated."""
    events, path = spark.read.parquet(f"{d}/events.parquet"), shared_path(spark, "table")
    runs = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a few types
    for run in [*runs, runs[0]]:
        own = events.where(F.col("event_type") == run).select(F.col("event_type").alias("run"), "event_id", *(["user_id"] if run == "click" else [F.col("event_type").alias("kind")]))
        manifests.append(own, path, run)
    manifests.compact(spark, path, 2)
    return manifests.read(spark, path).select("run", "event_id", "user_id", "kind")


@query()
def biased_walks(spark, d):
    v, e = _undirected(spark, d)
    out = walks.biased_walks(v.select("id"), e, 1, 6, 0.5, 2.0, seed=1)
    discard(e)
    return out


@query()
def neighbourhood_batches(spark, d):
    v, rows = _graph(spark, d, loops=True)
    edges = graphs.heterogeneous(v, rows, collapse=False)
    seeds = v.select(F.floor(F.col("id") / 128).alias("batch"), F.lit("file").alias("type"), "id")
    return walks.sampled_neighbourhood(edges, seeds, [8, 4], seed=1)


def _systems(spark, d, recovered: str = "true", truth: str = "true"):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("string").alias("dataset"), F.col("p_partkey").cast("string").alias("entity"), F.col("p_type").alias("a"), F.substring("p_brand", 7, 1).alias("b"), "p_name", "p_brand")
    side = lambda c, keep: part.where(keep).select("dataset", "entity", F.col(c).alias("cluster"))
    return side("a", recovered), side("b", truth)


_PARTS = "p as (select cast(p_size as varchar) as dataset, p_partkey as entity, p_type as a, substr(p_brand, 7, 1) as b, p_name, p_brand from part)"
#: Largest sums over one-to-one choices of columns, row by row, from a table ``t`` (dataset, a, b, n): all choices are tried.
_CHOICES = """ra as (select dataset, a, row_number() over (partition by dataset order by a) as i from (select distinct dataset, a from t)),
rb as (select dataset, b, cast(power(2, row_number() over (partition by dataset order by b) - 1) as bigint) as bit from (select distinct dataset, b from t)),
w as (select t.dataset, i, bit, n from t join ra using (dataset, a) join rb using (dataset, b)),
pick as (select distinct dataset, cast(0 as bigint) as i, cast(0 as bigint) as used, cast(0 as bigint) as total from t
  union all select p.dataset, p.i + 1, p.used + c.bit, p.total + c.n from pick p join (select dataset, i, bit, n from w union all select dataset, i, 0, 0 from ra) c on c.dataset = p.dataset and c.i = p.i + 1 and (p.used & c.bit) = 0)"""


@query(f"""with recursive {_PARTS}, t as (select dataset, a, b, count(*) as n from p group by 1, 2, 3), {_CHOICES}, best as (select dataset, max(total) as weight from pick group by 1),
s as (select dataset, count(distinct a) as k, count(distinct b) as g, sum(n) as n from t group by 1)
select dataset, cast(weight as double) as weight, round((1 - (abs(k - g) + n - weight) / cast(k + g + 4 * n as double)) * 100, 6) as a2a from s join best using (dataset)""")
def system_a2a(spark, d):
    return metrics.table_metrics(metrics.contingency(metrics.align(*_systems(spark, d)))).select("dataset", "weight", F.round("a2a", 6).alias("a2a"))


@query(f"""with recursive {_PARTS}, c as (select dataset, a, b, count(*) as n from p group by 1, 2, 3), tops as (select dataset, a, max(n) as top, sum(n) as na from c group by 1, 2),
t as (select c.dataset, c.a, c.b, 1 as n from c join tops using (dataset, a) where c.n = top), {_CHOICES}, matched as (select dataset, max(total) as m from pick group by 1),
cost as (select dataset, sum(na - top) + count(*) - m as cost from tops join matched using (dataset) group by dataset, m),
sizes as (select dataset, n, row_number() over (partition by dataset order by n) as j from (select dataset, b, count(*) as n from p group by 1, 2)),
r as (select distinct dataset, cast(0 as bigint) as j, cast(0 as bigint) as r from sizes union all select r.dataset, r.j + 1, r.r + case when r.r < s.n then 1 else 0 end from r join sizes s on s.dataset = r.dataset and s.j = r.j + 1),
most as (select dataset, (select sum(n) from sizes s where s.dataset = r.dataset) - max_by(r, j) as most from r group by 1),
total as (select dataset, count(*) as n from p group by 1)
select dataset, cast(cost as bigint) as mojo_cost, case when most = 0 then case when n > 1 and cost = 0 then 100.0 else 0.0 end else round_even((1 - cost / cast(most as double)) * 10000, 0) / 100 end as mojofm from cost join most using (dataset) join total using (dataset)""")
def system_mojofm(spark, d):
    return metrics.table_metrics(metrics.contingency(metrics.align(*_systems(spark, d)))).select("dataset", "mojo_cost", "mojofm")


@query(f"""with recursive {_PARTS}, x as (select * from p where p_name not like 'blue%'), y as (select * from p where p_brand not like '%1'),
t as (select x.dataset, x.a, y.b, count(*) as n from x join y using (dataset, entity) group by 1, 2, 3), {_CHOICES}, best as (select dataset, max(total) as weight from pick group by 1),
sx as (select dataset, count(distinct a) as k, count(*) as n from x group by 1), sy as (select dataset, count(distinct b) as k, count(*) as n from y group by 1), c as (select dataset, sum(n) as n from t group by 1)
select dataset, round((1 - (abs(sx.k - sy.k) + 2 * (sx.n - c.n) + 2 * (sy.n - c.n) + c.n - weight) / cast(sx.k + sy.k + 2 * sx.n + 2 * sy.n as double)) * 100, 6) as a2a from sx join sy using (dataset) join c using (dataset) join best using (dataset)""")
def system_a2a_files(spark, d):
    out = metrics.a2a_files(*_systems(spark, d, "p_name not like 'blue%'", "p_brand not like '%1'"))
    return out.select("dataset", F.round("a2a", 6).alias("a2a"))


@query(f"""with recursive {_PARTS}, t as (select dataset, a, b, count(*) as n from p group by 1, 2, 3), ka as (select dataset, a, sum(n) as na from t group by 1, 2), kb as (select dataset, b, sum(n) as nb from t group by 1, 2),
o as (select dataset, a, max(cast(n as double) / greatest(na, nb)) as share from t join ka using (dataset, a) join kb using (dataset, b) group by 1, 2),
cvg as (select dataset, avg(case when share >= 0.33 then 100.0 else 0.0 end) as c2c_cvg_33, avg(case when share >= 0.5 then 100.0 else 0.0 end) as c2c_cvg_50 from o group by 1),
s as (select dataset, sum(n * (n - 1) / 2) as pab, sum(n) as n from t group by 1), sa as (select dataset, sum(na * (na - 1) / 2) as pa from ka group by 1), sb as (select dataset, sum(nb * (nb - 1) / 2) as pb from kb group by 1),
f as (select dataset, cast(pab as double) as pab, cast(pa as double) * pb / (n * (n - 1) / 2.0) as e, (pa + pb) / 2.0 as top from s join sa using (dataset) join sb using (dataset))
select dataset, round(c2c_cvg_33, 6) as c2c_cvg_33, round(c2c_cvg_50, 6) as c2c_cvg_50, round(case when top = e then 1.0 else (pab - e) / (top - e) end, 6) as ari from cvg join f using (dataset)""")
def system_coverage_ari(spark, d):
    out = metrics.table_metrics(metrics.contingency(metrics.align(*_systems(spark, d))))
    return out.select("dataset", *[F.round(c, 6).alias(c) for c in ("c2c_cvg_33", "c2c_cvg_50", "ari")])
