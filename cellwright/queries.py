"""Registered queries over the operators, each with the SQL that gives the same rows.

There are no dirty tables among the inputs, so dirt is made by rule: an order's priority is lower-cased
where 19 divides the key, else blanked where 23 does. Floats are rounded to nine digits on both sides.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import BASIC, tokens, value_of
from .operators import clients, clustering, dependencies, features, fewshot, labelling, metrics, profile, prompts
from .sources import datasets
from .sources.scratch import Scratch
from .streaming import checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nine(c: str | Column) -> Column:
    return F.round(c, 9)


COLUMNS = ["o_orderpriority", "o_orderstatus", "o_custkey_mod"]
DIRTY = "case when o_orderkey % 19 = 0 then lower(o_orderpriority) when o_orderkey % 23 = 0 then '' else o_orderpriority end"
#: SQL views of the dirty and the clean orders.
WITH = f"""with clean as (select o_orderkey as row_id, o_orderpriority, o_orderstatus, (o_custkey % 7)::varchar as o_custkey_mod from orders),
dirty as (select o_orderkey as row_id, {DIRTY} as o_orderpriority, o_orderstatus, (o_custkey % 7)::varchar as o_custkey_mod from orders)"""


def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 7).cast("string").alias("o_custkey_mod"))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, p = F.col("row_id"), F.col("o_orderpriority")
    return clean_orders(spark, sf_dir).withColumn("o_orderpriority", F.when(key % 19 == 0, F.lower(p)).when(key % 23 == 0, F.lit("")).otherwise(p))


# --- sources -------------------------------------------------------------------------------------


@query("select n_nationkey::varchar as n_nationkey, case when n_nationkey % 5 = 0 then '' else n_name end as n_name, n_regionkey::varchar as n_regionkey, 'say \"' || n_name || '\", ok' as note from nation")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.col("n_name"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"), name.alias("n_name"), F.col("n_regionkey").cast("string"), F.concat(F.lit('say "'), F.col("n_name"), F.lit('", ok')).alias("note"))
    path = Scratch(spark, "csv").path()
    rows.write.options(header=True, quote='"', escape='"', emptyValue="").csv(path)
    return datasets.read_csv(spark, path)


RULES = [
    {"name": "p_size", "meaning": "size", "data_type": "integer", "format_rule": "plain integer"},
    {"name": "p_brand", "meaning": "brand", "data_type": "category", "format_rule": "Brand#NN", "null_value_rule": "never empty"},
]


@query("select * from (values ('p_size', 'size', 'integer', 'plain integer', null), ('p_brand', 'brand', 'category', 'Brand#NN', 'never empty')) t(name, meaning, data_type, format_rule, null_value_rule)")
def rules_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "rules").path()
    spark.createDataFrame([(json.dumps({"columns": RULES}),)], "value string").coalesce(1).write.text(path)
    return datasets.read_rules(spark, path)


def dataset_root(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one dataset, ``nations``: names blanked where 5 divides the key, and two rules."""
    root = Scratch(spark, "datasets").path()
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1)
    name = F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.col("n_name"))
    for file, value in (("dirty", name), ("clean", F.col("n_name"))):
        rows.select(F.col("n_nationkey").alias("key"), value.alias("name"), F.col("n_regionkey").alias("region")).coalesce(1).write.options(header=True, quote='"', escape='"', emptyValue="").csv(f"{root}/nations/{file}.csv")
    spark.createDataFrame([('{"columns": [{"name": "name", "meaning": "country"}, {"name": "region", "data_type": "integer"}]}',)], "value string").coalesce(1).write.text(f"{root}/nations/rule.json")
    return root


@query("select row_number() over (order by n_nationkey) - 1 as row_id, n_nationkey::varchar as key, case when n_nationkey % 5 = 0 then '' else n_name end as name, n_regionkey::varchar as region, n_name as clean_name from nation")
def dataset_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = datasets.load_dataset(spark, dataset_root(spark, sf_dir), "nations")
    return data.dirty.join(data.clean.select("row_id", F.col("name").alias("clean_name")), "row_id")


@query("select 'nations' as name, true as has_clean, true as has_dirty, true as has_rules, count(*) as n_rows, 3::bigint as n_columns, 'key,name,region' as columns, 2::bigint as num_rules from nation")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = dataset_root(spark, sf_dir)
    found = [datasets.dataset_info(spark, root, n) for n in datasets.available_datasets(spark, root)]
    rows = [(i["name"], i["has_clean"], i["has_dirty"], i["has_rules"], *i["dirty_shape"], ",".join(i["columns"]), i["num_rules"]) for i in found]
    return spark.createDataFrame(rows, "name string, has_clean boolean, has_dirty boolean, has_rules boolean, n_rows long, n_columns long, columns string, num_rules long")


# --- labels and profiles -------------------------------------------------------------------------


@query(WITH + " select d.row_id, 'o_orderpriority' as \"column\", coalesce(d.o_orderpriority <> c.o_orderpriority, true) as is_error from dirty d join clean c using (row_id)" + "".join(f" union all select d.row_id, '{c}', coalesce(d.{c} <> c.{c}, true) from dirty d join clean c using (row_id)" for c in COLUMNS[1:]))
def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.error_labels(dirty_orders(spark, sf_dir), clean_orders(spark, sf_dir), "row_id")


@query(WITH + " select round(avg(e), 9) as error_ratio, round(avg(e), 9) as error_rate from (" + " union all ".join(f"select avg((d.{c} <> c.{c})::int) as e from dirty d join clean c using (row_id)" for c in COLUMNS) + ")")
def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.error_rates(profile.error_labels(dirty_orders(spark, sf_dir), clean_orders(spark, sf_dir), "row_id"))
    return found.select(nine("error_ratio").alias("error_ratio"), nine("error_rate").alias("error_rate"))


_OUTER = "with d as (select c_custkey as row_id, c_mktsegment as label, (c_nationkey % 3)::varchar as class from customer), c as (select o_custkey as row_id, max(o_orderpriority) as label, min(o_custkey % 3)::varchar as class from orders group by o_custkey)"


@query(_OUTER + " " + " union all ".join(f"select row_id, '{c}' as \"column\", coalesce(d.{c} <> c.{c}, true) as is_error from d full join c using (row_id)" for c in ("label", "class")))
def dirty_clean_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole tables that don't have the same keys: customers, and what their orders say of them."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("label"), (F.col("c_nationkey") % 3).cast("string").alias("class"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.max("o_orderpriority").alias("label"), F.min(F.col("o_custkey") % 3).cast("string").alias("class"))
    return profile.error_labels(customers, orders, "row_id")


PROFILE = {
    "c_mktsegment": "c_mktsegment",
    "c_sparse": "case when c_custkey % 50 = 0 then 'x' when c_custkey % 3 = 0 then null else '  ' end",
    "c_one": "'only'",
    "c_empty": "cast(null as varchar)",
}


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("row_id"), "c_mktsegment", F.when(key % 50 == 0, "x").when(key % 3 == 0, None).otherwise("  ").alias("c_sparse"), F.lit("only").alias("c_one"), F.lit(None).cast("string").alias("c_empty")
    )


@query(" union all ".join(f"select '{n}' as \"column\", count(*) as n, count(*) filter ({e} is null) as n_null, count(*) filter (trim({e}) = '') as n_blank, count(distinct {e}) filter (trim({e}) <> '') as n_distinct, round(count(*) filter ({e} is null or trim({e}) = '') / count(*)::double, 9) as empty_ratio from customer" for n, e in PROFILE.items()))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(profiled(spark, sf_dir), "row_id").withColumn("empty_ratio", nine("empty_ratio"))


@query("""select * from (values ('c_mktsegment', true, null), ('c_sparse', false, 'Empty ratio: dirty=0.980, clean=0.980'), ('c_one', false, 'Constant value: dirty=only, clean=only'), ('c_empty', false, 'Empty ratio: dirty=1.000, clean=1.000')) t("column", kept, reason)""")
def pruned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profiled(spark, sf_dir)
    keep, gone = profile.prune_columns(df, df, "row_id")
    return spark.createDataFrame([(c, c in keep, gone.get(c)) for c in df.columns[1:]], "column string, kept boolean, reason string")


def renamed_orders(spark: SparkSession, sf_dir: str) -> datasets.Dataset:
    """Dirty and clean orders, whose clean columns have other names, with a column that has one value."""
    dirty, clean = (df.withColumn("o_one", F.lit("x")) for df in (dirty_orders(spark, sf_dir), clean_orders(spark, sf_dir)))
    return datasets.Dataset("orders", dirty, clean.toDF("row_id", "a", "b", "c", "d"))


@query(WITH + " " + " union all ".join(f"select d.row_id, '{c}' as \"column\", coalesce(d.{c} <> c.{c}, true) as is_error from dirty d join clean c using (row_id)" for c in COLUMNS))
def preprocess_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preprocess_dataset(renamed_orders(spark, sf_dir))[0].labels


@query(WITH + " select 'orders' as dataset, (select count(*) from dirty) as n_rows, 4::bigint as n_before, 3::bigint as n_after, 'o_one' as removed, 'Constant value: dirty=x, clean=x' as reason, round(avg(e), 9) as error_ratio from (" + " union all ".join(f"select avg((d.{c} <> c.{c})::int) as e from dirty d join clean c using (row_id)" for c in COLUMNS) + ")")
def preprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = profile.preprocess_dataset(renamed_orders(spark, sf_dir))
    row = (s["dataset_name"], *s["original_shape"], s["final_shape"][1], ",".join(s["removed_columns"]), ";".join(s["removal_reasons"].values()), s["error_ratio"])
    found = spark.createDataFrame([row], "dataset string, n_rows long, n_before long, n_after long, removed string, reason string, error_ratio double")
    return found.withColumn("error_ratio", nine("error_ratio"))


# --- text features -------------------------------------------------------------------------------

_COUNTS = {
    "char_count": "length(text)",
    "digit_count": r"length(regexp_replace(text, '[^\p{Nd}²³¹]', '', 'g'))",
    "alpha_count": r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))",
    "space_count": "length(text) - length(replace(text, ' ', ''))",
    "punct_count": r"length(regexp_replace(text, '[\p{L}\p{N}\p{Zs}\x09-\x0d\x1c-\x1f\x{85}\p{Zl}\p{Zp}]', '', 'g'))",
    "upper_count": r"length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))",
    "lower_count": r"length(regexp_replace(text, '[^\p{Ll}ªº]', '', 'g'))",
}


@query("select doc_id, " + ", ".join(f"({e})::bigint as {n}" for n, e in _COUNTS.items()) + ", " + ", ".join(f"round(coalesce(({_COUNTS[k + '_count']}) / nullif(length(text), 0)::double, 0), 9) as {k}_ratio" for k in ("digit", "alpha", "upper", "punct")) + " from documents")
def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.basic(table(spark, sf_dir, "documents"), "text", "doc_id")
    return found.select("doc_id", *BASIC[:7], *[nine(c).alias(c) for c in BASIC[7:]])


@query("""with t as (select p_partkey, regexp_replace(lower(p_name), '\\s\\s+', ' ', 'g') as t from part),
chars as (select p_partkey, unnest(string_split(t, '')) as c from t where t <> ''),
tf as (select p_partkey, c, count(*) as tf from chars group by all),
vocab as (select c, sum(tf) as ctf, count(*) as df from tf group by c order by ctf desc, c limit 200),
w as (select p_partkey, c, tf * (ln((1e0 + (select count(*) from part)) / (1 + df)) + 1) as w from tf join vocab using (c))
select p_partkey, 'char_' || c as feature, round(w / sqrt(sum(w * w) over (partition by p_partkey)), 9) as value from w""")
def char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.char_tfidf(table(spark, sf_dir, "part"), "p_name", "p_partkey").withColumn("value", nine("value"))


_TOKENS = r"regexp_extract_all({}, '\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]')"


@query(f"select token, count(*) as freq from (select unnest({_TOKENS.format('p_name')}) as token from part) group by token")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.token_frequencies(table(spark, sf_dir, "part"), "p_name")


def _bins_sql(edges: str) -> str:
    return f"""with tok as (select p_partkey, unnest({_TOKENS.format("p_name")}) as token from part),
f as (select token, count(*) as freq from tok group by token),
shape as (select least(50, count(distinct freq)) as b, min(freq)::double as lo, max(freq)::double as hi from f),
edges as (select list_sort(list_distinct(list_transform(generate_series(0, b - 1), lambda i: round({edges}, 9)))) as e from shape),
binned as (select token, greatest(len(list_filter(e, lambda x: x <= freq)) - 1, 0)::int as bin from f, edges),
m as (select p_partkey, bin, count(*) as n from tok join binned using (token) group by all)
select p_partkey, bin, round(n / sum(n) over (partition by p_partkey), 9)::double as value from m"""


def _bins(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return features.token_bins(table(spark, sf_dir, "part"), "p_name", "p_partkey", method=method).withColumn("value", nine("value"))


# linear interpolation in the sorted frequencies of unique tokens
_AT = "(len(fs) - 1) * i / greatest(b - 1, 1)::double"
_QUANTILE = f"(fs[floor({_AT})::int + 1] + ({_AT} - floor({_AT})) * (fs[ceil({_AT})::int + 1] - fs[floor({_AT})::int + 1]))"


@query(_bins_sql(_QUANTILE).replace("from shape),\nbinned", "from shape, (select list_sort(list(freq)) as fs from f)),\nbinned"))
def token_bins_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "quantile")


@query(_bins_sql("case when b = 1 then lo else lo + (hi - lo) * i / (b - 1) end"))
def token_bins_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "uniform")


@query(_bins_sql("exp(case when b = 1 then ln(lo) else ln(lo) + (ln(hi) - ln(lo)) * i / (b - 1) end)"))
def token_bins_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, "log")


@query(f"with n as (select p_partkey, len({_TOKENS.format('p_type')})::double as n from part) select p_partkey, round(coalesce((n - min(n) over ()) / nullif(max(n) over () - min(n) over (), 0), 0), 9) as token_count_scaled from n")
def token_count_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.token_count_scaled(table(spark, sf_dir, "part"), "p_type", "p_partkey").withColumn("token_count_scaled", nine("token_count_scaled"))


# --- dependencies --------------------------------------------------------------------------------


@query(WITH + ", " + ", ".join(f"f_{c} as (select row_id, '{c}' as lhs, count(*) over (partition by {c}, o_orderpriority) / (count(*) over ())::double / sqrt(3) as support, count(*) over (partition by {c}, o_orderpriority) / (count(*) over (partition by {c}))::double / sqrt(3) as confidence from dirty)" for c in COLUMNS[1:]) + " select row_id, lhs, round(support, 9) as support, round(confidence, 9) as confidence from (" + " union all ".join(f"select * from f_{c}" for c in COLUMNS[1:]) + " union all select row_id, 'o_orderpriority', 1 / sqrt(3), 1 / sqrt(3) from dirty)")
def fd_support_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dependencies.fd_features(dirty_orders(spark, sf_dir), "o_orderpriority", "row_id")
    return found.select("row_id", "lhs", nine("support").alias("support"), nine("confidence").alias("confidence"))


PAIRED = ["l_returnflag", "l_linestatus", "l_tax_s"]
_LINES = "select l_returnflag, l_linestatus, (l_tax * 100)::int::varchar as l_tax_s from lineitem"


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("l_tax_s"))


_PAIRS = " union all ".join(f"select '{a}' as col1, '{b}' as col2, {a} as x, {b} as y, count(*) as n from l group by all" for i, a in enumerate(PAIRED) for b in PAIRED[i:])
_NMI = f"""with l as ({_LINES}), p as ({_PAIRS}),
t as (select *, sum(n) over (partition by col1, col2, x)::double as nx, sum(n) over (partition by col1, col2, y)::double as ny, sum(n) over (partition by col1, col2)::double as total from p),
mi as (select col1, col2, sum(n / total * ln(n * total / (nx * ny))) as mi from t group by all),
hx as (select col1, col2, -sum(nx / total * ln(nx / total)) as h from (select distinct col1, col2, x, nx, total from t) group by all),
hy as (select col1, col2, -sum(ny / total * ln(ny / total)) as h from (select distinct col1, col2, y, ny, total from t) group by all),
u as (select col1, col2, round(case when hx.h + hy.h <= 1e-12 then 1 else least(1, greatest(0, 2 * mi / (hx.h + hy.h))) end, 9) as nmi from mi join hx using (col1, col2) join hy using (col1, col2)),
nmi as (select * from u union all select col2, col1, nmi from u where col1 <> col2)"""


@query(f"with l as ({_LINES}) {_PAIRS}")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.pair_counts(flags(spark, sf_dir), PAIRED)


_GAPS = {"type": "nullif(p_type, 'STEEL')", "size": "nullif(p_size % 5, 0)::varchar"}


@query(" union all ".join(f"select '{a}' as col1, '{b}' as col2, {x} as x, {y} as y, count(*) as n from part where {x} is not null and {y} is not null group by all" for (a, x), (b, y) in [(p, q) for i, p in enumerate(_GAPS.items()) for q in list(_GAPS.items())[i:]]))
def pair_counts_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.nullif("p_type", F.lit("STEEL")).alias("type"), F.nullif(F.col("p_size") % 5, F.lit(0)).cast("string").alias("size"))
    return dependencies.pair_counts(rows, ["type", "size"])


@query(_NMI + " select * from nmi")
def nmi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.nmi_matrix(flags(spark, sf_dir), PAIRED)


@query(_NMI + ", r as (select *, row_number() over (partition by col1 order by nmi desc, col2)::int as rank, count(*) filter (nmi > 0.1) over (partition by col1) as h from nmi where col1 <> col2) select col1, col2, nmi, rank from r where rank <= case when h >= 2 then 2 when h >= 1 then h else 1 end")
def top_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.top_relations(dependencies.nmi_matrix(flags(spark, sf_dir), PAIRED), 0.1, 2, 1)


# --- vectors, clusters, propagation --------------------------------------------------------------

_VEC = WITH + """, raw as (select row_id, length(o_orderpriority)::double as a, length(regexp_replace(o_orderpriority, '[^\\p{Lu}]', '', 'g'))::double as b,
  count(*) over (partition by o_orderstatus, o_orderpriority) / (count(*) over (partition by o_orderstatus))::double as c from dirty),
stats as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(c) as mc, stddev_pop(c) as sc from raw),
z as (select row_id, round(case when sa > 1e-12 then (a - ma) / sa else 0 end, 9) as a, round(case when sb > 1e-12 then (b - mb) / sb else 0 end, 9) as b, round(case when sc > 1e-12 then (c - mc) / sc else 0 end, 9) as c from raw, stats),
seeds as (select row_number() over (order by md5(row_id::varchar || '|20'), row_id) - 1 as cluster_id, a as sa, b as sb, c as sc from z order by md5(row_id::varchar || '|20'), row_id limit 20),
d as (select row_id, cluster_id, round(sqrt((a - sa) ** 2 + (b - sb) ** 2 + (c - sc) ** 2), 9) as dist from z, seeds),
near as (select row_id, min(row(dist, cluster_id)) as m from d group by row_id),
assigned as (select row_id, (m).cluster_id::int as cluster_id, (m).dist as dist from (select row_id, struct_pack(dist := m[1], cluster_id := m[2]) as m from near)),
reps as (select cluster_id, (min(row(dist, row_id)))[2] as rep from assigned group by cluster_id),
truth as (select d.row_id, coalesce(d.o_orderpriority <> c.o_orderpriority, true) as is_error from dirty d join clean c using (row_id)),
pred as (select a.row_id, 'o_orderpriority' as "column", t.is_error from assigned a join reps r using (cluster_id) join truth t on t.row_id = r.rep)"""


def order_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, vec): length, upper-case letters and confidence given the status, z-scored."""
    dirty = dirty_orders(spark, sf_dir)
    stats = features.basic(dirty, "o_orderpriority", "row_id").select("row_id", F.array(F.col("char_count").cast("double"), F.col("upper_count").cast("double")).alias("vec"))
    fd = dependencies.fd_features(dirty.select("row_id", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "row_id").where("lhs = 'o_orderstatus'")
    merged, _ = features.merge_vectors([(stats, ["a", "b"]), (fd.select("row_id", F.array(F.col("confidence") * F.sqrt(F.lit(2.0))).alias("vec")), ["c"])], "row_id")
    return features.zscore(merged, "row_id").withColumn("vec", F.transform("vec", lambda x: F.round(x, 9)))


@query(_VEC + " select row_id, a, b, c from z")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_vectors(spark, sf_dir).select("row_id", *[F.get("vec", F.lit(i)).alias(n) for i, n in enumerate("abc")])


def propagator(spark: SparkSession, sf_dir: str) -> clustering.LabelPropagator:
    return clustering.LabelPropagator({"o_orderpriority": order_vectors(spark, sf_dir)}, "row_id", clustering.SeededCentroids(20, 20))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.error_labels(dirty_orders(spark, sf_dir), clean_orders(spark, sf_dir), "row_id", ["o_orderpriority"])


@query(_VEC + " select row_id, cluster_id, dist from assigned")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagator(spark, sf_dir).sample()[0].select("row_id", "cluster_id", "dist")


@query(_VEC + " select cluster_id, rep from reps")
def cluster_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagator(spark, sf_dir).sample()[1].select("cluster_id", "rep")


@query(_VEC + " select * from pred")
def propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagator(spark, sf_dir).propagate(truth(spark, sf_dir))


_SCORES = """select "column", tn, fp, fn, tp, round(coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0)::double, 0), 9) as accuracy, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 9) as precision,
round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 9) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 9) as f1_score, tp + fn as true_error_count, tp + fp as pred_error_count, tn + fp + fn + tp as total_cells,
round(coalesce((tp + fn) / nullif(tn + fp + fn + tp, 0)::double, 0), 9) as true_error_rate, round(coalesce((tp + fp) / nullif(tn + fp + fn + tp, 0)::double, 0), 9) as pred_error_rate from counts"""
_COUNTED = "count(*) filter (not t and not p) as tn, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (t and p) as tp"
_RATES = [*metrics.METRICS, "true_error_rate", "pred_error_rate"]


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: nine(c) for c in df.columns if c in _RATES})


@query(_VEC + f", counts as (select 'o_orderpriority' as \"column\", {_COUNTED} from (select t.is_error as t, p.is_error as p from truth t join pred p using (row_id))) " + _SCORES)
def propagation_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = truth(spark, sf_dir)
    return rounded(metrics.by_column(metrics.pair(known, propagator(spark, sf_dir).propagate(known), "row_id")))


@query(None)
def mllib_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.KMeansClusterer(20, 114).assign(order_vectors(spark, sf_dir), "row_id")


#: Orders whose priority is null where 23 divides the key.
_GAPPY = DIRTY.replace("then ''", "then null")
_PARTS = ", ".join(f"({e.replace('text', 'x')})::double" for e in _COUNTS.values()) + ", " + ", ".join(f"coalesce(({_COUNTS[k + '_count'].replace('text', 'x')}) / nullif(length(x), 0)::double, 0)" for k in ("digit", "alpha", "upper", "punct"))


def _places(j: int, c: str) -> str:
    """Support and confidence of the j-th column, which for the target itself are constants."""
    both = f"count(*) over (partition by {c}, x)"
    values = ("0e0", "0e0") if c == "x" else (f"{both} / (count(*) over ())::double", f"{both} / (count(*) over (partition by {c}))::double")
    return " union all ".join(f"select row_id, bins_at + n_bins + {1 + 2 * j + i} as pos, {v} as value from t, sizes" for i, v in enumerate(values))


@query(f"""with t as (select o_orderkey as row_id, coalesce({_GAPPY}, '') as x, o_orderstatus as s, (o_custkey % 7)::varchar as m from orders),
base as (select row_id, [{_PARTS}] as v from t),
own as (select row_id, generate_subscripts(v, 1) - 1 as pos, unnest(v) as value from base),
ch as (select row_id, unnest(string_split(regexp_replace(lower(x), '\\s\\s+', ' ', 'g'), '')) as c from t where x <> ''),
tf as (select row_id, c, count(*) as tf from ch group by all),
vocab as (select *, row_number() over (order by ctf desc, c) - 1 as i from (select c, sum(tf) as ctf, count(*) as df from tf group by c) order by ctf desc, c limit 200),
w as (select row_id, i, tf * (ln((1e0 + (select count(*) from t)) / (1 + df)) + 1) as w from tf join vocab using (c)),
tfidf as (select row_id, 11 + i as pos, w / sqrt(sum(w * w) over (partition by row_id)) as value from w),
tok as (select row_id, unnest({_TOKENS.format("x")}) as token from t),
f as (select token, count(*) as freq from tok group by token),
shape as (select least(50, count(distinct freq)) as b from f),
edges as (select list_sort(list_distinct(list_transform(generate_series(0, b - 1), lambda i: round({_QUANTILE}, 9)))) as e from shape, (select list_sort(list(freq)) as fs from f)),
sizes as (select 11 + (select count(*) from vocab) as bins_at, (select len(e) from edges) as n_bins),
bins as (select row_id, bin, count(*) as n from tok join (select token, greatest(len(list_filter(e, lambda y: y <= freq)) - 1, 0) as bin from f, edges) using (token) group by all),
shares as (select row_id, bins_at + bin as pos, n / sum(n) over (partition by row_id) as value from bins, sizes),
lens as (select row_id, len({_TOKENS.format("x")})::double as n from t),
counts as (select row_id, bins_at + n_bins as pos, coalesce((n - min(n) over ()) / nullif(max(n) over () - min(n) over (), 0), 0) as value from lens, sizes),
fd as ({_places(0, "x")} union all {_places(1, "s")} union all {_places(2, "m")}),
found as (select * from own union all select * from tfidf union all select * from shares union all select * from counts union all select * from fd),
dense as (select t.row_id, p.pos, coalesce(f.value, 0) as x from t cross join (select unnest(generate_series(0, bins_at + n_bins + 6)) as pos from sizes) p left join found f on f.row_id = t.row_id and f.pos = p.pos),
stats as (select pos, avg(x) as mean, stddev_pop(x) as dev from dense group by pos)
select row_id, pos::int as pos, round(case when dev > 1e-9 then (x - mean) / dev else 0 end, 6) + 0e0 as value from dense join stats using (pos)""")
def column_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the whole feature vector of a column with nulls: statistics, characters, token bins, count, dependencies."""
    key, p = F.col("row_id"), F.col("o_orderpriority")
    rows = clean_orders(spark, sf_dir).withColumn("o_orderpriority", F.when(key % 19 == 0, F.lower(p)).when(key % 23 == 0, None).otherwise(p))
    vectors, _ = features.column_features(rows, "o_orderpriority", "row_id")
    return vectors.select("row_id", F.posexplode("vec").alias("pos", "x")).select("row_id", "pos", (F.round("x", 6) + F.lit(0.0)).alias("value"))


@query(None)
def mllib_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full features, k-means per column, propagation of true labels, scores per column."""
    data, _ = profile.preprocess_dataset(datasets.Dataset("orders", dirty_orders(spark, sf_dir), clean_orders(spark, sf_dir)))
    spread = clustering.LabelPropagator(features.dataset_features(data.dirty, "row_id"), "row_id", None, 20, 114)
    return metrics.both(metrics.pair(data.labels, spread.propagate_dataset(data.labels), "row_id"))


# --- metrics -------------------------------------------------------------------------------------

_TWO = """with both_ as (select doc_id, 'quality' as "column", quality = 0 as t, toxic = 1 as p from labels union all select doc_id, 'crossed', toxic = 1, quality = 0 from labels)"""


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    each = F.array(F.struct(F.lit("quality").alias("column"), bad.alias("is_error"), toxic.alias("predicted")), F.struct(F.lit("crossed").alias("column"), toxic.alias("is_error"), bad.alias("predicted")))
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.*")


@query(_TWO + f', counts as (select null::varchar as "column", {_COUNTED} from both_) ' + _SCORES.replace('"column", ', "", 1))
def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.overall(label_pairs(spark, sf_dir)))


@query(_TWO + f', counts as (select "column", {_COUNTED} from both_ group by "column") ' + _SCORES)
def metrics_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_column(label_pairs(spark, sf_dir)))


@query(_TWO + f', counts as (select "column", {_COUNTED} from both_ group by grouping sets (("column"), ())) ' + _SCORES)
def metrics_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.both(label_pairs(spark, sf_dir)))


@query(_TWO + f" select {_COUNTED} from both_")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(label_pairs(spark, sf_dir))


@query(_TWO + f', counts as (select "column", {_COUNTED} from both_ group by "column"), s as ({_SCORES}) select ' + ", ".join(f"round({f}({m}), 9) as {n}_{m}" for m in metrics.METRICS for n, f in (("avg", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " from s")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.summary(rounded(metrics.by_column(label_pairs(spark, sf_dir))))
    return found.select(*[nine(c).alias(c) for c in found.columns])


@query(_TWO + ", r as (select doc_id, count(*) filter (t) as true_errors, count(*) filter (p) as pred_errors from both_ group by doc_id) select true_errors, pred_errors, count(*) as n_rows from r group by all")
def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_distribution(label_pairs(spark, sf_dir), "doc_id")[1]


@query(_TWO + f', counts as (select "column", {_COUNTED} from both_ group by "column") select "column", tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 9) as detection_rate, round(coalesce(fp / nullif(fp + tn, 0)::double, 0), 9) as false_alarm_rate, case when coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) >= 0.9 then \'excellent\' when coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) >= 0.8 then \'good\' when coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) >= 0.6 then \'fair\' else \'poor\' end as grade from counts')
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.error_types(metrics.confusion(label_pairs(spark, sf_dir), ["column"]))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return found.withColumns({"detection_rate": nine("detection_rate"), "false_alarm_rate": nine("false_alarm_rate"), "grade": metrics.grade(f1)})


@query(f"""with counts as (select 'quality' as "column", {_COUNTED} from (select case when toxic = 1 then null else quality = 0 end as t, case when lang = 'fr' then null else n_chars > 2000 end as p from labels join documents using (doc_id)) where t is not null and p is not null) """ + _SCORES)
def metrics_of_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that lack the true or the predicted label don't count."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    true = rows.select("doc_id", F.lit("quality").alias("column"), F.when(F.col("toxic") == 1, None).otherwise(F.col("quality") == 0).alias("is_error"))
    found = rows.select("doc_id", F.lit("quality").alias("column"), F.when(F.col("lang") == "fr", None).otherwise(F.col("n_chars") > 2000).alias("is_error"))
    return rounded(metrics.by_column(metrics.pair(true, found, "doc_id")))


@query("""with n as (select count(*) as n from nation) select 'rows' as "case", 'Shape mismatch: (' || n || ', 3) and (' || 2 * n || ', 3)' as message from n
union all select 'columns', 'Shape mismatch: (' || n || ', 3) and (' || n || ', 2)' from n
union all select 'order', 'Column names do not match' union all select 'same', '1.0'""")
def evaluation_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an evaluation answers when rows, columns or the columns' order differ, and when all agree."""
    wide = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") == 1).alias("a"), (F.col("n_regionkey") == 2).alias("b"))
    cases = {"rows": wide.unionByName(wide), "columns": wide.select("n_nationkey", "a"), "order": wide.select("n_nationkey", "b", "a"), "same": wide}
    found = {name: metrics.Evaluator().evaluate_wide(wide, other, "n_nationkey") for name, other in cases.items()}
    return spark.createDataFrame([(n, r.get("error") or str(r["overall"]["f1_score"])) for n, r in found.items()], "`case` string, message string")


@query("""select * from (values ('fewer features', 'features of the columns have unequal lengths'), ('other columns', 'columns of features and labels differ'), ('fewer labels', 'rows of features, but labels of')) t("case", message)""")
def length_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What label propagation refuses."""
    points = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.col("n_regionkey").cast("double")).alias("vec"))
    few, labels = points.where("n_nationkey > 3"), points.select("n_nationkey", F.lit("a").alias("column"), F.lit(True).alias("is_error"))
    made = lambda features: clustering.LabelPropagator(features, "n_nationkey", clustering.SeededCentroids(3, 1))
    cases = {"fewer features": lambda: made({"a": points, "b": few}).sample(), "other columns": lambda: made({"b": points}).propagate_dataset(labels), "fewer labels": lambda: made({"a": points}).propagate_dataset(labels.where("n_nationkey > 3"))}
    out = []
    for name, run in cases.items():
        try:
            run()
        except ValueError as e:
            said = str(e)
            out.append((name, next(m for m in ("features of the columns have unequal lengths", "columns of features and labels differ", "rows of features, but labels of") if m in said)))
    return spark.createDataFrame(out, "`case` string, message string")


# --- few-shot, prompts, labelling ----------------------------------------------------------------

_FEW = WITH + """, j as (select d.row_id, d.o_orderpriority, d.o_orderstatus, d.o_custkey_mod, c.o_orderpriority as clean_value, md5(d.row_id::varchar || '|42') as h from dirty d join clean c using (row_id))
select row_id, o_orderpriority, o_orderstatus, o_custkey_mod, clean_value from (select *, {} as g from j) order by g, h, row_id limit {}"""


def _few(spark: SparkSession, sf_dir: str, k: int, strategy: str) -> DataFrame:
    return fewshot.select_few_shot(dirty_orders(spark, sf_dir), clean_orders(spark, sf_dir), "o_orderpriority", "row_id", k, strategy)


@query(_FEW.format("case when coalesce(o_orderpriority <> clean_value, true) then 0 else 1 end", 40))
def fewshot_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(spark, sf_dir, 40, "balanced")


@query(_FEW.format("case when row_number() over (partition by o_orderpriority order by h, row_id) = 1 then 0 else 1 end", 15))
def fewshot_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(spark, sf_dir, 15, "diverse")


@query(_FEW.format("0", 10))
def fewshot_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(spark, sf_dir, 10, "random")


@query("select c_mktsegment, c_name, c_custkey as row_id from customer where c_custkey in (select distinct o_custkey from orders where o_orderstatus = 'P')")
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return prompts.sample_rows(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"], ids, "c_custkey")


#: The prompt's first part, and its rows and labels as JSON with two blanks a level.
_HEAD = """'You are an error detection assistant. Respond ONLY in valid JSON.' || chr(10) || 'Instructions:' || chr(10) ||
 '- You are given a list of data rows extracted from a dataset, where the target column named `n_name`. Label each value from the target column as either an error or not an error. An error could be a typo or a formatting issue.' || chr(10) ||
 '- Only evaluate the `n_name` value.' || chr(10) || '- Only label values you are confident about. If you are not sure, do not label it as an error.' || chr(10)"""
_TAIL = """'Input:' || chr(10) || '[' || chr(10) || string_agg('  {' || chr(10) || '    "n_name": "' || n_name || '",' || chr(10) || '    "row_id": ' || k || chr(10) || '  }', ',' || chr(10) order by k) || chr(10) || ']' || chr(10) || chr(10) ||
 'Please fill in the "is_error" field (either `true` or `false`) in the following JSON template:' || chr(10) || '{' || chr(10) || '  "labels": [' || chr(10) ||
 string_agg('    {' || chr(10) || '      "row_id": ' || k || ',' || chr(10) || '      "is_error": null' || chr(10) || '    }', ',' || chr(10) order by k) || chr(10) || '  ]' || chr(10) || '}' || chr(10)"""
_ROWS = "b as (select ((row_number() over (order by n_nationkey)) - 1) // 10 as batch, n_nationkey as k, case when n_nationkey % 5 = 0 then '' else n_name end as n_name from nation)"


def nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dirty and clean: names blanked where 5 divides the key."""
    clean = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return clean.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.col("n_name"))), clean


def nation_prompts(spark: SparkSession, sf_dir: str, rules: Column | None = None, examples: Column | None = None) -> DataFrame:
    docs = prompts.batch_documents(nations(spark, sf_dir)[0], ["n_name"], "n_nationkey", 10)
    return docs.select("batch", prompts.PromptManager().prompt("n_name", F.col("data_json"), F.col("label_json"), rules, examples).alias("prompt"))


@query(f"with {_ROWS} select batch, md5({_HEAD} || {_TAIL}) as prompt_md5 from b group by batch")
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_prompts(spark, sf_dir).select("batch", F.md5("prompt").alias("prompt_md5"))


@query(f"""with {_ROWS}, few as (select *, row_number() over (order by (k % 5 <> 0), md5(k::varchar || '|42'), k) as i from (select n_nationkey as k, n_name as clean_value, case when n_nationkey % 5 = 0 then '' else n_name end as n_name, n_regionkey::varchar as n_regionkey from nation)),
shown as (select string_agg('Example ' || i || ':' || chr(10) || 'Row: {{''n_name'': ''' || n_name || ''', ''n_regionkey'': ''' || n_regionkey || '''}}' || chr(10) || 'Column: n_name' || chr(10) || 'Original value: ' || n_name || chr(10) || 'Corrected value: ' || clean_value || chr(10) || chr(10) || chr(10), '' order by i) as e from few where i <= 6)
select batch, md5({_HEAD} || '- If value does not follow the rules, label it as an error.' || chr(10) || chr(10) || chr(10) || 'Rules for column ''n_name'':' || chr(10) || '{{''meaning'': ''country'', ''data_type'': ''category'', ''format_rule'': nan}}' || chr(10)
 || chr(10) || chr(10) || 'Here are some examples:' || chr(10) || chr(10) || (select e from shown) || chr(10) || {_TAIL}) as prompt_md5 from b group by batch""")
def prompt_with_rules_and_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty, clean = nations(spark, sf_dir)
    block = prompts.PromptManager().examples(fewshot.select_few_shot(dirty, clean, "n_name", "n_nationkey", 6), "n_name", "n_nationkey")
    rule = prompts.rule_text({"name": "n_name", "meaning": "country", "data_type": "category"}, ["name", "meaning", "data_type", "format_rule"])
    return nation_prompts(spark, sf_dir, F.lit(rule), F.lit(block)).select("batch", F.md5("prompt").alias("prompt_md5"))


class OddRows(clients.Client):
    """Stands for a model: calls every row with an odd id an error, and counts a prompt's characters as tokens."""

    def chat(self, messages: list[dict], **how) -> str:
        text = messages[0]["content"]
        self.total_tokens += len(text)
        ids = [r["row_id"] for r in json.loads(text[text.index('{\n  "labels"') :])["labels"]]
        return json.dumps({"labels": [{"row_id": i, "is_error": i % 2 == 1} for i in ids]})


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark, "answers").keep(clients.respond(nation_prompts(spark, sf_dir), lambda: OddRows("odd")))


@query("select n_nationkey, n_nationkey % 2 = 1 as is_error from nation")
def llm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.settle_labels(labelling.parse_labels(answers(spark, sf_dir)), nations(spark, sf_dir)[0], "n_nationkey")


@query(f"with {_ROWS}, p as (select batch, {_HEAD} || {_TAIL} as prompt from b group by batch) select count(*) as n_prompts, sum(length(prompt))::bigint as total_tokens from p")
def llm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.usage(answers(spark, sf_dir)).select("n_prompts", "total_tokens")


_RESPONSE = "case conv_id % 5 when 0 then 'Sure: {\"labels\": [{\"row_id\": ' || conv_id || ', \"is_error\": true}, {\"row_id\": ' || conv_id || ', \"is_error\": false}]} done' when 1 then '{\"labels\":[{\"row_id\":\"' || conv_id || '\",\"is_error\":\"true\"}]}' when 2 then '{\"labels\":[{\"row_id\":' || conv_id || ',\"is_error\":null}]}' when 3 then 'garbage' else '{\"labels\":[{\"row_id\":-5,\"is_error\":true}]}' end"


@query("select distinct conv_id, conv_id % 5 = 1 as is_error from conversations where conv_id % 5 in (0, 1)")
def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    responses = ids.select(F.col("conv_id").alias("batch"), F.expr(_RESPONSE).alias("response"))
    return labelling.settle_labels(labelling.parse_labels(responses), ids, "conv_id")


@query("""select p_partkey, 'p_brand' as "column", not regexp_matches(p_brand, '^Brand#[1-3][0-9]$') as is_error from part union all
select p_partkey, 'p_size', p_size is null or not regexp_matches(p_size::varchar, '^[+-]?[0-9]+$') from part union all
select p_partkey, 'p_type', p_type not in ('STEEL', 'ECONOMY') from part""")
def rule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"p_brand": {"pattern": r"^Brand#[1-3][0-9]$"}, "p_size": {"data_type": "integer"}, "p_type": {"allowed": ["STEEL", "ECONOMY"]}}
    return labelling.label_by_rules(table(spark, sf_dir, "part"), rules, "p_partkey")


# --- streams -------------------------------------------------------------------------------------


@query("""select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, c as "column", count(*) as n, count(*) filter (case when c = 'event_type' then event_type is null or event_type not in ('click', 'view') else props is null or not regexp_matches(props, '^\\{"k": [0-4]') end) as n_errors
from events cross join (values ('event_type'), ('props')) t(c) group by all""")
def violation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule violations by hour, counted by a stream that reads all there is and ends."""
    scratch = Scratch(spark, "windows")
    path = scratch.path()
    events = scratch.keep(table(spark, sf_dir, "events"), path)  # a stream reads a folder, and the table may be one file
    stream = spark.readStream.schema(events.schema).parquet(path)
    rates = checks.violation_rates(stream, {"event_type": {"allowed": ["click", "view"]}, "props": {"pattern": r'^\{"k": [0-4]'}}, "ts")
    out = scratch.path()
    found = rates.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "column", "n", "n_errors")
    run = found.writeStream.outputMode("complete").option("checkpointLocation", scratch.path()).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)
