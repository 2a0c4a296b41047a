"""Queries over the test tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, markup, numbers, text, textmodel
from ..operators import aggregate, rows, sequence, sets
from ..session import register, table
from ..streaming import windows
from .pipeline import grid_table, sweep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _q(name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over one table."""
    query(name, sql)(lambda spark, sf_dir: build(table(spark, sf_dir, source)))


E_COLS = "event_id, user_id, event_type, value"
EVENT = E_COLS.split(", ")
WORD = r"[^\p{L}\p{N}_]+"

# ---- rows

_q("q01_filter_default_truthy", "events", lambda d: rows.filter_rows(d.withColumn("v", F.floor(F.col("value")).cast("bigint") % 3), "v").select("event_id", "v"), "SELECT event_id, CAST(floor(value) AS BIGINT) % 3 AS v FROM events WHERE CAST(floor(value) AS BIGINT) % 3 <> 0")
_q("q02_filter_fn", "events", lambda d: rows.filter_rows(d, (F.col("value") > 100) & (F.col("event_type") != "view")).select(*EVENT), f"SELECT {E_COLS} FROM events WHERE value > 100 AND event_type <> 'view'")
_q("q03_transform_drop_null", "events", lambda d: rows.transform(d, "root", F.when(F.col("value") > 50, F.round(F.sqrt("value"), 6))).select("event_id", "root"), "SELECT event_id, round(sqrt(value), 6) AS root FROM events WHERE value > 50")
_q("q04_function_drop_false", "events", lambda d: rows.function(d, "value", F.when(F.col("user_id") % 7 > 0, F.col("value") > 20), True).select("event_id", "value"), "SELECT event_id, value FROM events WHERE coalesce(CASE WHEN user_id % 7 > 0 THEN value > 20 END, true)")
_q(
    "q05_tuple_fns", "lineitem",
    lambda d: rows.tuple_of(d, ["l_orderkey", "l_quantity", "l_discount", "l_returnflag"], [rows.forward, [lambda c: c * 2, lambda c: c + 1], lambda c: F.round(c * 100, 2), F.lower], ["k", "q2", "pct", "flag"]),
    "SELECT l_orderkey AS k, l_quantity * 2 + 1 AS q2, round(l_discount * 100, 2) AS pct, lower(l_returnflag) AS flag FROM lineitem",
)
_q("q06_assign_columns", "lineitem", lambda d: rows.assign(d.select("l_orderkey", "l_linenumber", "l_extendedprice"), net=F.round(F.col("l_extendedprice") * 0.9, 4), l_linenumber=F.col("l_linenumber") + 1), "SELECT l_orderkey, l_linenumber + 1 AS l_linenumber, l_extendedprice, round(l_extendedprice * 0.9::DOUBLE, 4) AS net FROM lineitem")
_q("q07_extended_with", "lineitem", lambda d: rows.extended_with(d.select("l_orderkey", "l_quantity"), "zero", half=F.col("l_quantity") / 2), "SELECT l_orderkey, l_quantity, CAST(0 AS DOUBLE) AS zero, l_quantity / 2 AS half FROM lineitem")


@query("q08_partition_split", "SELECT 'big' AS side, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT 'small', count(*), round(sum(o_totalprice), 2) FROM orders WHERE NOT o_totalprice > 150000")
def partition_split(spark, sf_dir):
    big, small = rows.partition(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 150000)
    one = lambda d, s: d.agg(F.lit(s).alias("side"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    return one(big, "big").unionByName(one(small, "small"))


_q("q09_subdict_defaults", "part", lambda d: rows.set_defaults(rows.subdict(rows.lower_names(d), ["p_partkey", "p_size", "p_none"], strict=False), {"p_none": 7, "p_more": "x"}), "SELECT p_partkey, p_size, 7 AS p_none, 'x' AS p_more FROM part")

# ---- order

_q("q10_offset", "events", lambda d: sequence.offset(d.select(*EVENT), 950, ["event_id"]), f"SELECT {E_COLS} FROM events ORDER BY event_id OFFSET 950")
_q("q11_limit", "events", lambda d: sequence.limit(d.select(*EVENT), 77, ["-event_id"]), f"SELECT {E_COLS} FROM events ORDER BY event_id DESC LIMIT 77")
_q("q12_slice_step", "events", lambda d: sequence.slice_rows(d.select(*EVENT), 100, 5000, 7, ["event_id"]), f"SELECT {E_COLS} FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p >= 100 AND p < 5000 AND (p - 100) % 7 = 0")
_q("q13_subset", "events", lambda d: sequence.subset(d.select(*EVENT), 7, ["event_id"]), f"SELECT {E_COLS} FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS p FROM events) WHERE p % 7 = 0")
_q("q14_takewhile", "events", lambda d: sequence.take_while(d.select(*EVENT), F.col("value") < 300, ["event_id"], ["user_id"]), f"SELECT {E_COLS} FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id <= e.event_id AND NOT x.value < 300)")
_q("q15_dropwhile", "events", lambda d: sequence.drop_while(d.select(*EVENT), F.col("value") < 300, ["event_id"]), f"SELECT {E_COLS} FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT value < 300)")
_q("q16_stopon", "events", lambda d: sequence.stop_on(d.select(*EVENT), F.col("value") > 400, ["event_id"], ["user_id"]), f"SELECT {E_COLS} FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id <= e.event_id AND x.value > 400)")
_q("q17_batch_count", "events", lambda d: sequence.batch(d, 64, "event_id", ["event_id"]).select("_batch", F.size("items").cast("bigint").alias("n"), F.array_join("items", ",").alias("ids")), "SELECT CAST((p - 1) // 64 AS BIGINT) AS _batch, count(*) AS n, string_agg(event_id, ',' ORDER BY p) AS ids FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS p FROM events) GROUP BY 1")
_q("q18_list_all", "customer", lambda d: sequence.as_list(d, "c_mktsegment", ["c_custkey"]).select(F.array_join("items", ",").alias("items")), "SELECT string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS items FROM customer")
_Z = "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS p FROM supplier) "


@query("q19_zip_long", _Z + "SELECT coalesce(c.p, s.p) AS _pos, c_custkey, coalesce(s_suppkey, -1) AS s_suppkey FROM c FULL JOIN s ON c.p = s.p")
def zip_long(spark, sf_dir):
    return sequence.zip_rows(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey"), ["c_custkey"], ["-s_suppkey"], "long", {"s_suppkey": -1})


@query("q20_zip_short", _Z + "SELECT c.p AS _pos, c_custkey, s_suppkey FROM c JOIN s ON c.p = s.p")
def zip_short(spark, sf_dir):
    return sequence.zip_rows(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey"), ["c_custkey"], ["-s_suppkey"], "short")


_q(
    "q21_split_where", "events", lambda d: sequence.split_where(d, lambda p, c: p > c, "value", ["event_id"], ["user_id"]),
    """WITH a AS (SELECT *, row_number() OVER w AS p, CASE WHEN lag(value) OVER w > value THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY p) AS r FROM a) SELECT user_id, CAST(r AS BIGINT) AS _run, min(p) - 1 AS start, max(p) AS stop, count(*) AS size FROM b GROUP BY user_id, r""",
)
_q("q22_enumerate_limit", "events", lambda d: sequence.enumerate_limit(d.select(*EVENT), 50, ["event_id"], start=10), f"SELECT {E_COLS}, row_number() OVER (ORDER BY event_id) + 9 AS i FROM (SELECT * FROM events ORDER BY event_id LIMIT 50)")
_q("q23_progress", "region", lambda d: sequence.progress(d, ["r_regionkey"]).select("r_regionkey", F.round("percent", 4).alias("percent")), "SELECT r_regionkey, round(100.0 * row_number() OVER (ORDER BY r_regionkey) / count(*) OVER (), 4)::DOUBLE AS percent FROM region")
_q("q24_loop", "nation", lambda d: sequence.loop(d.select("n_nationkey"), 3), "SELECT n_nationkey, i AS _iter FROM nation, range(3) t(i)")

# ---- folds

_q("q30_mean_stddev", "lineitem", lambda d: aggregate.mean(d, "l_quantity", ["l_returnflag"]).select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"), "n"), "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS dev, count(l_quantity) AS n FROM lineitem GROUP BY l_returnflag")
_q("q31_weighted_mean", "lineitem", lambda d: d.groupBy("l_linestatus").agg(F.round(aggregate.weighted_mean("l_discount", "l_quantity"), 6).alias("m")), "SELECT l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY l_linestatus")
_q("q32_accumulator_prior", "lineitem", lambda d: d.groupBy("l_linestatus").agg(F.round(aggregate.weighted_mean("l_discount", "l_quantity", 0.5, 1000.0), 6).alias("m")), "SELECT l_linestatus, round((500.0 + sum(l_discount * l_quantity)) / (1000.0 + sum(l_quantity)), 6) AS m FROM lineitem GROUP BY l_linestatus")
_q(
    "q33_minmax_first_arg", "events", lambda d: d.groupBy("event_type").agg(*aggregate.min_max("value", "user_id", "event_id")),
    """SELECT event_type, min(value) AS min, max(value) AS max, arg_min(user_id, (value, event_id)) AS argmin, arg_min(user_id, (-value, event_id)) AS argmax,
    arg_min(event_id, (value, event_id)) AS idxmin, arg_min(event_id, (-value, event_id)) AS idxmax FROM events GROUP BY event_type""",
)
_q("q35_likelihood", "lineitem", lambda d: d.filter("l_discount > 0").groupBy("l_returnflag").agg(F.round(aggregate.likelihood("l_discount"), 6).alias("ll"), F.round(aggregate.likelihood("l_discount", exp=True), 6).alias("geo")), "SELECT l_returnflag, round(avg(ln(l_discount)), 6) AS ll, round(exp(avg(ln(l_discount))), 6) AS geo FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag")
_q("q36_unique_ordered", "documents", lambda d: aggregate.unique(d.withColumn("t", F.md5(F.col("text").cast("binary"))), "t", ["doc_id"]), "SELECT t FROM (SELECT md5(text) AS t, min(doc_id) AS k FROM documents GROUP BY 1) ORDER BY k, t")
_q("q37_duplicates", "documents", lambda d: aggregate.duplicates(d.withColumn("t", F.md5(F.col("text").cast("binary"))), "t"), "SELECT md5(text) AS t, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
_q("q34_describe", "lineitem", lambda d: aggregate.describe(d, "l_tax", ["l_linestatus"]).select("l_linestatus", "min", "max", *(F.round(c, 6).alias(c) for c in ("std", "median", "sum"))), "SELECT l_linestatus, min(l_tax) AS min, max(l_tax) AS max, round(stddev_pop(l_tax), 6) AS std, round(median(l_tax), 6) AS median, round(sum(l_tax), 6) AS sum FROM lineitem GROUP BY l_linestatus")

# ---- sets


@query("q38_chain", "SELECT c_custkey AS k, 0 AS _src FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier")
def chain(spark, sf_dir):
    return sets.chain(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


@query("q39_mergesort_labelled", "SELECT c_acctbal AS v, 'c' AS label FROM customer UNION ALL SELECT s_acctbal, 's' FROM supplier ORDER BY v, label")
def mergesort(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v")), table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"))
    return sets.heap_merge((c, "c"), (s, "s"), order_by=["v"])


_BIG, _F = "SELECT o_custkey FROM orders WHERE o_totalprice > 200000", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"
_q("q40_except", "orders", lambda d: d.filter("o_totalprice > 200000").select("o_custkey").subtract(d.filter("o_orderstatus = 'F'").select("o_custkey")), f"{_BIG} EXCEPT {_F}")
_q("q41_intersect", "orders", lambda d: d.filter("o_totalprice > 200000").select("o_custkey").intersect(d.filter("o_orderstatus = 'F'").select("o_custkey")), f"{_BIG} INTERSECT {_F}")
_q("q42_union", "orders", lambda d: sets.union(d.filter("o_totalprice > 200000").select("o_custkey"), d.filter("o_orderstatus = 'F'").select("o_custkey")), f"{_BIG} UNION {_F}")
_q("q43_topk_heap", "orders", lambda d: sets.top_k(d.select("o_orderkey", "o_totalprice"), 25, ["-o_totalprice", "o_orderkey"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")


def _sql(name: str, sql: str, *tables: str) -> None:
    """The same SQL on both sides: statements are passed through to Spark."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *tables)
        return spark.sql(sql)

    query(name, sql)(run)


_sql("q44_sql_join_semi_anti", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "customer", "nation", "orders")


@query("q45_asof_join", "SELECT e.event_id, p.event_id AS prev_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # the last view of a user up to a purchase is a running last value over both, one shuffle by user
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    d = e.filter(F.col("event_type").isin("purchase", "view"))
    return d.withColumn("prev_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).filter("event_type = 'purchase'").select("event_id", "prev_id")


_sql("q46_rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_sql("q47_grouping_sets_filter", "SELECT o_orderstatus, o_orderpriority, count(*) FILTER (WHERE o_totalprice > 100000) AS big, min(o_totalprice) AS low FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
_sql("q48_window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders", "orders")
_sql("q49_join_agg", "SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name", "customer", "orders", "lineitem", "nation")

# ---- text

_q("q50_merge_spaces", "documents", lambda d: d.select("doc_id", F.md5(text.merge_spaces("text").cast("binary")).alias("h")), r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS h FROM documents")
_q("q51_striptags", "pages", lambda d: d.select("page_id", F.md5(text.strip_tags("html").cast("binary")).alias("h")), r"SELECT page_id, md5(regexp_replace(html, '</?[A-Za-z][^<>]*>', '', 'g')) AS h FROM pages")
_q("q52_stripelem", "pages", lambda d: d.select("page_id", F.length(text.strip_elements("html", ["script", "style"])).alias("n")), r"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<script(?:\s[^<>]*)?>.*?</script\s*>', ' ', 'g'), '(?is)<style(?:\s[^<>]*)?>.*?</style\s*>', ' ', 'g')) AS n FROM pages")
_q("q53_find_emails", "documents", lambda d: d.select("doc_id", F.array_join(F.array_sort(text.find_emails("text", ["x@y.zz"])), ",").alias("mails")).filter("mails <> ''"), r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}'))), ',') AS mails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}')")
_STOP = ", ".join(f"'{w}'" for w in text.STOP)
_q("q54_stopwords", "documents", lambda d: d.select("doc_id", F.md5(text.stopwords("text").cast("binary")).alias("h")), rf"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\d+') AND NOT lower(w) IN ({_STOP})), ' ')) AS h FROM documents")
_LONG = ", ".join(f"'{w}'" for w in text.STOP_LONG)
_q(
    "q55_tokenize", "documents", lambda d: d.select("doc_id", F.md5(F.array_join(text.tokenize("text"), " ").cast("binary")).alias("h")),
    rf"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(replace(replace(replace(lower(text), 'e.g.', 'eg'), 'i.e.', 'ie'), 'etc.', 'etc'),
    '([\p{{L}}\p{{N}}])-([\p{{L}}\p{{N}}])', '\1\2', 'g'), '([\p{{L}}\p{{N}}])-([\p{{L}}\p{{N}}])', '\1\2', 'g'), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\d+') AND NOT lower(w) IN ({_LONG})), ' ')) AS h FROM documents""",
)
_q("q56_char_ngrams", "part", lambda d: d.select(F.explode(text.char_ngrams("p_name", 4)).alias("g")).groupBy("g").agg(F.count("*").alias("n")), "SELECT p_name[i : i + 3] AS g, count(*) AS n FROM part, range(1, 200) t(i) WHERE i <= length(p_name) - 3 GROUP BY 1")
_q("q57_before_after", "part", lambda d: d.select("p_partkey", text.before("p_name", " ").alias("b"), text.after("p_name", " ").alias("a")), "SELECT p_partkey, split_part(p_name, ' ', 1) AS b, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS a FROM part")
_q("q58_substitute_text", "part", lambda d: d.select("p_partkey", text.substitute("p_type", [("A", "4"), ("4N", "x"), ("E", "3")]).alias("t")), "SELECT p_partkey, replace(replace(replace(p_type, 'A', '4'), '4N', 'x'), 'E', '3') AS t FROM part")
_q("q59_trim_text", "documents", lambda d: d.select("doc_id", text.trim_text("text", 60).alias("t")), r"SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_extract(substr(text, 1, 61), '(?s)^(.*)[^\p{L}\p{N}_]+', 1) || '...' END AS t FROM documents")


@query("q60_levenshtein", "WITH d AS (SELECT DISTINCT p_name AS t FROM part) SELECT a.t AS a, b.t AS b, CAST(levenshtein(a.t, b.t) AS DOUBLE) AS dist FROM d a JOIN d b ON a.t < b.t")
def levenshtein(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_name").distinct()
    a, b = d.toDF("a"), d.toDF("b")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", distance.levenshtein("a", "b").alias("dist"))


_q("q61_levendist", "part", lambda d: d.select("p_partkey", F.round(distance.leven_dist("p_name", "p_type", 1.0, 1.0), 6).alias("d")), "SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 0 ELSE levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE END, 6) AS d FROM part")
_q("q62_times_between", "orders", lambda d: d.select("o_orderkey", *(F.round(f(F.lit("1992-01-01").cast("timestamp"), "o_orderdate"), 6).alias(n) for n, f in (("s", numbers.seconds_between), ("d", numbers.days_between), ("y", numbers.years_between)))), "SELECT o_orderkey, round(epoch(o_orderdate - TIMESTAMP '1992-01-01'), 6)::DOUBLE AS s, round(epoch(o_orderdate - TIMESTAMP '1992-01-01') / 86400.0, 6)::DOUBLE AS d, round(epoch(o_orderdate - TIMESTAMP '1992-01-01') / 31556952.0, 6)::DOUBLE AS y FROM orders")
_q(
    "q63_pdate_multi_format", "orders",
    lambda d: d.select("o_orderkey", numbers.format_date(numbers.parse_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")))).alias("day")),
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
_q("q64_hashmd5", "documents", lambda d: d.select("doc_id", numbers.hash_md5("text", 4).alias("h")), "SELECT doc_id, CAST('0x' || md5(text)[1:8] AS BIGINT) AS h FROM documents")
_q(
    "q65_crc32", "documents", lambda d: d.select("doc_id", numbers.crc32("text").alias("c")),
    """WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)
    SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS c FROM documents, crc""",
)
_q("q66_haversine", "customer", lambda d: d.select("c_custkey", F.round(numbers.distance_km(F.col("c_custkey") % 90, F.col("c_custkey") % 180, F.lit(52.0), F.lit(21.0)), 3).alias("km")), "SELECT c_custkey, round(2 * 6367.0 * asin(least(1.0, sqrt(pow(sin((radians(52.0) - radians(c_custkey % 90)) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(52.0)) * pow(sin(radians(21.0 - c_custkey % 180) / 2), 2)))), 3) AS km FROM customer")
_q("q67_sigmoids", "lineitem", lambda d: d.select("l_orderkey", "l_linenumber", *(F.round(f, 6).alias(n) for n, f in (("lg", numbers.logistic(F.col("l_discount") * 10 - 0.5)), ("ca", numbers.cauchy(F.col("l_discount") * 10 - 0.5)), ("lx", numbers.log_x(F.lit(20) - F.col("l_quantity")))))), "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount * 10 - 0.5))), 6) AS lg, round(atan(l_discount * 10 - 0.5) / pi() + 0.5, 6) AS ca, round(sign(20 - l_quantity) * ln(1 + abs(20 - l_quantity)), 6) AS lx FROM lineitem")
_q("q68_binarize_bounds", "lineitem", lambda d: d.select("l_orderkey", F.round(numbers.binarize(F.col("l_discount") * 10), 6).alias("b"), numbers.bound("l_quantity", 10.0, 40.0).alias("q"), numbers.div_up(F.col("l_quantity").cast("bigint"), 7).alias("u"), numbers.round_up(F.col("l_quantity").cast("bigint"), 5).alias("r"), F.round(numbers.percent("l_tax", "l_discount", -1.0), 4).alias("p")), "SELECT l_orderkey, round(greatest(0.0, least(1.0, (l_discount * 10 - 0.5) * 4.0 + 0.5)), 6)::DOUBLE AS b, greatest(least(l_quantity, 40.0), 10.0) AS q, CAST(ceil(CAST(l_quantity AS BIGINT) / 7) AS BIGINT) AS u, CAST(ceil(CAST(l_quantity AS BIGINT) / 5) AS BIGINT) * 5 AS r, CASE WHEN l_discount = 0 THEN -1.0 ELSE round(100.0 * l_tax / l_discount, 4) END AS p FROM lineitem")
_q("q69_softmax_norms", "embeddings", lambda d: d.select("vec_id", F.round(numbers.norm("embedding"), 4).alias("n"), F.round(F.array_max(numbers.softmax(F.col("embedding").cast("array<double>"))), 5).alias("top"), F.round(F.element_at(numbers.unit_norm(F.col("embedding").cast("array<double>")), 1), 4).alias("u")), "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS n, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 5) AS top, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS u FROM embeddings")

# ---- text model


@query(
    "q70_doc_freq_idf",
    r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents),
        c AS (SELECT word, count(*) AS df FROM w WHERE word <> '' GROUP BY word)
        SELECT word, CAST(df AS BIGINT) AS df, round(ln((SELECT count(*) FROM documents) / df), 6) AS idf FROM c WHERE df > 1""",
)
def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.words_of(F.lower("text")).alias("words"))
    return textmodel.words_model(d, "doc_id", "words").withColumn("idf", F.round("idf", 6))


@query(
    "q71_tfidf_cosine_pairs",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents), t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
        m AS (SELECT word, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM t GROUP BY word HAVING count(*) > 1), v AS (SELECT doc_id, word, tf * idf AS w FROM t JOIN m USING (word)),
        iw AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM benchmark), it AS (SELECT item_id, word, count(*) AS tf FROM iw WHERE word <> '' GROUP BY ALL), iv AS (SELECT item_id, word, tf * idf AS w FROM it JOIN m USING (word)),
        n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM v GROUP BY doc_id), k AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM iv GROUP BY item_id),
        p AS (SELECT item_id AS a, doc_id AS b, sum(iv.w * v.w) AS dot FROM iv JOIN v USING (word) GROUP BY ALL)
        SELECT a, b, round(dot / (k.n * n.n), 6) AS cosine FROM p JOIN k ON k.item_id = a JOIN n ON n.doc_id = b WHERE dot / (k.n * n.n) > 0.3""",
)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are shuffled by document, so that the words of one are counted where they are
    d, i = rows.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b"), "text"), "b"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), "text")
    split = [x.select(x.columns[0], F.split(F.lower("text"), WORD).alias("words")) for x in (i, d)]
    return textmodel.tfidf_cosine_above(*split, "a", "b", "words", 0.3).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(
    "q72_ngram_coverage_score",
    """WITH b AS (SELECT DISTINCT text[i : i + 7] AS g FROM benchmark, range(1, 2000) t(i) WHERE i <= length(text) - 7),
        d AS (SELECT doc_id, text FROM documents), h AS (SELECT doc_id, i - 1 AS s, text[i : i + 7] AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 6)) AS i FROM d)),
        x AS (SELECT h.doc_id, s, g, coalesce(max(s + 8) OVER (PARTITION BY h.doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM h JOIN b USING (g)),
        c AS (SELECT doc_id, sum(s + 8 - greatest(s, last)) AS chars, count(DISTINCT g) AS matched FROM x GROUP BY doc_id)
        SELECT doc_id, round(coalesce(chars, 0) / length(text), 6) AS covered, coalesce(matched, 0) AS matched FROM d LEFT JOIN c USING (doc_id)""",
)
def ngram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = textmodel.ngram_model(table(spark, sf_dir, "benchmark"), "text", 8, 1)
    return textmodel.ngram_score(table(spark, sf_dir, "documents"), "doc_id", "text", model, 8).withColumn("covered", F.round("covered", 6))


_q("q73_onehot_frame", "orders", lambda d: textmodel.OneHotFrame(["o_orderstatus"], min_freq=1).fit(d).transform(d.select("o_orderkey", "o_orderstatus")), "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
_q("q74_onehot_decode", "orders", lambda d: d.select("o_orderkey", textmodel.decode(textmodel.one_hot("o_orderstatus", ["F", "O", "P"]), ["f", "o", "p"], 0.5).alias("s"), F.array_join(textmodel.one_hot_multi(F.split("o_orderpriority", "-"), ["1", "2", "URGENT"]), ",").alias("m")), "SELECT o_orderkey, lower(o_orderstatus) AS s, (CASE WHEN list_contains(string_split(o_orderpriority, '-'), '1') THEN '1.0' ELSE '0.0' END) || ',' || (CASE WHEN list_contains(string_split(o_orderpriority, '-'), '2') THEN '1.0' ELSE '0.0' END) || ',' || (CASE WHEN list_contains(string_split(o_orderpriority, '-'), 'URGENT') THEN '1.0' ELSE '0.0' END) AS m FROM orders")


@query(
    "q75_threshold_best_f1",
    """WITH d AS (SELECT least(1.0, n_chars / 3000.0)::DOUBLE AS s, quality AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT i, i / 100.0 AS t FROM range(100) r(i)),
        f AS (SELECT i, 2.0 * count(*) FILTER (WHERE round(s * 100, 9) > i AND y = 1) / (count(*) FILTER (WHERE round(s * 100, 9) > i) + count(*) FILTER (WHERE y = 1)) AS f1 FROM g, d GROUP BY i)
        SELECT (i / 100.0)::DOUBLE AS threshold, round(f1, 6)::DOUBLE AS f1 FROM f ORDER BY f1 DESC, i LIMIT 1""",
)
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return textmodel.best_threshold(d.withColumn("s", F.least(F.lit(1.0), F.col("n_chars") / 3000.0)), "s", "quality").withColumn("f1", F.round("f1", 6))


_q("q76_grid_sweep", "lineitem", lambda d: sweep(d, {"lo": [0.02, 0.05], "q": [10, 30]}, lambda lo, q: F.round(F.sum(F.when((F.col("l_discount") >= lo) & (F.col("l_quantity") < q), F.col("l_extendedprice"))), 2)), "SELECT lo::DOUBLE AS lo, q, round(sum(CASE WHEN l_discount >= lo AND l_quantity < q THEN l_extendedprice END), 2) AS metric FROM lineitem, (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) a(lo), (VALUES (10), (30)) b(q) GROUP BY ALL")


@query(
    "q77_cosine_top_k",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS c FROM e a, e b WHERE a.vec_id <> b.vec_id)
        SELECT q, id, r FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS r FROM p) WHERE r <= 5""",
)
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return textmodel.cosine_top_k(e, e, "vec_id", "embedding", 5)


@query("q78_grid_table", "SELECT a, b FROM (VALUES (1), (2), (3)) x(a), (VALUES ('u'), ('v')) y(b)")
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_table(spark, {"a": [1, 2, 3], "b": ["u", "v"]}).select(F.col("a").cast("int").alias("a"), "b")


# ---- Arrow functions

_SPACED = r"trim(regexp_replace({x}, '[\s\x{{0B}}\x{{85}}\x{{A0}}]+', ' ', 'g'))"
#: Entities that occur in `pages` are decoded by hand.
_DECODED = """replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')"""
_NO_TAGS = r"regexp_replace({x}, '<!--(?s:.)*?-->|</?[A-Za-z][^<>]*>', ' ', 'g')"
_q("q80_html2text", "pages", lambda d: d.select("page_id", text.html_to_text("html").alias("t")), "SELECT page_id, " + _SPACED.format(x=_DECODED.format(x=_NO_TAGS.format(x="html"))) + " AS t FROM pages")
_q("q81_ascii", "documents", lambda d: d.select("doc_id", text.ascii_fold("text").alias("t")), r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS t FROM documents")
_GAP = "CASE WHEN {x} = ' ' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END"
_q(
    "q82_weighted_levenshtein", "part", lambda d: rows.spread(d.select("p_partkey", "p_name", "p_type"), "p_partkey").select("p_partkey", F.round(distance.levenshtein("p_name", "p_type", 0.5, 0.1), 6).alias("d")),
    # one row of the distance matrix is folded over the characters of p_name
    f"""WITH c AS (SELECT p_partkey, regexp_extract_all(p_name, '.') AS a, regexp_extract_all(p_type, '.') AS b FROM part),
    r AS (SELECT *, list_transform(range(len(b) + 1), lambda j: coalesce(list_sum(list_transform(b[1:j], lambda y: {_GAP.format(x="y")})), 0.0::DOUBLE)) AS run FROM c)
    SELECT p_partkey, round(list_reduce(list_concat([run], list_transform(a, lambda x: [ascii(x)::DOUBLE])), lambda w, x: list_transform(range(1, len(run) + 1), lambda j: run[j] + list_min(list_transform(range(1, j + 1), lambda k:
        CASE WHEN k = 1 THEN w[1] + {_GAP.format(x="chr(x[1]::INT)")} ELSE least(w[k] + {_GAP.format(x="chr(x[1]::INT)")}, w[k - 1] + CASE WHEN b[k - 1] = chr(x[1]::INT) THEN 0.0 WHEN lower(b[k - 1]) = lower(chr(x[1]::INT)) THEN 0.5 ELSE greatest({_GAP.format(x="b[k - 1]")}, {_GAP.format(x="chr(x[1]::INT)")}) END) END - run[k]))))[len(run)], 6) AS d FROM r""",
)
_q("q83_align_substring", "part", lambda d: rows.spread(d.select("p_partkey", "p_type", "p_name"), "p_partkey").select("p_partkey", distance.align_substring("p_type", "p_name").alias("a")).select("p_partkey", "a.*"))
_q("q84_align_multiple", "part", lambda d: distance.align_groups(d.select("p_partkey", "p_brand", "p_name"), "p_brand", "p_partkey", "p_name"))
_q("q85_pattern_links", "pages", lambda d: d.select("page_id", F.explode(markup.pattern_match_all("html", '<a href="{HREF}">{TEXT ..}</a>')).alias("m")).select("page_id", F.col("m")["HREF"].alias("href"), F.col("m")["TEXT"].alias("txt")), r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"<>]*">[^<]*</a>')) AS x FROM pages) SELECT page_id, regexp_extract(x, 'href="([^"]*)"', 1) AS href, regexp_extract(x, '>(.*)</a>', 1) AS txt FROM m""")
_q("q86_pattern_titles", "pages", lambda d: d.select("page_id", markup.pattern_match("html", "<title>{TITLE ..}</title>")["TITLE"].alias("title")), "SELECT page_id, trim(" + _DECODED.format(x="regexp_extract(html, '<title>([^<]*)</title>', 1)") + ") AS title FROM pages")
_q("q87_node_texts", "pages", lambda d: d.select("page_id", F.size(markup.node_texts("html", "nav a")).alias("n"), markup.node_text("html", "article h1").alias("h1")), "SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')) AS n, trim(" + _DECODED.format(x="regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)") + ") AS h1 FROM pages")
_q("q88_partial_sort", "events", lambda d: sets.partial_sort(d.select("event_id", "user_id", "value"), 4, "value", ["event_id"], ["user_id"]), """
    WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::STRUCT(v DOUBLE, i BIGINT, id BIGINT)[] AS heap, NULL::BIGINT AS gone FROM events
        UNION ALL SELECT s.user_id, e.i, list_sort(list_append(CASE WHEN len(s.heap) < 4 THEN s.heap ELSE s.heap[2:] END, {'v': e.value, 'i': e.i, 'id': e.event_id})), CASE WHEN len(s.heap) < 4 THEN NULL ELSE s.heap[1].id END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1),
    o AS (SELECT gone AS event_id, i AS place FROM s WHERE gone IS NOT NULL UNION ALL SELECT h.id, 1000000 + k FROM (SELECT unnest(heap) AS h, unnest(range(len(heap))) AS k FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i AND e.n = s.i))
    SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS _rank FROM o JOIN e USING (event_id)""")

# ---- event time

_N = lambda: F.count("*").alias("n")
_q("q90_window_tumbling", "events", lambda d: windows.tumbling(d, "ts", "6 hours", [_N(), F.round(F.sum("value"), 4).alias("s")], ["event_type"]), "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL")
_q("q91_window_sliding", "events", lambda d: windows.sliding(d, "ts", "12 hours", "6 hours", [_N()]), "SELECT b - INTERVAL 6 HOUR * i AS start, b - INTERVAL 6 HOUR * i + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events), range(2) t(i) GROUP BY ALL")
_q(
    "q92_session_gap", "events", lambda d: windows.sessions(d, "ts", "4 hours", [_N()], ["user_id"]),
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, g""",
)
_q("q93_dedup", "events", lambda d: windows.deduplicated(d.select("user_id", "event_type"), ["user_id", "event_type"]), "SELECT DISTINCT user_id, event_type FROM events")
_q(
    "q94_conversation_turn_gaps", "conversations", lambda d: sequence.split_where(d, lambda p, c: p == c, "role", ["turn"], ["conv_id"]),
    """WITH a AS (SELECT *, row_number() OVER w AS p, CASE WHEN lag(role) OVER w = role THEN 1 ELSE 0 END AS cut FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY p) AS r FROM a) SELECT conv_id, CAST(r AS BIGINT) AS _run, min(p) - 1 AS start, max(p) AS stop, count(*) AS size FROM b GROUP BY conv_id, r""",
)
_q("q95_json_props", "events", lambda d: d.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@query("q96_sample_hash", "SELECT true AS subset, true AS share_ok, true AS same_again")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of a sample: rows of the table, about the wanted share, and the same however the table is partitioned."""
    d = table(spark, sf_dir, "events").select(*EVENT)
    one, two = sets.sample(d, 0.1, ["event_id"], 3), sets.sample(d.repartition(5), 0.1, ["event_id"], 3)
    count = lambda x, n: x.agg(F.count("*").alias(n))
    all_ = count(d, "n").crossJoin(count(one, "k")).crossJoin(count(one.exceptAll(d), "outside")).crossJoin(count(one.exceptAll(two), "other"))
    near = F.abs(F.col("k") - 0.1 * F.col("n")) <= 5 * F.sqrt(0.09 * F.col("n"))
    return all_.select((F.col("outside") == 0).alias("subset"), near.alias("share_ok"), (F.col("other") == 0).alias("same_again"))


@query("q97_mix", "SELECT true AS draws_dense, true AS in_order, true AS one_exhausted, true AS share_ok")
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of a random interleaving: draws are numbered without gaps, each source keeps its order, one is used up, and shares are about the wanted."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    m = sets.mix([c, s], [0.7, 0.3], ["k"], 5)
    w = Window.partitionBy("_src").orderBy("_draw")
    steps = m.withColumn("up", F.col("k") > F.lag("k").over(w))
    one = steps.agg(F.count("*").alias("n"), F.min("_draw").alias("lo"), F.max("_draw").alias("hi"), F.min(F.coalesce("up", F.lit(True))).alias("in_order"), F.sum((F.col("_src") == 0).cast("int")).alias("a"), F.sum((F.col("_src") == 1).cast("int")).alias("b"))
    all_ = one.crossJoin(c.agg(F.count("*").alias("na"))).crossJoin(s.agg(F.count("*").alias("nb")))
    return all_.select(((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("draws_dense"), "in_order", ((F.col("a") == F.col("na")) | (F.col("b") == F.col("nb"))).alias("one_exhausted"), (F.abs(F.col("a") - 0.7 * F.col("n")) <= 5 * F.sqrt(0.21 * F.col("n"))).alias("share_ok"))


@query("q98_weighted_draw", "SELECT true AS all_drawn, true AS from_table, true AS mean_ok")
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of 20,000 weighted draws: each number once, rows of the table, and the mean weight that sampling by weight has."""
    d = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    x = sets.draw(d, 20_000, ["p_partkey"], "p_size", 9)
    one = x.agg(F.count("*").alias("n"), F.countDistinct("_draw").alias("k"), F.avg("p_size").alias("m"))
    outside = x.select("p_partkey", "p_size").distinct().exceptAll(d).agg(F.count("*").alias("outside"))
    w = F.col("p_size").cast("double")
    want = d.agg((F.sum(w * w) / F.sum(w)).alias("want"), F.max(w).alias("most"))
    return one.crossJoin(outside).crossJoin(want).select(((F.col("n") == 20_000) & (F.col("k") == 20_000)).alias("all_drawn"), (F.col("outside") == 0).alias("from_table"), (F.abs(F.col("m") - F.col("want")) <= 5 * F.col("most") / F.sqrt(F.lit(80_000.0))).alias("mean_ok"))
