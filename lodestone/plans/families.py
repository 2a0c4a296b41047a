"""Wide queries, one for each family of functions, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance, kinds, markup, notation, numbers, text, textmodel
from ..operators import aggregate, monitor, rows, sequence, sets
from ..session import table
from ..sources import io
from ..streaming import windows
from .catalogue import _DECODED, _NO_TAGS, _SPACED, _q, query
from .pipeline import Pipeline, ensemble, pipeline, sweep_runs

# ---- text

_q(
    "q100_spaces_and_lines", "part",
    lambda d: d.select(
        "p_partkey", text.flat_spaces(F.concat("p_name", F.lit("\n"), "p_type", F.lit("\t"), "p_brand")).alias("flat"), text.prefix("-", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).alias("pre"),
        text.indent(F.concat("p_name", F.lit("\n"), "p_type")).alias("ind"), text.list_to_str(text.str_to_list(F.concat(F.lit("  "), "p_name", F.lit("   x "))), "|").alias("parts"), text.list_to_str(text.str_to_list("p_brand", "#"), "/").alias("split"), text.regex_sub(F.concat("p_name", F.lit("   "), "p_type")).alias("sub"),
    ),
    r"""SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS flat, CASE WHEN p_partkey % 2 = 0 THEN '-' || p_brand ELSE '' END AS pre, '    ' || p_name || chr(10) || '    ' || p_type AS ind,
    array_to_string(regexp_split_to_array(trim(p_name || '   x'), '\s+'), '|') AS parts, replace(p_brand, '#', '/') AS split, p_name || ' ' || p_type AS sub FROM part""",
)

_PATH = lambda: F.concat(F.element_at(F.array(F.lit("a/b.c/"), F.lit(""), F.lit("x//")), (F.col("p_partkey") % 3 + 1).cast("int")), F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(F.array(F.lit(".tar.gz"), F.lit(""), F.lit(".TXT"), F.lit("/")), (F.col("p_partkey") % 4 + 1).cast("int")))
_q(
    "q101_paths", "part",
    lambda d: d.select("p_partkey", _PATH().alias("p")).select("p_partkey", text.extension("p").alias("ext"), text.drop_extension("p").alias("dropped"), text.drop_extensions("p").alias("bare"), text.set_extension("p", "md").alias("set_"), text.dir_name("p").alias("dir"), text.norm_dir("p").alias("norm")),
    r"""WITH d AS (SELECT p_partkey, ['a/b.c/', '', 'x//'][p_partkey % 3 + 1] || replace(p_name, ' ', '_') || ['.tar.gz', '', '.TXT', '/'][p_partkey % 4 + 1] AS p FROM part)
    SELECT p_partkey, regexp_extract(p, '\.([^./]*)$', 1) AS ext, regexp_replace(p, '([^/])\.[^./]*$', '\1') AS dropped, regexp_replace(p, '([^/.])(\.[^./]*)+$', '\1') AS bare, regexp_replace(p, '([^/])\.[^./]*$', '\1') || '.md' AS set_, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(p, '/+$', '') || '/' AS norm FROM d""",
)

_CRC = """coalesce(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""
_CRC_TABLE = "WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_q("q102_crc32_names", "customer", lambda d: d.select("c_custkey", numbers.crc32("c_name").alias("c")), f"{_CRC_TABLE} SELECT c_custkey, xor({_CRC.format(x='c_name')}, 4294967295) AS c FROM customer, crc")
_q("q103_safe_names", "pages", lambda d: d.select("page_id", text.safe_name("url", 20).alias("name")), f"{_CRC_TABLE} SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 20) || '_' || lower(lpad(to_hex(xor({_CRC.format(x='url')}, 4294967295)), 8, '0')) AS name FROM pages, crc")

_COUNTED = {"int": text.PATTERNS["int"], "float": text.PATTERNS["float"], "ident": text.PATTERNS["ident"], "email": text.PATTERNS["email"], "nospam": text.PATTERNS["email_nospam"], "url": text.PATTERNS["url"], "ip": text.PATTERNS["ip"], "string": text.PATTERNS["string"]}
_q(
    "q104_patterns_in_documents", "documents", lambda d: d.select("doc_id", *(F.regexp_count("text", F.lit(p)).alias(n) for n, p in _COUNTED.items())),
    "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS {n}" for n, p in _COUNTED.items()) + " FROM documents",
)
_q(
    "q105_patterns_in_pages", "pages",
    lambda d: d.select("page_id", F.regexp_count("html", F.lit(text.PATTERNS["tag"])).alias("all_tags"), F.regexp_count("html", F.lit(text.tags("p", "a"))).alias("named"), F.regexp_count("html", F.lit(text.tags_except("p", "a"))).alias("others"), F.regexp_count("html", F.lit(text.PATTERNS["html_comment"])).alias("comments"), F.regexp_count("html", F.lit(text.tags_pair("h1"))).alias("pairs")),
    r"""SELECT page_id, len(regexp_extract_all(html, '</?[A-Za-z][^<>]*>')) AS all_tags, len(regexp_extract_all(html, '</?(p|a)([\s/][^<>]*)?>')) AS named, len(regexp_extract_all(html, '</?[A-Za-z][^<>]*>')) - len(regexp_extract_all(html, '</?(p|a)([\s/][^<>]*)?>')) AS others,
    len(regexp_extract_all(html, '<!--(.|\n)*?-->')) AS comments, len(regexp_extract_all(html, '<h1(\s[^<>]*)?>(.|\n)*?</h1\s*>')) AS pairs FROM pages""",
)
_q(
    "q106_issn_and_choices", "part",
    lambda d: d.withColumn("code", F.concat(F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("p_partkey") * 7 % 1000).cast("string"), 3, "0"), F.when(F.col("p_partkey") % 11 == 0, "X").when(F.col("p_partkey") % 5 == 0, "").otherwise("3"))).select(
        "p_partkey", text.is_issn("code").alias("issn"), F.regexp_count("p_name", F.lit(text.alternative(["red", "r", "in", "ring", "wi"]))).alias("n"), text.key_count("p_type", "ECO").alias("upper_key"), text.key_count("p_name", "ri").alias("key"), F.array_join(text.extract_regex("p_name", r"([a-z])([a-z])\b"), "").alias("ends"),
        F.array_join(text.extract_regex("p_brand", r"#(?P<extract>\d+)"), ",").alias("named"), F.array_join(text.extract_regex("p_name", "[aeiou]+"), ",").alias("vowels"), F.lit(text.regex_escape("a.b*c[d]")).alias("escaped"),
    ),
    r"""WITH d AS (SELECT *, lpad(p_partkey::VARCHAR, 4, '0') || '-' || lpad((p_partkey * 7 % 1000)::VARCHAR, 3, '0') || CASE WHEN p_partkey % 11 = 0 THEN 'X' WHEN p_partkey % 5 = 0 THEN '' ELSE '3' END AS code FROM part)
    SELECT p_partkey, regexp_full_match(code, '\d{4}-\d{3}[\dXx]') AS issn, len(regexp_extract_all(p_name, 'ring|red|in|wi|r')) AS n, len(regexp_extract_all(p_type, '\bECO\b')) AS upper_key, len(regexp_extract_all(p_name, '(?i)\bri')) AS key, array_to_string(regexp_extract_all(p_name, '[a-z][a-z]\b'), '') AS ends,
    array_to_string(regexp_extract_all(p_brand, '#(\d+)', 1), ',') AS named, array_to_string(regexp_extract_all(p_name, '[aeiou]+'), ',') AS vowels, 'a\.b\*c\[d\]' AS escaped FROM d""",
)
_Q = "chr(39)"
_q(
    "q107_html_escapes", "pages",
    lambda d: d.select("page_id", F.md5(text.html_escape("html").cast("binary")).alias("esc"), F.md5(text.html_attr_escape("html").cast("binary")).alias("attr"), F.md5(text.decode_entities(text.html_attr_escape(F.replace("html", F.lit("&"), F.lit("")))).cast("binary")).alias("back"), F.md5(text.no_script("html").cast("binary")).alias("ns")),
    rf"""SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')) AS esc, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), {_Q}, '&#39;'), '"', '&#34;')) AS attr,
    md5(replace(html, '&', '')) AS back, md5(regexp_replace(html, '(?is)(<script\b[^>]*>.*?</script\s*>)', '<!--\1-->', 'g')) AS ns FROM pages""",
)
_q(
    "q108_html_text_smart", "pages", lambda d: d.select("page_id", text.html_to_text_smart("html").alias("t")),
    "SELECT page_id, " + _SPACED.format(x=_DECODED.format(x=_NO_TAGS.format(x=rf"regexp_replace(html, '(?i)</?({text.INLINE})([\s/][^<>]*)?>', '', 'g')"))) + " AS t FROM pages",
)
_q(
    "q109_word_lists", "customer",
    lambda d: d.select("c_custkey", F.array_join(text.list_ngrams(F.split("c_mktsegment", ""), 2), ",").alias("grams"), F.array_join(text.stopwords(F.split("c_name", "#"), ["customer"], numbers=False, as_string=False), ",").alias("kept"), F.array_join(text.words_of("c_name"), "+").alias("words")),
    r"""WITH d AS (SELECT *, regexp_extract_all(c_mktsegment, '.') AS cs FROM customer), e AS (SELECT *, list_concat(list_concat(['_'], cs), ['_']) AS p FROM d)
    SELECT c_custkey, array_to_string(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]), ',') AS grams, array_to_string(list_filter(string_split(c_name, '#'), lambda w: lower(w) <> 'customer' AND length(w) > 1), ',') AS kept,
    array_to_string(list_filter(regexp_split_to_array(c_name, '[^\p{L}\p{N}_]+'), lambda w: w <> ''), '+') AS words FROM e""",
)
_q(
    "q110_addresses", "pages",
    lambda d: d.select("page_id", text.fix_url(F.regexp_replace("url", "^http://", "")).alias("fixed"), text.url_join("url", F.concat(F.lit("/x/"), F.col("page_id").cast("string"))).alias("joined"), text.url_unquote(F.concat(F.lit("a%20b%2F"), F.col("page_id").cast("string"))).alias("plain"), text.short_id_value(text.short_id("page_id")).alias("back"), F.length(text.short_id("page_id")).alias("digits")),
    r"SELECT page_id, url AS fixed, regexp_extract(url, '^(https?://[^/]+)', 1) || '/x/' || page_id AS joined, 'a b/' || page_id AS plain, page_id AS back, CASE WHEN page_id < 57 THEN 1 WHEN page_id < 3249 THEN 2 ELSE 3 END AS digits FROM pages",
)
_q(
    "q111_tagged_texts", "part",
    lambda d: d.select("p_partkey", text.combine(text.tagged("p_name", "HTML"), text.tagged("p_type", F.when(F.col("p_partkey") % 2 == 0, "HTML").otherwise("HTML/plain"))).alias("t")).select("p_partkey", "t.text", "t.language"),
    "SELECT p_partkey, p_name || p_type AS text, 'HTML' AS language FROM part",
)
_q(
    "q112_json_texts", "events", lambda d: d.select("event_id", text.extract_text(F.to_json(F.struct(F.lit("é a").alias("t"), F.struct(F.col("event_type").alias("u"), F.array(F.lit("x"), F.lit("y")).alias("v")).alias("n"), F.lit("gone").alias("skip"))), ["skip"], "/", "+").alias("t")),
    "SELECT event_id, 'e a/' || event_type || '+x+y' AS t FROM events",
)
_q("q113_ascii_words", "nation", lambda d: d.select("n_nationkey", text.ascii_fold(F.concat("n_name", F.lit(" Ångström Łódź café"))).alias("t"), text.unicode_escape(F.concat("n_name", F.lit(" é\n"))).alias("u")), r"SELECT n_nationkey, n_name || ' Angstrom odz cafe' AS t, n_name || ' \xe9\n' AS u FROM nation")

# ---- numbers

_q(
    "q120_lenient_casts", "orders",
    lambda d: d.withColumn("k", F.col("o_orderkey") % 4).withColumn("s", F.when(F.col("k") == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).when(F.col("k") == 1, "abc").when(F.col("k") == 2, "true").otherwise("1,234")).select(
        "o_orderkey", numbers.as_int("s", -1).alias("i"), numbers.as_number("s", -0.5).alias("f"), numbers.as_bool(F.when(F.col("k") != 0, F.col("s")), False).alias("b"), numbers.parse_int("s").alias("pi"), numbers.parse_float(F.concat("s", F.lit(".5"))).alias("pf"),
        numbers.parse_decimal("s", 12, 2).cast("double").alias("pd"), F.round(numbers.parse_percent(F.concat(F.col("k").cast("string"), F.lit("2.1%"))), 6).alias("pp"), numbers.min_max("o_custkey", "o_orderkey", F.lit(100))["min"].alias("lo"), numbers.min_max("o_custkey", "o_orderkey", F.lit(100))["max"].alias("hi"),
    ),
    """WITH d AS (SELECT *, o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey WHEN 1 THEN 'abc' WHEN 2 THEN 'true' ELSE '1,234' END AS s FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN o_custkey ELSE -1 END AS i, CASE k WHEN 0 THEN o_custkey::DOUBLE ELSE -0.5::DOUBLE END AS f, k = 2 AS b, CASE k WHEN 0 THEN o_custkey WHEN 3 THEN 1234 END AS pi, CASE k WHEN 0 THEN o_custkey + 0.5::DOUBLE WHEN 3 THEN 1234.5::DOUBLE END AS pf,
    CASE k WHEN 0 THEN o_custkey::DOUBLE WHEN 3 THEN 1234::DOUBLE END AS pd, round((k * 10 + 2.1::DOUBLE) / 100, 6) AS pp, least(o_custkey, o_orderkey, 100) AS lo, greatest(o_custkey, o_orderkey, 100) AS hi FROM d""",
)
_q(
    "q121_more_sigmoids", "lineitem",
    lambda d: d.withColumn("x", F.col("l_discount") * 20 - 1).select("l_orderkey", "l_linenumber", "l_quantity", *(F.round(f, 6).alias(n) for n, f in (("a", numbers.sigmoid_sqrt("x")), ("b", numbers.sigmoid_lin("x")), ("m", numbers.mexican("x", 2.0)), ("e", numbers.exp1_x("x")), ("s", numbers.logistic_slope("x", 0.5)))), numbers.round_down(F.col("l_quantity").cast("bigint"), 7).alias("d")),
    """WITH t AS (SELECT *, l_discount * 20 - 1 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, round((x / sqrt(1 + x * x) + 1) / 2, 6) AS a, round(greatest(0.0, least(1.0, (x + 1) / 2)), 6)::DOUBLE AS b, round(2 / sqrt(3) * pow(pi(), -0.25) * (1 - x * x / 4) * exp(-x * x / 8), 6) AS m,
    round(sign(x) * (exp(abs(x)) - 1), 6) AS e, round(2 / (1 + exp(-2 * x)) * (1 - 1 / (1 + exp(-2 * x))), 6) AS s, CAST(l_quantity AS BIGINT) - CAST(l_quantity AS BIGINT) % 7 AS d FROM t""",
)
_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_q(
    "q122_vectors", "embeddings",
    lambda d: d.withColumn("v", F.col("embedding").cast("array<double>")).select(
        "vec_id", F.round(F.element_at(numbers.zero_sum("v"), 1), 5).alias("z"), F.round(F.element_at(numbers.unit_sum(F.transform("v", F.abs)), 2), 6).alias("u"), F.round(F.element_at(numbers.multi_softmax("v", [(0, 4), (4, 4)]), 6), 6).alias("ms"), F.round(numbers.dot("v", F.reverse("v")), 4).alias("dot"),
        F.size(numbers.find_nonzero("v")).alias("nz"), (F.abs(F.element_at(numbers.vector_of_json(numbers.vector_json("v")), 3) - F.element_at("v", 3)) <= F.abs(F.element_at("v", 3)) * 1e-4).alias("back"), F.round(F.element_at(numbers.unit_norm("v", 1.0), 1), 5).alias("n1"),
    ),
    f"""WITH t AS (SELECT vec_id, {_V} AS v FROM embeddings) SELECT vec_id, round(v[1] - list_avg(v), 5) AS z, round(abs(v[2]) / list_sum(list_transform(v, lambda x: abs(x))), 6) AS u, round(exp(v[6]) / (exp(v[5]) + exp(v[6]) + exp(v[7]) + exp(v[8])), 6) AS ms,
    round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[len(v) + 1 - i])), 4) AS dot, len(list_filter(v, lambda x: x <> 0)) AS nz, true AS back, round(v[1] / list_sum(list_transform(v, lambda x: abs(x))), 5) AS n1 FROM t""",
)
_q(
    "q123_maps", "nation",
    lambda d: d.withColumn("m", F.create_map(F.lit("Name"), F.col("n_name"), F.lit("A,b"), F.lit("two"))).select(
        "n_nationkey", numbers.print_map(numbers.lower_keys("m")).alias("low"), numbers.print_map(numbers.reverse_map("m")).alias("rev"), numbers.print_map(numbers.split_keys("m", ",")).alias("split"), numbers.print_map(numbers.update_map("m", F.create_map(F.lit("Name"), F.lit("new")))).alias("upd"),
        numbers.print_map(numbers.list_to_map(F.array(F.col("n_name"), F.lit("x")))).alias("ix"), numbers.print_map(numbers.list_to_map(F.array(F.col("n_name"), F.lit("zz")), True)).alias("inv"),
    ),
    """SELECT n_nationkey, 'a,b: two' || chr(10) || 'name: ' || n_name AS low, CASE WHEN n_name < 'two' THEN n_name || ': Name' || chr(10) || 'two: A,b' ELSE 'two: A,b' || chr(10) || n_name || ': Name' END AS rev, 'A: two' || chr(10) || 'Name: ' || n_name || chr(10) || 'b: two' AS split,
    'A,b: two' || chr(10) || 'Name: new' AS upd, '0: ' || n_name || chr(10) || '1: x' AS ix, n_name || ': 0' || chr(10) || 'zz: 1' AS inv FROM nation""",
)
_q(
    "q124_md5_widths", "customer", lambda d: d.select("c_custkey", numbers.hash_md5("c_name", 7).alias("h7"), numbers.hash_md5("c_name", 10).cast("string").alias("h10"), numbers.hash_md5("c_name", 16).alias("h16")),
    "SELECT c_custkey, ('0x' || md5(c_name)[1:14])::BIGINT AS h7, (('0x' || md5(c_name)[1:6])::HUGEINT * 72057594037927936 + ('0x' || md5(c_name)[7:20])::HUGEINT)::VARCHAR AS h10, md5(c_name) AS h16 FROM customer",
)
_EPOCH = "epoch(o_orderdate - TIMESTAMP '1995-06-17 12:30:00')"
_NOW = {"s": (numbers.seconds_since, 1.0), "m": (numbers.minutes_since, 60.0), "h": (numbers.hours_since, 3600.0), "d": (numbers.days_since, 86400.0), "y": (numbers.years_since, 31556952.0)}
_q(
    "q125_times", "orders",
    lambda d: d.select("o_orderkey", *(F.round(f(F.lit("1995-06-17 12:30:00").cast("timestamp"), "o_orderdate"), 5).alias(n) for n, f in (("mi", numbers.minutes_between), ("ho", numbers.hours_between), ("we", numbers.weeks_between))), *(F.round(f(F.lit("1995-06-17 12:30:00").cast("timestamp")) - f("o_orderdate"), 3).alias(f"since_{n}") for n, (f, _) in _NOW.items()), numbers.epoch_seconds("o_orderdate").alias("ep")),
    f"SELECT o_orderkey, round({_EPOCH} / 60, 5)::DOUBLE AS mi, round({_EPOCH} / 3600, 5)::DOUBLE AS ho, round({_EPOCH} / 604800, 5)::DOUBLE AS we, " + ", ".join(f"round({_EPOCH} / {k}, 3)::DOUBLE AS since_{n}" for n, (_, k) in _NOW.items()) + ", epoch(o_orderdate)::DOUBLE AS ep FROM orders",
)
_q(
    "q126_datetimes", "orders",
    lambda d: d.withColumn("k", F.col("o_orderkey") % 3).select(
        "o_orderkey", numbers.format_datetime("o_orderdate").alias("f"), numbers.format_datetime(numbers.parse_datetime(F.when(F.col("k") == 0, F.date_format("o_orderdate", "M/d/yyyy H:mm:ss")).when(F.col("k") == 1, F.date_format("o_orderdate", "M/d/yyyy h:mm:ss a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))).alias("p"),
        numbers.format_datetime(numbers.as_datetime(F.when(F.col("k") == 0, "no time").otherwise(F.date_format("o_orderdate", "yyyyMMdd HHmm")), "yyyyMMdd HHmm", "2000-01-01")).alias("a"), numbers.format_date(numbers.parse_date(F.when(F.col("k") == 0, F.date_format("o_orderdate", "d MMM yyyy")).when(F.col("k") == 1, F.date_format("o_orderdate", "MMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")))).alias("day"),
    ),
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS f, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS p, CASE WHEN o_orderkey % 3 = 0 THEN '2000-01-01 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:00') END AS a, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
_q("q127_time_zones", "events", lambda d: d.select("event_id", F.date_format(numbers.convert_timezone("ts", "UTC", "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("tokyo")), "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tokyo FROM events")

# ---- rows and folds

_q(
    "q130_truth_and_defaults", "events",
    lambda d: (lambda e: rows.ufunc(e, lambda c: c * 2, ["n"]).select("event_id", rows.get(e, "s", "none").alias("s"), rows.get(e, "n", -1).cast("bigint").alias("n"), rows.get(e, "l", None).isNull().alias("l"), rows.forward(F.col("event_type")).alias("t"), F.typeof("n").alias("kind")))(
        d.select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise("").alias("s"), (F.col("event_id") % 5).alias("n"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("l"))
    ),
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'none' END AS s, CASE WHEN event_id % 5 <> 0 THEN event_id % 5 * 2 ELSE -1 END AS n, event_id % 2 <> 0 AS l, event_type AS t, 'bigint' AS kind FROM events",
)
_q("q131_metric", "lineitem", lambda d: aggregate.metric(d, F.when(F.col("l_discount") > 0.03, F.col("l_quantity")), lambda c: F.round(F.avg(c), 6), "m", ["l_returnflag"]), "SELECT l_returnflag, round(avg(l_quantity), 6) AS m FROM lineitem WHERE l_discount > 0.03::DOUBLE GROUP BY l_returnflag")
_q("q132_total", "lineitem", lambda d: aggregate.total(d), "SELECT count(*) AS n FROM lineitem")
_q(
    "q133_weighted_losses", "lineitem",
    lambda d: d.withColumn("guess", F.when(F.col("l_tax") > 0.04, "R").otherwise("N")).groupBy("l_linestatus").agg(F.round(aggregate.weighted_mse("l_tax", "l_discount", "l_quantity"), 8).alias("mse"), F.round(aggregate.weighted_accuracy("guess", "l_returnflag", "l_quantity"), 8).alias("acc")),
    "SELECT l_linestatus, round(sum((l_tax - l_discount) * (l_tax - l_discount) * l_quantity) / sum(l_quantity), 8) AS mse, round(sum(CASE WHEN (CASE WHEN l_tax > 0.04::DOUBLE THEN 'R' ELSE 'N' END) = l_returnflag THEN l_quantity ELSE 0 END) / sum(l_quantity), 8) AS acc FROM lineitem GROUP BY l_linestatus",
)
_q(
    "q134_patches", "supplier",
    lambda d: aggregate.accumulate_2d(d.select((F.col("s_suppkey") % 3).cast("int").alias("x"), (F.col("s_suppkey") % 2).cast("int").alias("y"), F.array(F.array("s_acctbal", F.lit(1.0)), F.array(F.lit(2.0), "s_acctbal")).alias("v")), "x", "y", "v", prior=0.5).select("x", "y", F.round("value", 4).alias("value"), "weight"),
    """WITH c AS (SELECT s_suppkey % 3 + dx AS x, s_suppkey % 2 + dy AS y, CASE WHEN dx = dy THEN s_acctbal WHEN dx = 1 THEN 1.0 ELSE 2.0 END AS v FROM supplier, range(2) a(dx), range(2) b(dy))
    SELECT x, y, round(sum(v) / (0.5::DOUBLE + count(*)), 4) AS value, count(*)::DOUBLE AS weight FROM c GROUP BY x, y""",
)
_q("q135_running_number", "events", lambda d: sequence.count_rows(d.select("event_id", "user_id"), ["-event_id"], "n", ["user_id"]), "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events")
_q("q136_positions_by_two_keys", "orders", lambda d: sequence.count_rows(d.select("o_orderkey", "o_orderstatus"), ["o_orderstatus", "-o_orderkey"], "n"), "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus, o_orderkey DESC) AS n FROM orders")
_q("q137_unique_by_two_keys", "orders", lambda d: sequence.count_rows(aggregate.unique(d, "o_custkey", ["o_orderstatus", "-o_totalprice"]), ["o_custkey"], "n"), "SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS n FROM (SELECT DISTINCT o_custkey FROM orders)")


@query("q138_zip_strict", "SELECT p AS _pos, n_name, n_regionkey FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS p FROM nation) a JOIN (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey DESC) AS p FROM nation) b USING (p)")
def zip_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return sequence.zip_rows(n.select("n_name"), n.select("n_regionkey", "n_nationkey"), ["n_name"], ["-n_nationkey"], "strict").drop("n_nationkey")


@query("q139_merge_sort", "SELECT v, _src FROM (SELECT c_acctbal AS v, 0 AS _src FROM customer UNION ALL SELECT s_acctbal, 1 FROM supplier)")
def merge_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.merge_sort(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v")), table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v")), order_by=["v"])


_q("q140_flatten", "region", lambda d: sets.flatten(d.select("r_regionkey", F.array(F.array(F.array("r_name", F.lit("a")), F.array(F.lit(None).cast("string"))), F.array(F.array(F.lit("b")))).alias("x")), "x"), "SELECT r_regionkey, unnest([r_name, 'a', NULL, 'b']) AS x FROM region")
_FEW, _OPEN = "SELECT o_custkey FROM orders WHERE o_totalprice > 100000", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"
_q("q141_except_all", "orders", lambda d: d.filter("o_totalprice > 100000").select("o_custkey").exceptAll(d.filter("o_orderstatus = 'F'").select("o_custkey")), f"{_FEW} EXCEPT ALL {_OPEN}")
_q("q142_intersect_all", "orders", lambda d: d.filter("o_totalprice > 100000").select("o_custkey").intersectAll(d.filter("o_orderstatus = 'F'").select("o_custkey")), f"{_FEW} INTERSECT ALL {_OPEN}")
_q(
    "q143_partial_sort_all_rows", "supplier", lambda d: sets.partial_sort(d.select("s_suppkey", "s_acctbal"), 1, "s_acctbal", ["s_suppkey"]).select("s_suppkey", "_rank"),
    # with a buffer of one row each row goes out when the next comes: the order is that of the input
    "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS _rank FROM supplier",
)
_q("q144_set_union_intersect_arrays", "nation", lambda d: d.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_nationkey")).alias("a")).select("n_regionkey", F.array_join(F.array_sort(F.array_union("a", F.array(F.lit(1), F.lit(999)))), ",").alias("u"), F.array_join(F.array_except("a", F.array(F.lit(1), F.lit(2))), ",").alias("e")), "WITH g AS (SELECT n_regionkey, list_sort(list(n_nationkey)) AS a FROM nation GROUP BY 1) SELECT n_regionkey, array_to_string(list_sort(list_distinct(list_concat(a, [1, 999]))), ',') AS u, array_to_string(list_filter(a, lambda x: x NOT IN (1, 2)), ',') AS e FROM g")

# ---- chains


def _chain() -> Pipeline:
    return pipeline("only dear orders", lambda d: d.filter("o_totalprice > 50000"), None) >> (lambda d: d.withColumn("price", F.col("o_totalprice") * 2)) >> pipeline(lambda d: d.select("o_orderkey", "price"))


_q("q150_chain_of_stages", "orders", lambda d: _chain()(d), "SELECT o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_totalprice > 50000")
_q(
    "q151_runs_of_a_grid", "orders", lambda d: sweep_runs(d, {"least": [100000, 200000], "status": ["F", "O"]}, lambda e, least, status: e.filter((F.col("o_totalprice") > least) & (F.col("o_orderstatus") == status)).agg(F.count("*").alias("n"))),
    "SELECT least, status, count(*) FILTER (WHERE o_totalprice > least AND o_orderstatus = status) AS n FROM orders, (VALUES (100000), (200000)) a(least), (VALUES ('F'), ('O')) b(status) GROUP BY ALL",
)
_q("q152_ensemble", "lineitem", lambda d: d.select("l_orderkey", "l_linenumber", F.round(ensemble(F.col("l_discount"), F.when(F.col("l_tax") > 0.02, F.col("l_tax"))), 6).alias("vote")), "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0.02::DOUBLE THEN (l_discount + l_tax) / 2 ELSE l_discount END, 6) AS vote FROM lineitem")

# ---- text models

_q(
    "q160_unknown_words", "part",
    lambda d: textmodel.idf_of(d.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")), textmodel.words_model(d.filter("p_size < 10").select("p_partkey", F.split("p_name", " ").alias("w")), "p_partkey", "w").filter("word <> 'red'"), 50).withColumn("idf", F.round("idf", 6)).select("p_partkey", "word", "idf"),
    """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), s AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_size < 10),
    m AS (SELECT word, ln((SELECT count(*) FROM part WHERE p_size < 10) / count(*)) AS idf FROM s WHERE word <> 'red' GROUP BY word HAVING count(*) > 1) SELECT p_partkey, w.word, round(coalesce(idf, ln(50)), 6) AS idf FROM w LEFT JOIN m USING (word)""",
)


@query(
    "q161_same_text",
    r"""WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM benchmark), t AS (SELECT item_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
        m AS (SELECT word, ln((SELECT count(*) FROM benchmark) / count(*)) AS idf FROM t GROUP BY word HAVING count(*) > 1), v AS (SELECT item_id, word, tf * idf AS w FROM t JOIN m USING (word)),
        n AS (SELECT item_id, sqrt(sum(w * w)) AS n, count(*) AS k FROM v GROUP BY item_id),
        p AS (SELECT a.item_id AS a, b.item_id AS b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.word = b.word AND a.item_id < b.item_id GROUP BY ALL)
        SELECT a, b, round(greatest(0.0, least(1.0, dot / (x.n * y.n) / 0.5)) * least(2 * x.k, y.k, 15) / 15.0, 5)::DOUBLE AS same FROM p JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE dot > 0""",
)
def same_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id", text.words_of(F.lower("text")).alias("words"))
    v = textmodel.tfidf(d, "item_id", "words", textmodel.words_model(d, "item_id", "words"))
    return textmodel.same_text(v.toDF("a", "word", "w"), v.toDF("b", "word", "w"), "a", "b").filter("a < b and cosine > 0").select("a", "b", F.round("same", 5).alias("same"))


_q("q162_frequent_ngrams", "part", lambda d: textmodel.ngram_model(d, "p_name", 3, 5), "SELECT g AS ngram, count(*) AS n FROM (SELECT p_name[i : i + 2] AS g FROM part, range(1, 100) t(i) WHERE i <= length(p_name) - 2) GROUP BY g HAVING count(*) >= 5")
_q(
    "q163_multi_hot", "part", lambda d: d.withColumn("v", textmodel.one_hot_multi(F.split("p_name", " "), ["red", "blue", "ring", "bolt"])).select("p_partkey", F.array_join(textmodel.decode_multi("v", ["R", "B", "g", "t"]), "").alias("s"), F.array_join(textmodel.one_hot(F.element_at(F.split("p_name", " "), 1), ["red", "blue"], "zeros"), ",").alias("z")),
    """SELECT p_partkey, concat(CASE WHEN 'red' IN w THEN 'R' ELSE '' END, CASE WHEN 'blue' IN w THEN 'B' ELSE '' END, CASE WHEN 'ring' IN w THEN 'g' ELSE '' END, CASE WHEN 'bolt' IN w THEN 't' ELSE '' END) AS s,
    CASE w[1] WHEN 'red' THEN '1.0,0.0' WHEN 'blue' THEN '0.0,1.0' ELSE '0.0,0.0' END AS z FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
)
_q("q164_levenshtein_score", "part", lambda d: d.select("p_partkey", F.round(distance.leven_score("p_name", "p_type", 1.0, 1.0), 6).alias("s")), "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS s FROM part")

_q("q165_alignment_costs", "part", lambda d: rows.spread(d.select("p_partkey", "p_type", "p_name"), "p_partkey").select("p_partkey", distance.align(F.lower("p_type"), "p_name")["dist"].alias("pair"), distance.align_substring(F.lower("p_type"), "p_name")["dist"].alias("inside")), """
    WITH d AS (SELECT p_partkey, p_name, lower(p_type) AS t FROM part), s AS (SELECT p_partkey, min(levenshtein(t, substr(p_name, i, n))) AS inside FROM d, range(1, 40) a(i), range(0, 40) b(n) WHERE i + n <= length(p_name) + 1 GROUP BY p_partkey)
    SELECT p_partkey, levenshtein(t, p_name)::DOUBLE AS pair, inside::DOUBLE AS inside FROM d JOIN s USING (p_partkey)""")

# ---- sources: written and read back


def _scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{base}/scratch-{uuid.uuid4().hex}"


@query("q170_csv_written_and_read", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    io.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, sep=";")
    return spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").csv(path, sep=";")


@query("q171_json_pile_appended", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def json_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, d = _scratch(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    io.pile(spark, path, d)
    return io.pile(spark, path, d, append=True)


@query("q172_json_objects", "SELECT r_regionkey, r_name FROM region")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    io.save_text(table(spark, sf_dir, "region").select(F.concat(F.to_json(F.struct("r_regionkey", "r_name")), F.lit("\n")).alias("line")), "line", path)
    return io.json_objects(spark, path, "r_regionkey int, r_name string")


@query("q173_pages_of_files", "SELECT n_regionkey AS _page, n_name AS value FROM nation WHERE n_regionkey BETWEEN 1 AND 3")
def paged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, d = _scratch(spark), table(spark, sf_dir, "nation")
    for i in range(5):
        io.save_text(d.filter(F.col("n_regionkey") == i), "n_name", f"{path}/page-{i}")
    pages = [io.lines(spark, f"{path}/page-{i}").withColumn("_page", F.lit(i)) for i in range(1, 4)]
    return sets.chain(*pages).select("_page", "value")


@query("q174_notation_written_and_read", "SELECT p_partkey, p_name, p_size FROM part")
def notation_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", notation.notation_encode(F.to_json(F.struct("p_partkey", "p_name", "p_size"))).alias("t"))
    back = F.from_json(F.to_json(notation.notation_decode("t")), "p_partkey bigint, p_name string, p_size int")
    return d.select(back.alias("r")).select("r.*")


@query("q175_made_rows", "SELECT 'number' AS src, i AS v FROM range(3, 30, 4) t(i) UNION ALL SELECT 'const', 7 FROM range(5) UNION ALL SELECT 'repeat', r_regionkey FROM region, range(3) UNION ALL SELECT 'made', i * i FROM range(6) t(i), range(2) u(j) WHERE i % 2 = 0 UNION ALL SELECT 'given', i FROM range(1, 4) t(i)")
def made_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda d, s, c="value": d.select(F.lit(s).alias("src"), F.col(c).cast("bigint").alias("v"))
    out = one(io.numbers(spark, 3, 30, 4), "number").unionByName(one(io.const(spark, 7, 5), "const")).unionByName(one(io.repeat(table(spark, sf_dir, "region"), 3), "repeat", "r_regionkey"))
    made = io.generate(spark, 6, lambda i: [(i * i,)] * 2 if i % 2 == 0 else None, "value bigint")
    return out.unionByName(one(made, "made")).unionByName(one(io.collection(spark, [1, 2, 3]), "given")).unionByName(one(io.empty(spark, "value bigint"), "none"))


@query("q176_files_listed", "SELECT count(DISTINCT n_regionkey) AS n, true AS sized, sum(length(n_name) + 1) AS bytes FROM nation")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, d = _scratch(spark), table(spark, sf_dir, "nation")
    for i in range(5):
        io.save_text(d.filter(F.col("n_regionkey") == i).coalesce(1), "n_name", f"{path}/{i}")
    return io.files(spark, path, "part-*.txt").filter("size > 0").agg(F.count("*").alias("n"), F.min(F.col("modified").isNotNull()).alias("sized"), F.sum("size").alias("bytes"))


@query("q177_database", "SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS n, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = 7) AS top")
def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(name)
    db = io.DB(spark)
    n = db.count(name, "o_totalprice > 100000")
    top = db.select_one(f"SELECT max(o_orderkey) AS m FROM {name} WHERE o_custkey = :c", {"c": 7})["m"]
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(top).cast("bigint").alias("top"))


_q(
    "q178_type_tests", "events",
    lambda d: d.withColumn("v", F.parse_json(F.element_at(F.array(F.lit("3"), F.lit('"s"'), F.lit("[1]"), F.lit('{"a": 1}'), F.lit("2.5")), (F.col("event_id") % 5 + 1).cast("int")))).select(
        "event_id", *(f("v", True).alias(n) for n, f in (("i", kinds.is_int), ("n", kinds.is_number), ("s", kinds.is_string), ("l", kinds.is_list), ("d", kinds.is_dict), ("c", kinds.is_container), ("it", kinds.is_iterable))), kinds.is_int("user_id").alias("typed"), kinds.is_number("event_type").alias("not_typed"),
    ),
    "SELECT event_id, k = 0 AS i, k IN (0, 4) AS n, k = 1 AS s, k = 2 AS l, k = 3 AS d, k IN (2, 3) AS c, k IN (1, 2, 3) AS it, true AS typed, false AS not_typed FROM (SELECT event_id, event_id % 5 AS k FROM events)",
)
_q("q179_clocks", "region", lambda d: d.select("r_regionkey", (kinds.today_string() == F.date_format(kinds.now(), "yyyy-MM-dd")).alias("day"), (kinds.now_string() == F.date_format(kinds.now(), "yyyy-MM-dd HH:mm:ss")).alias("second"), (kinds.today() == F.to_date(kinds.now())).alias("date_"), (F.abs(numbers.seconds_between(kinds.utc_now(), F.to_utc_timestamp(kinds.now(), F.current_timezone()))) < 1).alias("utc")), "SELECT r_regionkey, true AS day, true AS second, true AS date_, true AS utc FROM region")


@query("q185_watched", "SELECT count(*) AS n, true AS counted, true AS timed FROM orders WHERE o_totalprice > 1000")
def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = monitor.Report(f"r{uuid.uuid4().hex}")
    n = r.watch(table(spark, sf_dir, "orders").filter("o_totalprice > 1000")).agg(F.count("*").alias("n")).first()["n"]
    seen = r.report()
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(seen["rows"] == n).alias("counted"), F.lit(seen["seconds"] >= 0).alias("timed"))


_q("q186_table_cells", "part", lambda d: rows.spread(d.select("p_partkey", "p_name", "p_type"), "p_partkey").withColumn("h", F.concat(F.lit("<table><tr><th>Name of it</th><td> <b>"), "p_name", F.lit("</b> </td></tr><tr><td>Type</td><td>"), "p_type", F.lit("</td></tr></table>"))).select("p_partkey", markup.text_after("h", "Name").alias("name"), markup.text_after("h", "Type", True).alias("type"), markup.text_after("h", "Typ", True).alias("none"), markup.re_text("h", r"it (\w+)").alias("first"), markup.re_html("h", "<b>[a-z]+").alias("source"), markup.re_text("h", r"^(\w+)", "td").alias("cell")), "SELECT p_partkey, p_name AS name, p_type AS type, NULL::VARCHAR AS none, regexp_extract(p_name, '^\\w+') AS first, '<b>' || regexp_extract(p_name, '^[a-z]+') AS source, regexp_extract(p_name, '^\\w+') AS cell FROM part")
_q("q187_pattern_to_struct", "part", lambda d: rows.spread(d.select("p_partkey", "p_name", "p_size"), "p_partkey").withColumn("h", F.concat(F.lit("<p>"), "p_name", F.lit("</p><i>"), F.col("p_size").cast("string"), F.lit("</i>"))).select("p_partkey", markup.pattern_extract("h", "<p>{NAME ..}</p><i>{SIZE ..}</i>", lower=True, model={"name": "string", "size": "int"}).alias("m")).select("p_partkey", "m.name", "m.size"), "SELECT p_partkey, p_name AS name, p_size AS size FROM part")

# ---- streams


def _stream(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    """All that a stream of `events` has now, through a streaming query that ends."""
    events = table(spark, sf_dir, "events")
    made = of(windows.read_stream(spark, f"{sf_dir}/event*.parquet", events.schema))
    return windows.run_available(made[0], f"s{uuid.uuid4().hex}", _scratch(spark), made[1])


@query("q180_stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda d: (windows.tumbling(d, "ts", "1 day", [F.count("*").alias("n")], ["event_type"], "1 hour"), "complete")).select("start", "event_type", "n")


@query("q181_stream_running_mean", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS dev, count(value) AS n FROM events GROUP BY event_type")
def stream_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda d: (windows.running_mean(d, "value", ["event_type"]), "complete")).select("event_type", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"), "n")


@query("q182_stream_deduplicated", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda d: (windows.deduplicated(d, ["user_id", "event_type"], "ts", "400 days"), "append")).agg(F.count("*").alias("n"))


@query("q183_stream_count_batches", "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS k FROM events) SELECT user_id, CAST(p // 8 AS BIGINT) AS _batch, string_agg(event_id, ',' ORDER BY p) AS ids FROM n WHERE p < k - k % 8 GROUP BY user_id, p // 8")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda d: (windows.count_batches(d, "user_id", "event_id", "event_id", 8), "append")).select("user_id", "_batch", F.array_join("items", ",").alias("ids"))


@query("q184_stream_join", "SELECT v.event_id AS a, p.event_id AS b FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(d: DataFrame):
        v = d.filter("event_type = 'view'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").alias("ta"))
        p = d.filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb"))
        return windows.stream_join(v, p, F.expr("ua = ub and tb >= ta and tb <= ta + interval 1 hour"), "ta", "tb", "1 day").select("a", "b"), "append"

    return _stream(spark, sf_dir, both)


# ---- joins and frames of statements

# Spark's own plans of these would make all pairs, or take the table through one task


@query("q190_sql_range_join", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 500 AND s_acctbal + 500 GROUP BY s_suppkey")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_acctbal") - 500).alias("low"), (F.col("s_acctbal") + 500).alias("high"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal")
    return aggregate.count_within(c, s, "c_acctbal", "low", "high", "k").groupBy("s_suppkey").agg(F.sum("n").alias("n"))


@query("q191_sql_full_outer", "SELECT n_name, count(DISTINCT c_custkey) AS c, count(DISTINCT s_suppkey) AS s FROM nation FULL JOIN customer ON n_nationkey = c_nationkey FULL JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a nation's customers and its suppliers are counted apart: a name's distinct keys are the same with and without the other table's rows
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    of = lambda name, key, by: nation.join(table(spark, sf_dir, name), F.col("n_nationkey") == F.col(by), "full").groupBy("n_name").agg(F.countDistinct(key).alias("n"))
    c, s = of("customer", "c_custkey", "c_nationkey").select("n_name", F.col("n").alias("c"), F.lit(0).cast("bigint").alias("s")), of("supplier", "s_suppkey", "s_nationkey").select("n_name", F.lit(0).cast("bigint").alias("c"), F.col("n").alias("s"))
    return c.unionAll(s).groupBy("n_name").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


@query("q192_sql_frames", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 300 AS high, ntile(4) OVER (ORDER BY event_id) AS q, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS d FROM events")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.ntile(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), 4, ["event_id"], "q")
    return d.selectExpr("event_id", "sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 300 AS high", "q", "dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS d")
