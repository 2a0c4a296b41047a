"""Operators that queries don't reach, and the cases that they must get right."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import order
from lodestone.functions import distance, markup, text, textmodel
from lodestone.operators import aggregate, monitor, rows, sequence, sets
from lodestone.plans import catalogue, families  # noqa: F401 - families registers its queries
from lodestone.plans.pipeline import Space
from lodestone.sources import io


def test_unique_follows_all_keys(spark):
    d = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 0, "c"), (3, 9, "a"), (None, 5, "d")], "p int, q int, v string")
    assert [r["v"] for r in aggregate.unique(d, "v", ["p", "q"]).collect()] == ["d", "b", "a", "c"]
    assert [r["v"] for r in aggregate.unique(d, "v", ["-p", "q"]).collect()] == ["a", "c", "b", "d"]
    assert [r["v"] for r in aggregate.unique(d, "v", ["-p"]).collect()] == ["a", "c", "b", "d"]


def test_partial_sort_without_groups(spark):
    d = spark.createDataFrame(list(enumerate([5, 9, 4, 8, 1, 6])), "i int, v int")
    got = [r["v"] for r in sets.partial_sort(d, 2, "v", ["i"]).orderBy("_rank").collect()]
    assert got == [5, 4, 8, 1, 6, 9]


@pytest.mark.parametrize("keys", [["a"], ["a", "-b"], ["-t", "a"], ["b", "a", "t"]])
def test_positions_are_dense_whatever_the_keys(spark, keys):
    r = np.random.default_rng(0)
    rows = [(int(r.integers(0, 3)) if r.random() < 0.9 else None, float(r.random()), str(r.integers(0, 40))) for _ in range(500)]
    d = spark.createDataFrame(rows, "a int, b double, t string")
    got = order.with_pos(d, keys, ranges=7).orderBy("_pos").collect()
    assert [x["_pos"] for x in got] == list(range(1, 501))
    want = d.orderBy(*order.keys(keys)).collect()
    names = [k.lstrip("-") for k in keys]
    assert [tuple(x[n] for n in names) for x in got] == [tuple(x[n] for n in names) for x in want]


def test_a_column_named_like_the_position_stays(spark):
    d = spark.createDataFrame([(i, f"own {i}") for i in range(20)], "i int, _pos string")
    got = sequence.subset(d, 5, ["i"]).orderBy("i").collect()
    assert [(r["i"], r["_pos"]) for r in got] == [(4, "own 4"), (9, "own 9"), (14, "own 14"), (19, "own 19")]
    assert sequence.take_while(d, F.col("i") < 3, ["i"]).columns == ["i", "_pos"]
    assert [r["items"] for r in sequence.as_list(d, "i", ["-i"]).collect()] == [list(range(19, -1, -1))]


def test_draws_are_in_proportion(spark):
    d = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "i int, w double")
    got = sets.draw(d, 6000, ["i"], "w", 4)
    n = {r["w"]: r["n"] for r in got.groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {1.0, 2.0, 3.0} and sum(n.values()) == 6000 and abs(n[3.0] - 3000) < 250 and abs(n[1.0] - 1000) < 200
    assert got.select("_draw").distinct().count() == 6000


def test_arguments_of_statements(spark):
    assert io.with_args("a = :x and b = ':x' and c = :y::int", {"x": "it's", "y": 3}) == "a = 'it''s' and b = ':x' and c = 3::int"
    assert io.with_args("a = ? and b = '?' and c = ?", [None, True]) == "a = NULL and b = '?' and c = TRUE"
    db = io.DB(spark)
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string").createOrReplaceTempView("args_view")
    assert [r["v"] for r in db.select("SELECT v FROM args_view WHERE k = :k", {"k": 2}).collect()] == ["y"] and db.table_exists("args_view")
    db.execute_script("CREATE OR REPLACE TEMP VIEW two AS SELECT ';' AS s; CREATE OR REPLACE TEMP VIEW three AS SELECT 3 AS t;")
    assert db.select_one("SELECT s, t FROM two, three") == (";", 3)


def test_json_dictionary(spark, tmp_path):
    d = io.JsonDict(spark, f"file://{tmp_path}/kept.json")
    d["a"] = [1, {"é": None}]
    again = io.JsonDict(spark, f"file://{tmp_path}/kept.json")
    assert "a" in again and again["a"] == [1, {"é": None}] and "b" not in again


def test_spaces():
    s = Space(1, 2, 4, 8)
    assert (s.cast(3), s.cast(5), s.cast(8), s.move(4), s.move(8), s.move(1, -1)) == (2, 4, 8, 8, 8, 1)
    assert s.random(3) in s.values and s.random(3) == s.random(3)


def test_fuzzy_strings():
    a, b = distance.Fuzzy.of("ab", "ab_"), distance.Fuzzy.of("b", "ab_")
    assert a.append(b).discretize() == "abb" and a.convert("_ba").discretize() == "ab"
    assert a.mismatch(b).tolist() == [[1.0], [0.0]]
    mixed = distance.Fuzzy.merge([distance.Fuzzy.of("a", "ab_"), distance.Fuzzy.of("b", "ab_")])
    assert mixed.mismatch(b).tolist() == [[0.5]]


def test_xpath_strings():
    assert markup.xpath_escape("a") == "'a'" and markup.xpath_escape("it's") == '"it\'s"'
    assert markup.xpath_escape("'\"") == "concat('',\"'\",'\"')"


def test_watched_rows(spark):
    d, said = spark.range(10), []
    assert monitor.print_rows(d, 2, ["-id"], said.append) is d and said == ["id=9", "id=8"]
    monitor.print_subset(d, 4, ["id"], out=said.append)
    assert said[2:] == ["id=3", "id=7"]
    r = monitor.Report("ten")
    assert r.watch(d).count() == 10 and r.report()["rows"] == 10


def test_buffered_rows_are_computed_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/kept")
    d = monitor.buffered(spark.range(5).withColumn("u", F.rand()))
    assert d.collect() == d.collect()


def test_flatten(spark):
    d = spark.createDataFrame([(1, [[[1, 2], None], [[3]]]), (2, None), (3, [])], "k int, x array<array<array<int>>>")
    assert [r["x"] for r in sets.flatten(d, "x").collect()] == [1, 2, 3]
    assert sets.flatten(d, "x", deep=False).count() == 2


def test_statements_over_jdbc(spark, tmp_path):
    db = io.DB(spark, f"jdbc:derby:memory:{tmp_path.name};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    db.execute_script("CREATE TABLE kept (k INT, v VARCHAR(20)); INSERT INTO kept VALUES (1, 'a;b'), (2, 'c')")
    db.execute("INSERT INTO kept VALUES (?, ?)", [3, "it's"])
    assert db.table_exists("kept") and not db.table_exists("other")
    assert [r["V"] for r in db.select("SELECT v FROM kept WHERE k >= :k AND v <> :v", {"k": 1, "v": "c"}).orderBy("V").collect()] == ["a;b", "it's"]
    assert db.count("kept", "k > 1") == 2
    db.insert("kept", spark.createDataFrame([(4, "d")], "k int, v string"))
    assert db.count("kept") == 4


def test_tiles_and_offset_leave_no_task_the_whole_table(spark, tmp_path):
    d = spark.range(4000).select(((F.col("id") * 7919) % 4001).alias("k"), F.col("id").alias("v"))
    cols = [sequence.ntile(d.filter(F.col("v") < n), 4, ["k"], "q").groupBy("q").agg(F.count("*").alias("n"), F.min("k").alias("k")).orderBy("k").collect() for n in (4000, 11, 3)]
    assert [[r["n"] for r in c] for c in cols] == [[1000] * 4, [3, 3, 3, 2], [1] * 3] and [[r["q"] for r in c] for c in cols] == [[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3]]
    after = sequence.offset(d, 5, ["k"])
    assert [r["k"] for r in after.collect()] == sorted(r["k"] for r in d.collect())[5:] and sequence.offset(d, 4000, ["k"]).count() == 0
    assert "Offset" not in after._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(p) for p in sequence.ntile(d, 4, ["k"]).rdd.glom().collect()) < 2000


def test_counts_within_ranges_make_no_pairs(spark):
    r = np.random.default_rng(0)
    p = [(int(r.integers(0, 4)) if r.random() < 0.9 else None, float(r.integers(-20, 20)) if r.random() < 0.9 else None) for _ in range(300)] + [(1, float("nan"))]
    q = [(i, int(r.integers(0, 5)), float(v := r.integers(-22, 20)), float(v + 3)) for i in range(60)] + [(60, 1, -0.0, 0.0), (61, 1, 0.0, -0.0), (62, 1, 5.0, 4.0), (63, None, 0.0, 9.0), (64, 1, None, 9.0), (60, 1, -0.0, 0.0)]
    points, ranges = spark.createDataFrame(p, "g int, x double"), spark.createDataFrame(q, "id int, g int, low double, high double")
    got = aggregate.count_within(points, ranges, "x", "low", "high", "g")
    assert got.columns == ["id", "g", "low", "high", "n"] and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = sorted((i, n) for i, g, lo, hi in q if g is not None and lo is not None and (n := sum(a == g and x is not None and lo <= x <= hi for a, x in p)))
    assert sorted((x["id"], x["n"]) for x in got.collect()) == want


def test_full_join_counts_nations_without_customers_or_suppliers(spark, tmp_path):
    made = {"nation": ([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "a")], "n_nationkey int, n_name string"), "customer": ([(10, 1), (11, 1), (12, 9), (13, None), (14, 4), (15, 5)], "c_custkey bigint, c_nationkey int"), "supplier": ([(20, 1), (21, 2), (22, 8), (23, 4), (23, 1)], "s_suppkey bigint, s_nationkey int")}
    for name, (data, kinds) in made.items():
        spark.createDataFrame(data, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    q = "q191_sql_full_outer"
    got = catalogue.QUERIES[q](spark, str(tmp_path))
    sql = catalogue.ORACLE_SQL[q]
    for name in made:
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(f"odd_{name}")
        sql = sql.replace(f"{name} ", f"odd_{name} ")
    key = lambda r: str(tuple(r))
    assert sorted(got.select("n_name", "c", "s").collect(), key=key) == sorted(spark.sql(sql).collect(), key=key)


SPREAD = ["q186_table_cells", "q187_pattern_to_struct", "q82_weighted_levenshtein", "q83_align_substring", "q165_alignment_costs"]


def test_rows_of_one_file_are_spread(spark, tmp_path):
    spark.range(1000).withColumn("t", F.lit("x")).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    d = rows.spread(spark.read.parquet(f"file://{tmp_path}/one"), "id")
    sizes = [len(part) for part in d.rdd.glom().collect()]
    assert len(sizes) == 4 and sum(sizes) == 1000 and min(sizes) > 150
    for name in SPREAD:
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_equal_values_are_computed_once():
    seen = []
    got = text.per_value(lambda a, b: seen.append((a, b)) or a + b, pd.Series(["a", "b", "a", None, "a"]), pd.Series(["x", "y", "x", "y", None]))
    assert got == ["ax", "by", "ax", None, None] and sorted(seen) == [("a", "x"), ("b", "y")]


def test_top_k_keeps_k_candidates_whatever_the_blocks(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((90, 5))
    v[30:60] = v[:30] * 2  # ties, settled by id
    v[60] = v[0]
    unit, ids = v / np.sqrt((v * v).sum(axis=1, keepdims=True)), np.arange(90)[::-1].copy()
    c = np.einsum("ij,kj->ik", unit, unit).round(12)
    want = {(int(ids[q]), int(i), n + 1) for q in range(90) for n, i in enumerate(sorted((ids[j] for j in range(90) if j != q), key=lambda i, q=q: (-c[q, 89 - i], i))[:4])}
    search = textmodel._Search(ids[:20], unit[:20], 4)
    for at in range(0, 90, 7):
        search.add(ids[at : at + 7], unit[at : at + 7])
        assert len(search.found[0]) <= 4 * 20
    d = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id bigint, v array<double>")
    for block in (3, 20, 1024):
        got = {(x["q"], x["id"], x["r"]) for x in textmodel.cosine_top_k(d, d, "id", "v", 4, block).collect()}
        assert {g[:2] for g in got} == {w[:2] for w in want} and len(got) == 360


def test_cosines_over_a_threshold(spark, monkeypatch):
    r = np.random.default_rng(2)
    texts = [[f"w{x}" for x in r.integers(0, 12, r.integers(0, 9))] for _ in range(60)]
    left = spark.createDataFrame([(f"a{i}", [*x, ""]) for i, x in enumerate(texts[:9])] + [("none", None), ("far", ["u"])], "a string, words array<string>")
    right = spark.createDataFrame([*((i, [*x, "all"]) for i, x in enumerate(texts)), (70, ["own"]), (71, None), (72, [""])], "b int, words array<string>")
    plain = lambda d: d.withColumn("words", F.filter("words", lambda w: w != ""))
    model = textmodel.words_model(plain(right), "b", "words")
    v = [textmodel.tfidf(plain(d), i, "words", model) for d, i in ((left, "a"), (right, "b"))]
    near = lambda d: {(x["a"], x["b"], round(x["cosine"], 9)) for x in d.collect()}
    want = near(textmodel.cosine_pairs(*v, "a", "b").filter("cosine > 0.3"))
    found = lambda d=left, e=right: textmodel.tfidf_cosine_above(d, e, "a", "b", "words", 0.3)
    assert found().columns == ["a", "b", "cosine"] and near(found()) == want and len(want) > 20
    monkeypatch.setattr(textmodel, "MATRIX_CELLS", 5)
    assert near(found()) == want
    monkeypatch.undo()
    assert found(left.limit(0)).count() == found(left, right.limit(0)).count() == 0


def test_ngrams_are_found_where_they_are(spark, monkeypatch):
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ab\u017c\U0001f600"), r.integers(0, 40))) for _ in range(80)] + ["", None, "ab"]
    ngrams = sorted({t[i : i + 3] for t in texts[:12] for i in range(len(t) - 2)}) + ["abcd", "x"]
    want = {}
    for i, t in enumerate(texts):
        at = [j for j in range(len(t or "") - 2) if t[j : j + 3] in ngrams]
        want[i] = (len({x for j in at for x in range(j, j + 3)}) / len(t) if t else 0.0, len({t[j : j + 3] for j in at}))
    monkeypatch.setattr(textmodel, "SEARCHED", 50)
    found = textmodel.NgramSet(ngrams, 3).find([t or "" for t in texts])
    assert [(a, b) for a, b, _ in zip(*(x.tolist() for x in found))] == [(i, j) for i, t in enumerate(texts) for j in range(len(t or "") - 2) if t[j : j + 3] in ngrams]
    d, model = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(g,) for g in ngrams], "ngram string")
    for limit in (textmodel.MODEL_NGRAMS, 0):
        monkeypatch.setattr(textmodel, "MODEL_NGRAMS", limit)
        assert {x["i"]: (x["covered"], x["matched"]) for x in textmodel.ngram_score(d, "i", "t", model.filter("length(ngram) = 3"), 3).collect()} == want
    monkeypatch.undo()
    assert {x["i"]: (x["covered"], x["matched"]) for x in textmodel.ngram_score(d, "i", "t", model, 3).collect()} == want
    assert textmodel.ngram_score(d, "i", "t", model.limit(0), 3).agg(F.sum("matched")).collect()[0][0] == 0
