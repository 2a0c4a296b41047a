"""Order-sensitive operators on small streams."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import aggregate, rows, sequence, sets
from lodestone.order import with_pos


def stream(spark, values, kind="bigint"):
    return spark.createDataFrame(list(enumerate(values)), f"i bigint, v {kind}")


def values(df, *order):
    return [r["v"] for r in df.orderBy(*(order or ["i"])).collect()]


def test_positions_are_dense_over_ranges(spark):
    d = spark.createDataFrame([(x,) for x in [5, 3, None, 3, 9, -2, 7, 7]], "k bigint")
    got = with_pos(d, ["k"], ranges=3).orderBy("_pos").collect()
    assert [r["_pos"] for r in got] == list(range(1, 9))
    assert [r["k"] for r in got] == [None, -2, 3, 3, 5, 7, 7, 9]
    down = with_pos(d, ["-k"], ranges=3).orderBy("_pos").collect()
    assert [r["k"] for r in down] == [9, 7, 7, 5, 3, 3, -2, None]
    text = spark.createDataFrame([(c,) for c in "qwertyuiop"], "k string")
    assert "".join(r["k"] for r in with_pos(text, ["k"], ranges=4).orderBy("_pos").collect()) == "eiopqrtuwy"


def test_order_is_needed(spark):
    with pytest.raises(ValueError):
        with_pos(spark.range(3), [])


def test_offset_limit_slice_subset(spark):
    d = stream(spark, [1, 2, 3, 4, 5, 6])
    assert values(sequence.offset(sequence.offset(d, 2, ["i"]), 2, ["i"])) == [5, 6]
    assert values(sequence.limit(d, 0, ["i"])) == []
    assert values(sequence.slice_rows(d, 1, 5, 2, ["i"])) == [2, 4]
    assert values(sequence.subset(stream(spark, range(7)), 3, ["i"])) == [2, 5]


def test_while(spark):
    d = stream(spark, [1, 2, 9, None, 1])
    assert values(sequence.take_while(d, F.col("v") < 5, ["i"])) == [1, 2]
    assert values(sequence.drop_while(d, F.col("v") < 5, ["i"])) == [9, None, 1]
    assert values(sequence.stop_on(d, F.col("v").isNull(), ["i"])) == [1, 2, 9]
    assert values(sequence.take_while(stream(spark, []), F.col("v") < 5, ["i"])) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 11), size=st.integers(1, 5))
def test_batch(spark, n, size):
    got = [r["items"] for r in sequence.batch(stream(spark, range(n)), size, "v", ["i"]).orderBy("_batch").collect()]
    assert got == [list(range(i, min(i + size, n))) for i in range(0, n, size)]


def test_batch_none_and_list(spark):
    assert sequence.batch(stream(spark, [4, 5]), None, "v", ["i"]).first()["items"] == [4, 5]
    assert sequence.as_list(stream(spark, [3, 1, 2]), "v", ["i"]).first()["items"] == [3, 1, 2]


def test_zip(spark):
    a, b = stream(spark, [1, 2, 3]), stream(spark, [10, 20]).toDF("j", "w")
    long = sequence.zip_rows(a, b, ["i"], ["j"]).orderBy("_pos").collect()
    assert [(r["v"], r["w"]) for r in long] == [(1, 10), (2, 20), (3, None)]
    assert sequence.zip_rows(a, b, ["i"], ["j"], "short").count() == 2
    with pytest.raises(Exception, match="lengths differ"):
        sequence.zip_rows(a, b, ["i"], ["j"], "strict").collect()


def test_split_where(spark):
    runs = sequence.split_where(stream(spark, [1, 5, 8, 3, 5, 8, 2, 0, 4]), lambda p, c: p > c, "v", ["i"]).orderBy("_run").collect()
    assert [(r["start"], r["stop"]) for r in runs] == [(0, 3), (3, 6), (6, 7), (7, 9)]
    assert sequence.split_where(stream(spark, []), lambda p, c: p > c, "v", ["i"]).count() == 0


def test_partial_sort(spark):
    d = sets.partial_sort(stream(spark, [2, 7, 3, 6, 8, 3]), 2, "v", ["i"])
    assert values(d, "_rank") == [2, 3, 6, 7, 3, 8]


def test_truthy_transform_function(spark):
    d = stream(spark, [0, 1, None, 5])
    assert values(rows.filter_rows(d, "v")) == [1, 5]
    assert values(rows.transform(d, "v", F.col("v") * 2)) == [0, 2, 10]
    assert values(rows.function(d, "v", F.col("v") > 1, True)) == [None, 5]
    pos, neg = rows.partition(d, F.col("v") > 0)
    assert (values(pos), values(neg)) == ([1, 5], [0, None])


def test_min_max_first_wins(spark):
    d = spark.createDataFrame([(1, 5.0, "a"), (2, 9.0, "b"), (3, 5.0, "c"), (4, 9.0, "d"), (5, None, "e")], "p bigint, v double, arg string")
    r = d.agg(*aggregate.min_max("v", "arg", "p")).first()
    assert (r["argmin"], r["argmax"], r["idxmin"], r["idxmax"]) == ("a", "b", 1, 2)


def test_weighted_mean_and_patches(spark):
    d = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (None, 5.0)], "v double, w double")
    assert d.agg(aggregate.weighted_mean("v", "w").alias("m")).first()["m"] == 2.5
    assert d.filter("v > 9").agg(aggregate.weighted_mean("v", "w").alias("m")).first()["m"] is None
    p = spark.createDataFrame([(0, 0, [[1.0, 2.0]]), (1, 0, [[4.0]])], "x int, y int, p array<array<double>>")
    got = {(r["x"], r["y"]): r["value"] for r in aggregate.accumulate_2d(p, "x", "y", "p", prior=0.0).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 3.0}


def test_unique_and_duplicates(spark):
    d = stream(spark, [3, 1, 3, 2, 1])
    assert [r["v"] for r in aggregate.unique(d, "v", ["i"]).collect()] == [3, 1, 2]
    assert {r["v"] for r in aggregate.duplicates(d, "v").collect()} == {3, 1}


def test_mix_stops_at_an_empty_source(spark):
    a, b = stream(spark, range(100)), stream(spark, range(1000, 1003))
    m = sets.mix([a, b], [0.5, 0.5], ["i"], 1).orderBy("_draw").collect()
    assert [r["v"] for r in m if r["_src"] == 1] == [1000, 1001, 1002]
    own = [r["v"] for r in m if r["_src"] == 0]
    assert own == list(range(len(own))) and [r["_draw"] for r in m] == list(range(len(m)))


def test_draw_follows_weights(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "i bigint, w double")
    got = sets.draw(d, 4000, ["i"], "w", 3).groupBy("i").count().collect()
    n = {r["i"]: r["count"] for r in got}
    assert set(n) == {1, 2} and sum(n.values()) == 4000 and 0.7 < n[2] / 4000 < 0.8


def test_sample_is_stable(spark):
    d = stream(spark, range(2000))
    a, b = sets.sample(d, 0.2, ["i"], 1), sets.sample(d.repartition(7), 0.2, ["i"], 1)
    assert values(a) == values(b) and 300 < a.count() < 500
