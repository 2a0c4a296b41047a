from pyspark.sql import functions as F

from lodestone.functions import randoms as R
from lodestone.functions import text


def test_distributions(spark):
    d = spark.range(4000)
    c = R.Choice([R.Interval(0.0, 1.0), R.Fixed(5.0)], [3, 1])
    got = d.select(c.column(["id"], 1).alias("x"), R.Range(3, 9, 2).column(["id"], 2).alias("r"), R.switch(0.2, 1, 0).column(["id"], 3).alias("s"), R.Intervals([(0.0, 1.0), (5.0, 8.0)]).column(["id"], 4).alias("v")).toPandas()
    assert 0.2 < (got.x == 5.0).mean() < 0.3 and ((got.x == 5.0) | (got.x < 1)).all()
    assert set(got.r) == {3, 5, 7} and 0.16 < got.s.mean() < 0.24 and 0.7 < (got.v >= 5).mean() < 0.8
    again = d.repartition(5).select("id", c.column(["id"], 1).alias("x")).orderBy("id").toPandas()
    assert again.x.tolist() == got.x.tolist()
    assert d.select(R.record({"a": R.Fixed(1), "b": R.Range(0, 2)}, ["id"]).alias("r")).select("r.*").columns == ["a", "b"]


def test_extract_text(spark):
    j = '{"a": ["x", {"b": "żó", "skip": "no"}], "c": 3, "d": null}'
    assert spark.range(1).select(text.extract_text(F.lit(j), ["skip"]).alias("t")).first()["t"] == "x\tzo\n3"
