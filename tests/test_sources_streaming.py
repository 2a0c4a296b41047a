"""Sources, sinks and streams."""

from pyspark.sql import functions as F

from lodestone.functions import notation
from lodestone.sources import io
from lodestone.streaming import windows


def test_sources(spark, tmp_path):
    assert [r["value"] for r in io.collection(spark, [5, 6]).orderBy("_pos").collect()] == [5, 6]
    assert io.const(spark, "sample", 2).count() == 2 and io.empty(spark, "a int").count() == 0
    assert [r["value"] for r in io.numbers(spark, 1, 7, 2).collect()] == [1, 3, 5]
    assert io.repeat(spark.range(2), 3).count() == 6 and io.repeat(spark.range(2), 0).count() == 0
    assert io.generate(spark, 3, lambda i: [(i, str(i))] * i or None, "a bigint, b string").count() == 3
    path = str(tmp_path / "pile")
    assert io.pile(spark, path, spark.range(3)).count() == 3
    assert io.pile(spark, path, spark.range(2), append=True).count() == 5 and io.pile(spark, path).count() == 5


def test_json_objects_and_pages(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in io.json_objects(spark, str(tmp_path / "o.json")).collect()] == [1, 2]
    for i in (1, 2, 4):
        (tmp_path / f"page{i}.txt").write_text(f"p{i}\n")
    d = io.paged(spark, str(tmp_path / "page%d.txt"), start=1, stop=2)
    assert {(r["_page"], r["value"]) for r in d.collect()} == {(1, "p1"), (2, "p2")}
    assert io.paged(spark, str(tmp_path / "page%d.txt")).count() == 3
    assert io.files(spark, str(tmp_path), "*.txt").count() == 3


def test_notation_source(spark, tmp_path):
    (tmp_path / "x.notation").write_text("\n".join(notation.encode(v) for v in ({"a": 1}, [1, None])))
    rows = io.read_notation(spark, str(tmp_path)).orderBy("_pos").selectExpr("_pos", "to_json(value) AS j").collect()
    assert [r["j"] for r in rows] == ['{"a":1}', "[1,null]"]
    io.write_notation(spark.range(2), str(tmp_path / "out"))
    got = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert [notation.decode(x) for x in got] == [{"id": 0}, {"id": 1}]


def test_safe_rewrite(spark, tmp_path):
    path = str(tmp_path / "t")
    io.safe_rewrite(spark.range(3), path)
    io.safe_rewrite(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1


def test_db(spark):
    spark.range(5).createOrReplaceTempView("numbers_view")
    db = io.DB(spark)
    assert db.select("SELECT * FROM numbers_view WHERE id > :k", {"k": 2}).count() == 2
    assert db.count("numbers_view", "id < 2") == 2 and db.select_one("SELECT max(id) AS m FROM numbers_view")["m"] == 4
    assert db.table_exists("numbers_view")


def _stream(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet")
    return d, spark.readStream.schema(d.schema).parquet(f"{sf}/events.parquet*")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_windows_equal_batch(spark, sf, tmp_path):
    batch, stream = _stream(spark, sf)
    n = lambda: F.count("*").alias("n")
    make = [
        lambda d: windows.tumbling(d, "ts", "6 hours", [n()], ["event_type"], "1 hour"),
        lambda d: windows.sliding(d, "ts", "12 hours", "6 hours", [n()], (), "1 hour"),
        lambda d: windows.sessions(d, "ts", "4 hours", [n()], ["user_id"], "1 hour"),
    ]
    for i, f in enumerate(make):
        got = windows.run_available(f(stream), f"w{i}", str(tmp_path / f"c{i}"), "complete")
        assert rows(got) == rows(f(batch))


def test_dedup_and_count_batches(spark, sf, tmp_path):
    batch, stream = _stream(spark, sf)
    got = windows.run_available(windows.deduplicated(stream.select("ts", "user_id"), ["user_id"], "ts", "60 days"), "dd", str(tmp_path / "d"))
    assert sorted(r["user_id"] for r in got.collect()) == sorted(r["user_id"] for r in batch.select("user_id").distinct().collect())
    got = windows.run_available(windows.count_batches(stream, "user_id", "event_id", "event_id", 3), "cb", str(tmp_path / "b"))
    want = {}
    for r in batch.orderBy("event_id").collect():
        want.setdefault(r["user_id"], []).append(r["event_id"])
    full = {(u, i): v[3 * i : 3 * i + 3] for u, v in want.items() for i in range(len(v) // 3)}
    assert {(r["user_id"], r["_batch"]): r["items"] for r in got.collect()} == full
