"""Streams against their batch twins, and dataflow graphs."""

from lakewright.operators import images, windows
from lakewright.plans import graph
from lakewright.streaming import feeds

FEED = [("a", 1, 5, "x"), ("a", 2, 5, "y"), ("a", 3, 3, "z"), ("a", 4, 9, ""), ("b", 1, 1, "q"), ("a", 5, 7, "k"), ("a", 6, 6, "l"), ("a", 7, 8, "m")]
SCHEMA = "feed string, seq long, ts long, text string"


def test_high_water(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch = windows.high_water(spark.createDataFrame(FEED, SCHEMA), ["feed"], ["seq"], "ts", "text")
    want = sorted(map(tuple, batch.collect()))
    got = []
    for k, part in enumerate((FEED[:5], FEED[5:])):  # a restart from the checkpoint between
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = feeds.high_water_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start().awaitTermination()
    assert sorted(got) == want == [("a", 1, 5, "x"), ("a", 5, 7, "k"), ("a", 7, 8, "m"), ("b", 1, 1, "q")]


def test_bounded_log(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").json(str(tmp_path / "in"))
        feeds.keep_newest(spark.readStream.schema("id long").json(str(tmp_path / "in")), str(tmp_path / "log"), "id", 5, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "log/1")).orderBy("id").collect()
    assert [r["id"] for r in rows] == [15, 16, 17, 18, 19] and rows[0]["total"] == 20


def test_latest(spark):
    assert {r["feed"]: r["text"] for r in feeds.latest_per_key(spark.createDataFrame(FEED, SCHEMA), "feed", "text", "seq").collect()} == {"a": "m", "b": "q"}


def test_latest_as_a_stream(spark, tmp_path):
    """In update mode a batch gives the keys that it changes, and what they hold now."""
    got = []
    for k, part in enumerate((FEED[:3], FEED[3:5], FEED[5:], [("b", 0, 0, "older")])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = feeds.latest_per_key(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), "feed", "text", "seq")
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: got.append(sorted(map(tuple, df.collect())))).start().awaitTermination()
    assert [g for g in got if g] == [[("a", "z", 3)], [("a", "", 4), ("b", "q", 1)], [("a", "m", 7)], [("b", "q", 1)]]


def test_graph():
    assert graph.stages(["a", "b", "c"], [("a", "b"), ("b", "c"), ("a", "c")]) == ([["a"], ["b"], ["c"]], set())
    assert graph.check(["a", "b"], [("a", "b"), ("b", "a"), ("a", "z")], {"a"}) == ["node b has no command", "edge a->z: no node z", "cycle among a, b"]


def test_life(spark):
    live = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "x long, y long")
    one = images.life_step(live, 10, 10)
    assert sorted(map(tuple, one.collect())) == [(0, 1), (1, 1), (2, 1)]
    assert sorted(map(tuple, images.life_step(one, 10, 10).collect())) == [(1, 0), (1, 1), (1, 2)]


def test_images(spark):
    pixels = spark.createDataFrame([(1, x, y, 250 if x < 3 else 10, 0, 0) for x in range(4) for y in range(4)], "image_id int, x long, y long, r int, g int, b int")
    best = images.dominant_colors(pixels, 20).orderBy("rank").collect()
    assert [(r["r"], r["n"], r["percent"]) for r in best] == [(250, 12, 75.0), (10, 4, 25.0)]
    parts = images.components(spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 5, 5)], "image_id int, x long, y long")).collect()
    assert [(r["n"], r["max_x"]) for r in parts] == [(2, 1), (1, 5)]
