"""Runs that end without a word, and packages put by streams."""

import hashlib
from datetime import datetime, timedelta

from lakewright.streaming import feeds

START = datetime(2024, 1, 1)
SCHEMA = "run string, at timestamp, seq long, kind string, message string"


def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_with_terminals(spark):
    events = spark.createDataFrame([("a", 1, "Tick", None, None, None), ("a", 2, "Done", "r", None, None), ("b", 1, "Error", None, 7, "m"), ("b", 2, "Tick", None, None, None), ("c", 5, "Tick", None, None, None)], "run string, seq long, kind string, result string, code int, message string")
    outcomes = spark.createDataFrame([("a", True, "x", None), ("b", True, "fine", None), ("d", False, None, "panicked"), ("e", None, None, None)], "run string, ok boolean, result string, message string")
    made = sorted(tuple(r) for r in feeds.with_terminals(events, outcomes, "run", "seq", "kind").exceptAll(events).collect())
    assert made == [("b", 3, "Done", "fine", None, None), ("c", 6, "Error", None, 1, "ended without an outcome"), ("d", 0, "Error", None, 1, "panicked"), ("e", 0, "Error", None, 1, "ended without an outcome")]


def test_terminal_stream(spark, tmp_path):
    rocksdb(spark)
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [("a", at(0), 0, "Started", None), ("b", at(1), 0, "Started", None), ("a", at(2), 1, "Done", None)],
        [("b", at(5), 1, "Tick", None), ("c", at(6), 0, "Started", None)],  # b lives on
        [("d", at(40), 0, "Started", None), ("d", at(41), 1, "Error", "m")],  # b and c have been silent for 10 s
        [("c", at(60), 5, "Tick", None)],  # c comes back, as a new run
        [("z", at(200), 0, "Done", None)],
        [("z", at(400), 1, "Tick", None)],
    ]
    got = []
    for rows in batches:  # every batch a restart from the checkpoint
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.terminal_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 10_000)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start().awaitTermination()
    given = [(r, s, k, m, False) for rows in batches for r, _, s, k, m in rows]
    made = [("b", 2, "Error", "no terminal event", True), ("c", 1, "Error", "no terminal event", True), ("c", 6, "Error", "no terminal event", True)]
    assert sorted(got, key=repr) == sorted(given + made, key=repr)


def test_put_stream(spark, tmp_path):
    rocksdb(spark)
    schema = "name string, version string, bytes binary, at timestamp"
    at = lambda h: START + timedelta(hours=h)
    batches = [
        [("x", "1", b"one", at(0)), ("y", "1", b"one", at(0)), ("x", "2", b"two", at(1))],
        [("z", "1", b"two", at(1)), ("x", "3", b"three", at(1))],
        [("y", "9", b"one", at(90)), ("x", "0", b"two", at(90))],  # long forgotten by the state
        [("w", "1", b"four", at(91)), ("w", "2", b"four", at(91))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for q in feeds.put_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")):
            q.awaitTermination()
    blobs = [(r["blob"], bytes(r["bytes"])) for r in spark.read.parquet(str(tmp_path / "store/blobs")).collect()]
    assert sorted(blobs) == sorted((hashlib.sha256(b).hexdigest(), b) for b in (b"one", b"two", b"three", b"four"))
    last = max(int(p.name) for p in (tmp_path / "store/index").iterdir())
    index = {r["name"]: (r["version"], r["blob"]) for r in spark.read.parquet(str(tmp_path / f"store/index/{last}")).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert index == {"x": ("0", sha(b"two")), "y": ("9", sha(b"one")), "z": ("1", sha(b"two")), "w": ("2", sha(b"four"))}
