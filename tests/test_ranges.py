"""Capped reads, duplicates by samples, and line files that grow."""

import hashlib
import os

from pyspark.sql import functions as F

from lakewright.sources import files, ranges


def test_capped(spark, tmp_path):
    data = {"a.bin": b"x" * 5000, "sub/b.bin": b"y" * 100, "sub/deep/c.bin": b"", "d.bin": bytes(range(256)) * 8}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for cap, want in ((2000, 2000), (10, 1024), (0, 1 << 60)):
        for root in (str(tmp_path), f"file://{tmp_path}"):
            got = {r["path"].split(f"{tmp_path}/")[1]: (r["size"], bytes(r["bytes"]), r["truncated"]) for r in ranges.capped(spark, root, cap).collect()}
            assert got == {n: (len(c), c[:want], len(c) > want) for n, c in data.items()}
    assert ranges.capped(spark, str(tmp_path), 0).select("path").count() == 4
    (tmp_path / "none").mkdir()
    assert ranges.capped(spark, str(tmp_path / "none"), 0).count() == 0


def test_tasks_are_planned_by_bytes(tmp_path, monkeypatch):
    for k in range(10):
        (tmp_path / f"{k}").write_bytes(b"z" * 10_000)
    monkeypatch.setattr(ranges, "TASK_BYTES", 30_000)
    assert len(ranges.CappedReader(str(tmp_path), 0).partitions()) == 5  # two files of 14 kB each
    assert len(ranges.CappedReader(str(tmp_path), 1024).partitions()) == 2  # five kB each, five files


def test_duplicate_files(spark, tmp_path):
    big = os.urandom(20_000)
    middle = big[:9000] + b"!" + big[9001:]  # equal at both ends
    data = {"1": big, "2": big, "3": middle, "4": b"same", "5": b"same", "6": b"same", "7": b"other", "8": b"", "9": b"", "a": big[:-1] + b"?", "b": middle}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    found = files.inventory(spark, str(tmp_path)).select("path", "size")
    rows = [(r["hash"], r["size"], r["n"], r["wasted"], [p.rsplit("/", 1)[1] for p in r["paths"]]) for r in ranges.duplicate_files(found).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert rows == [(sha(big), 20000, 2, 20000, ["1", "2"]), (sha(middle), 20000, 2, 20000, ["3", "b"]), (sha(b"same"), 4, 3, 8, ["4", "5", "6"])]
    assert ranges.duplicate_files(found.limit(0)).count() == 0 and len(ranges.duplicate_files(found, 100).collect()) == 2


def drain(spark, tmp_path, piece):
    got = []
    ranges.register(spark)
    stream = ranges.feed_items(spark.readStream.format("line_feed").option("piece", piece).load(str(tmp_path / "feed")))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.select("ts", "text").collect()))).start().awaitTermination()
    return sorted(got)


def test_line_feed(spark, tmp_path):
    """Every drain, a restart from the checkpoint each, gives all whole lines that came since, each once, whatever the pieces."""
    (tmp_path / "feed").mkdir()
    a, b = str(tmp_path / "feed/a"), str(tmp_path / "feed/b")
    sent = [(k, "é" * (k % 50)) for k in range(300)]
    for ts, text in sent[:200]:
        ranges.append_item(a, ts, text)
    assert drain(spark, tmp_path, 700) == sent[:200]
    assert drain(spark, tmp_path, 700) == []
    for ts, text in sent[200:]:
        ranges.append_item(b if ts % 2 else a, ts, text)
    with open(b, "a") as f:
        f.write('no json\n{"ts": 999, "text": "cut')  # not at its end yet
    assert drain(spark, tmp_path, 13) == sent[200:]
    with open(b, "a") as f:
        f.write(' off"}\r\n')
    assert drain(spark, tmp_path, 1 << 20) == [(999, "cut off")]


def test_pieces_hold_each_line_once(tmp_path):
    (tmp_path / "x").write_bytes(b"one\n\ntwo two\nthree\n" + b"y" * 40 + b"\nlast, open")
    for piece in range(1, 70):
        reader = ranges.LineFeedReader(str(tmp_path), piece)
        end = reader.latestOffset()
        lines = [line for p in reader.partitions({}, end) for _, _, line in reader.read(p)]
        assert lines == ["one", "", "two two", "three", "y" * 40]
