"""Streaming twins of the ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql import types as T


class HighWater(StatefulProcessor):
    """Keeps the highest time seen of a key and passes only rows with text above it, in the order of ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", T.StructType([T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("seq", kind="stable")
        mark = self.mark.get()[0] if self.mark.exists() else None
        keep = []
        for ts, text in zip(found["ts"], found["text"], strict=True):
            ok = bool(text) and (mark is None or ts > mark)
            mark = int(ts) if ok else mark
            keep.append(ok)
        if mark is not None:
            self.mark.update((mark,))
        yield found[keep][["feed", "seq", "ts", "text"]]

    def close(self) -> None:
        pass


def high_water_stream(df: DataFrame) -> DataFrame:
    """A stream (feed, seq, ts, text) without rows that are not newer than all before of their feed.

    The state is one number a feed, so it doesn't grow with the rows. Needs the RocksDB state store.
    """
    return df.groupBy("feed").transformWithStateInPandas(HighWater(), "feed string, seq long, ts long, text string", "Append", "none")


def latest_per_key(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The newest value of each key; as a stream in update mode, a changed key comes again."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def keep_newest(df: DataFrame, path: str, key: str, keep: int, checkpoint: str) -> StreamingQuery:
    """Append every batch to a bounded log: after each, ``path`` holds the newest ``keep`` rows and the total seen.

    Batches are numbered, so a batch that is run again after a failure writes the same folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/{number - 1}") if number else None
        rows = batch if before is None else before.drop("total").unionByName(batch)
        seen = batch.count() + (0 if before is None else before.agg(F.max("total")).first()[0] or 0)
        rows.orderBy(F.desc(key)).limit(keep).withColumn("total", F.lit(seen)).write.mode("overwrite").parquet(f"{path}/{number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def terminal_check(events: DataFrame, run: str, kind: str) -> DataFrame:
    """(run, n_terminal, ok): each run must have exactly one Done or Error."""
    n = F.count_if(F.col(kind).isin("Done", "Error"))
    return events.groupBy(run).agg(n.alias("n_terminal")).withColumn("ok", F.col("n_terminal") == 1)


def with_terminals(events: DataFrame, outcomes: DataFrame, run: str, seq: str, kind: str) -> DataFrame:
    """The events, and for each run whose last one is neither Done nor Error the terminal one that is missing.

    ``events``: (run, seq, kind, result, code, message); ``outcomes``: (run, ok, result, message), one row a run. What a run returned makes a
    Done with its result, what it failed with an Error of code 1; a run without an outcome has ended without a word, an Error too. Runs
    that have an outcome and no events get their terminal event at seq 0."""
    last = events.groupBy(run).agg(F.max(seq).alias("__at"), F.max_by(kind, seq).alias("__kind"))
    ended = last.join(outcomes, run, "full").where(~F.coalesce(F.col("__kind").isin("Done", "Error"), F.lit(False)))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    made = ended.select(
        F.col(run), (F.coalesce("__at", F.lit(-1)) + 1).cast(events.schema[seq].dataType).alias(seq), F.when(ok, "Done").otherwise("Error").alias(kind),
        F.when(ok, F.col("result")).alias("result"), F.when(~ok, 1).alias("code"), F.when(~ok, F.coalesce("message", F.lit("ended without an outcome"))).alias("message"),
    )
    return events.select(*made.columns).unionByName(made)


class Terminals(StatefulProcessor):
    """Passes events on and waits for each run's terminal one; ``timeout`` milliseconds of event time after the last event it
    emits an Error in its place. A run is forgotten that long after its last event, so the state holds live runs alone."""

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("seq", T.LongType()), T.StructField("ended", T.BooleanType()), T.StructField("due", T.LongType())]
        self.state = handle.getValueState("run", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seq, ended, due = self.state.get() if self.state.exists() else (-1, False, 0)
        if due:
            self.handle.deleteTimer(due)
        last = int(found["at"].max().value // 1_000_000) + self.timeout
        ended = bool(ended or found["kind"].isin(["Done", "Error"]).any())
        due = max(due, last)
        self.handle.registerTimer(due)
        self.state.update((max(seq, int(found["seq"].max())), ended, due))
        yield found.assign(made=False)[["run", "seq", "kind", "message", "made"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, ended, due = self.state.get() if self.state.exists() else (-1, True, 0)
        self.state.clear()
        if not ended:
            yield pd.DataFrame({"run": [key[0]], "seq": [seq + 1], "kind": ["Error"], "message": ["no terminal event"], "made": [True]})

    def close(self) -> None:
        pass


def terminal_stream(df: DataFrame, timeout: int, lateness: str = "0 seconds") -> DataFrame:
    """A stream (run, at, seq, kind, message) as (run, seq, kind, message, made), with an Error for each run that falls silent.

    ``timeout``: milliseconds of event time without an event. Needs the RocksDB state store."""
    rows = df.withWatermark("at", lateness).groupBy("run")
    return rows.transformWithStateInPandas(Terminals(timeout), "run string, seq long, kind string, message string, made boolean", "Append", "EventTime")


def put_stream(df: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour") -> list[StreamingQuery]:
    """A stream of packages (name, version, bytes, at) into a content-addressed store: ``blobs``, each once by SHA-256, and
    ``index/<n>``, the last written blob of each name after batch n.

    Copies of a blob that arrive within ``lateness`` of event time are dropped in the state, which forgets it then; copies that come later are
    found in the store itself. The index of a batch is made from that before it, so that a batch run again writes the same. Ties in
    ``at`` go by the greater version, then blob."""
    packages = df.select("name", "version", "bytes", "at", F.sha2("bytes", 256).alias("blob"))
    fresh = packages.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["blob"]).select("blob", "bytes")

    def blobs(batch: DataFrame, number: int) -> None:
        there = batch.sparkSession.read.schema("blob string, bytes binary, batch long").parquet(f"{path}/blobs") if number else None
        new = batch if there is None else batch.join(there.where(F.col("batch") != number).select("blob"), "blob", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/blobs/batch={number}")

    def index(batch: DataFrame, number: int) -> None:
        newest = batch.select("name", F.struct("at", "version", "blob").alias("x"))
        if number:
            before = batch.sparkSession.read.parquet(f"{path}/index/{number - 1}")
            newest = newest.unionByName(before.select("name", F.struct("at", "version", "blob").alias("x")))
        newest.groupBy("name").agg(F.max("x").alias("x")).select("name", "x.*").write.mode("overwrite").parquet(f"{path}/index/{number}")

    start = lambda rows, write, name: rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    return [start(fresh, blobs, "blobs"), start(packages, index, "index")]


def tail_events(log: DataFrame, jobs: DataFrame, by: str, keep: int) -> DataFrame:
    """What a reader of a bounded log hasn't had: (by, seq, event, data), lines in order of ``seq``, then a done event.

    ``log`` is (by, seq, line), lines numbered from 0 over all that were ever written, of which the newest ``keep`` of a job
    are held; ``jobs`` is (by, consumed, running, exit_code), consumed being the number of lines read, evicted ones
    included. Lines evicted unread are skipped; a job that runs on has no done event.
    """
    total = log.groupBy(by).agg((F.max("seq") + 1).alias("total"))
    at = jobs.join(total, by, "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    due = at.select(by, F.greatest(F.col("consumed"), F.col("total") - keep).alias("from"))
    lines = log.join(due, by).where("seq >= from").select(by, "seq", F.lit("line").alias("event"), F.col("line").alias("data"))
    done = at.where("not running").select(by, F.col("total").alias("seq"), F.lit("done").alias("event"), F.col("exit_code").cast("string").alias("data"))
    return lines.unionByName(done)


def until_terminal(events: DataFrame, run: str, seq: str, is_terminal) -> DataFrame:
    """The events of each run up to its first terminal one, that one included; all of a run that has none."""
    last = events.where(is_terminal).groupBy(F.col(run).alias("__run")).agg(F.min(seq).alias("__last"))
    out = events.join(last, F.col(run).eqNullSafe(F.col("__run")), "left")
    return out.where(F.col("__last").isNull() | (F.col(seq) <= F.col("__last"))).drop("__run", "__last")


def json_lines_sink(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of events as JSON, one a line, each once, in the files of ``path``."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
