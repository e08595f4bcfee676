"""Files by ranges of bytes: capped reads, head and tail fingerprints, and growing line files as a stream.

Files are opened by ``pyarrow.fs`` in the tasks, so any store that it knows will do, and no more is read than asked for.
Folders are listed on the driver (names and sizes alone); what is read is dealt to tasks by bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A cap below this is raised to it; 0 is no cap.
LEAST_CAP = 1024
#: Bytes of a sample at each end of a file, and of a piece when a file is read whole.
SAMPLE, PIECE = 4096, 1 << 20
#: Bytes that a task of a planned read gets, and of a piece of a line file.
TASK_BYTES, LINE_BYTES = 64 << 20, 16 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(root: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, in order."""
    system, path = _open(root)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    lead = root[: len(root) - len(path)] if root.endswith(path) else "file://" if "://" in root or root.startswith("file:") else ""
    return sorted((lead + f.path, f.size) for f in found if f.type == fs.FileType.File)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class CappedReader(DataSourceReader):
    def __init__(self, root: str, cap: int) -> None:
        self.root, self.cap = root, cap

    def wanted(self, size: int) -> int:
        return size if self.cap == 0 else min(size, max(self.cap, LEAST_CAP))

    def partitions(self) -> list[InputPartition]:
        """Files in tasks of TASK_BYTES of what is read of them, or of one file."""
        out, part, held = [], [], 0
        for path, size in _listed(self.root):
            cost = self.wanted(size) + 4096  # opening a file costs, too
            if part and held + cost > TASK_BYTES:
                out.append(Files(part))
                part, held = [], 0
            part.append((path, size))
            held += cost
        return [*out, Files(part)] if part else out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            system, name = _open(path)
            want = self.wanted(size)
            with system.open_input_stream(name, buffer_size=None) as f:
                yield path, size, f.read(want), size > want


class CappedFiles(DataSource):
    """``spark.read.format("capped_files").option("cap", n).load(folder)``: (path, size, bytes, truncated), at most ``cap`` bytes of
    each file below the folder, which are all that is read; 0 is no cap, a cap below LEAST_CAP is raised to it. An empty folder
    gives no rows; a file that is gone or can't be read is an error."""

    @classmethod
    def name(cls) -> str:
        return "capped_files"

    def schema(self) -> str:
        return "path string, size long, bytes binary, truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return CappedReader(self.options["path"], int(self.options.get("cap", "0")))


class Lines(InputPartition):
    """Lines that begin in [start, end) of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class LineFeedReader(DataSourceStreamReader):
    def __init__(self, root: str, piece: int) -> None:
        self.root, self.piece = root, piece

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file the place behind its last whole line."""
        out = {}
        for path, size in _listed(self.root):
            system, name = _open(path)
            with system.open_input_file(name) as f:
                at = size
                while at:
                    start = max(0, at - 4096)
                    found = f.read_at(at - start, start).rfind(b"\n")
                    if found >= 0:
                        at = start + found + 1
                        break
                    at = start
            out[path] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """All that is pending, in pieces; a file that has shrunk is read from its start."""
        out = []
        for path, to in sorted(end.items()):
            at = start.get(path, 0) if start.get(path, 0) <= to else 0
            out += [Lines(path, a, min(a + self.piece, to)) for a in range(at, to, self.piece)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        system, name = _open(partition.path)
        with system.open_input_file(name) as f:
            at = partition.start
            # A line belongs to the piece in which it begins: look at the byte before for where the first one does.
            skip = at > 0 and f.read_at(1, at - 1) != b"\n"
            rest = b""
            while True:
                piece = f.read_at(PIECE, at + len(rest))
                if not piece and not rest:
                    return
                buffer, held = rest + piece, 0
                while (stop := buffer.find(b"\n", held)) >= 0:
                    begins = at + held
                    if skip:
                        skip = False
                    elif begins >= partition.end:
                        return
                    else:
                        yield partition.path, begins, buffer[held:stop].removesuffix(b"\r").decode("utf-8", "replace")
                    held = stop + 1
                if not piece or at + held >= partition.end:
                    return
                at, rest = at + held, buffer[held:]

    def commit(self, end: dict) -> None:
        pass


class LineFeed(DataSource):
    """``spark.readStream.format("line_feed").load(folder)``: (path, offset, line) of text files that others go on appending to.

    Every batch drains all whole lines that are there, and never waits; the offset is a place in each file, so that a restart goes
    on where the last batch ended. A line without its end is left for later. Lines come in pieces of ``piece`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "line_feed"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineFeedReader(self.options["path"], int(self.options.get("piece", str(LINE_BYTES))))


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(CappedFiles)
    spark.dataSource.register(LineFeed)


def capped(spark: SparkSession, root: str, cap: int) -> DataFrame:
    register(spark)
    return spark.read.format("capped_files").option("cap", str(cap)).load(root)


def _digests(paths: DataFrame, whole: bool) -> DataFrame:
    """(path, size, hash) of the files of (path, size): of the first and last SAMPLE bytes, or of all, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = _open(path)
                h = hashlib.sha256()
                with system.open_input_file(name) as f:
                    if whole:
                        for at in range(0, size, PIECE):
                            h.update(f.read_at(min(PIECE, size - at), at))
                    else:
                        h.update(f.read_at(min(SAMPLE, size), 0))
                        h.update(f.read_at(min(SAMPLE, size), max(0, size - SAMPLE)))
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "size", "hash"])

    n = paths.sparkSession.sparkContext.defaultParallelism * 4
    return paths.select("path", "size").repartition(n).mapInArrow(run, "path string, size long, hash string")


def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that share their keys with others."""
    several = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(several, keys, "left_semi")


def duplicate_files(files: DataFrame, min_size: int = 1) -> DataFrame:
    """(hash, size, n, wasted, paths) of the groups of equal files of (path, size), most wasted first.

    Three steps, each on what the one before leaves: equal sizes (no byte is read), equal samples of both ends, equal SHA-256 of
    the whole file. ``paths`` is sorted; a group's list holds its paths alone, a few bytes for each file that is there."""
    candidates = files.where(F.col("size") >= min_size).select("path", "size")
    sampled = _shared(_digests(_shared(candidates, ["size"]), whole=False), ["size", "hash"])
    equal = _digests(sampled, whole=True)
    groups = equal.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where("n > 1")
    return groups.select("hash", "size", "n", (F.col("size") * (F.col("n") - 1)).alias("wasted"), "paths").orderBy(F.desc("wasted"), F.col("paths")[0])


def feed_items(lines: DataFrame) -> DataFrame:
    """(path, offset, ts, text) of lines that are JSON items; others are passed over."""
    item = F.from_json("line", "ts long, text string")
    return lines.select("path", "offset", item.alias("x")).where("x.ts is not null").select("path", "offset", "x.ts", "x.text")


def append_item(path: str, ts: int, text: str) -> None:
    """Send an item to a feed: one line of JSON at the end of a local file."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"ts": ts, "text": text}, ensure_ascii=False) + "\n")
