"""Packing by concatenation and cutting.

Pass one tokenises every document and writes its ids, with the partition and the place in it. The
token totals of the partitions, one row each, get a prefix sum, which gives every document its
offset in the one stream of all tokens. Pass two cuts the stream into windows of 2048: a document
that crosses a boundary gives one boundary record a piece. Nothing is shuffled but the totals, and
only the last sequence is not full, so that no other needs padding.

Edge cases: a null or empty text has the end mark alone, one token. The text <|endoftext|> is one token. Repeated rows and equal ids are
packed as often as they occur. An empty table gives no rows. Documents of any length are cut freely.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import stored, table

SEQUENCE = 2048
END_ID = 1
#: The vocabulary's added token, and its id as two bytes.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", np.array([50256], "<u2").tobytes()
#: Distinct chunks whose ids a worker remembers.
CACHE = 300_000


class Encoder:
    """Token ids of ``byte_bpe_50k``, two bytes an id, by the same vocabulary's ranks.

    As in ``tokenizers``, which the ranks stand in for, the text END_OF_TEXT is the added token END_OF_TEXT_ID
    wherever it stands, and what is before and after it is tokenised apart.

    The tokenizer's pattern always breaks before a space that stands before a character that is not
    white space, so a text can be cut there and the ids of each chunk remembered.
    """

    def __init__(self, ranks_path: str) -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _new(self, part: str) -> bytes:
        if len(self.known) >= CACHE:
            self.known.clear()
        ids = self.encode(" " + part)
        if len(part) <= 40:
            self.known[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        return END_OF_TEXT_ID.join(map(self._plain, text.split(END_OF_TEXT)))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        parts = [first]
        for piece in rest:
            if piece and not piece[0].isspace():
                parts.append(piece)
            else:  # more white space: it belongs to the chunk before
                parts[-1] += " " + piece
        found = map(self.known.get, parts[1:])
        return self.encode(parts[0]) + b"".join(ids if ids is not None else self._new(part) for part, ids in zip(parts[1:], found, strict=True))


TOKENS = "part int, start long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Rows and bytes of ids in one Arrow batch.
BATCH_BYTES = 8 << 20


def tokenise(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Pass one: each document's ids with the end mark, its partition and its start in the partition."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, encode, at = TaskContext.get().partitionId(), Encoder(path), 0
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                rows.append((part, at, doc_id.as_py(), len(ids) // 2, ids))
                at += len(ids) // 2
                size += len(ids)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def _cut(batches, size: int):
    """Pass two: rows (doc_id, global offset, n_tokens, ids) into one row a piece."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, at, n, ids in zip(*(batch.column(k) for k in range(4)), strict=True):
            doc_id, at, n = doc_id.as_py(), at.as_py(), n.as_py()
            wide = memoryview(np.frombuffer(ids.as_py(), "<u2").astype("<u4").tobytes())
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, size)
                length = min(size - offset, n - start)
                rows.append((doc_id, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, sequence, offset))
                start += length
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, size: int = SEQUENCE, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence of ``size`` tokens.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (place in the sequence).
    """
    tokens = stored(tokenise(docs, ranks_path), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row for each input partition.
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n_tokens", "ids")
    return placed.mapInArrow(lambda batches: _cut(batches, size), PIECES)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
