"""Which of many keys a text contains, by an inverted index of n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.session import checkpointed

GRAM = 3
#: Keys, and grams of keys, that are sent to every task; beyond that texts meet them by shuffles.
BROADCAST_KEYS = 200_000


def _grams(text: Column, n: int) -> Column:
    """The distinct n-grams of a text, in linear time; an empty array for a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


#: Bytes of the grams by which texts meet keys that were sent to them, bits of the gram's bucket, and positions looked at together.
BYTES, BITS, SPAN = 4, 18, 1 << 20


def _codes(b: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position on as one number."""
    out = b[: max(len(b) - n + 1, 0)].astype(np.uint32)
    for i in range(1, n):
        out |= b[i : len(b) - n + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _bucket(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


class KeyIndex:
    """Keys by a bucket of one of their grams, that which the fewest grams of other keys fall into. UTF-8 is searched as bytes."""

    def __init__(self, keys: list[bytes]) -> None:
        self.size = np.array([len(k) for k in keys], np.int64)
        self.from_ = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(keys), np.uint8)
        self.n = np.minimum(self.size, BYTES)
        self.parts = []
        for n in np.unique(self.n):
            codes = _codes(self.bytes, int(n))
            mine = np.flatnonzero(self.n == n)
            grams = self.size[mine] - n + 1
            key = np.repeat(mine, grams)
            at = np.arange(len(key)) - np.repeat(np.cumsum(grams) - grams, grams)
            bucket = _bucket(codes[self.from_[key] + at])
            load = np.bincount(bucket, minlength=1 << BITS)
            best = np.lexsort((at, load[bucket], key))
            best = best[np.concatenate([[True], key[best][1:] != key[best][:-1]])]
            order = best[np.argsort(bucket[best], kind="stable")]
            count = np.bincount(bucket[order], minlength=1 << BITS)
            self.parts.append((int(n), np.cumsum(count) - count, count, key[order], at[order], codes[self.from_[key[order]]], codes[self.from_[key[order]] + self.size[key[order]] - n]))

    def met(self, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (text, key) pairs, each once, of texts that lie one behind another from ``begin`` to ``end`` in ``b``."""
        found = [np.zeros(0, np.int64)]
        for n, start, count, key, at, head, tail in self.parts:
            codes = _codes(b, n)
            for low in range(0, len(codes), SPAN):
                bucket = _bucket(codes[low : low + SPAN])
                hit = np.flatnonzero(count[bucket])
                c = count[bucket[hit]]
                place = np.repeat(hit + low, c)
                which = np.repeat(start[bucket[hit]] - (np.cumsum(c) - c), c) + np.arange(len(place))
                s = place - at[which]
                e = s + self.size[key[which]]
                fits = np.flatnonzero((s >= 0) & (e <= len(b)))
                s, e, which = s[fits], e[fits], which[fits]
                alike = np.flatnonzero((codes[s] == head[which]) & (codes[e - n] == tail[which]))
                s, e, which = s[alike], e[alike], which[alike]
                row = np.searchsorted(begin, s, "right") - 1
                inside = np.flatnonzero((row >= 0) & (e <= end[row]))
                s, which, row = s[inside], key[which[inside]], row[inside]
                size = self.size[which]
                for long in np.unique(size[size > 2 * n]):
                    own = np.flatnonzero(size == long)
                    mid = np.arange(n, long - n)
                    same = (b[s[own, None] + mid] == self.bytes[self.from_[which[own], None] + mid]).all(1)
                    row[own[~same]] = -1
                found.append(np.unique(row[row >= 0] * len(self.size) + which[row >= 0]))
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.size), pairs % len(self.size)


def _search(index: Callable[[], KeyIndex], text: str, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of texts without the text, a row for each key met (``__key``, its place in the list), or for the first alone."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index()
        for batch in batches:
            column = batch.column(text).cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            rest = pa.table(batch.drop_columns([text]))
            low = 0
            while low < len(column):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + SPAN, "right")) - 1)
                row, key = known.met(data[ends[low] : ends[high]], ends[low:high] - ends[low], ends[low + 1 : high + 1] - ends[low])
                if first and len(row):
                    keep = np.concatenate([[True], row[1:] != row[:-1]])
                    row, key = row[keep], key[keep]
                yield from rest.take(pa.array(row + low)).append_column("__key", pa.array(key, pa.int64())).to_batches()
                low = high

    return search


def _sent(texts: DataFrame, ids: list[str], text: str, keys: list[str], first: bool = False) -> DataFrame:
    """The ids of ``texts`` with ``__key``, the places of the keys that they contain in the list, which every task has; the first alone."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast([k.encode() for k in keys])
    made = []

    def index() -> KeyIndex:
        if not made:
            made.append(KeyIndex(held.value))
        return made[0]

    given = texts.where(F.col(text).isNotNull()).select(*[F.col(c).alias(f"__i{i}") for i, c in enumerate(ids)], F.col(text).cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop("__text").schema.fields)
    if not keys:
        return texts.select(*ids, F.lit(0).cast("long").alias("__key")).limit(0)
    met = given.mapInArrow(_search(index, "__text", first), f"{schema}, __key long")
    return met.select(*[F.col(f"__i{i}").alias(c) for i, c in enumerate(ids)], "__key")


def _sizes(keys: DataFrame, key: str) -> tuple[bool, list[int]]:
    """Whether the keys and their grams can be sent around, and the lengths of grams that they need."""
    n = F.least(F.length(key), F.lit(GRAM))
    found = keys.where(F.length(key) > 0).agg(F.count(F.lit(1)), F.sum(F.length(key) - n + 1), F.sort_array(F.collect_set(n))).first()
    return found[0] <= BROADCAST_KEYS and (found[1] or 0) <= 10 * BROADCAST_KEYS, list(found[2])


def contains_join(texts: DataFrame, ids: list[str], text: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``texts`` (their ids) with the rows of ``keys`` whose key they contain, each pair once.

    A key is looked up by one of its n-grams alone, and the text itself decides. Keys up to BROADCAST_KEYS, and ten grams each, are
    sent to the texts, which stay where they are; a task has them by grams of bytes, and looks at its texts in Arrow batches, as the
    built-in search for one key after another reads a text once a key. More keys are met by shuffles of ids and a hash, on the gram that
    the fewest texts have, and what was met goes back to the texts, which are shuffled once and not once a gram; keys shorter than
    GRAM are grams by themselves. An empty key is in every text and would be a cross join, so it is left out, as are nulls; repeated
    ids are one row only if their texts are equal, too. Keys are counted when this is called."""
    known = keys.where(F.length(key) > 0).select(*[F.col(c).alias(f"__k_{c}") for c in keys.columns])
    word = F.col(f"__k_{key}")
    out = [F.col(f"__k_{c}").alias(c) for c in keys.columns]
    small, lengths = _sizes(keys, key)
    if small:
        words = sorted(r[0] for r in known.select(word).distinct().collect())
        places = keys.sparkSession.createDataFrame(list(enumerate(words)), "__key long, __word string")
        return _sent(texts, ids, text, words).join(F.broadcast(places.join(known, F.col("__word") == word)), "__key").select(*ids, *out)
    own = _grams(word, GRAM)
    for n in range(1, GRAM):
        own = F.when(F.length(word) == n, F.array(word)).otherwise(own)
    held = known.select(word).distinct().select(word, F.explode(own).alias("__gram"))
    every = F.concat(F.array().cast("array<string>"), *[_grams(F.col(text), n) for n in lengths])
    # Texts of equal ids and hashes share what they may contain; each of them decides for itself.
    hashed = texts.where(F.col(text).isNotNull()).withColumn("__hash", F.xxhash64(text))
    by = [*ids, "__hash"]
    posted = hashed.select(*by, F.explode(every).alias("__gram")).join(held.select("__gram").distinct(), "__gram", "left_semi")
    seen = posted.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rare = held.join(seen, "__gram", "left").groupBy(word).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("r"))
    probes = checkpointed(rare.where("r.n > 0").select(word, F.col("r.__gram").alias("__gram")))
    may = posted.join(probes, "__gram").select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(by)], word).distinct()
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__m{i}"))
    met = may.join(hashed.select(*by, text), same).where(F.contains(F.col(text), word)).select(*ids, word)
    return met.join(known, f"__k_{key}").select(*ids, *out)


def first_rule(texts: DataFrame, ids: list[str], text: str, rules: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``texts`` (ids) that contain any rule's key, with the rule that comes first in ``order``.

    Rules up to BROADCAST_KEYS are sent around in that order, and a text gives its first alone."""
    placed = [*order, *[c for c in rules.columns if c not in order]]
    if _sizes(rules, key)[0]:
        first = rules.where(F.length(key) > 0).groupBy(key).agg(F.min(F.struct(*placed)).alias("r"))
        held = first.orderBy("r").collect()
        ranked = rules.sparkSession.createDataFrame([(i, h["r"]) for i, h in enumerate(held)], f"__key long, r {dict(first.dtypes)['r']}")
        best = _sent(texts, ids, text, [h[key] for h in held], True).groupBy(*ids).agg(F.min("__key").alias("__key"))
        return best.join(F.broadcast(ranked), "__key").select(*ids, *[F.col(f"r.{c}").alias(c) for c in rules.columns])
    met = contains_join(texts, ids, text, rules, key)
    best = F.min(F.struct(*placed)).alias("r")
    return met.groupBy(*ids).agg(best).select(*ids, *[F.col(f"r.{c}").alias(c) for c in rules.columns])
