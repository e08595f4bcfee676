"""Near-duplicate documents by BagMinHash.

A text is the multiset of its shingles of five words (A-Z lower-cased; a text of one to four words is
one shingle). Weighted Jaccard similarity is the sum of the smaller over the sum of the larger counts.
For a shingle of count w the signature draws points of Poisson processes, one for each dyadic block of
weights [0,1), [1,2), [2,4), [4,8) ... that w reaches into; a point has a time, a register and a weight
level, and counts if the level is below w. A register keeps the least time, so two texts agree in a
register with the probability of their similarity. A process ends as soon as its time is past the
latest register of its text, which bounds the work by about m log m points a text.

Texts that agree in a whole band are candidates. Equal texts are first merged into one node. Candidates are compared in
rounds, and a round leaves out what lies in one component of the links found so far, as it can't change the classes:

1. every node with one other, the most central that it shares a bucket with (``nearest``): of a group of near copies, the
   text that most others were made from has the fullest buckets;
2. the nodes of each bucket with its most central (``stars``);
3. all of a bucket of at most SMALL nodes (``within_small``);
4. the nodes of large buckets that hold several components still, by their rarest shingles (``rare_shingles``): first
   each with one node of the list's most frequent component (``by_first``), then every two that can be similar enough
   (``by_all``).

So no bucket is capped, no large one is expanded into the pairs within a component, and no candidate pair between two
components goes unseen. Every pair is verified on the multisets themselves (similarity of SIMILARITY or more), and
classes are the connected components of the verified links.

Edge cases: a null text, or one without words, is a class of its own. Repeated rows and equal texts share
a class, ties in id included. Very long texts are hashed whole, in chunks. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.common import stored, table
from lakewright.llm.components import components
from lakewright.llm.quality import chunks

SHINGLE = 5
BANDS, ROWS = 24, 4
SIMILARITY = 0.8
SMALL = 12
#: Texts that share a bucket with others, 50 bytes each, up to which their keys are broadcast.
BROADCAST_NODES = 500_000
#: Bands that a pair must share before its texts are compared: at 0.8, six pairs in 100,000 share fewer.
SHARED = 2
#: Bytes of text whose signatures are made at once.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _times_base(n: int) -> np.uint64:
    return np.uint64(n * int(_BASE) % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, in order, and the text of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    b = np.frombuffer(b"\x00".join([*raw, b""]), np.uint8)
    inside = _WORD[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Polynomial hash of each word from prefix sums, brought back to the power 0.
    power = np.cumprod(np.full(len(b) + 1, _BASE))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    back = np.cumprod(np.full(len(b) + 1, _INVERSE))
    word = mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
    doc = np.searchsorted(first, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n) - n
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    out = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        more = k < size[owner]
        out[more] = mix(out[more] * _BASE + word[at[more] + k])
    return out, owner


def multisets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts, in order of the text."""
    hashes, owner = shingles(texts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))


def signatures(texts: list[str | None], registers: int = BANDS * ROWS) -> np.ndarray:
    """The BagMinHash signature of each text: the least time of each register, inf for a text without words."""
    doc, shingle, weight = multisets(texts)
    sig = np.full((len(texts), registers), np.inf)
    flat = sig.reshape(-1)
    parts, low = [], 0
    while True:  # one process for each block of weights that a count reaches into
        reach = weight > low
        if not reach.any():
            break
        length = max(low, 1)
        seed = mix(shingle[reach] + _times_base(low + 1))
        parts.append((doc[reach], seed, weight[reach], np.full(reach.sum(), low), np.full(reach.sum(), length)))
        low += length
    if not parts:
        return sig
    doc, seed, weight, low, length = (np.concatenate(c) for c in zip(*parts, strict=True))
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        a = mix(seed + _times_base(step))
        b = mix(a + _BASE)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / length
        register = (b & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
        level = low + (b >> np.uint64(32)).astype(np.int64) % length
        counts = level < weight
        np.minimum.at(flat, (doc * registers + register)[counts], time[counts])
        on = time < sig.max(axis=1)[doc] if step % 4 == 1 or len(doc) < 4 * len(sig) else np.ones(len(doc), bool)
        if not on.all():
            doc, seed, weight, low, length, time = doc[on], seed[on], weight[on], low[on], length[on], time[on]
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands; 0 rows matter for texts without words."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE), bits.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * _BASE + bits[:, :, k])
    return out.view(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def bands_udf(texts: pa.Array) -> pa.Array:
    """The band hashes of each text; null for a text without words."""
    out = []
    for part in chunks(texts, CHUNK_BYTES):
        sig = signatures(part)
        out += [row if full else None for row, full in zip(band_hashes(sig), np.isfinite(sig[:, 0]), strict=True)]
    return pa.array(out, pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def shingles_udf(texts: pa.Array) -> pa.Array:
    """The sorted shingle hashes of each text, 8 bytes each, repeated as often as they occur."""
    out = []
    for part in chunks(texts, CHUNK_BYTES):
        hashes, owner = shingles(part)
        hashes = hashes[np.lexsort((hashes, owner))]
        cut = np.searchsorted(owner, np.arange(len(part) + 1))
        out += [hashes[cut[k] : cut[k + 1]].tobytes() for k in range(len(part))]
    return pa.array(out, pa.binary())


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    if len(np.unique(a)) == len(a) and len(np.unique(b)) == len(b):
        return int((both[1:] == both[:-1]).sum())
    values = np.unique(both)
    count = lambda x: np.searchsorted(x, values, "right") - np.searchsorted(x, values, "left")
    return int(np.minimum(count(a), count(b)).sum())


@F.arrow_udf(T.DoubleType())
def similarity_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Weighted Jaccard similarity of two sorted multisets of hashes."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        same = overlap(x, y)
        out.append(same / max(len(x) + len(y) - same, 1))
    return pa.array(out, pa.float64())


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def shared(buckets: DataFrame) -> DataFrame:
    """(bucket, node, n, weight, center, center_weight), stored, of the buckets (bucket, node) with several nodes: their
    number, how many others a node meets in all its buckets, and the bucket's node of most weight, the smallest of equal ones."""
    size = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(buckets.join(size, "bucket"), "met")
    weighed = stored(met.join(met.groupBy("node").agg(F.sum("n").alias("weight")), "node"), "weighed")
    top = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("top"))
    return stored(weighed.join(top, "bucket").select("bucket", "node", "n", "weight", (-F.col("top.node")).alias("center"), F.col("top.weight").alias("center_weight")), "buckets")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def nearest(met: DataFrame) -> DataFrame:
    """A pair (a, b), a < b, for each node but those that are the center of all their buckets: with the weightiest center."""
    best = met.groupBy("node").agg(F.max(F.struct("center_weight", (-F.col("center")).alias("center"))).alias("best")).select("node", (-F.col("best.center")).alias("center"))
    return best.where("center <> node").select(*ordered(F.col("center"), F.col("node"))).distinct()


def labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """The rows with the component of their node; a node without links is its own."""
    known = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(known, node, "left").withColumn(label, F.coalesce(label, node))


def still_open(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with the label of the node and of the bucket's center, stored.

    A bucket is open if any node has another label than the center."""
    both = stored(labelled(labelled(met, labels), labels, "center", "center_label"), "labelled")
    many = both.where("label <> center_label").select("bucket").distinct()
    return stored(both.join(many, "bucket", "left_semi"), "open")


def stars(open_: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: the center of a bucket and each of its nodes in another component."""
    return open_.where("label <> center_label").select(*ordered(F.col("center"), F.col("node"))).distinct()


def within_small(open_: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes in different components of a bucket of at most SMALL nodes."""
    few = open_.where(F.col("n") <= SMALL)
    a, b = (few.select("bucket", F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab")
    return a.join(b, "bucket").where("a < b and a_label <> b_label").select("a", "b").distinct()


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that share at least SHARED bands; a pair at the similarity sought shares ten on average."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("bands").alias(f"{c}_bands"))
    same = F.size(F.filter(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), lambda e: e))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(same >= SHARED).select("a", "b")


@F.arrow_udf(T.ArrayType(T.LongType()))
def tokens_udf(shingles: pa.Array) -> pa.Array:
    """One number for each shingle of a sorted multiset; the second, third ... of equal ones get other numbers."""
    out = []
    for s in shingles:
        h = np.frombuffer(s.as_py(), np.uint64)
        new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        place = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        out.append(mix(h + place.astype(np.uint64) * _BASE).view(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def rare_shingles(loose: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rarest shingles of each node, stored: node, n (size of its multiset), token, at (its place by rareness), listed.

    Of two multisets of sizes m <= n that are similar enough, the rarest n - ceil(s n) + 1 shingles of the
    larger hold one of the rarest m - ceil(2 s m / (1 + s)) + 1 of the smaller, its listed ones.
    """
    each = loose.join(sets, "node").select("node", tokens_udf("shingles").alias("tokens"))
    each = stored(each.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "tokens")
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    # Shingles of one node alone come first of all; only their number matters.
    ranked = each.join(seen, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("rare"))
    n, alone = F.col("n"), F.col("n") - F.size("rare")
    asks = (n - F.ceil(F.lit(similarity) * n - 1e-9) + 1).cast("int")
    listed = (n - F.ceil(F.lit(2 * similarity / (1 + similarity)) * n - 1e-9) + 1).cast("int")
    rows = ranked.select("node", "n", listed.alias("listed"), alone.alias("alone"), F.posexplode(F.slice("rare", F.lit(1), F.greatest(asks - alone, F.lit(0)))).alias("i", "r"))
    at = F.col("alone") + F.col("i")
    return stored(rows.select("node", "n", "r.token", at.alias("at"), (at < F.col("listed")).alias("listed")), "rare")


def by_first(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different components: each with the first listed node of the list's most frequent component.

    That merges most groups at the cost of a row a posting.
    """
    per = rows.where("listed").groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    top = per.groupBy("token").agg(F.max(F.struct("n", F.col("label").alias("label"), "first")).alias("top")).select("token", F.col("top.label").alias("top_label"), F.col("top.first").alias("first"))
    return rows.join(top, "token").where("label <> top_label").select(*ordered(F.col("node"), F.col("first"))).distinct()


def by_all(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of nodes in different components that can be similar enough.

    A node meets every listed node that isn't larger, unless the two sizes, or what stands behind the shared
    shingle in both, rule the similarity out; the first shingle that two similar texts share always passes.
    The rows of a list's most frequent component never meet each other, so that no more pairs are tried
    than lie between components.
    """
    per = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("rows"))
    per = per.groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    mixed = stored(rows.join(per.where("labels > 1"), "token").select("token", "node", "n", "at", "listed", "label", (F.col("label") == F.col("top")).alias("top")), "mixed")
    other = mixed.where("listed").select("token", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "at", "label", "top")])
    smaller = F.struct("other_n", "other_node") < F.struct("n", "node")
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("other_n")) - 1e-9)
    behind = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))
    on = (F.col("label") != F.col("other_label")) & smaller & (behind >= least)
    met = mixed.where("not top").join(other, "token").where(on).select("node", "other_node")
    met = met.unionByName(mixed.where("top").join(other.where("not other_top"), "token").where(on).select("node", "other_node"))
    return met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose multisets are similar enough; ``sets`` has node and shingles."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(similarity_udf("x", "y") >= similarity).select("a", "b")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links: components of the components that they tie."""
    ends = stored(labelled(labelled(links, labels, "a", "a_label"), labels, "b", "b_label").select("a", "b", "a_label", "b_label"), "ends")
    up = components(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))).withColumnRenamed("label", "up")
    new = ends.select(F.col("a").alias("node"), F.col("a_label").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("b_label").alias("label")))
    every = labels.unionByName(new).distinct().join(up.withColumnRenamed("node", "label"), "label", "left")
    return stored(every.select("node", F.coalesce("up", "label").alias("label")), "labels")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles), stored, of the texts of ``wanted`` (node, h1, h2, first_id).

    Texts are read again rather than kept from the first pass; those that aren't wanted go before any shuffle, as long as
    the wanted ones are few enough to be broadcast."""
    few = wanted.count() <= BROADCAST_NODES
    keyed = docs.select(*text_key(F.col("text")), F.col("doc_id").alias("first_id"), "text").alias("k")
    wanted = F.broadcast(wanted.alias("w")) if few else wanted.alias("w")
    found = keyed.join(wanted, (F.col("k.h1") == F.col("w.h1")) & (F.col("k.h2") == F.col("w.h2")) & F.col("k.first_id").eqNullSafe(F.col("w.first_id")))
    # An id can stand on several rows with one text: of each node one text is hashed.
    once = found.select("w.node", "k.text", shingles_udf("k.text").alias("shingles")).drop("text")
    return stored(once.dropDuplicates(["node"]) if not few else once, "shingles")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: documents (doc_id, h1, h2, null hashes for texts without words) and their texts
    (h1, h2, node, first_id, copies, class_id, label). The class id is the smallest document id in the class."""
    h1, h2 = text_key(F.col("text"))
    signed = stored(docs.select("doc_id", h1, h2, bands_udf("text").alias("bands")), "signatures")
    rows = signed.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("bands").isNotNull(), F.col("h2")).alias("h2"))
    merged = signed.where("bands is not null").groupBy("h1", "h2")
    # Copies of a text have equal bands.
    nodes = merged.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first_id", "copies", "bands"), "nodes")

    met = shared(nodes.select(F.explode("bands").alias("bucket"), "node"))
    meeting = stored(nodes.drop("copies").join(met.select("node").distinct(), "node", "left_semi"), "meeting")
    sets = shingle_sets(docs, meeting.drop("bands"))
    labels = met.select("node", F.col("node").alias("label")).limit(0)
    seen = None

    def compare(pairs: DataFrame) -> bool:
        """Verify the pairs that no round has seen and merge the components that they link; whether there were any."""
        nonlocal labels, seen
        fresh = pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")
        fresh = stored(likely(fresh, meeting), "pairs")
        if not fresh.limit(1).count():
            return False
        seen = fresh if seen is None else seen.unionByName(fresh)
        links = stored(verified(fresh, sets, similarity).distinct(), "links")
        if not links.limit(1).count():
            return False
        labels = merged_labels(labels, links)
        return True

    open_ = met
    for find in (nearest, stars, within_small):
        if open_.limit(1).count() and compare(find(open_)) or open_ is met:
            open_ = still_open(open_.select(*met.columns), labels)
    large = open_.where(F.col("n") > SMALL)
    if large.limit(1).count():
        loose = stored(large.select("node").distinct(), "loose")
        rare = rare_shingles(loose, sets, similarity)
        compare(by_first(labelled(rare, labels)))
        compare(by_all(labelled(rare, labels), similarity))
    known = labelled(nodes.drop("bands"), labels)
    first = known.groupBy("label").agg(F.min("first_id").alias("class_id"))
    return rows, stored(known.join(first, "label").select("h1", "h2", "node", "first_id", "copies", "class_id", "label"), "classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest id of its class), n_copies (rows with its very text)."""
    rows, texts = classes(docs.select("doc_id", "text"), similarity)
    found = rows.join(texts, ["h1", "h2"], "left")
    return found.select("doc_id", F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the smallest id, with all its columns; texts without words all stay."""
    rows, texts = classes(docs.select("doc_id", "text"), similarity)
    # Of texts with the class's smallest id (the same id can stand with several texts) the smallest key stays.
    best = texts.where(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min(F.struct("h1", "h2", "first_id")).alias("k"))
    keep = best.select(F.col("k.h1").alias("__h1"), F.col("k.h2").alias("__h2"), F.col("k.first_id").alias("__id"))
    many = rows.where("h1 is not null").groupBy("h1", "h2", "doc_id").count().where("count > 1")
    many = many.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("doc_id").alias("__id"))
    keyed = docs.withColumns({"__h1": F.xxhash64(docs["text"]), "__h2": F.xxhash64(F.lit(1), docs["text"]), "__id": docs["doc_id"]})
    same = lambda a, b: (a["__h1"] == b["__h1"]) & (a["__h2"] == b["__h2"]) & a["__id"].eqNullSafe(b["__id"])
    worded = F.coalesce(docs["text"].rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    blank = keyed.where(~worded).select(*docs.columns)
    kept = keyed.where(worded).join(keep, same(keyed, keep), "left_semi")
    if many.limit(1).count():  # rows that are repeated with id and text: one of each stays
        again = kept.join(many, same(kept, many), "left_semi").dropDuplicates(["__h1", "__h2"])
        kept = kept.join(many, same(kept, many), "left_anti").unionByName(again)
    return kept.select(*docs.columns).unionByName(blank)


def op4_near_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
