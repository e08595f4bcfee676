"""Jaccard join of texts on their sets of word n-grams, by prefixes of token combinations.

A text is the set of its distinct shingles of four words (A-Z lower-cased; fewer words are one shingle), each a token, a
64-bit hash. Texts link when 100 * intersection >= PERCENT * union. Equal sets are first merged into one node.

All tokens have one order: by class, then by hash. Class 1 is rare tokens, class 2 frequent ones, class 3 very frequent
ones; the classes come from counts over all texts and only choose how a token is indexed, so that any choice gives the same
links. A token of class k counts in combinations of k: the tokens of classes 2 and 3 are dealt into groups by hash, the more
the larger the sets (``groups``), and every k tokens of a group are one entry of the index. Of a set of n tokens, at most
e = n - ceil(t n) are missing in a similar one. Each group can miss out on k - 1 shared tokens before it yields an entry, so
the prefix is prolonged until its tokens, less k - 1 for each group, number e + 1: then two similar sets share an entry. A
prefix of rare tokens alone is the usual one of e + 1 tokens. The smaller of two similar sets misses fewer,
n - ceil(2 t n / (1 + t)), and its entries within that shorter prefix are "listed": the larger asks, the smaller is listed.

Candidates are compared in rounds that leave out what already lies in one component: each node with the most central one
that it shares an entry with, then with the centers of all its lists, at last with every listed node of another component
that sizes, the tokens in front of the shared entry and those that no other set has allow. A sketch (counts of tokens
by hash bits) bounds each pair's intersection from above before the sets themselves decide. Nothing is capped: lists that
one component fills are never expanded, and no candidate between two components goes unseen.

Edge cases: null, empty and blank texts have the empty set and link with nothing. Repeated rows and texts of equal sets
share a component. A row without an id links like any other; the component's id is the smallest that is not null (null if
there is none). Very long texts are read whole. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.common import stored, table
from lakewright.llm.components import components
from lakewright.llm.minhash import _BASE, _INVERSE, _LOWER, _times_base, labelled, merged_labels, mix, nearest, overlap, stars, still_open, text_key
from lakewright.llm.quality import chunks

SHINGLE, PERCENT = 4, 85
#: Share of the texts from which a token is of class 2, and of class 3.
FREQUENT, VERY_FREQUENT = 1 / 2000, 1 / 100
#: Tokens of classes 2 and 3 at most, the most frequent ones (8 bytes each are sent to every task).
MAX_FREQUENT = 1 << 17
#: Tokens that are counted at once in a task, and texts of them that must hold a token for it to be counted on.
BLOCK_TOKENS, LEAST_SEEN = 2 << 20, 3
#: Sets of fewer tokens have no similar ones but equal ones, from 80 percent on.
LEAST = 4
#: Entries of a set that go along with each of its rows, so that a pair is met where it first shares one.
HEAD = 8
#: Bytes of text that are handled at once, and nodes up to which their keys are broadcast (50 bytes each).
CHUNK_BYTES, BROADCAST_NODES = 1 << 20, 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def token_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each text, in order of the text and the token, and the text of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    inside = ~_SPACE[b]
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
    width = np.minimum(n, size)
    count = np.where(n > 0, n - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    out = np.zeros(len(owner), np.uint64)
    for k in range(size):
        more = k < width[owner]
        out[more] = mix(out[more] * _BASE + word[at[more] + k])
    order = np.argsort(out)
    # By text, keeping the order of tokens; 16-bit numbers are sorted by radix.
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], owner[new]


def set_keys(tokens: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """(texts, 2) hashes of whole sets."""
    out = np.zeros((texts, 2), np.uint64)
    if len(tokens):
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for k, part in enumerate((mix(tokens + _BASE), mix(tokens ^ _INVERSE))):
            out[owner[at], k] = np.add.reduceat(part, at)
    return out


def missing(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a set of n can miss in a similar one, and in a similar one that isn't smaller."""
    return n - -(-percent * n // 100), n - -(-2 * percent * n // (100 + percent))


def groups(level: np.ndarray, kind: int) -> np.ndarray:
    """Into how many groups the tokens of a class are dealt for sets of 2^level tokens or more."""
    return np.maximum(1, (1 << level) // (32 if kind == 2 else 16))


def entries(tokens: np.ndarray, owner: np.ndarray, texts: int, frequent: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index entries of some sets: text, hash and code, in order of the text.

    ``frequent``: the sorted tokens of classes 2 and 3. The code of a single token is 2 * place + listed; that of a combination
    is -1, or -2 if it is listed. A set's combinations are made for its own size, and, listed ones alone, for the next power of two
    if a similar set can be that large."""
    kind = np.ones(len(tokens), np.int64)
    for k, known in zip((2, 3), frequent, strict=True):
        if len(known):
            found = np.searchsorted(known, tokens)
            kind[known[np.minimum(found, len(known) - 1)] == tokens] = k
    if (kind > 1).any():  # tokens come in order of the text and their hash
        order = np.argsort(owner * 4 + kind, kind="stable")
        tokens, owner, kind = tokens[order], owner[order], kind[order]
    n = np.bincount(owner, minlength=texts)
    begin = np.cumsum(n) - n
    place = np.arange(len(tokens)) - begin[owner]
    most, fewer = missing(n, percent)
    large = n >= LEAST
    single = (kind == 1) & (place <= most[owner]) & large[owner]
    at = np.flatnonzero(single)
    parts = [(owner[at], mix(tokens[at] ^ _BASE), 2 * place[at] + (place[at] <= fewer[owner[at]]))]
    level = np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 1
    for up in (0, 1):
        allowed = most if up == 0 else fewer
        # Tokens of frequent classes that can lie in a prefix; a rare token in front of them counts for one.
        rare = np.bincount(owner[kind == 1], minlength=texts)
        wide = large & (rare <= allowed) if up == 0 else large & (rare <= allowed) & (100 * n >= percent << (level + 1))
        at = np.flatnonzero((kind > 1) & wide[owner])
        if not len(at):
            continue
        own, k = owner[at], kind[at]
        dealt = np.where(k == 2, groups(level[own] + up, 2), groups(level[own] + up, 3))
        group = ((tokens[at] >> np.uint64(8)).astype(np.int64) & ((1 << 40) - 1)) % dealt
        by = np.lexsort((np.arange(len(at)), group, k, own))
        head = np.ones(len(at), bool)
        head[1:] = (own[by][1:] != own[by][:-1]) | (k[by][1:] != k[by][:-1]) | (group[by][1:] != group[by][:-1])
        first = np.flatnonzero(head)
        rank = np.empty(len(at), np.int64)
        rank[by] = np.arange(len(at)) - first[np.cumsum(head) - 1]
        counts = (rank >= k - 1).astype(np.int64)
        before = np.cumsum(counts) - counts  # within a text, as class 2 stands in front of class 3
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        before -= before[start][np.cumsum(np.concatenate([[True], own[1:] != own[:-1]])) - 1]
        before += rare[own]
        inside, listed = before <= allowed[own], before <= fewer[own]
        by = by[inside[by]]
        key = np.stack([own[by], k[by], group[by]])
        head = np.ones(len(by), bool)
        head[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(by)))
        for kinds in (2, 3):
            for p in np.unique(size[(k[by][first] == kinds) & (size >= kinds)]).tolist():
                rows = first[(k[by][first] == kinds) & (size == p)]
                member = by[rows[:, None] + np.arange(p)]
                for chosen in combinations(range(p), kinds):
                    x = member[:, chosen]
                    h = mix(_times_base(kinds) + (level[own[x[:, 0]]] + up).astype(np.uint64))
                    for c in range(kinds):
                        h = mix(h * _BASE + tokens[at[x[:, c]]])
                    parts.append((own[x[:, 0]], h, np.where(listed[x[:, -1]], -2, -1)))
    text, sig, code = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], sig[order], code[order]


def sketches(tokens: np.ndarray, owner: np.ndarray, texts: int) -> list[bytes | None]:
    """Counts of each set's tokens by their low bits, a byte each, about one for each 4 to 8 tokens; None if one is over 255."""
    n = np.bincount(owner, minlength=texts)
    width = 1 << np.maximum(np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 3, 3)
    begin = np.cumsum(width) - width
    counts = np.bincount(begin[owner] + (tokens & (width[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=int(width.sum()))
    return [None if (c := counts[a : a + w]).max() > 255 else c.astype(np.uint8).tobytes() for a, w in zip(begin.tolist(), width.tolist(), strict=True)]


def frequent_tokens(texts: DataFrame, text: str = "text") -> list[np.ndarray]:
    """The tokens of class 2 and of class 3, from counts of the sets of all texts.

    A task counts block by block and passes on what LEAST_SEEN of a block's sets (and half the share sought) hold, so that one-off
    tokens, nearly all, are never shuffled; the rest are summed. At most MAX_FREQUENT tokens come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, sets, size = [], set(), 0, 0

        def out() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            on = n >= max(LEAST_SEEN, sets * FREQUENT / 2)
            return pa.RecordBatch.from_arrays([pa.array(np.append(token[on].view(np.int64), 0)), pa.array(np.append(n[on], sets)), pa.array(np.append(np.zeros(on.sum(), bool), True))], names=["token", "n", "total"])

        for batch in batches:
            for part in chunks(batch.column(0), CHUNK_BYTES):
                tokens, owner = token_sets(part)
                key = set_keys(tokens, owner, len(part))
                fresh = np.zeros(len(part), bool)
                for i in np.unique(owner).tolist():
                    if (k := key[i].tobytes()) not in keys:
                        keys.add(k)
                        fresh[i] = True
                held.append(tokens[fresh[owner]])
                size += len(held[-1])
                sets += int(fresh.sum())
                if size >= BLOCK_TOKENS:
                    yield out()
                    held, keys, sets, size = [], set(), 0, 0
        if sets:
            yield out()

    counted = stored(texts.select(text).mapInArrow(count, "token long, n long, total boolean"), "counted")
    sets = counted.where("total").agg(F.sum("n")).first()[0] or 0
    seen = counted.where("not total").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2 * LEAST_SEEN, sets * FREQUENT))
    top = seen.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).collect()
    of = lambda rows: np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))
    very = sets * VERY_FREQUENT
    return [of([r for r in top if r["n"] < very]), of([r for r in top if r["n"] >= very])]


INDEXED = "struct<h1: long, h2: long, n: long, sketch: binary, singles: long, entries: array<long>, codes: array<int>>"


def indexed(text: Column, frequent: list[np.ndarray], percent: int = PERCENT) -> Column:
    """A struct for each text: its set's key and size, sketch, number of single entries, entries and codes; null for the empty set."""
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("singles", pa.int64()), ("entries", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))])

    @F.arrow_udf(INDEXED)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in chunks(texts, CHUNK_BYTES):
            tokens, owner = token_sets(part)
            n = np.bincount(owner, minlength=len(part))
            keys = set_keys(tokens, owner, len(part)).view(np.int64).tolist()
            of, sig, code = entries(tokens, owner, len(part), frequent, percent)
            cut = np.searchsorted(of, np.arange(len(part) + 1))
            sig, code = sig.view(np.int64), code.astype(np.int32)
            singles = np.bincount(of[code >= 0], minlength=len(part)).tolist()
            for i, s in enumerate(sketches(tokens, owner, len(part))):
                a, b = cut[i], cut[i + 1]
                out.append({"h1": keys[i][0], "h2": keys[i][1], "n": int(n[i]), "sketch": s, "singles": singles[i], "entries": sig[a:b], "codes": code[a:b]} if n[i] else None)
        return pa.array(out, kind)

    return run(text)


@F.arrow_udf(T.BinaryType())
def sets_udf(texts: pa.Array) -> pa.Array:
    """The sorted distinct tokens of each text, 8 bytes each."""
    out = []
    for part in chunks(texts, CHUNK_BYTES):
        tokens, owner = token_sets(part)
        cut = np.searchsorted(owner, np.arange(len(part) + 1))
        out += [tokens[cut[k] : cut[k + 1]].tobytes() for k in range(len(part))]
    return pa.array(out, pa.binary())


@F.arrow_udf(T.LongType())
def bound_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """An upper bound of the intersection by two sketches, the wider one folded; a bound for anything if there is none."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = x.as_py(), y.as_py()
        if x is None or y is None:
            out.append(1 << 62)
            continue
        x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
        width = min(len(x), len(y))
        out.append(int(np.minimum(x.reshape(-1, width).sum(0), y.reshape(-1, width).sum(0)).sum()))
    return pa.array(out, pa.int64())


@F.arrow_udf(T.BooleanType())
def similar_udf(a: pa.Array, b: pa.Array, percent: pa.Array) -> pa.Array:
    """Whether two sets link."""
    out = []
    for x, y, p in zip(a, b, percent, strict=True):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        same = overlap(x, y)
        out.append(100 * same >= p.as_py() * (len(x) + len(y) - same))
    return pa.array(out, pa.bool_())


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")))
    return sized.where((100 + percent) * bound_udf("a_sketch", "b_sketch") >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their sets, made again from the texts of those nodes."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(nodes.select("node", "rep").join(ends, "node", "left_semi"), "wanted")
    few = wanted.count() <= BROADCAST_NODES
    w = (F.broadcast(wanted) if few else wanted).alias("w")
    t1, t2 = text_key(F.col("text"))
    keyed = docs.select(t1.alias("t1"), t2.alias("t2"), "doc_id", "text").alias("k")
    found = keyed.join(w, (F.col("k.t1") == F.col("w.rep.t1")) & (F.col("k.t2") == F.col("w.rep.t2")) & F.col("k.doc_id").eqNullSafe(F.col("w.rep.doc_id")))
    # An id can stand on several rows with one text: all give one set.
    sets = stored(found.select("w.node", sets_udf("k.text").alias("tokens")), "sets")
    sets = sets.dropDuplicates(["node"])
    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(similar_udf("x", "y", F.lit(percent))).select("a", "b")


def met_first(rows: DataFrame) -> DataFrame:
    """The entries (token, node, n, code, at, listed) with ``earlier``: the node's first entries before this one, and ``head``: its
    first listed entries; HEAD of them at most. Single entries come in order of their place, then combinations in order of their hash."""
    entry = F.struct((F.col("code") < 0).alias("many"), F.when(F.col("code") >= 0, F.col("code")).alias("place"), "token", "at", "listed")
    each = rows.groupBy("node", "n").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    tokens = lambda e: F.transform(F.slice(e, 1, HEAD), lambda x: x["token"])
    each = each.select("node", "n", tokens(F.col("e")).alias("first"), tokens(F.filter("e", lambda x: x["listed"])).alias("head"), F.posexplode("e").alias("i", "x"))
    return each.select("x.token", "node", "n", "x.at", "x.listed", F.slice("first", F.lit(1), F.least(F.col("i"), F.lit(HEAD))).alias("earlier"), "head")


def between(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of nodes in different components that can be similar: the larger asks, the smaller is listed.

    Sizes, and what neither set shares with the other if the entry is their first shared one (``at``), rule out most; a pair that shares
    an earlier entry, as far as the heads tell, is left to that one. The rows of a list's most frequent component never meet each
    other, so that no more pairs are tried than lie between components."""
    per = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("rows"))
    per = per.groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    mixed = stored(rows.join(per.where("labels > 1"), "token").select("token", "node", "n", "at", "listed", "label", (F.col("label") == F.col("top")).alias("top"), "earlier", "head"), "mixed")
    other = mixed.where("listed").select("token", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "at", "label", "top", "head")])
    smaller = F.struct("other_n", "other_node") < F.struct("n", "node")
    least = F.ceil(percent * (F.col("n") + F.col("other_n")) / (100 + percent) - 1e-9)
    behind = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))
    on = (F.col("label") != F.col("other_label")) & smaller & (behind >= least) & ~F.arrays_overlap("earlier", "other_head")
    met = mixed.where("not top").join(other, "token").where(on).select("node", "other_node")
    met = met.unionByName(mixed.where("top").join(other.where("not other_top"), "token").where(on).select("node", "other_node"))
    return met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def centered(met: DataFrame) -> DataFrame:
    """(bucket, node, n, weight, center, center_weight), stored, of lists (bucket, node, n) of n nodes: how many others a node meets in all
    its lists, and the list's node of most weight, the smallest of equal ones."""
    weighed = stored(met.join(met.groupBy("node").agg(F.sum("n").alias("weight")), "node"), "weighed")
    top = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("top"))
    return stored(weighed.join(top, "bucket").select("bucket", "node", "n", "weight", (-F.col("top.node")).alias("center"), F.col("top.weight").alias("center_weight")), "lists")


def components_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a document (doc_id, text): doc_id, n_shingles and component_id. ``percent`` is 80 to 100: below, small sets could
    end before their prefix does."""
    if not 80 <= percent <= 100:
        raise ValueError(f"percent must be 80 to 100, not {percent}")
    docs = docs.select("doc_id", "text")
    t1, t2 = text_key(F.col("text"))
    made = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), indexed(F.col("text"), frequent_tokens(docs), percent).alias("i"))
    signed = stored(made.select("doc_id", "t1", "t2", "i.*"), "indexed")
    merged = signed.where("n is not null").groupBy("h1", "h2", "n")
    rep = F.min(F.struct("doc_id", "t1", "t2")).alias("rep")
    nodes = merged.agg(rep, F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("sketch", "singles", "entries", "codes")])
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    rows = nodes.select(F.explode(F.arrays_zip("entries", "codes")).alias("e"), "node", "n").select(F.col("e.entries").alias("token"), "node", "n", F.col("e.codes").alias("code"))
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    rows = stored(rows.join(lists, "token"), "entries")
    met = centered(rows.select(F.col("token").alias("bucket"), "node", F.col("seen").alias("n")))
    labels = none = met.select("node", F.col("node").alias("label")).limit(0)
    nodes_small = nodes.select("node", "n", "sketch", "rep")

    def compare(pairs: DataFrame) -> None:
        """Verify some pairs and merge the components that they link."""
        nonlocal labels
        fresh = stored(likely(pairs, nodes_small, percent), "pairs")
        if not fresh.limit(1).count():
            return
        links = stored(linked(fresh, docs, nodes_small, percent), "links")
        if links.limit(1).count():
            labels = components(links) if labels is none else merged_labels(labels, links)

    compare(nearest(met))
    open_ = still_open(met, labels)
    compare(stars(open_))
    open_ = still_open(open_.select(*met.columns), labels)
    if open_.limit(1).count():
        # What two similar sets can't share. If their first common token is rare, neither has another before it in common, nor any
        # that no other set has; if it isn't, they have no rare token in common.
        single, own = F.col("code") >= 0, Window.partitionBy("node")
        before = F.coalesce(F.count_if(single).over(own.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        alone = F.col("singles") - F.count_if(single).over(own)
        here = nodes.select("node", "singles").join(open_.select("node").distinct(), "node", "left_semi")
        placed = rows.join(here, "node").select("token", "node", "n", "code", F.when(single, alone + before).otherwise(F.col("singles")).alias("at"), F.when(single, F.col("code") % 2 == 1).otherwise(F.col("code") == -2).alias("listed"))
        left = placed.join(open_.select(F.col("bucket").alias("token")).distinct(), "token", "left_semi")
        compare(between(stored(labelled(met_first(left), labels), "last"), percent))

    known = stored(labelled(nodes.select("node", "h1", "h2", "n", "first_id"), labels), "components")
    first = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    sets = known.join(first, "label").select("h1", "h2", "n", "component_id")
    out = signed.select("doc_id", "h1", "h2", "n").join(sets, ["h1", "h2", "n"], "left")
    empty = F.col("n").isNull()
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM d),
  t AS MATERIALIZED (SELECT r, unnest(s) AS t FROM s),
  o AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM t a JOIN t b ON a.t = b.t AND a.r <> b.r GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT a, b FROM o JOIN s x ON o.a = x.r JOIN s y ON o.b = y.r WHERE 100 * n >= {PERCENT} * (len(x.s) + len(y.s) - n)),
  c AS (SELECT r AS a, r AS b FROM s UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE m.id END AS component_id
  FROM s JOIN (SELECT a, min(doc_id) AS id FROM c JOIN s ON c.b = s.r GROUP BY a) m ON m.a = s.r"""
