"""Runs of repeated words in texts, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, as long as four periods and MIN_WORDS words at least, that neither
neighbour prolongs with that period. All texts of a chunk are handled at once, as arrays:

1. ``Index``: names of all substrings of 1, 2, 4 ... words (equal names, equal words), which give the order of the
   suffixes and, by descending powers of two, the longest common extension of any two places to either side.
2. ``blocks``: the Lempel-Ziv blocks; each is the longest that occurs before (overlaps allowed), or a new word.
3. ``covering``: the leftmost occurrence of a square has its right half in two blocks at most, so it is found around a
   block's start h by comparing h with h - k and h + k, k up to the lengths of the block and the one before. The stretches
   of period k found there cover the leftmost occurrences of all squares.
4. ``vocabulary``: suffix links from the first square of such a stretch, followed as long as the next word is the
   square's first, lead to all its rotations; each is marked once at its place in the suffix tree, which is an interval of the
   ordered suffixes and a length.
5. ``located``: the suffixes below the marked places are the occurrences of all squares of primitive root; those of one
   period at consecutive words merge into runs.

Before that, words whose four-word window occurs but once in the text are cut out, as no run holds such a window; the
stretches that are left are texts of their own. Squares of roots that are repeats themselves are left out in step 3: their
occurrences lie in the runs of the shorter period, and there can be quadratically many of them.

Texts are read whole. Edge cases: a null text has no words; a null, empty or blank text has no runs (four nulls, and the
digests of the empty string). A row without an id is never altered by ``altered``. Repeated rows get equal rows; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.common import table

MIN_WORDS, EXPONENT, WINDOW = 6, 4, 4
#: Words of the texts that are handled at once in a worker.
CHUNK_WORDS = 1 << 18

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("best", T.ArrayType(T.LongType())),
        T.StructField("runs_sha256", T.StringType()),
        T.StructField("collapsed_sha256", T.StringType()),
    ]
)


def _places(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers first, first + 1, ... (n of them) of several ranges, and the range of each."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.asarray(first)[of], of


def _first_of(*columns: np.ndarray, key: int) -> tuple[np.ndarray, ...]:
    """The rows of some columns in order, of those that agree in the first ``key`` columns the first."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:key]], axis=0)
    return tuple(c[new] for c in columns)


class Index:
    """Names, suffix order and common extensions of some texts: ``words`` joins them, each ended by a number of its own."""

    def __init__(self, words: np.ndarray) -> None:
        self.size = len(words)
        name = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.names = [name.astype(np.int32)]
        step = 1
        while name.max(initial=-1) < self.size - 1:
            after = np.full(self.size, -1, np.int64)
            after[: max(self.size - step, 0)] = name[step:]
            name = np.unique(name * (self.size + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
            self.names.append(name.astype(np.int32))
            step *= 2
        self.table = np.stack(self.names)
        self.rank = name
        self.order = np.empty(self.size, np.int64)
        self.order[name] = np.arange(self.size)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i and j differ."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][i] == self.names[k][j]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i - 1 and j - 1 are equal."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (a >= 0) & (b >= 0)
            same &= self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)]
            i[same], j[same] = a[same], b[same]
        return start - i

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from i and from j on are equal, by the names of their first and last 1, 2, 4 ... words."""
        level = np.frexp(length)[1] - 1  # floor of the binary logarithm
        rest = length - (1 << level)
        far = (level >= len(self.names)) | (j + rest >= self.size)
        level, rest = np.where(far, 0, level), np.where(far, 0, rest)
        same = (self.table[level, i] == self.table[level, j]) & (self.table[level, i + rest] == self.table[level, j + rest])
        return (i == j) | (same & ~far)

    def interval(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last of the ordered suffixes that begin with the ``length`` words from i on, by bisection."""
        out = []
        for side in (-1, 1):
            at = self.rank[i]  # the farthest suffix known to be inside; all between are
            step = 1 << max(int(self.size).bit_length() - 1, 0)
            while step:
                to = at + side * step
                inside = (to >= 0) & (to < self.size)
                inside &= self.equal(i, self.order[np.where(inside, to, 0)], length)
                at = np.where(inside, to, at)
                step //= 2
            out.append(at)
        return out[0], out[1]


def previous(index: Index) -> np.ndarray:
    """For each place the length of the longest factor that begins there and at an earlier place, too: the better of the
    nearest earlier places before and after it in the order of the suffixes."""
    n, order = index.size, index.order.tolist()
    near = []
    for around in (order, order[::-1]):
        stack, found = [], [-1] * n
        for place in around:
            while stack and stack[-1] > place:
                stack.pop()
            if stack:
                found[place] = stack[-1]
            stack.append(place)
        near.append(np.array(found, np.int64))
    best = np.zeros(n, np.int64)
    for other in near:
        has = np.flatnonzero(other >= 0)
        best[has] = np.maximum(best[has], index.ahead(has, other[has]))
    return best


def blocks(longest: np.ndarray, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The starts and lengths of the Lempel-Ziv blocks that don't begin a text, the length of the block before, and the text's ends."""
    known, h, size, before, low, high = longest.tolist(), [], [], [], [], []
    for start, end in zip(starts, ends, strict=True):
        at, last = start, 0
        while at < end:
            n = max(1, known[at])
            if at > start:
                h.append(at)
                size.append(n)
                before.append(last)
                low.append(start)
                high.append(end)
            at, last = at + n, n
    return tuple(np.array(x, np.int64) for x in (h, size, before, low, high))


def covering(index: Index, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of stretches of two periods or more that cover the leftmost occurrences of all squares of
    primitive root."""
    h, size, before, low, high = found
    left, of_left = _places(np.ones(len(h), np.int64), np.minimum(size + before, h - low))
    right, of_right = _places(np.ones(len(h), np.int64), np.minimum(size, high - h - 1))
    a = np.concatenate([h[of_left] - left, h[of_right]])
    k = np.concatenate([left, right])
    back, on = index.behind(a, a + k), index.ahead(a, a + k)
    square = back + on >= k
    start, length, period = a[square] - back[square], on[square] + back[square] + k[square], k[square]
    # Of stretches with the same ends the one of the shortest period.
    return _first_of(start, length, period, key=2)


def vocabulary(index: Index, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, period) of the suffix-tree places of all squares that occur, each once.

    A suffix link leads from a square to its words but the first; the walk goes on if the stretch's next word is that first
    one, so that the words up to the end of the stretch are all that it reads, and ends when it has come around."""
    at, of = _places(start, np.minimum(length - 2 * period + 1, period))
    first, last = index.interval(at, 2 * period[of])
    return _first_of(first, last, period[of], key=3)


def located(index: Index, first: np.ndarray, last: np.ndarray, period: np.ndarray) -> np.ndarray:
    """(start, length, period) of the runs, merged from all occurrences of the squares, in order."""
    rank, of = _places(first, last - first + 1)
    at, q = index.order[rank], period[of]
    ordered = np.lexsort((at, q))
    at, q = at[ordered], q[ordered]
    begins = np.ones(len(at), bool)
    begins[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(begins)
    tails = np.append(heads[1:], len(at)) - 1
    runs = np.stack([at[heads], at[tails] - at[heads] + 2 * q[heads], q[heads]]) if len(at) else np.zeros((3, 0), np.int64)
    runs = runs[:, runs[1] >= np.maximum(MIN_WORDS, EXPONENT * runs[2])]
    return runs[:, np.lexsort((runs[2], runs[0]))]


def runs_of(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, period) of the runs of the texts ids[start:end], each taken by itself, in order."""
    n = ends - starts
    if not len(n):
        return np.zeros((3, 0), np.int64)
    to = np.cumsum(n + 1) - n - 1  # a place more for each text's end
    at, of = _places(starts, n)
    words = np.empty(int(n.sum()) + len(n), np.int64)
    place = at - starts[of] + to[of]
    name = np.unique(of * np.int64(len(ids)) + ids[at], return_inverse=True)[1]  # no two texts share a name
    words[place] = name
    words[to + n] = name.max(initial=0) + 1 + np.arange(len(n))
    index = Index(words)
    cover = covering(index, blocks(previous(index), to.tolist(), (to + n).tolist()))
    if not len(cover[0]):
        return np.zeros((3, 0), np.int64)
    runs = located(index, *vocabulary(index, *cover))
    text = np.searchsorted(to, runs[0], side="right") - 1
    runs[0] += starts[text] - to[text]
    return runs[:, np.lexsort((runs[2], runs[0]))]


def repeated_stretches(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of MIN_WORDS words or more all of whose four-word windows occur again in their
    text. ``ids``: numbers of words, no two texts sharing one. Windows go by hash, so a stretch may be too long, never too short."""
    m = len(ids) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, word = np.zeros(m, np.uint64), ids.astype(np.uint64)
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[k : m + k] + np.uint64(1)
    whole = doc[:m] == doc[WINDOW - 1 :]
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(m, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again &= whole
    first = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]]) | again & np.concatenate([[True], doc[1:m] != doc[: m - 1]]))
    stop = np.flatnonzero(again & ~np.concatenate([again[1:], [False]]) | again & np.concatenate([doc[1:m] != doc[: m - 1], [True]]))
    long = stop - first + WINDOW >= MIN_WORDS
    return first[long], stop[long] + WINDOW


def _chunk(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text (start, length, period), given as words."""
    parts, base = [], 0
    for words in texts:
        number: dict[bytes, int] = dict(zip(words, range(len(words)), strict=True))
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)) + base)
        base += len(words)
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), size)
    runs = runs_of(ids, *repeated_stretches(ids, doc))
    cut = np.searchsorted(runs[0], np.append(begin, len(ids)))
    return [runs[:, a:b] - np.array([[s], [0], [0]]) for a, b, s in zip(cut[:-1], cut[1:], begin, strict=True)]


def summary(words: list[bytes], runs: np.ndarray) -> dict:
    """The row of RESULT of a text of some words and its runs."""
    each = list(zip(*runs.tolist(), strict=True))
    best = max(each, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = words
    if each:
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[0] + runs[2], 1)
        np.add.at(drop, runs[0] + runs[1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in each)
    return {
        "n_words": len(words), "runs": [list(r) for r in each], "best": [*best, 1000 * best[1] // best[2]] if best else None,
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
    }


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document after the contract's rule: of one id in ten the words from a place on repeat a period."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // len(period) + 1))[: n - a]


def summaries(texts: list[str | None], ids: list[int | None] | None = None) -> list[dict]:
    """The rows of RESULT of some texts; with ids, of the texts that ``altered`` makes of them."""
    out, part, size = [], [], 0

    def flush() -> None:
        out.extend(summary(w, r) for w, r in zip(part, _chunk(part), strict=True))
        part.clear()

    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        part.append(altered(words, ids[k]) if ids is not None else words)
        size += len(words)
        if size >= CHUNK_WORDS:
            flush()
            size = 0
    flush()
    return out


@F.arrow_udf(RESULT)
def tandem_udf(texts: pa.Array) -> pa.Array:
    return pa.array(summaries([t.as_py() for t in texts]), pa_type())


@F.arrow_udf(RESULT)
def altered_udf(texts: pa.Array, ids: pa.Array) -> pa.Array:
    return pa.array(summaries([t.as_py() for t in texts], [i.as_py() for i in ids]), pa_type())


def pa_type() -> pa.DataType:
    longs = pa.list_(pa.int64())
    return pa.struct([("n_words", pa.int64()), ("runs", pa.list_(longs)), ("best", longs), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def tandem_runs(text: Column) -> Column:
    """A struct for each text: n_words, runs ([start, length, period] each, by start, then period), best (of the greatest
    exact exponent: start, length, period and floor(1000 * length / period)) and the two digests."""
    return tandem_udf(text)


def op11_tandem_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", altered_udf("text", F.col("doc_id").cast("long")).alias("r"))
    best = [F.col("r.best")[k].alias(c) for k, c in enumerate(("start", "length", "period", "exponent_milli"))]
    return found.select("doc_id", F.size("r.runs").cast("long").alias("n_runs"), *best, "r.runs_sha256", "r.collapsed_sha256")
