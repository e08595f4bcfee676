"""Runs of repeated words against every stretch of every period."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import tandem

DATA = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of all runs: maximal stretches of each period, each kept for its smallest."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(words):
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    best = [*best, 1000 * best[1] // best[2]] if best else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return {"n_words": len(words), "runs": [list(r) for r in runs], "best": best, "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept).hexdigest()}


def made(r):
    """A text of few words: noise, repeats of random and of repeating stretches, copies of what stands before."""
    words = []
    while len(words) < r.randint(1, 120):
        kind, letters = r.random(), "abcdefghij"[: r.choice((1, 2, 3, 10))]
        part = [r.choice(letters) for _ in range(r.randint(1, 9))]
        if kind < 0.5:
            part = part * r.randint(2, 7) + part[: r.randint(0, len(part))]
        elif kind < 0.7 and words:
            a = r.randrange(len(words))
            part = words[a : a + r.randint(1, 60)]
        words += part
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    r = random.Random(seed)
    texts = [made(r) for _ in range(400)]
    got = tandem.summaries([" ".join(t) for t in texts])
    for words, row in zip(texts, got, strict=True):
        assert row == plain_row([w.encode() for w in words])


def test_fibonacci_and_powers():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    for text in (list(b), ["x"] * 700, list("ab" * 300 + "c" + "ab" * 200), list("aab" * 5 + "aabaab" + "b" + "aab" * 4)):
        assert tandem.summaries([" ".join(text)])[0] == plain_row([w.encode() for w in text])


def test_vocabulary_covers_every_square():
    """Each square of primitive root has a place in the vocabulary, each place is a square."""
    r = random.Random(3)
    for _ in range(200):
        words = np.array([r.randrange(2) for _ in range(r.randint(2, 40))] + [9])
        n = len(words) - 1
        index = tandem.Index(words)
        first, last, period = tandem.vocabulary(index, *tandem.covering(index, tandem.blocks(tandem.previous(index), [0], [n])))
        got = {(int(index.order[f]), int(q)) for f0, l0, q in zip(first, last, period, strict=True) for f in range(f0, l0 + 1)}
        primitive = lambda i, q: not any(q % d == 0 and (words[i : i + q - d] == words[i + d : i + q]).all() for d in range(1, q))  # noqa: E731, B023
        want = {(i, q) for q in range(1, n // 2 + 1) for i in range(n - 2 * q + 1) if (words[i : i + q] == words[i + q : i + 2 * q]).all() and primitive(i, q)}
        assert got == want


def test_altered():
    words = [str(k).encode() for k in range(100)]
    ids = [d for d in range(400) if tandem.altered(words, d) is not words]
    assert 20 < len(ids) < 60 and tandem.altered(words, None) is words and tandem.altered([], ids[0]) == []
    import zlib

    for d in ids:
        g = zlib.crc32(str(d).encode()) // 10
        a = g % 100
        p = 1 + (100 - a) // (3 + g % 8)
        assert tandem.altered(words, d) == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]


def test_query(spark):
    """The query over a whole table against the plain search."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in tandem.op11_tandem_runs(spark, DATA).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = tandem.altered((d["text"] or "").encode().split(), d["doc_id"])
        row, want = got[d["doc_id"]], plain_row(words) if len(words) < 2500 else None
        if want is None:
            continue
        some += len(want["runs"]) > 0
        assert [row[c] for c in ("start", "length", "period", "exponent_milli")] == (want["best"] or [None] * 4)
        assert (row["n_runs"], row["runs_sha256"], row["collapsed_sha256"]) == (len(want["runs"]), want["runs_sha256"], want["collapsed_sha256"])
    assert some > 10


def test_odd(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t ", 0), (None, "x x x x x x", 1), (4, "x x x x x", 2), (4, "x x x x x", 3), (5, "ab " * 200000, 4), (6, "            y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = [r["r"] for r in docs.select("runs", tandem.tandem_runs(F.col("text")).alias("r")).orderBy("runs").collect()]
    by_size = {r["n_words"]: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert [r["runs"] for r in got if r["n_words"] == 0] == [[]] * 3 and by_size[0]["collapsed_sha256"] == by_size[0]["runs_sha256"] == empty and by_size[0]["best"] is None
    assert by_size[6]["runs"] == [[0, 6, 1]] and by_size[5]["runs"] == [] and by_size[200000]["runs"] == [[0, 200000, 1]] and by_size[7]["runs"] == [[0, 6, 1]]
    assert docs.limit(0).select(tandem.tandem_runs(F.col("text"))).count() == 0
