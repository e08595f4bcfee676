"""The n-gram join against all pairs of sets."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from lakewright.llm import ngram_join

SCHEMA = "doc_id long, text string"


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_components(rows, percent=85):
    """(doc_id, size, component) of all rows, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            up[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return sorted(((d, len(s), ids.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed, families=14):
    """Families of near copies of texts of all lengths, with passages and openings that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    shared_passages = [[word() for _ in range(r.randint(5, 40))] for _ in range(3)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(r.choice((3, 5, 8, 9, 11, 15, 30, 60, 200, 400)))]
        if r.random() < 0.5:
            base = base[:5] + r.choice(shared_passages) + base[5:]
        for _ in range(r.choice((1, 2, 5, 12, 30))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, len(base) // 50))):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = [word() for _ in range(r.randint(0, 2))]
            rows.append((len(rows), " ".join(w)))
    for p in shared_passages:  # texts that are little but a passage
        for k in range(20):
            rows.append((len(rows), " ".join(p + [word() for _ in range(k % 5)])))
    r.shuffle(rows)
    return rows


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "frequent", "percent"), [(1, (1 / 2000, 1 / 100), 85), (2, (0.004, 0.02), 85), (3, (0.004, 0.03), 80), (4, (1e-9, 1e-9), 90)])
def test_brute_force(spark, monkeypatch, seed, frequent, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent[0])
    monkeypatch.setattr(ngram_join, "VERY_FREQUENT", frequent[1])
    rows = corpus(seed)
    monkeypatch.setattr(ngram_join, "LEAST_SEEN", 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(ngram_join.components_of(docs, percent)) == plain_components(rows, percent)


@pytest.mark.parametrize("seed", range(30))
def test_every_link_shares_an_entry(seed):
    """Of two sets that link, the larger has an entry that the smaller has listed, whatever the classes."""
    r = random.Random(seed)
    universe = np.array(r.sample(range(1, 1 << 62), 5000), np.uint64)
    frequent = [np.sort(universe[r.choice((0, 100, 2000)) : 2500]), np.sort(universe[2500 : r.choice((2500, 3000, 5000))])]
    for _ in range(60):
        n = r.choice((4, 5, 6, 7, 8, 13, 20, 31, 32, 33, 63, 64, 100, 130, 300, 700))
        low = r.choice((0, 0, 1500, 2400, 2600))
        a = set(r.sample(range(low, min(5000, low + r.choice((n + 200, 5000)))), min(n, 4900 - low)))
        b = set(a)
        for _ in range(r.randint(0, max(1, n // 6))):
            if r.random() < 0.5 and len(b) > 1:
                b.discard(r.choice(sorted(b)))
            if r.random() < 0.5:
                b.add(r.randrange(5000))
        tokens = [np.sort(universe[sorted(s)]) for s in (a, b)]
        owner = np.repeat([0, 1], [len(a), len(b)])
        of, sig, code = ngram_join.entries(np.concatenate(tokens), owner, 2, frequent)
        if 100 * len(a & b) < 85 * len(a | b) or a == b:
            continue
        large, small = (0, 1) if len(a) >= len(b) else (1, 0)
        listed = (code == -2) | (code >= 0) & (code % 2 == 1)
        asked, found = set(sig[of == large].tolist()), set(sig[(of == small) & listed].tolist())
        assert asked & found
        if len(a) == len(b):
            assert set(sig[of == small].tolist()) & set(sig[(of == large) & listed].tolist())
        x, y = ngram_join.sketches(np.concatenate(tokens), owner, 2)
        wide = [np.frombuffer(s, np.uint8).astype(int) for s in (x, y)]
        w = min(map(len, wide))
        assert np.minimum(*(s.reshape(-1, w).sum(0) for s in wide)).sum() >= len(a & b)


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(ngram_join.ORACLE_SQL).fetchall())
    got = result(ngram_join.op13_ngram_join(spark, "/root/testdata/sf0.01"))
    assert sorted(got) == want and len({c for _, _, c in want}) < len(want)


def test_odd(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Tiny text"), (4, "tiny  TEXT"), (None, "tiny text"), (None, None), (5, "word " * 30000), (6, "Word word\tword word"), (None, "lonely words that no other row has"), (7, "Ä b c d e"), (8, "ä b c d e")]
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA + ", node long, n long, rep string")
    assert result(ngram_join.components_of(docs)) == plain_components(rows)
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    assert result(ngram_join.components_of(docs)) == plain_components(rows)
    assert ngram_join.components_of(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.components_of(docs, 50)
