"""Decontamination, line dedup, near duplicates, URL filter, secrets and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import components, decontam, line_dedup, minhash, queries, secrets, url_filter

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, key string"
ODD = [(d, t, None, "s", None, "r", "w", "k") for d, t in [(1, None), (2, ""), (3, " \n "), (4, "tiny"), (4, "tiny"), (None, "no id and some words here"), (5, "word " * 30000)]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    result = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_decontamination_odd(spark, odd):
    items = spark.createDataFrame([(1, "Tiny"), (1, "tiny"), (2, None), (3, "!!"), (None, "some words here"), (9, "word " * 13)], "item_id long, text string")
    rows = {(r["doc_id"], r["n_words"]): r for r in decontam.report(odd.select("doc_id", "text"), items).collect()}
    assert len(rows) == 6  # the repeated row is equal
    assert rows[(4, 1)]["contaminated"] and rows[(4, 1)]["n_items"] == 1
    assert rows[(None, 6)]["n_hit"] == 3 and rows[(None, 6)]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[(5, 30000)]["n_hit"] == 30000
    assert rows[(1, 0)]["n_hit"] == 0 and not rows[(1, 0)]["contaminated"]
    left = decontam.drop_contaminated(odd, items)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3}
    assert decontam.report(odd.select("doc_id", "text"), items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.report(odd.select("doc_id", "text").limit(0), items).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = sorted(map(str, decontam.report(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontam.report(docs, items).collect())) == want


def test_long_text_without_broadcast(spark, monkeypatch):
    """A text of 200,000 words whose rows are shuffled: a word's row holds neither the text nor the document."""
    import time

    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    item = " ".join(f"w{k}" for k in range(20))
    text = " ".join(f"x{k % 977}" for k in range(100_000)) + " " + item + " " + " ".join(f"y{k % 991}" for k in range(99_980))
    docs = spark.createDataFrame([(1, text), (2, "x1 x2")], "doc_id long, text string")
    began = time.perf_counter()
    row = decontam.report(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).where("doc_id = 1").first()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (200_000, 20, 1) and time.perf_counter() - began < 60


def test_proximity(spark):
    item = "alpha one two beta three four gamma five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "x alpha y beta z gamma"), (2, "alpha " + "q " * 60 + "beta gamma")], "doc_id long, text string")
    filler = spark.createDataFrame([(k, "one two three four five six seven eight nine ten") for k in range(3, 9)], "doc_id long, text string")
    rows = {r["doc_id"]: r["n_near_items"] for r in decontam.report(docs.unionByName(filler), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert rows[1] == 1 and rows[2] == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(s, k, r, letters):
    s = list(s)
    for _ in range(k):
        at = r.randrange(len(s) + 1)
        what = r.randrange(3)
        if what == 0:
            s.insert(at, r.choice(letters))
        elif at < len(s):
            s[at : at + 1] = [] if what == 1 else [r.choice(letters)]
    return "".join(s)


def test_banded_distance(spark):
    r = random.Random(3)
    rows = [(a, changed(a, r.randrange(5), r, "abé😀")) for a in ("".join(r.choice("abé😀") for _ in range(r.randint(0, 25))) for _ in range(300))]
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        for row in df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), t).alias("d")).collect():
            want = distance(row["a"], row["b"])
            assert row["d"] == (want if want <= t else None)


@pytest.mark.parametrize("hot", [10**9, 3])
def test_segment_join_is_complete(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r, lines = random.Random(4), set()
    while len(lines) < 150:
        a = "".join(r.choice("ab") for _ in range(r.randint(8, 14)))
        lines |= {x for x in (a, changed(a, 1, r, "ab"), changed(a, 2, r, "ab")) if len(x) >= 6}
    lines = sorted(lines)
    found = {(x["a"], x["b"]) for x in line_dedup._candidates(spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(lines)], "id long, line string, length int"), 2).collect()}
    assert {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if distance(lines[i], lines[j]) <= 2} <= found


def slow_line_dedup(docs, threshold, least):
    doc_of = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(line) >= least:
                doc_of[line] = min(doc_of.get(line, 1 << 63), d)
    gone = {b if (doc_of[a], a.encode()) < (doc_of[b], b.encode()) else a for a, b in itertools.combinations(doc_of, 2) if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold}
    out = []
    for d, text in docs:
        seen, kept = set(), []
        for line in (text or "").split("\n"):
            if len(line) < least or (line not in gone and doc_of[line] == d and line not in seen):
                kept.append(line)
            seen.add(line)
        out.append((d, None if text is None else "\n".join(kept)))
    return out


def test_line_dedup(spark, odd):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefé ") for _ in range(r.randint(35, 60))) for _ in range(25)]
    docs = []
    for d in range(40):
        lines = [r.choice((x, x, changed(x, r.randint(1, 3), r, "abc"))) for x in r.sample(base, r.randint(1, 4))] + r.sample(["short", "", "tiny"], 2)
        docs.append((d, "\n".join(lines)))
    docs += [(99, None), (98, "")]
    df = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, line string")
    got = line_dedup.dedup_lines(df, 2, 30)
    assert sorted((x["doc_id"], x["text"] or "") for x in got.collect()) == sorted((d, t or "") for d, t in slow_line_dedup(docs, 2, 30))
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == len(ODD) and Counter(x["text"] for x in rows) == Counter(x[1] for x in ODD)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_of_short_lines_and_null_ids(spark):
    rows = [(1, "Read more\n\nok\n---\nfirst body"), (2, "Read more\n\nok\n---\nother text"), (3, "Read mole\nno"), (None, "menu one\nquite alone"), (None, "menu one\nsome more"), (None, "menu one\nsome more")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x["text"] for x in got if x["doc_id"]) == sorted(["Read more\n\nok\n---\nfirst body", "\n---\nother text", "no"])
    assert Counter(y for x in got if x["doc_id"] is None for y in x["text"].split("\n") if y) == {"menu one": 1, "quite alone": 1, "some more": 1}


@pytest.mark.parametrize("hot", [16, 1])
def test_line_dedup_of_long_lines_and_many(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(10_000))
    same = ["o" * n + "x" * (300 - n) for n in (30, 140, 200, 255, 260, 300)]  # more of a letter than a byte counts
    docs = [(k, x) for k, x in enumerate(same)] + [(10, long), (11, long[:5000] + "z" + long[5001:] + "é"), (12, long[:100] + "zzz" + long[100:])]
    docs += [(20, "\n".join(f"line number {k * k} of {k}" for k in range(16_000))), (21, "\n".join(["again"] * 16_000)), (22, "day 1"), (23, "day 2")]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[d] == t for d, t in docs if d not in (11, 20, 21)) and got[11] == "" and got[21] == "again"
    kept = got[20].split("\n")
    assert kept[0] == "line number 0 of 0" and set(kept) <= set(docs[-4][1].split("\n"))


def test_segment_join_of_short_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    lines = sorted({"".join(x) for n in (3, 4, 5) for x in itertools.product("ab", repeat=n)})
    df = spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(lines)], "id long, line string, length int")
    found = {(x["a"], x["b"]) for x in line_dedup._candidates(df, 2).collect()}
    assert {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if distance(lines[i], lines[j]) <= 2} <= found


@pytest.mark.parametrize("few", [200_000, 0])
def test_line_dedup_shuffles_hot_lines_only_beyond_the_limit(spark, monkeypatch, few):
    plans, stored = {}, line_dedup.stored

    def noting(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", noting)
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", few)
    r = random.Random(9)
    base = ["".join(r.choice("abcdefé ") for _ in range(r.randint(35, 60))) for _ in range(12)]
    docs = [(d, "\n".join(changed(x, r.randint(0, 3), r, "abc") for x in r.sample(base, 3))) for d in range(50)]
    key, df = "spark.sql.autoBroadcastJoinThreshold", spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = line_dedup.dedup_lines(df, 2, 30).select("doc_id", "text").collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, got)) == sorted(slow_line_dedup(docs, 2, 30))
    assert ("SortMergeJoin" in plans["hot-lines"]) == (few == 0)


def test_block_test_goes_by_the_edits_allowed(spark):
    r = random.Random(10)
    near = [(a, changed(a, e, r, "abcdé"), e) for e in (0, 1, 2) for a in ("".join(r.choice("abcdé") for _ in range(r.randint(3, 40))) for _ in range(60))]
    far = [("abcdefgh", "abcXefYh", 1), ("abcdefgh", "abcdefgX", 0)]
    df = spark.createDataFrame(near + far, "a string, b string, edits int")
    got = [x[0] for x in df.select(line_dedup.may_be_near(F.col("a"), F.col("b"), F.col("edits"))).collect()]
    assert all(got[: len(near)]) and not any(got[len(near) :])


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def slow_multiset(text):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def slow_similarity(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def slow_classes(texts, least=0.8):
    sets = [slow_multiset(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and (texts[i] == texts[j] or slow_similarity(sets[i], sets[j]) >= least):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def near_copies(r, n, words):
    base = [r.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out


def test_signatures_estimate_similarity():
    r = random.Random(6)
    words = ["w%d" % k for k in range(50)]
    a = [r.choice(words) for _ in range(300)] * 2
    b = a[:420] + [r.choice(words) for _ in range(180)]
    texts = [" ".join(a), " ".join(b)]
    want = slow_similarity(*map(slow_multiset, texts))
    sig = minhash.signatures(texts, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert np.isinf(minhash.signatures(["", None])).all()
    alone = minhash.signatures(["one two three"])
    assert np.isfinite(alone).all() and (alone == minhash.signatures(["x", "ONE two-three"])[1]).all()


@pytest.mark.parametrize("small", [12, 1])
def test_near_duplicates(spark, odd, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)  # at 1, all that the stars leave is joined by rare shingles
    r = random.Random(7)
    words = ["w%d" % k for k in range(400)]
    texts = [t for n in (2, 3, 7, 40) for t in near_copies(r, n, words)] + [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(60)] + ["a b c d", "A b, c d!", "", None, ""]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == slow_classes(texts)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(k for k, c in got.items() if k == c)
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and sum(x["n_copies"] == 2 for x in rows) == 2
    assert sorted(str(x["doc_id"]) for x in minhash.keep_one(odd).collect()) == ["1", "2", "3", "4", "5", "None"]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0 and minhash.keep_one(odd.limit(0)).count() == 0


def test_no_link_between_components_goes_unseen(spark):
    r = random.Random(12)
    words = ["w%d" % k for k in range(400)]
    base = [r.choice(words) for _ in range(120)]
    texts = []
    for edits in itertools.product((0, 1), repeat=5):  # up to two edits apart they are similar enough, the farthest are five apart
        w = list(base)
        for place, edit in zip((20, 40, 60, 80, 100), edits, strict=True):
            w[place] = "edited" if edit else w[place]
        texts.append(" ".join(w))
    sets = [slow_multiset(t) for t in texts]
    alike = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if slow_similarity(sets[i], sets[j]) >= 0.8}
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(len(texts))], "node long, label long")  # components yet to be merged
    rows = minhash.labelled(minhash.rare_shingles(nodes.select("node"), nodes.select("node", minhash.shingles_udf("text").alias("shingles")), 0.8), labels)
    wanted = {(i, j) for i, j in alike if i % 3 != j % 3}
    found = lambda df: {(x["a"], x["b"]) for x in df.collect()}
    assert wanted <= found(minhash.by_all(rows, 0.8)) and all(i % 3 != j % 3 for i, j in found(minhash.by_all(rows, 0.8)))
    assert wanted - found(minhash.by_first(rows))  # what the first of each component alone would miss
    docs = nodes.withColumnRenamed("node", "doc_id")
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == slow_classes(texts)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 102), (101, 102), (200, 200)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    day = lambda d: f"2024-01-{d:02d}"
    entries = spark.createDataFrame(
        [("l", "d:b.com", "block", day(5)), ("l", "d:b.com", "remove", day(10)), ("l", "d:a.b.com", "allow", day(1)), ("m", "p:b.com/x", "allow", day(1)), ("l", None, "block", day(1)), ("n", "d:c.com", "block", day(5)), ("n", "d:c.com", "allow", day(5))],
        "list string, key string, action string, day string",
    ).withColumn("day", F.to_date("day"))
    cases = [
        ("http://b.com/", 4, False), ("http://b.com/", 5, True), ("http://b.com/", 9, True), ("http://b.com/", 10, False), ("https://u@A.B.com:80/q", 6, False), ("http://z.b.com", 6, True),
        ("http://b.com/x/y", 6, False), ("http://b.com/xx", 6, True), ("http://c.com", 6, False), (None, 6, False), ("", 6, False), ("not a url", 6, False), ("http://b.com/", None, False), ("http://b.com/", 5, True),
    ]
    captures = spark.createDataFrame([(k, u, d and day(d), "r") for k, (u, d, _) in enumerate(cases)], "capture_id long, url string, day string, rule string").withColumn("day", F.to_date("day"))
    for limit in (10**6, 0):
        url_filter.BROADCAST_ENTRIES, old = limit, url_filter.BROADCAST_ENTRIES
        got = {x["capture_id"]: x["blocked"] for x in url_filter.judge(captures, entries).collect()}
        url_filter.BROADCAST_ENTRIES = old
        assert [got[k] for k in range(len(cases))] == [b for *_, b in cases]
    assert url_filter.judge(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filter.judge(captures.limit(0), entries).count() == 0


def test_hosts_are_whole(spark):
    cases = {"http://exämple.de/x": "exämple.de", "https://u:p@Ünï.example.:8080/a?b": "ünï.example", "http://[2001:DB8::1]:80/x": "[2001:db8::1]", "http://a_b-c.d": "a_b-c.d", "http:///x": None, "ftp://:80/": None}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {x["url"]: x["h"] for x in df.select("url", url_filter.host_of(F.col("url")).alias("h")).collect()} == cases


def test_secrets(spark, odd):
    key, weak = "AKIA" + "Z9" * 8, "aB3" + "xY7z" * 9
    texts = {
        1: f"id {key} and {weak} at https://s3.example.com/x", 2: f"only {weak} at https://s3.example.com/x", 3: f"{key}" + " " * 300 + weak,
        4: 'secret=api_key: abcdefghij', 5: f'é😀 PASSWORD = "{weak}" {"0f" * 16}', 6: f"user: bob {weak}", 7: f"user: bob, no more", 8: "AKIA12 AKIAABCDEFGHIJKL0",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, kind string")
    got = {x["doc_id"]: x for x in secrets.scan(df).collect()}
    kinds = lambda k: [s.split(":")[0] for s in got[k]["spans"].split(",") if s]
    assert kinds(1) == ["access", "weak_secret", "endpoint"] and kinds(2) == [] and kinds(3) == ["access"]
    assert kinds(4) == [] and kinds(5) == ["assign", "hex"] and kinds(6) == ["weak_id", "weak_secret"] and kinds(7) == [] and kinds(8) == ["access"]
    for x in got.values():
        for s in filter(None, x["spans"].split(",")):
            kind, start, end = s.split(":")
            part = texts[x["doc_id"]][int(start) : int(end)]
            assert {"access": part.startswith("AKIA"), "weak_secret": part == weak, "hex": part == "0f" * 16, "endpoint": part.startswith("https://"), "assign": part.endswith(weak), "weak_id": part == "user: bob"}[kind]
        base = ",".join(s for s in x["spans"].split(",") if s.split(":")[0] in secrets.KINDS[:3])
        assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert all(x["spans"] == "" for x in secrets.scan(odd).collect()) and secrets.scan(odd).count() == len(ODD)
    assert secrets.scan(odd.limit(0)).count() == 0


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
        rows = kept.collect()
        assert 0 < len(rows) <= before.count()
        kept = spark.createDataFrame(rows, docs.schema)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in kept.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DATA).columns == odd.columns
