"""Containment, pointers, shelves and layers against plain loops."""

import json
import random

from pyspark.sql import functions as F

from lakewright.operators import aggregates, atlas, contains, shred


def test_contains(spark):
    r = random.Random(1)
    texts = [(k, "".join(r.choice("abcd é\n") for _ in range(r.choice((0, 1, 2, 5, 30, 80))))) for k in range(120)] + [(500, None), (501, "aaaaaaa"), (501, "aaaaaaa"), (502, "x😀y😀z")]
    keys = {"".join(r.choice("abcd é\n") for _ in range(r.randint(1, 6))) for _ in range(60)} | {"aaa", "😀y", "é", "zzzz"}
    df = spark.createDataFrame(texts, "id long, text string")
    kf = spark.createDataFrame([(k, i) for i, k in enumerate(sorted(keys))] + [("", -1), (None, -2)], "word string, text long")
    got = sorted((x["id"], x["word"], x["text"]) for x in contains.contains_join(df.distinct(), ["id"], "text", kf, "word").collect())
    rank = {k: i for i, k in enumerate(sorted(keys))}
    assert got == sorted((i, k, rank[k]) for i, t in set(texts) if t for k in keys if k in t)
    first = {x["id"]: x["word"] for x in contains.first_rule(df.distinct(), ["id"], "text", kf, "word", ["text"]).collect()}
    assert first == {i: min(k for k in keys if k in t) for i, t in texts if t and any(k in t for k in keys)}
    assert contains.contains_join(df.limit(0), ["id"], "text", kf, "word").count() == 0 and contains.contains_join(df, ["id"], "text", kf.limit(0), "word").count() == 0


def test_contains_many_keys(spark, monkeypatch):
    """Keys that are too many to be sent around give the same pairs, and no text is shuffled once a gram."""
    r = random.Random(6)
    texts = [(k % 50 or None, "".join(r.choice("abcd é") for _ in range(r.choice((0, 2, 9, 60))))) for k in range(150)]
    keys = sorted({"".join(r.choice("abcd é") for _ in range(r.randint(1, 5))) for _ in range(60)})
    df = spark.createDataFrame(texts, "id long, text string").distinct()
    kf = spark.createDataFrame([(k, -i) for i, k in enumerate(keys)] + [(keys[0], 1)], "word string, place long")
    want = sorted((str(i), k, p) for i, t in set(texts) for j, k in enumerate(keys) if k in t for p in ((0, 1) if j == 0 else (-j,)))
    first = {}
    for i, k, p in want:
        first[i] = min(first.get(i, (9, "")), (p, k))
    for most in (contains.BROADCAST_KEYS, 3):
        monkeypatch.setattr(contains, "BROADCAST_KEYS", most)
        assert sorted((str(x["id"]), x["word"], x["place"]) for x in contains.contains_join(df, ["id"], "text", kf, "word").collect()) == want
        assert {str(x["id"]): (x["place"], x["word"]) for x in contains.first_rule(df, ["id"], "text", kf, "word", ["place"]).collect()} == first


def test_texts_stay_where_they_are(spark):
    """Without broadcasts by size, what is shuffled is no more than the matches, and far less than a text for each of its grams."""
    words = [f"word{k:03d}" for k in range(40)]
    df = spark.range(50).select("id", F.concat(F.col("id").cast("string"), F.lit(" " + " ".join(words) * 20)).alias("text"))
    kf = spark.createDataFrame([(w,) for w in words], "word string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contains.contains_join(df, ["id"], "text", kf, "word")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 50 * len(words)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]


def plain_pick(value, pointer):
    for s in (pointer or "").split("/"):
        s = s.replace("~1", "/").replace("~0", "~") if s else None
        if s is None:
            continue
        if isinstance(value, dict):
            value = value.get(s)
        elif isinstance(value, list):
            value = value[int(s)] if s.isdigit() and int(s) < len(value) else None
        else:
            return None
    return value


def test_pointers(spark):
    r = random.Random(2)

    def made(depth):
        kind = r.random()
        if depth and kind < 0.4:
            return {r.choice(("a", "b/c", "d~e", "", "0", "é")): made(depth - 1) for _ in range(r.randint(0, 4))}
        if depth and kind < 0.7:
            return [made(depth - 1) for _ in range(r.randint(0, 4))]
        return r.choice((1, -2, "x", "", None, True, "long text"))

    docs = [made(5) for _ in range(60)]
    steps = ["a", "b~1c", "d~0e", "0", "1", "2", "é", "", "zz"]
    rows = [(i, json.dumps(d), "/" + "/".join(r.choice(steps) for _ in range(r.randint(0, 4))) if r.random() < 0.95 else None) for i, d in enumerate(docs) for _ in range(6)]
    rows = [(i, j, p) for i, j, p in rows] + [(1000, "no json", "/a"), (1001, None, "/a")]
    df = spark.createDataFrame(rows, "id long, json string, pointer string")
    held = shred.shred(df.select("id", "json").distinct(), ["id"], "json")
    got = sorted(((x["id"], x["pointer"], x["value"]) for x in shred.pick(held, ["id"], df.select("id", "pointer"), "pointer").collect()), key=repr)

    def text(i, p):
        v = plain_pick(docs[i], p) if i < 1000 else None
        return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)

    assert [(i, p, v if v is None or not v.startswith(("{", "[")) else json.loads(v)) for i, p, v in got] == [(i, p, v if v is None or not v.startswith(("{", "[")) else json.loads(v)) for i, p, v in sorted(((i, p, text(i, p)) for i, _, p in rows), key=repr)]


def plain_shelves(sprites, side):
    x = y = row = 0
    out = {}
    fits = True
    for h, s, w in sorted((-h, s, w) for s, w, h in sprites):
        h = -h
        if x + w > side:
            x, y, row = 0, y + row, 0
        fits = fits and w <= side and y + h <= side
        out[s] = (x, y)
        x, row = x + w, max(row, h)
    return out, fits


def test_shelves(spark):
    r = random.Random(3)
    books = {k: [(s, r.randint(1, 30), r.randint(1, 20)) for s in range(r.choice((1, 2, 7, 40)))] for k in range(8)} | {"hot": [(s, r.randint(1, 64), r.randint(1, 9)) for s in range(700)]}
    df = spark.createDataFrame([(str(k), s, w, h) for k, v in books.items() for s, w, h in v], "atlas string, sprite long, w int, h int")
    got = {(x["atlas"], x["sprite"]): (x["x"], x["y"], x["fits"]) for x in atlas.shelves(df, "atlas", F.lit(64)).collect()}
    for k, v in books.items():
        places, fits = plain_shelves(v, 64)
        assert {s: got[(str(k), s)] for s in places} == {s: (*p, fits) for s, p in places.items()}
    grown = {(x["atlas"], x["sprite"]): (x["side"], x["x"], x["y"], x["fits"]) for x in atlas.grown(df, "atlas").collect()}
    for k, v in books.items():
        side = 64
        while not plain_shelves(v, side)[1]:
            side *= 2
        assert {s: grown[(str(k), s)] for s, _, _ in v} == {s: (side, *p, True) for s, p in plain_shelves(v, side)[0].items()}
    assert atlas.shelves(df.limit(0), "atlas", F.lit(64)).count() == 0


def test_cut_shelves(spark, monkeypatch):
    """Atlases of more than a chunk are cut, and give what they give whole."""
    from lakewright.plans import scan

    monkeypatch.setattr(scan, "CHUNK", 150)
    monkeypatch.setattr(scan, "SAMPLE", 50)
    r = random.Random(7)
    books = {"long": [(s, r.randint(1, 30), r.randint(1, 20)) for s in range(1500)], "flat": [(s, r.randint(1, 3), 1) for s in range(900)], "wide": [(s, r.randint(1, 80), r.randint(1, 3)) for s in range(400)], "short": [(s, 5, 5) for s in range(60)]}
    df = spark.createDataFrame([(k, s, w, h) for k, v in books.items() for s, w, h in v], "atlas string, sprite long, w int, h int")
    for side in (64, 400):
        got = {(x["atlas"], x["sprite"]): (x["x"], x["y"], x["fits"]) for x in atlas.shelves(df, "atlas", F.lit(side)).collect()}
        for k, v in books.items():
            places, fits = plain_shelves(v, side)
            assert {s: got[(k, s)] for s in places} == {s: (*p, fits) for s, p in places.items()}


def test_composited(spark):
    r = random.Random(4)
    rows = [(p, n, *(r.randrange(256) for _ in range(3)), r.choice((0, 0, 1, 40, 200, 255))) for p in range(40) for n in range(r.randint(1, 6))]
    got = {x["p"]: tuple(x[c] for c in "rgba") for x in atlas.composited(spark.createDataFrame(rows, "p long, n int, r int, g int, b int, a int"), ["p"], "n").collect()}
    for p in range(40):
        d = [0, 0, 0, 0]
        for _, _, *s in sorted(x for x in rows if x[0] == p):
            if s[3]:
                a = s[3] + d[3] * (255 - s[3]) // 255
                d = [*(min((s[c] * s[3] + d[c] * d[3] * (255 - s[3]) // 255) // a, 255) for c in range(3)), min(a, 255)]
        assert got[p] == tuple(d)


def test_sampled_duplicates(spark):
    long = "ab" * 500
    rows = [(1, long), (2, long), (3, long[:500] + "!" + long[501:]), (4, "é"), (5, "é"), (6, None), (7, None), (8, ""), (9, "")]
    got = [tuple(x)[1:] for x in aggregates.sampled_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", 1, 16).collect()]
    assert sorted(got) == [(2, 2, 2, 4), (1000, 2, 1000, 1)]
