"""Quality rules, language profiles, packing, toxicity and main text: brute force, round trips and accuracy."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakewright.llm import html_extract, langid, packing, quality, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, stats string, row string"
ODD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "s", 0, None, None),
    (3, " \n\t ", "en", "s", 4, None, None),
    (4, "a b c d e f g h a b c d e f g h", "en", "s", 31, None, None),
    (4, "a b c d e f g h a b c d e f g h", "en", "s", 31, None, None),
    (None, "no id here  é😀\x1c x", "fr", None, 12, None, None),
    (5, "word " * 30000, "en", "s", 150000, None, None),
    (6, "line one\nline one\n\nline two #$%\nline one", "de", "s", 10, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()]


def slow_stats(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(words) < 2000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_quality_counts(texts):
    sample = texts[:120] + [r[1] for r in ODD]
    got = quality.text_stats(sample)
    for k, t in enumerate(sample):
        want = slow_stats(t)
        have = tuple(int(got[c][k]) for c in quality.COUNTS)
        assert have[:4] == want[:4]
        assert want[4] is None or have[4] == want[4]
    assert got["n_repeat_words"][len(texts[:120]) + 6] == 30000


def test_quality_odd_rows(spark, odd):
    rows = quality.score(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["base_failed"] and not r["kept"] for r in rows)
    assert quality.keep_good(odd.limit(0)).count() == 0
    assert quality.score(odd.where("false")).count() == 0


def test_quality_separates(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    scored = quality.score(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (scored.kept == (scored.quality == 1)).mean() > 0.97
    assert kept.count() == quality.score(docs).where("kept").count()


def test_em_needs_no_majority():
    # Bad documents fail two rules of eleven together: a majority vote would keep them all.
    good, bad = int("2" * 11, 3), int("2" * 9 + "11", 3)
    posterior = quality.fit(np.array([good, bad]), np.array([900, 100]))
    assert posterior[0] > 0.9 and posterior[1] < 0.5


def test_packing_round_trip(spark, odd, texts):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([*enumerate(texts[:60], 100), (90, "a <|endoftext|> b"), (91, "<|endoftext|><|endoftext|>\n x")], "doc_id long, text string"))
    size = 256
    rows = packing.pack(docs, size).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {}
    for d, t in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        wanted[d] = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    stream = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for sequence, offset, length in stream:  # no gap, no overlap, nothing beyond a sequence
        assert (sequence, offset) == divmod(at, size) and offset + length <= size
        at += length
    assert at == sum(len(wanted[r["doc_id"]]) for r in docs.collect())
    for r in rows:
        ids = wanted[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.pack(docs.limit(0)).count() == 0


def test_encoder_equals_tokenizer(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(1)
    hard = ["".join(r.choice(" \t\n\x1c 　ab'sé1😀.<|endoftext|>") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in [*texts[:80], *hard]:
        assert np.frombuffer(encode(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_knows_the_added_token(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(2)
    mark = "<|endoftext|>"
    hard = ["".join(r.choice([mark, mark, " ", "  ", "\n", "a", " b", "'s", "é", "<|", "|>", mark[:-1]]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for t in [mark, f"a {mark} b", f"a{mark}{mark}b", *texts[:20], *hard]:
        assert np.frombuffer(encode(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_langid(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op8_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    profiles = langid.fit_profiles(docs.select("doc_id", "lang", "text"))
    rows = langid.predict(odd, profiles).select("text", "lang_found.*").collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and all(r["lang_pred"] in profiles for r in rows[3:])
    assert langid.predict(odd, {}).where("lang_found.lang_pred <> 'und'").count() == 0


def test_langid_distance(texts):
    profiles = {"aa": [g for g, _ in langid.grams(" ".join(texts[:20])).most_common(300)], "bb": [g for g, _ in langid.grams(" ".join(texts[20:40])).most_common(300)]}
    model = langid.Profiles(profiles)
    for t in texts[40:60]:
        counts = langid.grams(t)
        alphabet = {c for p in profiles.values() for g in p for c in g}
        if not all(c in alphabet for g in counts for c in g):
            continue
        n = sorted(counts.values(), reverse=True)
        # Without ties the distance is that of the definition.
        top = [g for g, _ in counts.most_common(300)]
        if len(set(n[:301])) == len(n[:301]):
            want = [sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(top)) for p in profiles.values()]
            assert model.distances(t)[0].tolist() == want
        assert model.distances(t)[1] == min(len(counts), 300) * 300


def test_langid_distance_where_counts_tie():
    profiles = {"aa": ["e", " t", "th", "a", "the", " a"], "bb": ["a", "la", " l", "e", " la", "a "]}
    model, place = langid.Profiles(profiles), {c: k for k, c in enumerate(" aehlt")}
    for t in ("the tale", "La la thea", "ha, ha: the theatre", "e", "at the lathe a heel"):
        counts = langid.grams(t)
        if not all(c in place for g in counts for c in g):
            t = "".join(c for c in t.lower() if c in place or c == " ")
            counts = langid.grams(t)
        # Equal counts: the shorter first, then by code points, the blank first.
        top = sorted(counts, key=lambda g: (-counts[g], len(g), [place[c] for c in g]))[:300]
        want = [sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(top)) for p in profiles.values()]
        assert model.distances(t)[0].tolist() == want


def gradient_error():
    r = np.random.default_rng(0)
    net = toxicity.Network({"bad": 2.0, "good": -1.0})
    vocabulary = ["bad", "good", "other", "wörd"]
    idx = r.integers(0, 5, (6, toxicity.WINDOW))
    idx[0, 5:] = 0
    y, w = np.array([1, 0, 1, 0, 0, 1], np.float32), np.ones(6, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        x = np.concatenate([np.zeros((1, toxicity.SIZE)), net.inputs(vocabulary)[0]])
        z = net.forward(x, idx)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    x = np.concatenate([np.zeros((1, toxicity.SIZE)), net.inputs(vocabulary)[0]])
    g, _ = net.gradients(x, idx, y, w)
    worst = 0.0
    for name in ("Uf", "Wb", "cf", "att", "out"):
        flat, got = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in r.integers(0, len(flat), 5):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            worst = max(worst, abs((up - down) / 2e-2 - got[k]))
    return worst


def test_toxicity_gradients():
    assert gradient_error() < 2e-3


def test_toxicity(spark, odd):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for k in range(400):
        ws = [r.choice(vocabulary) for _ in range(r.randint(5, 200))]
        if k % 5 == 0:
            ws.insert(r.randrange(len(ws)), "zz" + r.choice(vocabulary))
        rows.append((ws, k % 5 == 0))
    net = toxicity.fit([w for w, _ in rows[:300]], np.array([t for _, t in rows[:300]]))
    got = net.scores([w for w, _ in rows[300:]]) >= 0.5
    assert (got == np.array([t for _, t in rows[300:]])).mean() > 0.9
    scored = toxicity.predict(odd, net).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored) and scored[0]["score"] < 0.5
    assert toxicity.fit([["a"]], np.array([False])) is None and toxicity.predict(odd, None).where("score <> 0").count() == 0


def test_windows_cover():
    for n in (0, 1, 31, 32, 33, 100, 1000):
        starts = list(toxicity.window_starts(n))
        assert {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))


def marginals_by_enumeration(forest, weights, edges):
    unary = np.bincount(forest.node, weights[forest.at], forest.size)
    total, hit = 0.0, np.zeros(forest.size)
    for bits in range(1 << forest.size):
        y = [(bits >> k) & 1 for k in range(forest.size)]
        score = np.exp(sum(unary[k] * y[k] for k in range(forest.size)) + sum(edges[forest.kind[k], y[p], y[k]] for k, p in enumerate(forest.parent) if p >= 0))
        total += score
        hit += score * np.array(y)
    return hit / total


def test_sum_product_is_exact():
    r = np.random.default_rng(3)
    trees = [html_extract.parse("<body><div>a<p>b</p></div><ul><li>c<li>d</ul></body>")]
    forest = html_extract.Forest(trees)
    weights, edges = r.standard_normal(len(html_extract.FEATURES)), r.standard_normal((html_extract.KINDS, 2, 2))
    assert np.allclose(forest.marginals(weights, edges)[0], marginals_by_enumeration(forest, weights, edges))


@pytest.fixture(scope="module")
def model():
    return html_extract.fit(html_extract.labelled_pages())


def test_main_text(spark, model):
    page = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav><article><h1>A&amp;B</h1><p><b>One\n  two.<br><p>Three &lt;x&gt;.</p></article><footer>&copy; me</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<div><p>" * 3000), (5, "u", "<script>x")], "page_id long, url string, html string")
    rows = html_extract.extract(pages, model).collect()
    assert rows[0]["text"] == "A&B\nOne two.\nThree <x>." == rows[3]["text"]
    assert [rows[k]["text"] for k in (1, 2, 4, 5)] == [""] * 4
    assert html_extract.extract(pages.limit(0), model).count() == 0


def test_main_text_of_new_layouts(model):
    test = html_extract.labelled_pages(150, seed=77)
    got = model.texts([p for p, _ in test])
    assert sum(g == "\n".join(b) for g, (_, b) in zip(got, test)) > 0.75 * len(test)


def test_main_text_of_the_pages(model):
    pages = duckdb.sql(f"SELECT html FROM '{DATA}/pages.parquet'").fetchall()
    import html as H

    for (page,), got in zip(pages, model.texts([p[0] for p in pages])):
        inside = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = [" ".join(H.unescape(re.sub(r"<br>|</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got == "\n".join(b for b in blocks if b)
