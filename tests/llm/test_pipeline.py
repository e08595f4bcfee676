"""Each stage of the pipeline against a plain version, on odd rows, and on empty tables."""

import itertools
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from lakewright.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pattern string, node long, places string, line string"
GOOD = "The first of all sentences is for the reader. It was on that day that they came from the north with their words.\nThis line is by an author who wrote it as a part of the whole. And so it was.\nThe third line ends the text that was on it."
WORDS = [f"w{k}x" for k in range(400)]


def text(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    near = text(1)
    texts = [
        (1, GOOD), (2, GOOD), (2, GOOD), (3, near), (4, near.replace("w1", "q1", 1)), (5, f"{text(2)}\n{text(3)}"), (6, f"{text(3)}\n{text(4)}"), (7, f"{text(3)}z\n{text(5)}"),
        (8, None), (9, ""), (10, " \n\t"), (None, text(6)), (None, text(6)), (None, None), (11, text(7, 40_000)), (12, "é😀 <|endoftext|> \x1c"),
    ]
    return [(d, t, "en", "s", None if t is None else len(t), "p", 1, "x", "y") for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder with a benchmark: one item is in the fifth text's first line."""
    at = tmp_path_factory.mktemp("data")
    items = [(1, " ".join(text(2).split()[10:30])), (2, None), (3, "nothing of it"), (4, text(99, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_quality_rules(spark, docs, rows, folder):
    got = corpus_pipeline.quality_rules(spark, docs, folder)
    stats = quality.text_stats([r[1] for r in rows])
    votes = [{n: int(stats[n][k]) for n in stats} for k in range(len(rows))]
    patterns = [plain_pattern(v) for v in votes]
    seen = sorted(Counter(patterns).items())
    posterior = dict(zip([p for p, _ in seen], quality.fit(np.array([p for p, _ in seen]), np.array([n for _, n in seen])), strict=True))
    failed = [v["n_words"] < 20 or 100 * v["n_repeat_words"] > 30 * v["n_words"] for v in votes]
    want = [r for r, f, p in zip(rows, failed, patterns, strict=True) if not f and posterior[p] >= 0.5]
    assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def plain_pattern(v):
    """The votes of the eleven rules, in order, as digits in base 3."""
    words, letters, lines = max(v["n_words"], 1), max(v["n_letters"], 1), max(v["n_lines"], 1)
    mean = v["word_chars"] / words
    bad_good = [
        (v["n_words"] < 30, v["n_words"] >= 80), (mean < 2.5 or mean > 12, 3 <= mean <= 9), (v["n_symbols"] > 0.2 * words, v["n_symbols"] < 0.05 * words),
        (v["n_dup_lines"] > 0.25 * lines, v["n_dup_lines"] == 0 and lines >= 3), (v["n_repeat_words"] > 0.2 * words, v["n_repeat_words"] < 0.05 * words),
        (v["n_upper"] > 0.4 * letters, v["n_upper"] < 0.15 * letters), (v["n_bang"] > 0.2 * words, v["n_bang"] < 0.03 * words), (v["n_bars"] > 0.1 * words, v["n_bars"] == 0),
        (v["n_alpha_words"] < 0.7 * words, v["n_alpha_words"] > 0.9 * words), (v["n_stop"] < 0.02 * words, v["n_stop"] > 0.08 * words), (v["n_ended"] < 0.2 * lines, v["n_ended"] > 0.8 * lines),
    ]
    return sum((1 if bad else 2 if good else 0) * 3**k for k, (bad, good) in enumerate(bad_good))


def test_dedup_lines(spark, docs, rows, folder):
    got = sorted((r["doc_id"] or 99, r["text"] or "", r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, folder).collect())
    repeated = {2: None, 6: text(4), 7: text(5)}  # 4 differs from 3 by two edits at most, 7's first line from 5's second by one
    want = []
    for (d, t, *_), again in zip(rows, [False] * 12 + [True] + [False] * 3, strict=True):
        kept = None if again or d == 4 else repeated.get(d, t)
        if d in (2, 4) or again:
            continue  # no word is left
        want.append((d or 99, kept or "", None if kept is None else len(kept)))
    assert got == sorted(want)


def test_near_duplicates(spark, docs, rows, folder):
    got = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def shingles(t):
        w = [x.lower() for x in word.findall((t or "").encode())]
        return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()

    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 10 * (sets[i] & sets[j]).total() >= 8 * (sets[i] | sets[j]).total():
            label = [label[i] if x == label[j] else x for x in label]
    first = {}
    for k, r in enumerate(rows):
        key = label[k] if sets[k] else ("blank", k)
        if key not in first or (r[0] is not None and (first[key][0] is None or r[0] < first[key][0])):
            first[key] = r
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, first.values()))


def test_decontaminate(spark, docs, rows, folder):
    got = corpus_pipeline.decontaminate(spark, docs, folder)
    want = [r for r in rows if r[0] != 5]  # 20 of its 120 words
    assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_pack(spark, docs, rows, folder):
    pieces = corpus_pipeline.pack(spark, docs, folder).collect()
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r[0] for r in rows)
    taken = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    assert [2048 * s + o for s, o, _ in taken] == [0, *np.cumsum([n for *_, n in taken])[:-1].tolist()]
    assert sum(p["doc_tokens"] for p in pieces if p["start"] == 0) == sum(p["length"] for p in pieces)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_no_documents(spark, docs, folder, stage):
    assert stage[1](spark, docs.limit(0), folder).count() == 0
