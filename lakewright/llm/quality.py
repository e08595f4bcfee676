"""Quality rules as weak supervision.

Each rule votes "good", votes "bad" or abstains. Expectation-maximisation over the counts of the
vote patterns estimates how often each rule votes either way on good and on bad documents, and a
document is kept if the posterior probability of "good" is at least 0.5. A rule that is right only
on one sort of junk thus counts for as much as its votes say, which an all-must-pass filter cannot.

The statistics of a text are computed in an Arrow UDF (numpy over a chunk of texts); what goes
through Spark's aggregation, and to the driver, is one row for each vote pattern: 3 ** 11 at most,
whatever the size of the corpus.

Edge cases: a null, empty or blank text has no words, all its counts are 0, ``base_failed`` is true
and it is not kept. Repeated rows each get their own, equal, result. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.common import stored, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Bytes of text that are handled at once in a Python worker.
CHUNK_BYTES = 4 << 20

# The most frequent function words of four languages.
FUNCTION_WORDS = (
    b"the of and to in a is that it for on was as with be by this are from or an",
    b"de la le et les des en un du une que est pour qui dans par sur au plus ne se",
    b"der die und in den von zu das mit sich des auf ist im dem nicht ein eine als",
    b"de la que el en y a los se del las un por con no una su para es al lo como",
)
STOP = frozenset(w for line in FUNCTION_WORDS for w in line.split())

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_letters", "n_bang", "n_bars", "n_alpha_words", "n_stop", "n_lines", "n_ended")
STATS = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS + EXTRA])

# Byte classes of the table below: 1 ASCII white space, 2 symbol, 3 upper case, 4 lower case, 5 continuation byte.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[list(b"#*$%&|<>")] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x61:0x7B] = 4
_CLASS[0x80:0xC0] = 5
_CLASS[0xC0:] = 6


def _repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, the words that lie in an 8-word window found twice or more in it."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    key = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    word = ids.astype(np.uint64) + np.uint64(1)
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[k : n + k]
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    ordered = np.sort(key[at])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(ids) + 1, np.int64)
    if len(twice):
        at = at[np.isin(key[at], twice)]
        # Equal hashes are only candidates: the windows themselves decide.
        windows = list(zip(doc[at].tolist(), *(ids[at + k].tolist() for k in range(WINDOW)), strict=True))
        seen = Counter(windows)
        for i, w in zip(at.tolist(), windows, strict=True):
            if seen[w] > 1:
                cover[i] += 1
                cover[i + WINDOW] -= 1
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


def _sums(flags: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[starts + lengths] - total[starts]


def text_stats(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of COUNTS and EXTRA for each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(raw)
    lengths = np.fromiter(map(len, raw), np.int64, n)
    starts = np.cumsum(lengths) - lengths
    kind = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    space, tail = _sums(kind == 1, starts, lengths), _sums(kind == 5, starts, lengths)
    out = {
        "word_chars": lengths - tail - space,
        "n_symbols": _sums(kind == 2, starts, lengths),
        "n_upper": _sums(kind == 3, starts, lengths),
        "n_letters": _sums((kind == 3) | (kind == 4) | (kind == 6), starts, lengths),
        "n_bang": np.fromiter((b.count(b"!") for b in raw), np.int64, n),
        "n_bars": np.fromiter((b.count(b"|") for b in raw), np.int64, n),
    }
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = [b.split() for b in raw]
    n_words = np.fromiter(map(len, words), np.int64, n)
    ids = np.fromiter((i for ws in words for i in map(numbers.__getitem__, ws)), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(n), n_words)
    vocabulary = list(numbers)
    alpha = np.fromiter((w.isalpha() or any(c > 127 or chr(c).isalpha() for c in w) for w in vocabulary), bool, len(vocabulary))
    stop = np.fromiter((w.lower() in STOP for w in vocabulary), bool, len(vocabulary))
    out["n_words"] = n_words
    out["n_alpha_words"] = np.bincount(doc[alpha[ids]], minlength=n) if len(ids) else np.zeros(n, np.int64)
    out["n_stop"] = np.bincount(doc[stop[ids]], minlength=n) if len(ids) else np.zeros(n, np.int64)
    out["n_repeat_words"] = _repeated_words(ids, doc, n)
    dup, lines, ended = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, b in enumerate(raw):
        whole = b.split(b"\n")
        real = [x for x in whole if x and not x.isspace()]
        lines[k], dup[k] = len(real), len(real) - len(set(real))
        ended[k] = sum(x.rstrip()[-1:] in b".!?\"':;" for x in real)
    return out | {"n_dup_lines": dup, "n_lines": lines, "n_ended": ended}


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Lists of texts of about ``limit`` bytes, so that a batch of long texts doesn't fill a worker's memory."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


@F.arrow_udf(STATS)
def stats_udf(texts: pa.Array) -> pa.Array:
    parts = [text_stats(p) for p in chunks(texts)]
    names = STATS.names
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in names]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 1).when(good, 2).otherwise(0)


def rules(s: Column) -> dict[str, Column]:
    """The rules over a struct of STATS: 1 is a bad vote, 2 a good one, 0 abstains."""
    words, letters = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["n_letters"], F.lit(1))
    lines = F.greatest(s["n_lines"], F.lit(1))
    mean = s["word_chars"] / words
    return {
        "length": _vote(s["n_words"] < 30, s["n_words"] >= 80),
        "word_length": _vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 9)),
        "symbols": _vote(s["n_symbols"] > 0.2 * words, s["n_symbols"] < 0.05 * words),
        "dup_lines": _vote(s["n_dup_lines"] > 0.25 * lines, (s["n_dup_lines"] == 0) & (lines >= 3)),
        "repeats": _vote(s["n_repeat_words"] > 0.2 * words, s["n_repeat_words"] < 0.05 * words),
        "upper": _vote(s["n_upper"] > 0.4 * letters, s["n_upper"] < 0.15 * letters),
        "exclaim": _vote(s["n_bang"] > 0.2 * words, s["n_bang"] < 0.03 * words),
        "bars": _vote(s["n_bars"] > 0.1 * words, s["n_bars"] == 0),
        "alpha": _vote(s["n_alpha_words"] < 0.7 * words, s["n_alpha_words"] > 0.9 * words),
        "function_words": _vote(s["n_stop"] < 0.02 * words, s["n_stop"] > 0.08 * words),
        "line_ends": _vote(s["n_ended"] < 0.2 * lines, s["n_ended"] > 0.8 * lines),
    }


N_RULES = 11


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def pattern(s: Column) -> Column:
    """All votes as one number, a digit in base 3 for each rule."""
    votes = list(rules(s).values())
    return sum((v * F.lit(3**k) for k, v in enumerate(votes[1:], 1)), votes[0]).cast("int")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM over vote patterns: the posterior probability of "good" for each pattern.

    Each rule has, for either class, the probability of a bad vote given that it votes; an abstention
    says nothing. Weak Beta priors (20 pseudo-documents: a rule errs on a good document in 5 % of its
    votes, and finds a bad document in 30 %) give the classes their meaning and keep tiny corpora stable.
    """
    digits = patterns[:, None] // 3 ** np.arange(N_RULES) % 3
    bad, good = (digits == 1).astype(float), (digits == 2).astype(float)
    w = counts.astype(float)[:, None]
    false_alarm, hit, share = np.full(N_RULES, 0.05), np.full(N_RULES, 0.3), 0.85
    posterior = np.ones(len(patterns))
    for _ in range(rounds):
        up = np.log(share) + bad @ np.log(false_alarm) + good @ np.log1p(-false_alarm)
        down = np.log(1 - share) + bad @ np.log(hit) + good @ np.log1p(-hit)
        posterior = 1 / (1 + np.exp(np.clip(down - up, -500, 500)))
        p, q = posterior[:, None] * w, (1 - posterior)[:, None] * w
        false_alarm = ((p * bad).sum(0) + 1) / ((p * (bad + good)).sum(0) + 20)
        hit = ((q * bad).sum(0) + 6) / ((q * (bad + good)).sum(0) + 20)
        false_alarm = np.clip(false_alarm, 1e-4, 0.3)
        hit = np.clip(hit, np.minimum(2 * false_alarm, 0.6), 0.99)
        share = np.clip((p.sum() + 17) / (w.sum() + 20), 0.5, 0.99)
    return posterior


def posteriors(votes: DataFrame) -> DataFrame:
    """(pattern, posterior) from a column ``pattern``: one row a pattern, 3 ** N_RULES at most."""
    seen = votes.groupBy("pattern").count().toPandas().sort_values("pattern")
    p, n = seen["pattern"].to_numpy(np.int64), seen["count"].to_numpy(np.int64)
    rows = [(int(a), float(b)) for a, b in zip(p, fit(p, n) if len(p) else [], strict=True)]
    return votes.sparkSession.createDataFrame(rows, "pattern int, posterior double")


def score(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, the posterior and kept."""
    s = F.col("stats")
    one = docs.select("doc_id", stats_udf("text").alias("stats"))
    one = one.select("doc_id", *[s[c].alias(c) for c in COUNTS], base_failed(s).alias("base_failed"), pattern(s).alias("pattern"))
    one = stored(one, "quality")
    known = F.broadcast(posteriors(one))  # 3 ** N_RULES rows at most
    kept = ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    return one.join(known, "pattern").select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; names that begin with two underscores are the operator's own.

    The rows are written once with their votes, so that the statistics of a text are computed once."""
    s, own = F.col("__stats"), [F.col(f"`{c}`") for c in docs.columns]
    scored = docs.withColumn("__stats", stats_udf("text")).select(*own, base_failed(s).alias("__failed"), pattern(s).alias("__pattern"))
    scored = stored(scored, "scored")
    known = posteriors(scored.select(F.col("__pattern").alias("pattern")))
    known = F.broadcast(known.withColumnsRenamed({"pattern": "__pattern", "posterior": "__posterior"}))  # 3 ** N_RULES rows at most
    return scored.where("not __failed").join(known, "__pattern").where("__posterior >= 0.5").select(*own)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
