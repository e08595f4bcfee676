"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 letters, words
padded by a blank). A document's own list is compared with each profile: the out-of-place distance
sums, over the document's n-grams, how far the rank in the profile lies from the rank in the
document, and counts a missing n-gram as far as the profile is long. The nearest language wins, a
tie goes to the first by name.

The profiles are counted by Spark over a sample of PER_LANGUAGE documents a language (in
expectation; drawn by a hash of the id), for every language that the labels name. Documents
are scored whole in an Arrow UDF. N-grams of equal count rank by length, then by their letters' code points, the blank first,
in profiles and documents alike, so that a text lies at distance 0 from a profile of its own. What is kept of the profiles is
their n-grams, PROFILE for each language, whatever the scripts; more than MAX_LANGUAGES labels are an error, as
their n-grams come to the driver and go to every worker.

Edge cases: a null text, or one without a letter, gives ``und`` and score 0. A null id is learned
from and is not held out. Without any labelled document every text gives ``und``. Repeated rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import id_remainder, table

PROFILE = 300
PER_LANGUAGE = 1500
HELD_OUT = 2
UNDETERMINED = "und"
#: Bins up to which n-grams are counted by address; above, and where a text has letters that no profile has, by sorting.
DENSE_BINS = 300_000
MAX_LANGUAGES = 10_000


@cache
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def grams(text: str) -> Counter:
    """The n-grams of a text as strings; words are set in single blanks."""
    counts: Counter = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for word, n in Counter(words).items():
        padded = f" {word} "
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                counts[padded[i : i + k]] += n
    counts.pop(" ", None)
    return counts


def fit_profiles(train: DataFrame, per_language: int = PER_LANGUAGE, profile: int = PROFILE) -> dict[str, list[str]]:
    """Profiles, best n-gram first, from the columns text and lang."""
    train = train.where("lang is not null and text is not null")
    found = train.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is lang the right column?")
    # One row for each language.
    share = train.groupBy("lang").agg((F.lit(per_language) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = train.join(F.broadcast(share), "lang").where(drawn).select("lang", "text")

    def count(batches):
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(lang, Counter()).update(grams(text))
        rows = [(lang, g, n) for lang, counts in total.items() for g, n in counts.items()]
        for at in range(0, len(rows), 50_000):
            a, b, c = zip(*rows[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "gram", "rank").collect()
    out: dict[str, list[str]] = {}
    for row in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


#: Bits of a letter in the number of an n-gram: code point + 2, the blank 1, so that numbers sort by length, then code points.
_BITS = 21


def _number(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << _BITS | (1 if c == " " else ord(c) + 2)
    return out


class Profiles:
    """Profiles over numbered n-grams, for fast distances: a sorted list of the n-grams that any profile has, and for each the
    languages and ranks that it has there."""

    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE) -> None:
        self.langs, self.size = sorted(profiles), size
        rows = sorted((_number(g), row, rank) for row, lang in enumerate(self.langs) for rank, g in enumerate(profiles[lang]))
        code, self.lang, self.rank = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        self.known, self.first = np.unique(code, return_index=True)
        self.first = np.append(self.first, len(code))
        alphabet = sorted({c for grams in profiles.values() for g in grams for c in g} - {" "})
        self.k = k = len(alphabet) + 2  # 0: the blank; k - 1: any other letter
        self.table = np.zeros(sys.maxunicode + 1, np.int32)
        self.table[_letters()] = k - 1
        for i, c in enumerate(alphabet, 1):
            self.table[ord(c)] = i
        self.letters = np.array([1, *(ord(c) + 2 for c in alphabet), 0], np.int64)
        self.bins = k + k * k + k * k * k

    def _numbers(self, bins: np.ndarray) -> np.ndarray:
        """The numbers of n-grams that are given by their bins."""
        k = self.k
        length = 1 + (bins >= k) + (bins >= k + k * k)
        rest = bins - np.array([0, 0, k, k + k * k])[length]
        a, b, c = (self.letters[rest // k**j % k] for j in (2, 1, 0))
        return np.where(length > 2, a << 2 * _BITS, 0) | np.where(length > 1, b << _BITS, 0) | c

    def top(self, text: str) -> np.ndarray | None:
        """The numbers of a text's most frequent n-grams, best first, or None if it has no letter."""
        k, points = self.k, _points(text)
        x = self.table[points].astype(np.int64)
        dense = self.bins <= DENSE_BINS and not (x == k - 1).any()
        if not dense:
            x = np.where(x > 0, points.astype(np.int64) + 2, 1)
        blank = 0 if dense else 1
        x = np.concatenate([[blank], x, [blank]])
        x = x[np.concatenate([[True], (x[1:] != blank) | (x[:-1] != blank)])]
        if len(x) < 3:
            return None
        if dense:
            two = x[:-1] * k + x[1:]
            three = (two[:-1] * k + x[2:])[x[1:-1] != blank]
            counts = np.bincount(np.concatenate([x[x != blank], two + k, three + k + k * k]), minlength=self.bins)
            ids = np.flatnonzero(counts)
            keys = np.sort(ids - counts[ids] * self.bins)[: self.size]  # most frequent first; ties by number
            return self._numbers(keys % self.bins)
        two = x[:-1] << _BITS | x[1:]
        three = (two[:-1] << _BITS | x[2:])[x[1:-1] != blank]
        ids, counts = np.unique(np.concatenate([x[x != blank], two, three]), return_counts=True)
        return ids[np.argsort(-counts, kind="stable")[: self.size]]

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        top = self.top(text)
        if top is None:
            return None
        apart = np.full(len(self.langs), len(top) * self.size, np.int64)
        at = np.searchsorted(self.known, top)
        here = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == top) if len(self.known) else np.zeros(0, np.int64)
        first, n = self.first[at[here]], self.first[at[here] + 1] - self.first[at[here]]
        place = np.repeat(here, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        np.add.at(apart, self.lang[entry], np.abs(self.rank[entry] - place) - self.size)
        return apart, len(top) * self.size

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if text and self.langs else None
        if found is None:
            return UNDETERMINED, 0.0
        apart, most = found
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / most


def predict(docs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """All columns of ``docs`` and a struct ``lang_found`` with lang_pred and score; a column of that name is replaced."""
    made: list[Profiles] = []

    @F.arrow_udf("lang_pred string, score double")
    def find(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Profiles(profiles))
        rows = [made[0].predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn("lang_found", find("text"))


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 4) == HELD_OUT, F.lit(False))
    profiles = fit_profiles(docs.where(~held_out).select("doc_id", "lang", "text"))
    scored = predict(docs.select("doc_id", "text"), profiles)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_found.lang_pred", "lang_found.score")
