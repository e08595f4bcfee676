"""Benchmark decontamination by a positional inverted index.

A test window is 13 consecutive words of an item (all words of a shorter item). One pass over the corpus stores the
postings (document, position, term) of all words that occur in test windows; everything else is read from this index.
The postings of a term are counted there, and each window follows its rarest term: every posting of that gives an
offset-adjusted start, which is kept if the posting of the second rarest term stands at its own offset from it, and then
those of all other words (phrase match). A window whose three rarest terms stand within NEAR words of the rarest is a
proximity match.

Joins are on term, or on document and position, with at most a row a posting; lists that are as long as a third of the
corpus are split by Spark, as nothing above these joins needs a term together. The test terms are broadcast if they are
at most BROADCAST_ROWS, as are the rows of documents with a candidate; beyond that these are ordinary joins.

Edge cases: null or word-less texts have no words, no hits and the digest of the empty string; null or
word-less items have no windows; a null item id reads as the empty string. Repeated documents get equal
results, repeated items with one id count once. Empty tables: without documents no rows, without items
no hits. A document's columns that bear the name of a result are left out; other columns, of any name, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import stored, table

WINDOW = 13
NEAR = 26
#: Rows of terms or document numbers, of 50 bytes at most, up to which they are broadcast.
BROADCAST_ROWS = 200_000
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased and nothing else."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, NOT_A_WORD), "")


def windows(items: DataFrame) -> DataFrame:
    """Distinct windows: ``window`` (array of words), ``item_ids`` (of all items that have it)."""
    w, n = F.col("w"), F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(WINDOW - 1), F.lit(1)))
    item = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(n > 0)
    each = item.select("item_id", "w", F.explode(starts).alias("start"))
    each = each.select("item_id", F.slice(w, F.col("start"), F.lit(WINDOW)).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def _sized(rows: DataFrame) -> DataFrame:
    """Stored rows, to be broadcast if they are at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index, stored: row (number of the document), pos (from 1) and term (a number of ``terms``: word, term), of those
    terms alone: items with other words need a pass of their own.

    Position 0, with a null term, stands for the document itself: its columns but text as ``doc``, and n_words.
    """
    kept = [c for c in docs.columns if c != "text"]
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), words(F.col("text")).alias("w"))
    first = terms.limit(0).unionByName(terms.sparkSession.createDataFrame([("", None)], "word string, term long"))
    itself = F.col("pos") == 0
    # A word's row is narrow before it meets the terms: the document and its words don't go through a shuffle with each word.
    each = each.select("*", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word")).select("row", "pos", "word", F.when(itself, F.col("doc")).alias("doc"), F.when(itself, F.size("w")).alias("n_words"))
    met = each.join(_sized(stored(terms.unionByName(first), "terms")), "word")
    return stored(met.select("row", "pos", "term", "doc", "n_words"), "postings")


def by_rareness(found: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """The windows, stored, whose terms all occur in the corpus: window_id, length, the rarest term and its offset ``at``,
    ``rest``, the offsets and terms of all other words, rarest first, and near1 and near2, the next rarest terms.

    Ties go by offset. Where a window has fewer than three terms the last stands for those that it lacks.
    """
    counts = index.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = found.select("window_id", F.posexplode("window").alias("at", "word")).join(_sized(terms), "word").join(counts, "term", "left")
    one = placed.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("r"))
    one = one.withColumn("terms", F.array_distinct(F.transform("r", lambda x: x["term"])))
    nth = lambda k: F.get("terms", F.least(F.lit(k), F.size("terms") - 1))
    first = F.get("r", F.lit(0))
    rest = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: F.struct(x["at"].alias("at"), x["term"].alias("term")))
    return stored(one.where(first["n"] > 0).select("window_id", F.size("r").alias("length"), first["term"].alias("term"), first["at"].alias("at"), rest.alias("rest"), nth(1).alias("near1"), nth(2).alias("near2")), "by-rareness")


def phrases(rarest: DataFrame, index: DataFrame) -> DataFrame:
    """(row, start, window_id, length) of the phrase matches; ``rarest``: postings of the rarest terms with their windows."""
    term = index.select("row", "pos", "term").where("term is not null")
    starts = rarest.where(F.col("pos") > F.col("at")).select("row", (F.col("pos") - F.col("at")).alias("start"), "window_id", "length", "rest")
    second = F.get("rest", F.lit(0))
    asked = starts.where(F.size("rest") > 0).select("*", second["term"].alias("term"), (F.col("start") + second["at"]).alias("pos"))
    wanted = _sized(stored(asked.select("term").distinct(), "second-terms"))
    two = stored(asked.join(term.join(wanted, "term", "left_semi"), ["row", "pos", "term"], "left_semi").select("row", "start", "window_id", "length", F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "two-terms")
    rows = _sized(stored(two.select("row").distinct(), "candidates"))
    each = two.select("row", "start", "window_id", "length", F.explode("rest").alias("r")).select("row", "start", "window_id", "length", F.col("r.term").alias("term"), (F.col("start") + F.col("r.at")).alias("pos"))
    met = each.join(term.join(rows, "row", "left_semi"), ["row", "pos", "term"]).groupBy("row", "start", "window_id", "length").agg(F.count(F.lit(1)).alias("n"))
    whole = met.where(F.col("n") == F.col("length") - 2).drop("n")
    short = starts.where(F.size("rest") == 0).drop("rest").unionByName(two.where(F.size("rest") == 0).drop("rest"))
    return whole.unionByName(short)


def proximities(rarest: DataFrame, index: DataFrame) -> DataFrame:
    """(row, window_id) of the proximity matches."""
    block = 2 * NEAR + 1  # so that two blocks hold all that is near a position
    in_block = lambda pos: F.call_function("div", pos, F.lit(block))
    found = rarest.select("row", "pos", "window_id", "near1", "near2")
    for name in ("near1", "near2"):
        blocks = F.array_distinct(F.array(in_block(F.greatest(F.col("pos") - NEAR, F.lit(0))), in_block(F.col("pos") + NEAR)))
        asked = found.select("*", F.col(name).alias("term"), F.explode(blocks).alias("block"))
        wanted = _sized(stored(found.select(F.col(name).alias("term")).distinct(), "near-terms"))
        there = index.where("term is not null").select("row", "term", F.col("pos").alias("there")).join(wanted, "term", "left_semi").withColumn("block", in_block(F.col("there")))
        near = (asked["row"] == there["row"]) & (asked["term"] == there["term"]) & (asked["block"] == there["block"]) & (F.abs(F.col("there") - F.col("pos")) <= NEAR)
        found = stored(asked.join(there, near, "left_semi").drop("term", "block").distinct(), name)
    return found.select("row", "window_id").distinct()


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: all columns of ``docs`` but text, n_words, ``hits``, the set of (start, length) of phrase
    matches, item_ids, the items that these belong to, and near_ids, those with a proximity match."""
    found = stored(windows(items).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    terms = stored(found.select(F.explode("window").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "words")
    index = postings(docs, terms)
    ranked = by_rareness(found, terms, index)
    rarest = stored(index.select("row", "pos", "term").join(ranked, "term"), "rarest")
    ids = found.select("window_id", "item_ids")
    hits = stored(phrases(rarest, index), "phrases").join(ids, "window_id").groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    near = proximities(rarest, index).join(ids, "window_id").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("near_ids"))
    itself = index.where("pos = 0").select("row", "doc", F.col("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = itself.join(hits, "row", "left").join(near, "row", "left")
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ("text", "n_words", "hits", "item_ids", "near_ids")]
    return out.select(*kept, "n_words", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids"))


def covered(hits: Column) -> Column:
    """The number of words that lie in at least one of the (start, length) intervals."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = (span["start"] + span["length"]).cast("long")
        more = F.greatest(end - F.greatest(span["start"].cast("long"), state["end"]), F.lit(0).cast("long"))
        return F.struct((state["n"] + more).alias("n"), F.greatest(end, state["end"]).alias("end"))

    return F.aggregate(spans, zero, add)["n"]


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, and n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    kept = [c for c in docs.columns if c != "text" and c not in RESULTS]
    found = matches(docs.select(*[F.col(f"`{c}`") for c in [*kept, "text"]]), items)
    out = found.withColumn("n_hit", covered(F.col("hits")))
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    number = lambda ids: F.size(ids).cast("long")
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "n_words", "n_hit", number("item_ids").alias("n_items"), digest.alias("items_sha256"), dirty.alias("contaminated"), number("near_ids").alias("n_near_items")
    )


def _text_key(docs: DataFrame) -> list[Column]:
    return [F.xxhash64(docs["text"]).alias("__h1"), F.xxhash64(F.lit(1), docs["text"]).alias("__h2")]


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Equal texts share one verdict."""
    h1, h2 = _text_key(docs)
    dirty = report(docs.select(h1, h2, "text"), items).where("contaminated").select("__h1", "__h2").distinct()
    keyed = docs.withColumns({"__h1": h1, "__h2": h2})
    return keyed.join(dirty, ["__h1", "__h2"], "left_anti").select(*docs.columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for each document, and n_near_items, the number of items with a proximity match."""
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, s, s + 12) AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, n, s, list_slice(w, s, s + n - 1) AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.s, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.win = win.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid),
p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
tc AS (SELECT word, count(*) AS n FROM p GROUP BY word),
wt AS (SELECT item_id, win, word, min(i) AS i FROM (SELECT item_id, win, unnest(win) AS word, generate_subscripts(win, 1) AS i FROM win) GROUP BY item_id, win, word),
rk AS (SELECT item_id, win, wt.word, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item_id, win ORDER BY coalesce(n, 0), i) AS r FROM wt LEFT JOIN tc ON wt.word = tc.word),
three AS (SELECT DISTINCT item_id, t1, coalesce(t2, t1) AS t2, coalesce(t3, t2, t1) AS t3
          FROM (SELECT item_id, win, max(n) FILTER (r = 1) AS n, max(word) FILTER (r = 1) AS t1, max(word) FILTER (r = 2) AS t2, max(word) FILTER (r = 3) AS t3 FROM rk GROUP BY item_id, win) WHERE n > 0),
two AS (SELECT DISTINCT a.rid, a.pos, item_id, t3 FROM (SELECT rid, pos, item_id, t2, t3 FROM three JOIN p ON word = t1) a
        JOIN p b ON b.rid = a.rid AND b.word = a.t2 WHERE abs(b.pos - a.pos) <= 26),
near AS (SELECT two.rid, count(DISTINCT item_id) AS n_near FROM two JOIN p c ON c.rid = two.rid AND c.word = two.t3 WHERE abs(c.pos - two.pos) <= 26 GROUP BY two.rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN ids ON d.rid = ids.rid LEFT JOIN near ON d.rid = near.rid
"""
