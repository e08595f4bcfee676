"""Line dedup by a segment-partition edit join.

All lines with a word take part; the others (blank lines, rules) always stay, and so do lines under ``min_chars``
where a caller asks for such a floor. Equal lines are one node. Two nodes are linked if their edit distance is at most
what the shorter one allows: an edit for each ``every`` characters, ``threshold`` at most. So lines under ``every``
characters go by equality alone ("Day 1" and "Day 2" are not copies). To find such pairs, each line is
cut into one segment more than the edits it allows, of even length: of two linked lines, one contains a segment of the
other, near the same place. The index holds (length, segment number, segment); a line probes it, for each length
from its own down to ``threshold`` less, with the few substrings whose start a match can have. Both
sides travel as 64-bit keys. Keys that more than HOT lines share are refined: their lines, without the
matching segment, are joined in the same way once more on the rest, which is exact too, as what is left
must match within the allowance, and meet only if the parities of their letter counts allow it; keys whose rest would be too short
for that stay as they are. Candidates are verified by a banded bit-parallel edit distance.

A line stays where it first occurs (smallest doc_id, then place) unless it is linked to a line that
first occurs in an earlier document, or in the same and is smaller as a string. All else is removed.

Everything is DataFrame functions, and linear in the lines of a document. Edge cases: null and empty texts have no lines
that take part and stay as they are. Rows that share an id count as one document; each of them keeps the lines that stay.
Rows with a null id are a document each and come last. A text of which every line goes becomes the empty string.
Lines of any length and any letters take part whole. Empty tables give no rows. Other columns stay, of any name that
doesn't begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import stored, table

THRESHOLD = 2
#: Characters of a line for each edit that it allows.
EVERY = 8
MIN_CHARS = 0
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
HOT = 16
#: Rows of ids or hashes, of 50 bytes at most, up to which they are broadcast.
BROADCAST_IDS = 200_000

def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def takes_part(line: Column, min_chars: int) -> Column:
    return (F.length(line) >= min_chars) & line.rlike(WORD)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with __id, the document id, __row, which numbers the rows without one and is null for all others, and
    __text, a hash of the text, by which rows that share an id are told apart.

    The rows without an id are written out, so that their numbers stay."""
    docs = docs.withColumn("__text", F.xxhash64(docs["text"]))
    with_id = docs.where(docs["doc_id"].isNotNull()).withColumns({"__id": docs["doc_id"].cast("long"), "__row": F.lit(None).cast("long")})
    none = docs.where(docs["doc_id"].isNull())
    if not none.limit(1).count():
        return with_id
    return with_id.unionByName(stored(none.withColumns({"__id": F.lit(None).cast("long"), "__row": F.monotonically_increasing_id()}), "null-ids"))


def letter_parities(line: Column) -> Column:
    """A bit for each of 64 classes of characters, by code: whether a line has an odd number of them."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def parities_allow(a: Column, b: Column, edits: Column, apart: Column) -> Column:
    """Whether two lines can be within so many edits, as their lengths are so far apart: a character more or less changes one
    class, and each of the other edits two."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * edits - F.abs(apart)


def allowed_edits(length: Column, threshold: int, every: int) -> Column:
    """The edits that a line of a length allows."""
    return F.least(F.lit(threshold), F.call_function("div", length, F.lit(every))).cast("int")


def _options(edits: int, probing: bool) -> list[tuple[int, int, int, int]]:
    """(edits, delta, number, shift) of the keys of a line: how much shorter the indexed line is, which of its segments, and
    how far from its place there. An index key has neither delta nor shift; a probe leaves out the shifts that would need
    too many edits on one side of the segment."""
    k = edits + 1
    if not probing:
        return [(edits, 0, i, 0) for i in range(1, k + 1)]
    shifts = range(-edits, edits + 1)
    return [(edits, d, i, s) for d in range(k) for i in range(1, k + 1) for s in shifts if abs(s) <= i - 1 and abs(s - d) <= k - i]


def key_rows(lines: DataFrame, threshold: int, probing: bool, every: int, outer: list[str] | None = None) -> DataFrame:
    """One row for each key of each line (id, line, length): id, key, at, size, other (the indexed line's length), key_edits, delta.

    The options are exploded first, so that one short expression makes all keys: unrolled, they are more
    than the JVM compiles. Segments are even, the later ones longer by one where the length doesn't part.
    With ``outer``, columns that go into the key, the lines are what is left of others and have a column ``edits``.
    """
    option = lambda o: F.struct(*[F.lit(x).alias(n) for n, x in zip(("of_edits", "delta", "i", "shift"), o, strict=True)])
    options = [F.array(*[option(o) for t in range(least, threshold + 1) for o in _options(t, probing)]) for least in (1, threshold)]
    all_allowed = F.col("edits") == threshold if outer else F.col("length") >= threshold * (every + 1)  # that of shorter lines too
    each = lines.select("*", F.explode(F.when(all_allowed, options[1]).otherwise(options[0])).alias("o")).select("*", "o.*")
    each = each.withColumn("other", F.col("length") - F.col("delta"))
    edits = F.col("edits") if outer else allowed_edits(F.col("other"), threshold, every)
    k = F.col("of_edits") + 1
    each = each.where((edits == F.col("of_edits")) & (F.col("other") >= k))
    each = each.withColumn("short", F.call_function("div", F.col("other"), k).cast("int"))
    each = each.withColumn("even", k - F.pmod(F.col("other"), k))  # so many segments are the short ones
    start = F.col("short") * (F.col("i") - 1) + F.greatest(F.col("i") - 1 - F.col("even"), F.lit(0)) + 1
    each = each.select("*", (start + F.col("shift")).alias("at"), (F.col("short") + F.when(F.col("i") > F.col("even"), 1).otherwise(0)).alias("size"))
    each = each.where((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("length")))
    of = [F.col("other"), F.col("i"), F.substring(F.col("line"), F.col("at"), F.col("size")), *map(F.col, outer or [])]
    return each.select("id", F.xxhash64(*of).alias("key"), "at", "size", "other", F.col("of_edits").alias("key_edits"), "delta")


def common_start(a: Column, b: Column) -> Column:
    """The number of characters that two strings begin with alike, found by halving; of the first 33 million, in full."""
    least = F.least(F.length(a), F.length(b))
    halves = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    same = lambda n, w: F.substring(a, n + 1, w) == F.substring(b, n + 1, w)
    return F.aggregate(halves, F.lit(0), lambda n, w: F.when((n + w <= least) & same(n, w), n + w).otherwise(n))


def _differing(a: Column, b: Column) -> Column:
    """An array of one struct (a, b): the reversed strings without what they begin and end with alike."""
    rest = lambda s, n: F.substring(s, n + 1, F.length(s))
    # A lambda's variable is evaluated once.
    out = F.array(F.struct(a.alias("a"), b.alias("b")))
    for _ in range(2):
        cut = F.transform(out, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), common_start(s["a"], s["b"]).alias("n")))
        out = F.transform(cut, lambda s: F.struct(F.reverse(rest(s["a"], s["n"])).alias("a"), F.reverse(rest(s["b"], s["n"])).alias("b")))
    return out


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings if it is at most ``threshold``, else null, by bit vectors along the diagonal.

    What the strings begin and end with alike doesn't count and is left out first.

    The band holds the diagonals i - j from -threshold to threshold, a bit each. ``r[e]`` has a diagonal's
    bit set if the distance there, at place j of ``b``, is at most e. With ``eq`` for the places at which
    the characters agree, a step to the next j is: agree on the diagonal, or spend an edit on a substitution
    (same bit), on a character of ``b`` (the bit above) or on one of ``a`` (the bit below, in the new column).
    """
    t, width = threshold, 2 * threshold + 1
    letters = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))  # noqa: E731  code points
    once = F.transform(_differing(a, b), lambda s: F.struct(F.concat(F.array_repeat(F.lit(""), t), letters(s["a"])).alias("x"), letters(s["b"]).alias("y")))
    name = [f"r{e}" for e in range(t + 1)]

    def agreeing(c: Column, j: Column, x: Column) -> Column:
        bits = [F.when(F.get(x, j + k) == c, 1 << k).otherwise(0) for k in range(width)]
        return sum(bits[1:], bits[0])

    def step(s: Column, eq: Column) -> Column:
        new = [s["r0"].bitwiseAND(eq)]
        for e in range(1, t + 1):
            less = s[name[e - 1]]
            spent = less.bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[-1], 1).bitwiseAND(F.lit((1 << width) - 1)))
            new.append(s[name[e]].bitwiseAND(eq).bitwiseOR(spent))
        return F.struct(*[v.alias(n) for v, n in zip(new, name, strict=True)])

    start = F.struct(*[F.lit(sum(1 << (t + i) for i in range(e + 1))).alias(name[e]) for e in range(t + 1)])
    end = F.length(a) - F.length(b) + t
    # A lambda's variable is evaluated once: the letters, and then the last vectors, are bound by transforms over one element.
    last = F.transform(once, lambda p: F.aggregate(F.transform(p["y"], lambda c, j: agreeing(c, j, p["x"])), start, step))
    level = lambda v: F.call_function("shiftright", v, end).bitwiseAND(F.lit(1))
    within = F.get(F.transform(last, lambda r: F.array_position(F.array(*[level(r[n]) for n in name]), 1) - 1), F.lit(0))
    return F.when((end >= 0) & (end < width), F.when(within >= 0, within))


def may_be_near(a: Column, b: Column, edits: int | Column, blocks: int = 8) -> Column:
    """Whether all but ``edits`` of the blocks of one line stand in the other, as each edit spoils one at most."""
    size = F.call_function("div", F.length(a), F.lit(blocks)).cast("int")
    held = [F.contains(b, F.substring(a, size * k + 1, size)).cast("int") for k in range(blocks)]
    return sum(held[1:], held[0]) >= blocks - edits


def _known(ids: DataFrame) -> DataFrame:
    """Stored ids or hashes, for a broadcast where they are few. Left to Spark's own statistics, the other side, whole lines
    at times, may be shuffled before these are told to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _candidates(lines: DataFrame, threshold: int, every: int = 1) -> DataFrame:
    """Pairs (a, b) of line ids, a < b, that share a key. ``lines``: id, line and length.

    The index is written once, to be counted and to be joined. In the join one row without an id stands for the lines of a
    hot key, so that one pass over the probes gives the pairs and the lines that ask for a hot key too.
    """
    pair = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    refinable = F.col("other") - F.col("size") > F.col("key_edits")
    index = stored(key_rows(lines, threshold, False, every).select("key", F.col("id").alias("a"), refinable.alias("refinable")), "index")
    asks = key_rows(lines, threshold, True, every).select("key", F.col("id").alias("b"))
    hot = stored(index.where("refinable").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "hot")
    index = index.select("key", "a")
    if hot.isEmpty():
        return pair(index.join(asks, "key")).distinct()
    known = _known(hot)
    standing = index.join(known, "key", "left_anti").unionByName(hot.select("key", F.lit(None).cast("long").alias("a")))
    found = standing.join(asks, "key").where("a is null or a <> b")
    met = stored(found.select(F.when(F.col("a").isNotNull(), F.least("a", "b")).alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    # A line's own segments are among what it asks for, so its probes tell whether it has a hot key.
    having = _known(met.where("a is null").select(F.col("b").alias("id")))
    some = stored(lines.join(having, "id", "left_semi").select("id", "line", "length", letter_parities(F.col("line")).alias("letters")), "hot-lines")
    return met.where("a is not null").unionByName(pair(_refined(some, known, threshold, every))).distinct()


def _refined(lines: DataFrame, hot: DataFrame, threshold: int, every: int) -> DataFrame:
    """The pairs of hot keys: the rests of the lines, without the segment of the key, must share a key too.

    Keys are told hot before any rest is made, so that few strings are copied.
    """
    line = F.col("line")

    def again(probing: bool, name: str) -> DataFrame:
        each = key_rows(lines, threshold, probing, every).join(hot, "key", "left_semi").join(lines, "id")
        rest = F.concat(F.substring(line, F.lit(1), F.col("at") - 1), F.substring(line, F.col("at") + F.col("size"), F.col("length")))
        rests = each.select("id", F.col("key").alias("outer"), rest.alias("line"), (F.col("length") - F.col("size")).alias("length"), F.col("key_edits").alias("edits"))
        rows = key_rows(rests, threshold, probing, every, ["outer"]).select(F.col("key").alias("finer"), F.col("id").alias(name), F.col("key_edits").alias("edits"), F.col("delta").alias("apart"))
        return rows.distinct().join(lines.select(F.col("id").alias(name), F.col("letters").alias(f"{name}_letters")), name)

    # The edits and the difference of the lengths go into the key, so that both sides have the same.
    allowed = parities_allow(F.col("a_letters"), F.col("b_letters"), F.col("edits"), F.col("apart")) & (F.col("a") != F.col("b"))
    return again(False, "a").drop("edits", "apart").join(again(True, "b"), "finer").where(allowed).select("a", "b")


def line_nodes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct lines that take part of ``numbered`` documents: id, line, length, first_id and first_row (of the first document), n (places)."""
    each = docs.select("__id", "__row", F.explode(lines_of(F.col("text"))).alias("line")).where(takes_part(F.col("line"), min_chars))
    nodes = each.groupBy("line").agg(F.min("__id").alias("first_id"), F.min("__row").alias("first_row"), F.count(F.lit(1)).alias("n"))
    first_row = F.when(F.col("first_id").isNull(), F.col("first_row")).alias("first_row")
    return stored(nodes.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("length"), "first_id", first_row, "n"), "lines")


def links(nodes: DataFrame, threshold: int = THRESHOLD, every: int = EVERY) -> DataFrame:
    """(a, b, later): linked lines, and which of them goes."""
    pairs = stored(_candidates(nodes.select("id", "line", "length"), threshold, every), "pairs")
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    wanted = nodes.join(_known(ids), "id", "left_semi")
    at = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "first_row", "line")
    side = lambda c: wanted.select(F.col("id").alias(c), at.alias(f"{c}_at"), F.col("length").alias(f"{c}_length"))
    a, b = F.col("a_at.line"), F.col("b_at.line")
    edits = allowed_edits(F.least("a_length", "b_length"), threshold, every)
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(may_be_near(a, b, edits))
    found = likely.where(banded_distance(a, b, threshold) <= edits)
    return found.select("a", "b", F.when(F.col("a_at") > F.col("b_at"), F.col("a")).otherwise(F.col("b")).alias("later"))


def removals(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, every: int = EVERY) -> DataFrame:
    """For each text of ``numbered`` documents with repeated or linked lines: __id, __row, __text, gone (places of lines that go), n_links."""
    nodes = line_nodes(docs, min_chars)
    found = stored(links(nodes, threshold, every), "links")
    gone = found.select(F.col("later").alias("id")).distinct().withColumn("gone", F.lit(True))
    ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    h1, h2 = F.xxhash64("line"), F.xxhash64(F.lit(1), F.col("line"))
    verdict = nodes.join(gone, "id", "left").join(ends, "id", "left").where("n > 1 or gone or n_links > 0")
    verdict = stored(verdict.select(h1.alias("h1"), h2.alias("h2"), "first_id", "first_row", F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "verdicts")
    each = docs.select("__id", "__row", "__text", F.posexplode(lines_of(F.col("text"))).alias("place", "line")).where(takes_part(F.col("line"), min_chars))
    placed = each.select("__id", "__row", "__text", "place", h1.alias("h1"), h2.alias("h2")).join(_known(verdict), ["h1", "h2"])
    elsewhere = ~(F.col("__id").eqNullSafe(F.col("first_id")) & F.col("__row").eqNullSafe(F.col("first_row")))
    # Partitioned by text once, for both groupings. In its first document a line stays at its first place.
    line = placed.repartition("__id", "__row", "__text").groupBy("__id", "__row", "__text", "h1", "h2")
    line = line.agg(F.array_sort(F.collect_set("place")).alias("places"), F.first(F.col("gone") | elsewhere).alias("goes"), F.first("n_links").alias("n_links"))
    goes = F.when(F.col("goes"), F.col("places")).otherwise(F.slice("places", F.lit(2), F.size("places")))
    return line.groupBy("__id", "__row", "__text").agg(F.flatten(F.collect_list(goes)).alias("gone"), F.sum("n_links").alias("n_links"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, every: int = EVERY) -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, and __n_lines, __n_removed, __n_links."""
    keyed = numbered(docs)
    found = removals(keyed, threshold, min_chars, every).withColumnsRenamed({"gone": "__gone", "n_links": "__n_links"})
    # The struct is never null, so that this is an ordinary join on keys, with rows that have no id too.
    key = F.struct("__id", "__row", "__text").alias("__key")
    out = keyed.withColumn("__key", key).join(found.select(key, "__gone", "__n_links"), "__key", "left").withColumn("__lines", lines_of(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n")
    text = F.when(F.size("__gone") > 0, kept).otherwise(F.col("text"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    number = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    n_removed = number(F.when(F.col("__gone").isNotNull(), F.size("__gone")))
    return out.select(*columns, number(F.when(F.col("text").isNotNull(), F.size("__lines"))).alias("__n_lines"), n_removed.alias("__n_removed"), number(F.col("__n_links")).alias("__n_links"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, n_links (of its distinct lines, to other lines) and the digest of the lines that stay."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__n_links").alias("n_links"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
