"""Secret scans with multipart credential linking.

Base spans, each kind leftmost and non-overlapping in the whole text: ``assign`` (a secret's name, a
sign and a value of 8 or more characters), ``access`` (AKIA... of 16 or more), ``hex`` (runs of 32 or
more). They always stay.

Weak candidates mean nothing alone: ``weak_id`` (a user or client name that is assigned), ``weak_secret``
(a run of 24 to 64 characters with a digit, an upper and a lower case letter that is no assigned value)
and ``endpoint`` (a web address). Every access identifier, ``access`` or ``weak_id``, opens a scope that
reaches SCOPE characters to either side. Secrets and endpoints are interval-joined to the scopes by
where they start; in a scope that holds at least one secret (``assign``, ``hex`` or ``weak_secret``),
the weak parts are reported.

Positions come from regular expressions alone: matching ``(.*?)(pattern)`` over and over yields the
gaps and the matches of a text, whose lengths add up to code point offsets in a window sum. The join
has a key of document and block of SCOPE characters, so its fan-out is bounded by what fits in a scope.

Edge cases: null and empty texts have no spans, counts of 0, the digest of the empty string and empty
``spans``. Repeated rows each get their own, equal, result. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import stored, table

SCOPE = 200

# The kinds in the order of their listing, and their patterns.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK_ID = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
WEAK_SECRET = r"[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"""https?://[^\s"'<>]+"""


def _found(text: Column, kind: int, pattern: str, value: bool = False) -> Column:
    """Array of (kind, i, gap, length, value): the i-th match, and the characters between it and the one before."""
    each = rf"(?s)\G(.*?)({pattern})"  # \G: each match starts where the last ended, so the end of a text is searched once
    gaps, hits = F.regexp_extract_all(text, F.lit(each), F.lit(1)), F.regexp_extract_all(text, F.lit(each), F.lit(2))
    values = F.regexp_extract_all(text, F.lit(each), F.lit(3)) if value else hits
    rows = F.transform(
        F.arrays_zip(gaps.alias("g"), hits.alias("h"), values.alias("v")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["h"]).alias("length"), x["v"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,value:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end) of all base and weak parts; a document without any has one row with nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_found(text, 0, ASSIGN, True), _found(text, 1, ACCESS), _found(text, 2, HEX))
    weak = F.concat(_found(text, 3, WEAK_ID, True), _found(text, 4, WEAK_SECRET), _found(text, 5, ENDPOINT))
    # Without an access identifier no weak part is reported.
    weak = F.when(text.rlike(ACCESS) | text.rlike(WEAK_ID), weak)
    each = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(base, F.coalesce(weak, F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,value:string>>"))).alias("found"))
    each = each.select("row", "doc_id", F.explode_outer("found").alias("f")).select("row", "doc_id", "f.*")
    before = Window.partitionBy("row", "kind").orderBy("i")
    placed = each.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before))
    value = F.col("value")
    ok = (
        F.when(F.col("kind") == 0, F.length(value) >= 8)
        .when(F.col("kind") == 4, (F.length(value) <= 64) & value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]"))
        .otherwise(F.lit(True))
    )
    # A match that fails leaves a row of nulls, so that its document is not lost.
    held = lambda c: F.when(ok & F.col("kind").isNotNull(), c)
    return placed.select("row", "doc_id", held(F.col("kind")).alias("kind"), held(F.col("end") - F.col("length")).alias("start"), held(F.col("end")).alias("end"))


def linked(found: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the weak parts to report."""
    part = found.where("kind is not null")
    values = part.where("kind = 0").select("row", "end")  # the value that ends an assignment is no weak secret
    weak = part.where("kind = 4").join(values, ["row", "end"], "left_anti").select("row", "kind", "start", "end")
    secrets = part.where("kind in (0, 2, 5)").select("row", "kind", "start", "end").unionByName(weak)
    scopes = part.where("kind in (1, 3)").select("row", F.col("kind").alias("id_kind"), F.col("start").alias("id_start"), F.col("end").alias("id_end"))
    low, high = F.col("id_start") - SCOPE, F.col("id_end") + SCOPE
    block = lambda c: F.floor(c / F.lit(SCOPE))
    scopes = scopes.withColumn("block", F.explode(F.sequence(block(low), block(high))))
    inside = (F.col("start") >= low) & (F.col("start") <= high)
    pairs = scopes.join(secrets.withColumn("block", block(F.col("start"))), ["row", "block"]).where(inside)
    scope = Window.partitionBy("row", "id_kind", "id_start")
    whole = pairs.withColumn("has_secret", F.max(F.col("kind") != 5).over(scope)).where("has_secret")
    of = whole.where("kind in (4, 5)").select("row", "kind", "start", "end")
    ids = whole.where("id_kind = 3").select("row", F.col("id_kind").alias("kind"), F.col("id_start").alias("start"), F.col("id_end").alias("end"))
    return of.unionByName(ids).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = stored(parts(docs), "secrets")
    base = found.select("row", "doc_id", F.when(F.col("kind") < 3, F.col("kind")).alias("kind"), "start", "end")
    more = linked(found).select("row", F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end")
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    one = base.unionByName(more).groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.array_sort(F.collect_list(span)).alias("all"))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return one.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line(F.filter("all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), line(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["kind"] >= 3)).cast("long").alias("n_linked"),
    )


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_kind(kind: int, pattern: str, value: str, ok: str) -> str:
    each = f"(?s)(.*?)({pattern})".replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, e AS "end", e - len AS start FROM (
        SELECT rid, length(h) AS len, v, CAST(sum(length(g) + length(h)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e FROM (
        SELECT rid, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g, unnest(hs) AS h, unnest(vs) AS v FROM (
        SELECT rid, regexp_extract_all(text, '{each}', 1) AS gs, regexp_extract_all(text, '{each}', 2) AS hs, regexp_extract_all(text, '{each}', {value}) AS vs FROM d))) WHERE {ok}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
part AS ({_sql_kind(0, ASSIGN, '3', 'length(v) >= 8')}
  UNION ALL {_sql_kind(1, ACCESS, '2', 'true')}
  UNION ALL {_sql_kind(2, HEX, '2', 'true')}
  UNION ALL {_sql_kind(3, WEAK_ID, '3', 'true')}
  UNION ALL {_sql_kind(4, WEAK_SECRET, '2', "length(v) <= 64 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')")}
  UNION ALL {_sql_kind(5, ENDPOINT, '2', 'true')}),
sec AS (SELECT * FROM part p WHERE kind IN (0, 2, 5) OR kind = 4 AND NOT EXISTS (SELECT 1 FROM part a WHERE a.kind = 0 AND a.rid = p.rid AND a."end" = p."end")),
pair AS (SELECT i.rid, i.kind AS id_kind, i.start AS id_start, i."end" AS id_end, s.kind, s.start, s."end",
         max(s.kind <> 5) OVER (PARTITION BY i.rid, i.kind, i.start) AS has
         FROM part i JOIN sec s ON i.rid = s.rid AND s.start >= i.start - {SCOPE} AND s.start <= i."end" + {SCOPE} WHERE i.kind IN (1, 3)),
more AS (SELECT DISTINCT rid, kind, start, "end" FROM pair WHERE has AND kind IN (4, 5)
         UNION SELECT DISTINCT rid, id_kind, id_start, id_end FROM pair WHERE has AND id_kind = 3),
allp AS (SELECT rid, kind, start, "end" FROM part WHERE kind < 3 UNION ALL SELECT rid, kind, start, "end" FROM more),
named AS (SELECT *, ['assign', 'access', 'hex', 'weak_id', 'weak_secret', 'endpoint'][kind + 1] || ':' || start || ':' || "end" AS s FROM allp),
agg AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind > 2) AS n,
        string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n, 0) AS n_linked FROM d LEFT JOIN agg ON d.rid = agg.rid
"""
