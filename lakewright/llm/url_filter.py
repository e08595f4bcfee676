"""URL filters with dated lists: a temporal join.

A list entry says from which day on a key is blocked, allowed or removed from the list. The entries
of one list and key become validity intervals, each up to the next entry. A capture has the keys that
lists can name: its host's domains (``d:`` and the labels from any one to the last) and its paths'
prefixes (``p:`` host and whole path segments). An as-of join finds the entries that were active when
the capture was fetched, and the most specific (longest) active key decides; of equal ones, ``block``.

Everything is DataFrame functions. The intervals are broadcast if they are at most BROADCAST_ENTRIES,
else joined by key; a host that has many captures then makes a skewed join, which Spark splits.

Edge cases: a null or malformed URL has no host and no keys, and is not blocked. A null fetch day
meets no entry. Entries with a null key, list, action or day are no entries; of several entries of one
list, key and day the first by name of action holds (allow, block, remove). Repeated captures each get
their own, equal, row. Empty lists block nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import stored, table

BROADCAST_ENTRIES = 200_000


def host_of(url: Column) -> Column:
    """The host, of any letters or a bracketed address, in lower case without user, port and last dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """The keys that a list can name a URL by."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(labels, lambda _, i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.transform(segments, lambda _, i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i + 1), "/")))
    none = F.array().cast("array<string>")
    return F.when(host.isNull(), none).otherwise(F.array_distinct(F.concat(domains, F.coalesce(prefixes, none))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, from_day, to_day) of blocking and allowing entries; to_day is open if null."""
    clean = entries.dropna(subset=["list", "key", "action", "day"]).groupBy("list", "key", "day").agg(F.min("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    dated = clean.select("list", "key", "action", F.col("day").alias("from_day"), following.alias("to_day"))
    return dated.where(F.col("action").isin("block", "allow"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a capture (columns capture_id, url, day): with host, n_active, blocked and rule (the deciding key)."""
    active = stored(intervals(entries), "intervals")
    active = F.broadcast(active) if active.count() <= BROADCAST_ENTRIES else active
    each = captures.select(F.monotonically_increasing_id().alias("row"), "capture_id", "url", "day")
    # The empty key stands for the capture itself.
    each = each.withColumn("key", F.explode(F.concat(F.array(F.lit("")), keys_of(F.col("url")))))
    valid = (F.col("c.key") == F.col("e.key")) & (F.col("c.day") >= F.col("e.from_day")) & (F.col("e.to_day").isNull() | (F.col("c.day") < F.col("e.to_day")))
    met = each.alias("c").join(active.alias("e"), valid, "left").where("c.key = '' or e.key is not null")
    rule = F.when(F.col("action").isNotNull(), F.struct(F.length("c.key").alias("length"), (F.col("action") == "block").alias("block"), F.col("c.key").alias("key")))
    own = lambda c: F.max(F.when(F.col("c.key") == "", F.col(c)))
    one = met.groupBy("row").agg(own("capture_id").alias("capture_id"), own("url").alias("url"), own("day").alias("day"), F.count("action").alias("n_active"), F.max(rule).alias("rule"))
    return one.select("capture_id", "url", "day", host_of(F.col("url")).alias("host"), "n_active", F.coalesce(F.col("rule.block"), F.lit(False)).alias("blocked"), F.col("rule.key").alias("rule"))


def _number(text: Column) -> Column:
    """A number below 2 ** 24 that a text always gives, in SQL of any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures; the table has no fetch time, so a day of 2024 is drawn from the URL."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), _number(F.coalesce("url", F.lit(""))) % 366)
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Lists over the hosts of the pages, of a size with the input, for want of a table of lists.

    A quarter of the hosts is blocked from some day on, half of those for 60 days; the first path
    segment of a third of the hosts is allowed from some day on; two parent domains have fixed entries.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.get(F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != ""), F.lit(0)).alias("first"))
    hosts = hosts.where("host is not null").groupBy("host").agg(F.min("first").alias("first")).withColumn("v", _number(F.col("host")))
    start = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), F.col("v") % n)
    entry = lambda name, key, action, day: F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), day.alias("day"))
    domain = F.concat(F.lit("d:"), F.col("host"))
    made = F.array_compact(
        F.array(
            F.when(F.col("v") % 4 == 0, entry("hosts", domain, "block", start(300))),
            F.when(F.col("v") % 8 == 0, entry("hosts", domain, "remove", F.date_add(start(300), 60))),
            F.when((F.col("v") % 3 == 0) & F.col("first").isNotNull(), entry("paths", F.concat(F.lit("p:"), F.col("host"), F.lit("/"), F.col("first")), "allow", start(200))),
        )
    )
    fixed = pages.sparkSession.createDataFrame(FIXED, "list string, key string, action string, day string")
    return hosts.select(F.explode(made).alias("e")).select("e.*").unionByName(fixed.withColumn("day", F.to_date("day")))


# Entries for parent domains.
FIXED = [
    ("parents", "d:example.net", "block", "2024-03-01"),
    ("parents", "d:example.net", "allow", "2024-06-01"),
    ("parents", "d:example.net", "remove", "2024-10-01"),
    ("parents", "d:example.org", "block", "2024-08-15"),
]


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(captures_of(pages), entries_of(pages)).withColumnRenamed("capture_id", "page_id")
    return out.withColumn("day", F.col("day").cast("string"))


ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, CAST('0x' || substr(md5(coalesce(url, '')), 1, 6) AS INT) AS uv,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)', 1)), '\.+$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM pages),
c AS (SELECT rid, page_id, url, host, CAST(DATE '2024-01-01' + uv % 366 AS DATE) AS day,
    CASE WHEN host IS NULL THEN [] ELSE list_distinct(list_concat(
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'd:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
      list_transform(range(1, len(seg) + 1), lambda i: 'p:' || host || '/' || array_to_string(list_slice(seg, 1, i), '/')))) END AS keys FROM p),
h AS (SELECT host, min(seg[1]) AS first, CAST('0x' || substr(md5(host), 1, 6) AS INT) AS v FROM p WHERE host IS NOT NULL GROUP BY host),
e AS (SELECT 'hosts' AS list, 'd:' || host AS key, 'block' AS action, CAST(DATE '2024-01-01' + v % 300 AS DATE) AS day FROM h WHERE v % 4 = 0
  UNION ALL SELECT 'hosts', 'd:' || host, 'remove', CAST(DATE '2024-01-01' + (v % 300 + 60) AS DATE) FROM h WHERE v % 8 = 0
  UNION ALL SELECT 'paths', 'p:' || host || '/' || first, 'allow', CAST(DATE '2024-01-01' + v % 200 AS DATE) FROM h WHERE v % 3 = 0 AND first IS NOT NULL
  UNION ALL VALUES ('parents', 'd:example.net', 'block', DATE '2024-03-01'), ('parents', 'd:example.net', 'allow', DATE '2024-06-01'),
                   ('parents', 'd:example.net', 'remove', DATE '2024-10-01'), ('parents', 'd:example.org', 'block', DATE '2024-08-15')),
v AS (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS to_day FROM e),
m AS (SELECT k.rid, length(k.key) AS n, v.action = 'block' AS block, k.key FROM (SELECT rid, day, unnest(keys) AS key FROM c) k
      JOIN v ON k.key = v.key AND v.action IN ('block', 'allow') AND k.day >= v.day AND (v.to_day IS NULL OR k.day < v.to_day)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, block DESC, key DESC) AS place, count(*) OVER (PARTITION BY rid) AS n_active FROM m)
SELECT c.page_id, c.url, CAST(c.day AS VARCHAR) AS day, c.host, coalesce(r.n_active, 0) AS n_active, coalesce(r.block, false) AS blocked, r.key AS rule
FROM c LEFT JOIN r ON c.rid = r.rid AND r.place = 1
"""
