"""Registered queries of joins and counters over part tables, of log tails and of totals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import aggregates, joins, parts
from lakewright.registry import query, table
from lakewright.streaming import feeds

COMMENTS = """SELECT user_id AS doc, event_id AS "at", CASE WHEN event_id % 11 > 0 THEN CAST(floor(value) AS VARCHAR) END AS para_id FROM events WHERE event_type IN ('purchase', 'error', 'signup')"""
EXT = """SELECT user_id AS doc, event_id AS "at", CAST(floor(value) AS VARCHAR) AS para_id, CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS done, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) + 1 AS VARCHAR) END AS parent FROM events WHERE event_type = 'view'"""
IDS = """SELECT user_id AS doc, event_id AS "at", CAST(floor(value) AS VARCHAR) AS para_id, CAST(event_id AS VARCHAR) AS durable_id FROM events WHERE event_type = 'click'"""
FIRST = """SELECT *, row_number() OVER (PARTITION BY doc, para_id ORDER BY "at") AS n FROM ({}) WHERE para_id IS NOT NULL"""
THREADS = f"""SELECT c.doc, c."at", c.para_id, e.n IS NOT NULL AS ex_found, i.n IS NOT NULL AS id_found, e.done AS done_written, e.done = '1' AS done, e.parent AS parent_para_id, o."at" AS replies_to, i.durable_id FROM ({COMMENTS}) c
    LEFT JOIN ({FIRST.format(EXT)}) e ON c.doc = e.doc AND c.para_id = e.para_id AND e.n = 1 LEFT JOIN ({FIRST.format(IDS)}) i ON c.doc = i.doc AND c.para_id = i.para_id AND i.n = 1
    LEFT JOIN ({FIRST.format(COMMENTS)}) o ON c.doc = o.doc AND e.parent = o.para_id AND o.n = 1"""


def _comment_parts(spark, sf_dir):
    """Events as comments, their extensions and their ids; the whole part of a value stands for the paragraph."""
    events = table(spark, sf_dir, "events")
    whole = lambda plus=0: (F.floor("value") + plus).cast("double").cast("long").cast("string")
    base = events.select(F.col("user_id").alias("doc"), F.col("event_id").alias("at"), "event_type", whole().alias("para_id"), whole(1).alias("next"))
    comments = base.where(F.col("event_type").isin("purchase", "error", "signup")).select("doc", "at", F.when(F.col("at") % 11 > 0, F.col("para_id")).alias("para_id"))
    done = F.when(F.col("at") % 3 == 0, "1").when(F.col("at") % 3 == 1, "0")
    ext = base.where("event_type = 'view'").select("doc", "at", "para_id", done.alias("done"), F.when(F.col("at") % 4 == 0, F.col("next")).alias("parent"))
    return comments, ext, base.where("event_type = 'click'").select("doc", "at", "para_id", F.col("at").cast("string").alias("durable_id"))


def _whole(sql: str) -> str:
    """The SQL with whole numbers in place of DuckDB's text of doubles."""
    return sql.replace("CAST(floor(value) AS VARCHAR)", "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)").replace("CAST(floor(value) + 1 AS VARCHAR)", "CAST(CAST(floor(value) AS BIGINT) + 1 AS VARCHAR)")


@query("comment_threads", _whole(THREADS))
def comment_threads(spark, sf_dir):
    return parts.comment_threads(*_comment_parts(spark, sf_dir))


@query("comment_totals", _whole(f"""WITH t AS ({THREADS}), d AS (SELECT DISTINCT user_id AS doc FROM events WHERE event_type IN ('purchase', 'error', 'signup', 'view', 'click')), per AS (SELECT doc, count(*) AS comments_total, count(para_id) AS paras_with_para_id,
    count(DISTINCT para_id) FILTER (ex_found) AS ext_matched, count(DISTINCT para_id) FILTER (id_found) AS ids_matched, count(done_written) AS done_written_total, count(*) FILTER (done) AS done_true, count(*) FILTER (NOT done) AS done_false,
    count(*) FILTER (ex_found AND done_written IS NULL) AS ex_without_done, count(parent_para_id) AS replies_total, count(*) FILTER (parent_para_id IS NOT NULL AND replies_to IS NULL) AS replies_dangling FROM t GROUP BY doc),
    n AS (SELECT d.doc, (SELECT count(*) FROM ({EXT}) x WHERE x.doc = d.doc) AS ext_total, (SELECT count(*) FROM ({IDS}) x WHERE x.doc = d.doc) AS ids_total FROM d)
    SELECT n.doc, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('comments_total', 'paras_with_para_id', 'ext_matched', 'ids_matched', 'done_written_total', 'done_true', 'done_false', 'ex_without_done', 'replies_total', 'replies_dangling'))}, ext_total, ids_total,
    ext_total - coalesce(ext_matched, 0) AS ext_orphans, ids_total - coalesce(ids_matched, 0) AS ids_orphans FROM n LEFT JOIN per ON n.doc = per.doc"""))
def comment_totals(spark, sf_dir):
    comments, ext, ids = _comment_parts(spark, sf_dir)
    return parts.thread_totals(parts.comment_threads(comments, ext, ids), ext, ids)


MERGES = """SELECT l_partkey AS g, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_tax >= 0.01 THEN CAST(floor(l_quantity) AS BIGINT) END AS r0, CAST(floor(l_quantity) + l_linenumber - 2 AS BIGINT) AS r1,
    CAST(floor(l_discount * 100) AS BIGINT) AS c0, CAST(floor(l_discount * 100) + l_suppkey % 3 AS BIGINT) AS c1, l_returnflag = 'N' AS has_text FROM {}"""


@query("merge_ledger", f"""WITH m AS (SELECT g, pos, has_text, r0 > r1 OR c0 > c1 AS flips, least(r0, r1) AS a, greatest(r0, r1) AS b, least(c0, c1) AS c, greatest(c0, c1) AS d FROM ({MERGES.format('lineitem')}) WHERE r0 IS NOT NULL),
    hit AS (SELECT *, EXISTS (SELECT 1 FROM m e WHERE e.g = m.g AND e.pos < m.pos AND NOT e.flips AND e.a <= m.b AND m.a <= e.b AND e.c <= m.d AND m.c <= e.d) AS hits FROM m),
    s AS (SELECT g, count(DISTINCT (a, b, c, d)) FILTER (NOT flips) AS distinct_ranges, count(*) FILTER (hits) AS overlapping, count(*) FILTER (NOT flips AND a = b AND c = d) AS solo,
    CAST(coalesce(sum((b - a + 1) * (d - c + 1) - 1) FILTER (NOT flips), 0) AS BIGINT) AS covered_cells, count(*) FILTER (NOT flips AND has_text) AS anchors_with_text FROM hit GROUP BY g),
    t AS (SELECT g, count(*) AS total, count(*) FILTER (r0 IS NULL) AS bad_refs FROM ({MERGES.format('lineitem')}) GROUP BY g)
    SELECT t.g, total, bad_refs, coalesce(distinct_ranges, 0) AS distinct_ranges, coalesce(overlapping, 0) AS overlapping, coalesce(solo, 0) AS solo, coalesce(covered_cells, 0) AS covered_cells, coalesce(anchors_with_text, 0) AS anchors_with_text,
    total - bad_refs - coalesce(distinct_ranges, 0) AS duplicated FROM t LEFT JOIN s ON t.g = s.g""")
def merge_ledger(spark, sf_dir):
    return parts.merge_ledger(spark.sql(MERGES.format("{lineitem}"), lineitem=table(spark, sf_dir, "lineitem")).withColumnRenamed("pos", "at"), ["g"])


@query("table_csv", """WITH l AS (SELECT conv_id, turn, string_split(coalesce(text, ''), '. ') AS f FROM conversations),
    r AS (SELECT conv_id, turn, len(f) AS w, len(list_filter(f, lambda x: x = '')) AS e, array_to_string(list_transform(f, lambda x: CASE WHEN regexp_matches(x, '[",\r\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ',') AS line FROM l)
    SELECT conv_id, count(*) AS rows, max(w) AS columns, string_agg(w, ',' ORDER BY turn) AS widths, min(w) < max(w) AS ragged, CAST(sum(e) AS BIGINT) AS empty_cells, CAST(0 AS BIGINT) AS covered_cells, string_agg(line, chr(10) ORDER BY turn) || chr(10) AS csv FROM r GROUP BY 1""")
def table_csv(spark, sf_dir):
    """Conversations as tables: a turn is a row, a sentence a cell."""
    cells = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. "))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("row"), cells.alias("col", "text")).withColumn("covered", F.lit(False))
    return parts.table_csv(turns, ["conv_id"]).withColumn("widths", F.array_join(F.transform("widths", lambda w: w.cast("string")), ","))


@query("placeholder_hops", """WITH s AS (SELECT l_orderkey AS slide, l_linenumber AS line, l_returnflag <> 'A' AS ph, CASE WHEN l_tax >= 0.02 THEN l_suppkey % 7 END AS idx FROM lineitem), y AS (SELECT o_orderkey AS slide, o_custkey % 50 AS layout FROM orders),
    p AS (SELECT p_partkey % 50 AS layout, CAST(CASE WHEN p_size > 5 THEN p_size % 7 END AS BIGINT) AS idx FROM part), m AS (SELECT s.*, ph AND EXISTS (SELECT 1 FROM y JOIN p ON y.layout = p.layout WHERE y.slide = s.slide AND coalesce(p.idx, 0) = coalesce(s.idx, 0)) AS hit FROM s)
    SELECT count(*) AS shape_total, count(*) FILTER (ph) AS with_ph, count(*) FILTER (hit) AS hop_found, count(*) FILTER (ph AND NOT hit) AS hop_missing, count(*) FILTER (ph AND idx IS NULL) AS no_idx_written FROM m""")
def placeholder_hops(spark, sf_dir):
    idx = F.when(F.col("l_tax") >= 0.02, F.col("l_suppkey") % 7)
    shapes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide"), F.col("l_linenumber").alias("at"), (F.col("l_returnflag") != "A").alias("is_placeholder"), idx.alias("idx"))
    layouts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide"), F.lit(0).alias("at"), (F.col("o_custkey") % 50).alias("layout"))
    book = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("layout"), F.col("p_partkey").alias("at"), F.when(F.col("p_size") > 5, F.col("p_size") % 7).cast("long").alias("idx"), F.col("p_type").alias("kind"))
    return parts.hop_totals(parts.placeholder_hops(shapes, layouts, book))


@query("numbered_sections")
def numbered_sections(spark, sf_dir):
    """No SQL: DuckDB reads no HTML. tests/test_parts.py holds the numbers and headings against a plain version."""
    from lakewright.functions import html

    return parts.numbered_sections(table(spark, sf_dir, "pages").select("page_id", html.blocks("html").alias("blocks")), "page_id", "blocks")


@query("grid_overall", "SELECT round(avg(abs(floor(l_tax * 100) - floor(l_discount * 100)) / 255.0), 9) AS overall FROM lineitem")
def grid_overall(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"), F.floor(F.col("l_tax") * 100).alias("a"), F.floor(F.col("l_discount") * 100).alias("b"))
    return aggregates.grid_overall(aggregates.grid_diff(pixels, 2, 10)).select(F.round("overall", 9).alias("overall"))


@query("nested_total", "SELECT count(*) AS orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def nested_total(spark, sf_dir):
    nested = joins.nest(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ["o_orderkey"], "orders")
    return aggregates.nested_total(nested, ["orders"])


NUMBERED = "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS total FROM events"


@query("incremental_tail", f"""SELECT user_id, seq, 'line' AS event, event_type AS data FROM ({NUMBERED}) WHERE seq >= greatest(user_id % 40, total - 30)
    UNION ALL SELECT user_id, count(*), 'done', CAST(user_id % 3 AS VARCHAR) FROM events WHERE user_id % 2 = 0 GROUP BY user_id""")
def incremental_tail(spark, sf_dir):
    """Every user a job whose reader has had as many lines as the id says, modulo 40; those of even ids have ended."""
    events = table(spark, sf_dir, "events")
    log = events.sparkSession.sql("SELECT user_id, event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1L AS seq FROM {events}", events=events)
    jobs = events.select("user_id").distinct().select("user_id", (F.col("user_id") % 40).alias("consumed"), (F.col("user_id") % 2 != 0).alias("running"), (F.col("user_id") % 3).alias("exit_code"))
    return feeds.tail_events(log, jobs, "user_id", 30)


@query("until_terminal", """SELECT '{"user_id":' || user_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events e
    LEFT JOIN (SELECT user_id AS u, min(event_id) AS last FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) ON user_id = u WHERE last IS NULL OR event_id <= last""")
def until_terminal(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    kept = feeds.until_terminal(events, "user_id", "event_id", F.col("event_type").isin("purchase", "error"))
    return kept.select(F.to_json(F.struct("user_id", "event_id", "event_type")).alias("json"))


APIS = "SELECT event_id, user_id % 9 AS u, event_type AS t FROM events"


@query("discovered_apis", f"""SELECT event_id, array_to_string(list_sort(['/api/' || t || '/' || u, '/v1/all/{{id}}', 'https://h.example/' || u]), ' ') AS apis FROM ({APIS})""")
def discovered_apis(spark, sf_dir):
    """A made-up page for every event, calls written in several ways, one outside of scripts."""
    u, t = (F.col("user_id") % 9).cast("string"), F.col("event_type")
    page = F.concat(F.lit("<p>fetch('/api/none')</p><SCRIPT async>fetch('/api/"), t, F.lit("/"), u, F.lit("?q=1');x.open('GET', 'https://h.example/"), u, F.lit("');</SCRIPT><script>axios.get(`/v1/all/{id}`); y = '/v1/all/{id}'; z = '/img/a.png'</script>"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(parts.discovered_apis(page), " ").alias("apis"))


@query("pivot_sources", """WITH rel AS (SELECT c_custkey AS book, k, 'xl/worksheets/s' || k AS target FROM customer, (SELECT unnest(range(5)) AS k)),
    s AS (SELECT o_custkey AS book, o_orderkey, o_orderstatus || o_orderkey AS sheet, o_orderkey % 7 AS rid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    named AS (SELECT s.book, s.n, s.sheet, coalesce(target, 'xl/worksheets/sheet' || n || '.xml') AS sheet_part FROM s LEFT JOIN rel ON s.book = rel.book AND s.rid = rel.k),
    held AS (SELECT named.*, j FROM named JOIN (VALUES ('xl/worksheets/s0', 0), ('xl/worksheets/s1', 1), ('xl/worksheets/s2', 0), ('xl/worksheets/sheet1.xml', 2)) h(part, j) ON sheet_part = part),
    own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, j ORDER BY n DESC) AS last FROM held) WHERE last = 1)
    SELECT c_custkey AS book, 'pivot' || p.j AS part, 'P' || p.j AS name, sheet, sheet_part, CASE p.j WHEN 0 THEN 'xl/worksheets/s1' WHEN 1 THEN 'xl/worksheets/s2' END AS cache_part
    FROM customer CROSS JOIN (SELECT unnest(range(4)) AS j) p LEFT JOIN own ON own.book = c_custkey AND own.j = p.j""")
def pivot_sources(spark, sf_dir):
    """Customers as workbooks and their orders as sheets; relations, pivot tables and caches alike in each."""
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"))

    def of_each(rows, names):
        return books.select("book", F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))

    rels = of_each([(k, f"r{k}", f"xl/worksheets/s{k}") for k in range(5)] + [(9, "r1", "late")], ["at", "rid", "target"])
    held = of_each([("xl/worksheets/s0", 0, "pivot0"), ("xl/worksheets/s1", 0, "pivot1"), ("xl/worksheets/s2", 0, "pivot0"), ("xl/worksheets/sheet1.xml", 0, "pivot2")], ["sheet_part", "at", "target"])
    caches = of_each([(0, "c0", "r1"), (1, "c1", "r9"), (2, "c1", "r2"), (3, "c0", "r3")], ["at", "cache_id", "rid"])
    pivots = of_each([(f"pivot{j}", f"P{j}", f"c{j}") for j in range(4)], ["part", "name", "cache_id"])
    orders = table(spark, sf_dir, "orders")
    sheets = orders.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("at"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("r"), (F.col("o_orderkey") % 7).cast("string")).alias("rid"))
    return parts.pivot_sources(sheets, rels, held, caches, pivots)
