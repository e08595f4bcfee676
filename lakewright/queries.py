"""Registered queries of the library's own operators, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright import queries_parts, queries_plans, queries_scalars  # noqa: F401  they register queries of their own
from lakewright.functions import scalars as S
from lakewright.operators import aggregates, dom, joins, records, sets, text, topk, windows
from lakewright.plans import graph, tree
from lakewright.registry import oracle_sql, queries, query  # noqa: F401
from lakewright.registry import table as _t


@query(
    "stats_by_group",
    """SELECT source AS grp, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total,
    CAST(floor(sum(n_chars) * 1000.0 / sum(sum(n_chars)) OVER () + 0.5) AS DOUBLE) / 10 AS percent
    FROM documents GROUP BY source""",
)
def stats_by_group(spark, sf_dir):
    return aggregates.stats_by_group(_t(spark, sf_dir, "documents"), F.col("source"), F.col("n_chars"))


# Text search

LINES_SQL = """SELECT doc_id, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line FROM
    (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE length(text) > 0)
    WHERE NOT (i = len(string_split(text, chr(10))) AND string_split(text, chr(10))[i] = '')"""


@query("text_lines", LINES_SQL)
def text_lines(spark, sf_dir):
    return text.lines(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("grep_lines", f"SELECT * FROM ({LINES_SQL}) WHERE contains(line, 'the')")
def grep_lines(spark, sf_dir):
    return text.grep(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "the")


@query("grep_ignore_case", f"SELECT * FROM ({LINES_SQL}) WHERE contains(lower(line), 'license')")
def grep_ignore_case(spark, sf_dir):
    return text.grep(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "LICENSE", ignore_case=True)


@query("grep_totals", f"SELECT (SELECT count(*) FROM documents) AS files, count(*) AS match_count FROM ({LINES_SQL}) WHERE contains(line, 'the')")
def grep_totals(spark, sf_dir):
    return text.grep_totals(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "the")


@query("grep_first_hits", f"SELECT doc_id, line_no, trim(line, ' ') AS line FROM ({LINES_SQL}) WHERE contains(line, 'the') ORDER BY doc_id, line_no LIMIT 40")
def grep_first_hits(spark, sf_dir):
    return text.grep_first(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "the")


@query("suffix_glob", "SELECT c_name FROM customer WHERE c_name LIKE '%7' ORDER BY c_name LIMIT 40")
def suffix_glob(spark, sf_dir):
    return text.suffix_first(_t(spark, sf_dir, "customer").select("c_name"), "c_name", "7")


@query("glob_names", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '.*a.e.*', 's')")
def glob_names(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name").where(S.glob_match(F.col("p_name"), "**a?e*"))


@query("find_filter", "SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src2', 'src3') AND n_chars BETWEEN 500 AND 2000 AND lang LIKE 'e%'")
def find_filter(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    found = text.find(docs, F.col("source"), F.col("n_chars"), S.glob_match(F.col("lang"), "e*"), ["SRC1", ".src2", "src3"], F.col("source"), 500, 2000, order=["doc_id"])
    return found.select("doc_id", "source", "n_chars")


@query("find_limited", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 400 ORDER BY doc_id LIMIT 25")
def find_limited(spark, sf_dir):
    return text.find(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("doc_id"), F.col("n_chars"), high=400, limit=25)


@query("ascii_page_find", "SELECT page_id, url FROM pages WHERE contains(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/de/')")
def ascii_page_find(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", "url").where(text.ascii_contains(F.col("url"), "/DE/"))


@query("line_window", f"SELECT * FROM ({LINES_SQL}) WHERE line_no > 2 AND line_no <= 5")
def line_window(spark, sf_dir):
    return text.line_window(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 2, 3)


@query("section_read", "SELECT doc_id, string_split(text, chr(10))[1] AS section FROM documents")
def section_read(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.nth(F.split("text", "\n"), 1).alias("section"))


@query("replace_once", """SELECT doc_id, CAST((length(text) - length(replace(text, 'license', ''))) / 7 AS BIGINT) AS matches,
    CASE WHEN (length(text) - length(replace(text, 'license', ''))) / 7 = 1 THEN replace(text, 'license', 'licence') END AS text FROM documents""")
def replace_once(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.replace_once(F.col("text"), "license", "licence").alias("r")).select("doc_id", "r.*")


@query("catalog_search", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget')")
def catalog_search(spark, sf_dir):
    return text.catalog_search(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "Gadget", ["p_name", "p_type"], {"gadget": "widget"})


@query("front_end_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')")
def front_end_search(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer")
    return customers.where(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("build"))).select("c_custkey")


@query("argument_validation", """SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'range' WHEN l_returnflag NOT IN ('N', 'R') THEN 'enum' WHEN l_tax >= 0.08 THEN 'tax' END AS violation
    FROM lineitem""")
def argument_validation(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    rules = {"range": F.col("l_quantity").between(1, 45), "enum": F.col("l_returnflag").isin("N", "R"), "tax": F.col("l_tax") < 0.08}
    return text.violations(rows, rules).select("l_orderkey", "l_linenumber", "violation")


@query("audit_like_or_topk", "SELECT event_id, event_type FROM events WHERE event_type LIKE 'view%' OR event_type LIKE 'click%' ORDER BY event_id DESC NULLS LAST LIMIT 50")
def audit_like_or_topk(spark, sf_dir):
    return topk.matching_any_like(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["view%", "click%"], "event_id")


# Joins


@query("nested_left_join", """SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(ids, '') AS order_ids FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n_orders, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def nested_left_join(spark, sf_dir):
    nested = joins.nest(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ["o_orderkey", "o_orderstatus"], "orders")
    ids = F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",")
    return nested.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), ids.alias("order_ids"))


@query("children_of", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def children_of(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey")


@query("existence_check", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def existence_check(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.existing(_t(spark, sf_dir, "customer").select("c_custkey"), keys, "c_custkey")


@query("cascade_delete", """SELECT 'customer' AS kind, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def cascade_delete(spark, sf_dir):
    customers, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    parents, children = joins.cascade_delete(customers, orders, "c_custkey", "o_custkey", customers.where("c_mktsegment = 'BUILDING'"))
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(parents, "customer").unionByName(n(children, "orders"))


@query("retention_prune", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 500)")
def retention_prune(spark, sf_dir):
    return joins.beyond_newest(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("two_way_orphans", """SELECT count(*) FILTER (l.doc_id IS NOT NULL AND r.doc_id IS NULL) AS left_only, count(*) FILTER (l.doc_id IS NULL) AS right_only,
    count(*) FILTER (l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) AS matched FROM (SELECT DISTINCT doc_id FROM documents) l FULL JOIN (SELECT DISTINCT doc_id FROM labels) r ON l.doc_id = r.doc_id""")
def two_way_orphans(spark, sf_dir):
    return joins.two_way_orphans(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@query("three_state_refs", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS resolved FROM documents")
def three_state_refs(spark, sf_dir):
    return joins.three_state(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id"), "doc_id", "label_id")


@query("override_or_default", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 'seven' END, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END) AS kind FROM orders""")
def override_or_default(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    overrides = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("seven").alias("kind"))
    defaults = spark.createDataFrame([("F", "final"), ("O", "open")], "ext string, kind string")
    return joins.override_or_default(orders, overrides, defaults, "o_orderkey", F.col("o_orderstatus"), "kind").select("o_orderkey", "kind")


@query("as_of_owner", """SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p
    ON e.user_id = p.user_id AND p.event_type = 'purchase' AND p.event_id <= e.event_id GROUP BY e.event_id""")
def as_of_owner(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("last_purchase"))
    return joins.as_of(events, bought, ["user_id"], "event_id", "event_id", "last_purchase").select("event_id", "last_purchase")


@query("rename_collisions", "SELECT c_mktsegment AS target, count(*) AS n, c_mktsegment = 'BUILDING' AS exists FROM customer GROUP BY 1 HAVING count(*) > 1 OR c_mktsegment = 'BUILDING'")
def rename_collisions(spark, sf_dir):
    taken = spark.createDataFrame([("BUILDING",)], "target string")
    return joins.collisions(_t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("target")), "target", taken)


@query("address_index", """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def address_index(spark, sf_dir):
    return joins.first_of_each(_t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("unambiguous_alias", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def unambiguous_alias(spark, sf_dir):
    return joins.unambiguous(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("alias_conflicts", "SELECT count(*) AS conflicts FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1)")
def alias_conflicts(spark, sf_dir):
    return joins.ambiguous(_t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


RECTS = "SELECT l_partkey AS g, l_orderkey * 10 + l_linenumber AS id, CAST(floor(l_quantity) AS BIGINT) AS x0, CAST(floor(l_quantity) + l_linenumber AS BIGINT) AS x1, CAST(floor(l_discount * 100) AS BIGINT) AS y0, CAST(floor(l_discount * 100) + 1 AS BIGINT) AS y1 FROM {}"


@query("rect_overlap", f"WITH r AS ({RECTS.format('lineitem')}) SELECT a.g, a.id AS earlier, b.id AS later FROM r a JOIN r b ON a.g = b.g AND a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def rect_overlap(spark, sf_dir):
    return joins.rect_overlaps(spark.sql(RECTS.format("{lineitem}"), lineitem=_t(spark, sf_dir, "lineitem")), ["g"])


@query("domain_suffix_join", """SELECT p.page_id, c.name FROM (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages) p
    JOIN (VALUES ('example.com', 'a'), ('example.net', 'b'), ('www.example.com', 'c')) c(domain, name) ON p.host = c.domain OR p.host LIKE '%.' || c.domain""")
def domain_suffix_join(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"))
    cookies = spark.createDataFrame([("example.com", "a"), ("example.net", "b"), ("www.example.com", "c")], "domain string, name string")
    return joins.domain_suffix(pages, "host", cookies, "domain").select("page_id", "name")


@query("fallback_match", """SELECT p_partkey, rule_id, priority FROM (SELECT p_partkey, r.rule_id, CASE WHEN p_type = key THEN 0 WHEN contains(p_type, key) THEN 1 END AS priority,
    row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN p_type = key THEN 0 WHEN contains(p_type, key) THEN 1 END, r.rule_id) AS n
    FROM part LEFT JOIN (VALUES (1, 'STEEL'), (2, 'BRASS'), (3, 'ECONOMY')) r(rule_id, key) ON p_type = key OR contains(p_type, key)) WHERE n = 1""")
def fallback_match(spark, sf_dir):
    rules = spark.createDataFrame([(1, "STEEL"), (2, "BRASS"), (3, "ECONOMY")], "rule_id int, key string")
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    return joins.best_match(parts, "p_partkey", rules, [F.col("p_type") == F.col("key"), F.contains("p_type", "key")]).select("p_partkey", "rule_id", "priority")


# Aggregates


@query("dedup_groups", """SELECT n_chars AS size, sha256(text) AS digest, count(*) AS n, min(doc_id) AS first, n_chars * (count(*) - 1) AS wasted FROM documents
    WHERE n_chars >= 10 GROUP BY n_chars, text HAVING count(*) > 1""")
def dedup_groups(spark, sf_dir):
    return aggregates.duplicate_groups(_t(spark, sf_dir, "documents"), F.col("text"), F.col("n_chars"), F.col("doc_id"), 10)


@query("text_tally", r"""SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '\s', '', 'g')) AS dense_chars, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS paragraphs FROM documents""")
def text_tally(spark, sf_dir):
    return aggregates.text_tally(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("scoped_tally", """SELECT 'all' AS scope, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents UNION ALL SELECT 'en', CAST(sum(n_chars) AS BIGINT) FROM documents WHERE lang = 'en'
    UNION ALL SELECT 'other', CAST(sum(n_chars) AS BIGINT) FROM documents WHERE lang <> 'en'""")
def scoped_tally(spark, sf_dir):
    scopes = {"all": F.lit(True), "en": F.col("lang") == "en", "other": F.col("lang") != "en"}
    return aggregates.scoped_tally(_t(spark, sf_dir, "documents"), scopes, ["n_chars"])


@query("declared_vs_actual", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars = length(text) END AS right_count FROM documents")
def declared_vs_actual(spark, sf_dir):
    declared = F.when(F.col("doc_id") % 5 != 0, F.col("n_chars"))
    return _t(spark, sf_dir, "documents").select("doc_id", aggregates.declared_equals(declared, F.length("text")).alias("right_count"))


@query("value_census", "SELECT event_type AS value, count(*) AS n, min(event_id) AS first_seen FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_census(spark, sf_dir):
    return aggregates.census(_t(spark, sf_dir, "events"), "event_type", "event_id")


@query("written_states", "SELECT count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v = '') AS n_empty, count(*) FILTER (v <> '') AS n_other FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE text END AS v FROM documents)")
def written_states(spark, sf_dir):
    v = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.col("text"))
    return aggregates.written_states(_t(spark, sf_dir, "documents").select(v.alias("v")), "v")


SHEET = """SELECT l_suppkey AS book, CASE l_linenumber % 6 WHEN 0 THEN 's' WHEN 1 THEN 'n' WHEN 2 THEN 'str' WHEN 3 THEN 'inlineStr' WHEN 4 THEN 'e' END AS kind, CASE WHEN l_tax > 0.02 THEN l_partkey % 9 END AS style, CASE l_linenumber % 6 WHEN 0 THEN '' || (l_partkey % 40) WHEN 4 THEN '#DIV/0!' WHEN 2 THEN l_returnflag ELSE '' || l_orderkey END AS value,
    CASE WHEN l_linenumber % 6 = 2 THEN CASE WHEN l_discount > 0.05 THEN 'HYPERLINK("x")' ELSE 'A1' END END AS formula, l_linenumber % 6 = 3 AS is_inline, l_discount > 0.03 AS own_rich, l_discount > 0.07 AS own_kept FROM {}"""
STRINGS = "SELECT s_suppkey AS book, k AS at, (s_suppkey + k) % 3 = 0 AS rich, k % 4 = 1 AS preserved FROM {supplier} LATERAL VIEW explode(sequence(0, 29)) AS k"
STYLES = "SELECT s_suppkey AS book, k AS style, CASE WHEN k % 3 > 0 THEN k % 3 = 1 END AS bold, k % 4 = 2 AS filled, (s_suppkey + k) % 5 = 0 AS wrapped, element_at(array('General', 'yyyy-mm-dd', '0.00', 'h:mm', 'm/d/yy h:mm', '@'), cast((s_suppkey + k) % 6 + 1 AS int)) AS format FROM {supplier} LATERAL VIEW explode(sequence(0, 6)) AS k"
KINDS = "CASE p_size % 9 WHEN 0 THEN 'merged' WHEN 1 THEN 'hidden_rows' WHEN 2 THEN 'hidden_cols' WHEN 3 THEN 'comments' WHEN 4 THEN 'charts' WHEN 5 THEN 'conditional_rules' WHEN 6 THEN 'validations' WHEN 7 THEN 'links' ELSE 'pictures' END"
CORNERS = "l_suppkey AS book, l_orderkey AS {ord}, CASE WHEN l_tax >= 0.01 THEN l_partkey % 50 END AS r0, l_partkey % 50 + l_linenumber - 2 AS r1, l_orderkey % 30 AS c0, l_orderkey % 30 + l_suppkey % 3 AS c1, true AS has_text FROM {lineitem} WHERE l_orderkey % 40 = 0 OR l_partkey % 40 = 1"


@query("workbook_totals", f"""WITH c AS ({SHEET.format('lineitem')}), s AS (SELECT s_suppkey AS book, k AS "at", (s_suppkey + k) % 3 = 0 AS rich, k % 4 = 1 AS kept FROM supplier, (SELECT unnest(range(30)) AS k)),
    y AS (SELECT s_suppkey AS book, k AS style, k % 3 = 1 AS bold, k % 4 = 2 AS filled, (s_suppkey + k) % 5 = 0 AS wrapped, (s_suppkey + k) % 6 IN (1, 3, 4) AS dated FROM supplier, (SELECT unnest(range(7)) AS k)),
    t AS (SELECT c.book, count(*) AS cells, count(formula) AS formulas, count(*) FILTER (coalesce(kind, 'n') IN ('n', 'inlineStr')) AS "numeric", count(*) FILTER (kind = 's') AS shared_strings, count(*) FILTER (is_inline) AS inline_strings, count(*) FILTER (dated) AS dates, count(*) FILTER (formula LIKE 'HYPERLINK(%') AS hyperlink_formulas,
      count(*) FILTER (kind = 'e') AS error_cells, count(*) FILTER (kind = 'str') AS string_result_cells, count(kind) AS cells_with_written_type, count(*) FILTER (CASE WHEN is_inline THEN own_rich ELSE rich END) AS cells_with_runs, count(*) FILTER (CASE WHEN is_inline THEN own_kept ELSE kept END) AS cells_with_preserved_space,
      count(*) FILTER (bold) AS cells_bold, count(*) FILTER (filled) AS cells_filled, count(*) FILTER (wrapped) AS cells_wrapped, count(*) FILTER (c.style IS NULL) AS cells_without_style_written
      FROM c LEFT JOIN s ON c.book = s.book AND kind = 's' AND value = CAST(s."at" AS VARCHAR) LEFT JOIN y ON c.book = y.book AND coalesce(c.style, 0) = y.style GROUP BY c.book),
    f AS (SELECT p_partkey % 100 AS book, {', '.join(f"count(*) FILTER (p_size % 9 = {i}) AS {k}" for i, k in enumerate(["merged", "hidden_rows", "hidden_cols", "comments", "charts", "conditional_rules", "validations", "links", "pictures"]))} FROM part GROUP BY 1),
    m AS (SELECT book, ord, r0 > r1 AS flips, least(r0, r1) AS a, greatest(r0, r1) AS b, c0 AS c, c1 AS d FROM (SELECT {CORNERS.format(ord='ord', lineitem='lineitem')}) WHERE r0 IS NOT NULL),
    h AS (SELECT *, EXISTS (SELECT 1 FROM m e WHERE e.book = m.book AND e.ord < m.ord AND NOT e.flips AND e.a <= m.b AND m.a <= e.b AND e.c <= m.d AND m.c <= e.d) AS hits FROM m),
    g AS (SELECT book, count(DISTINCT (a, b, c, d)) FILTER (NOT flips) AS merges_ranges, CAST(coalesce(sum((b - a + 1) * (d - c + 1) - 1) FILTER (NOT flips), 0) AS BIGINT) AS merges_covered, count(*) FILTER (hits) AS merges_overlapping FROM h GROUP BY book)
    SELECT book, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'cells formulas "numeric" shared_strings inline_strings dates hyperlink_formulas error_cells string_result_cells cells_with_written_type cells_with_runs cells_with_preserved_space cells_bold cells_filled cells_wrapped cells_without_style_written merged hidden_rows hidden_cols comments charts conditional_rules validations links pictures merges_ranges merges_covered merges_overlapping'.split())}
    FROM t FULL JOIN f USING (book) FULL JOIN g USING (book)""")
def workbook_totals(spark, sf_dir):
    """Suppliers as workbooks: lines are cells and merged ranges, parts are what stands beside them."""
    from lakewright.operators import workbooks

    lines, suppliers = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier")
    own = F.when(F.col("is_inline"), F.struct(F.col("own_rich").alias("rich"), F.col("own_kept").alias("preserved")))
    cells = spark.sql(SHEET.format("{lineitem}"), lineitem=lines).withColumn("inline", own)
    features = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("book"), F.expr(KINDS).alias("feature"))
    merges = spark.sql("SELECT " + CORNERS.format(ord="at", lineitem="{lineitem}"), lineitem=lines)
    return workbooks.totals(cells, spark.sql(STRINGS, supplier=suppliers), spark.sql(STYLES, supplier=suppliers), features, merges)


@query("ext_totals", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) AS by_ext FROM documents")
def ext_totals(spark, sf_dir):
    out = aggregates.ext_totals(_t(spark, sf_dir, "documents"), F.col("lang"), F.col("n_chars"))
    return out.withColumn("by_ext", F.array_join(F.transform(F.map_entries("by_ext"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


CHECK_SUM = " + ".join(f"CAST(substr(value, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(S.ID_WEIGHTS))
VALUES = """SELECT c_custkey AS profile, 'own' AS category, k AS key, CASE k WHEN 'Credit_Code' THEN CASE WHEN c_custkey % 3 = 0 THEN '91350100M000100Y43' ELSE '91350100M000100Y4' || (c_custkey % 10) END WHEN 'id_card_no' THEN CASE WHEN c_custkey % 2 = 0 THEN ' 11010519491231002x ' ELSE '11010519491231' || lpad('' || c_custkey % 9999, 4, '0') END
    WHEN 'mobile' THEN '138' || lpad('' || c_custkey % 99, CASE WHEN c_custkey % 4 = 0 THEN 7 ELSE 8 END, '0') WHEN 'note' THEN CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '  ' END END AS value FROM {customer}, {keys}"""


@query("proofread_report", f"""WITH v AS ({VALUES.format(customer='customer', keys="(SELECT unnest(['Credit_Code', 'id_card_no', 'mobile', 'note']) AS k)")}),
    i AS (SELECT profile, CASE key WHEN 'Credit_Code' THEN CASE WHEN value <> '91350100M000100Y43' THEN 'error' END WHEN 'id_card_no' THEN CASE WHEN trim(value) <> '11010519491231002x' AND substr('10X98765432', CAST(({CHECK_SUM}) % 11 + 1 AS INT), 1) <> substr(value, 18, 1) THEN 'error' END
      WHEN 'mobile' THEN CASE WHEN length(value) <> 11 THEN 'warning' END ELSE CASE WHEN trim(value) = '' THEN 'warning' END END AS severity FROM v
      UNION ALL SELECT o_custkey, CASE WHEN p_partkey IS NULL THEN 'error' WHEN p_size * 100 > 3 * 1024 + 1023 THEN 'warning' END FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 300)
    SELECT profile, count(*) FILTER (severity = 'error') = 0 AS passed, count(*) AS checked_count, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY profile""")
def proofread_report(spark, sf_dir):
    """Customers as profiles with four fields each; their orders are attachments, the parts the files that are there."""
    from lakewright.operators import proofread

    keys = spark.createDataFrame([("Credit_Code",), ("id_card_no",), ("mobile",), ("note",)], "k string")
    fields = spark.sql(VALUES, customer=_t(spark, sf_dir, "customer"), keys=F.broadcast(keys))
    attachments = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile"), F.lit("doc").alias("key"), (F.col("o_orderkey") % 300).cast("string").alias("path"))
    files = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") * 100).cast("long").alias("size"))
    issues = proofread.profile_issues(fields, attachments, files, 3)
    return proofread.report(issues, fields.select("profile").unionByName(attachments.select("profile")), "profile")


@query("grid_diff", """SELECT CAST(floor(l_linenumber / 2.0) AS BIGINT) AS gx, CAST(floor(l_quantity / 10) AS BIGINT) AS gy, count(*) AS n,
    round(avg(abs(floor(l_tax * 100) - floor(l_discount * 100)) / 255.0), 9) AS score FROM lineitem GROUP BY 1, 2""")
def grid_diff(spark, sf_dir):
    pixels = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"), F.floor(F.col("l_tax") * 100).alias("a"), F.floor(F.col("l_discount") * 100).alias("b"))
    return aggregates.grid_diff(pixels, 2, 10).withColumn("score", F.round("score", 9))


@query("band_usage", """SELECT band, low, high, count(DISTINCT p_size) AS used, high - low + 1 - count(DISTINCT p_size) AS free, coalesce(string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)), '') AS ports
    FROM (VALUES ('a', CAST(1 AS BIGINT), CAST(20 AS BIGINT)), ('b', 21, 60), ('c', 100, 120)) b(band, low, high) LEFT JOIN part ON p_size BETWEEN low AND high GROUP BY band, low, high""")
def band_usage(spark, sf_dir):
    bands = spark.createDataFrame([("a", 1, 20), ("b", 21, 60), ("c", 100, 120)], "band string, low long, high long")
    out = aggregates.band_usage(_t(spark, sf_dir, "part").select(F.col("p_size").alias("port")), bands)
    return out.withColumn("ports", F.array_join(F.array_sort(F.transform("ports", lambda p: p.cast("string"))), ","))


@query("success_counter", "SELECT c_custkey, CAST(sum(n) AS BIGINT) AS success_count, max(ts) AS last_used FROM (SELECT c_custkey, 2 AS n, CAST(0 AS BIGINT) AS ts FROM customer UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders) GROUP BY 1")
def success_counter(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select("c_custkey", F.lit(2).cast("long").alias("success_count"), F.lit(0).cast("long").alias("last_used"))
    return aggregates.success_counter(old, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at")), "c_custkey")


# Ordered operators

SPANS = "SELECT l_orderkey AS g, CAST(l_linenumber * 10 AS BIGINT) AS s, CAST(floor(l_quantity / 3) AS BIGINT) AS n FROM {}"
GAPS_SQL = f"""SELECT g, kind, start, length FROM (SELECT g, s, e, r, unnest([{{'kind': 'gap', 'start': r, 'length': s - r}}, {{'kind': 'claimed', 'start': greatest(s, coalesce(r, s)), 'length': e - greatest(s, coalesce(r, s))}}], recursive := true)
    FROM (SELECT g, s, s + n AS e, max(s + n) OVER (PARTITION BY g ORDER BY s, s + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ({SPANS.format('lineitem')}))) WHERE length > 0 AND start IS NOT NULL"""


@query("interval_gaps", GAPS_SQL)
def interval_gaps(spark, sf_dir):
    return windows.interval_gaps(spark.sql(SPANS.format("{lineitem}"), lineitem=_t(spark, sf_dir, "lineitem")), ["g"], "s", "n")


@query("region_totals", f"SELECT g, CAST(coalesce(sum(length) FILTER (kind = 'claimed'), 0) AS BIGINT) AS claimed, CAST(coalesce(sum(length) FILTER (kind = 'gap'), 0) AS BIGINT) AS unreferenced FROM ({GAPS_SQL}) GROUP BY g")
def region_totals(spark, sf_dir):
    return windows.region_totals(interval_gaps(spark, sf_dir), ["g"])


@query("adjacent_merge", """SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM
    (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2, 3""")
def adjacent_merge(spark, sf_dir):
    return windows.adjacent_runs(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], ["event_type"])


@query("latest_per_name", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def latest_per_name(spark, sf_dir):
    return windows.latest_of_each(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_per_key(spark, sf_dir):
    return joins.first_of_each(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("newest_percent", "SELECT user_id, least(greatest(max_by(value, event_id) * 100.0 / 250, 0), 100) AS percent FROM events GROUP BY 1")
def newest_percent(spark, sf_dir):
    return windows.newest_percent(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "value", F.lit(250.0))


@query("next_same_before_boundary", """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN coalesce(nxt = event_type, false) END AS keep FROM (SELECT *, first_value(CASE WHEN event_type IN ('view', 'click') THEN event_type WHEN event_type = 'error' THEN 'b' END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events)""")
def next_same_before_boundary(spark, sf_dir):
    t = F.col("event_type")
    return windows.keep_if_same_next(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], t.isin("view", "click"), t == "error", "event_type").select("event_id", "keep")


@query("inherited_rows", """SELECT event_id, CASE WHEN event_type <> 'error' THEN last_value(CASE WHEN event_type <> 'error' THEN v END IGNORE NULLS) OVER (PARTITION BY user_id, c ORDER BY event_id) ELSE v END AS effective FROM
    (SELECT *, CASE WHEN event_type = 'view' THEN value END AS v, sum(CASE WHEN event_type <> 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events)""")
def inherited_rows(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return windows.inherit(events, ["user_id"], "event_id", "v", F.col("event_type") != "error").select("event_id", "effective")


@query("failure_streaks", """SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id, ok ORDER BY event_id) AS BIGINT) AS streak FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f,
    sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM events)""")
def failure_streaks(spark, sf_dir):
    return windows.failure_streaks(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error").select("event_id", "streak")


TURNS = """SELECT user_id, event_id, sub, ev FROM (SELECT user_id, event_id, posexplode(array('orient', 'decide', CASE WHEN event_type = 'purchase' THEN 'act_mutating' ELSE 'act' END, CASE WHEN event_type = 'purchase' AND event_id % 4 > 0 THEN 'checkpointed' END,
    CASE WHEN event_type IN ('error', 'view') THEN 'fail' ELSE 'ok' END, CASE WHEN event_type = 'signup' THEN 'recovered' ELSE 'verify' END, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'recovered' END)) AS (sub, ev) FROM {events}) WHERE ev IS NOT NULL"""


@query("turn_machine", """WITH RECURSIVE x AS (SELECT user_id, event_id, unnest(range(7)) AS sub, unnest(['orient', 'decide', CASE WHEN event_type = 'purchase' THEN 'act_mutating' ELSE 'act' END, CASE WHEN event_type = 'purchase' AND event_id % 4 > 0 THEN 'checkpointed' END,
    CASE WHEN event_type IN ('error', 'view') THEN 'fail' ELSE 'ok' END, CASE WHEN event_type = 'signup' THEN 'recovered' ELSE 'verify' END, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'recovered' END]) AS ev FROM events),
    e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, sub) AS i FROM x WHERE ev IS NOT NULL),
    m AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 'observe' AS phase, false AS awaiting, 0 AS failures, 0 AS step, 0 AS checkpoints, false AS legal FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT e.user_id, e.i, CASE WHEN ev = 'verify' AND step >= 8 THEN 'done' WHEN ev = 'orient' AND phase = 'observe' THEN 'orient' WHEN ev = 'decide' AND phase = 'orient' THEN 'decide' WHEN ev IN ('act', 'act_mutating') AND phase = 'decide' THEN 'act'
      WHEN ev = 'ok' AND phase = 'act' AND NOT awaiting THEN 'verify' WHEN ev = 'fail' AND phase = 'act' AND NOT awaiting THEN CASE WHEN failures >= 2 THEN 'rollback' ELSE 'verify' END WHEN ev = 'verify' AND phase = 'verify' OR ev = 'recovered' AND phase = 'rollback' THEN 'observe' ELSE phase END,
      CASE WHEN ev = 'act_mutating' AND phase = 'decide' THEN true WHEN ev = 'checkpointed' THEN false ELSE awaiting END,
      CASE WHEN ev = 'ok' AND phase = 'act' AND NOT awaiting OR ev = 'recovered' AND phase = 'rollback' THEN 0 WHEN ev = 'fail' AND phase = 'act' AND NOT awaiting THEN failures + 1 ELSE failures END,
      step + CASE WHEN ev IN ('ok', 'fail') AND phase = 'act' AND NOT awaiting THEN 1 ELSE 0 END, checkpoints + CASE WHEN ev = 'checkpointed' AND awaiting THEN 1 ELSE 0 END,
      CASE ev WHEN 'verify' THEN step >= 8 OR phase = 'verify' WHEN 'orient' THEN phase = 'observe' WHEN 'decide' THEN phase = 'orient' WHEN 'recovered' THEN phase = 'rollback' WHEN 'checkpointed' THEN awaiting WHEN 'ok' THEN phase = 'act' AND NOT awaiting WHEN 'fail' THEN phase = 'act' AND NOT awaiting ELSE phase = 'decide' END
      FROM m JOIN e ON e.user_id = m.user_id AND e.i = m.i + 1)
    SELECT user_id, event_id, sub, phase, awaiting, CAST(failures AS BIGINT) AS failures, CAST(step AS BIGINT) AS step, CAST(checkpoints AS BIGINT) AS checkpoints, legal FROM m JOIN e USING (user_id, i)""")
def turn_machine(spark, sf_dir):
    """Every user a run and every event a turn of it, with a budget of eight ended acts."""
    from lakewright.operators import machines

    events = spark.sql(TURNS, events=_t(spark, sf_dir, "events"))
    return machines.run_turns(events, "user_id", ["event_id", "sub"], "ev", 8, 3).drop("ev").withColumn("sub", F.col("sub").cast("long"))


@query("feed_high_water", """SELECT event_id FROM (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS v FROM events WHERE event_type <> '')) WHERE mark IS NULL OR v > mark""")
def feed_high_water(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") * 10))
    return windows.high_water(events, ["user_id"], ["event_id"], "v", "event_type").select("event_id")


@query("playhead", """WITH f AS (SELECT l_orderkey AS seq, CAST(l_linenumber - 1 AS BIGINT) AS frame, CAST(floor(max(l_quantity)) AS BIGINT) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber),
    p AS (SELECT *, sum(t) OVER (PARTITION BY seq ORDER BY frame) AS e, sum(t) OVER (PARTITION BY seq) AS al, count(*) OVER (PARTITION BY seq) AS n FROM f),
    q AS (SELECT *, CASE WHEN 1 >= n THEN 0 ELSE 1 END AS st FROM p), r AS (SELECT *, coalesce(sum(CASE WHEN frame < st THEN t END) OVER (PARTITION BY seq), 0) AS intro FROM q),
    u AS (SELECT *, CASE WHEN 100 < al THEN 100 ELSE intro + (100 - al) % nullif(al - intro, 0) END AS l FROM r) SELECT seq, CAST(100 AS BIGINT) AS at, frame FROM u WHERE l >= e - t AND l < e""")
def playhead(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    frames = lines.select(F.col("l_orderkey").alias("seq"), (F.col("l_linenumber") - 1).cast("long").alias("frame"), F.floor("q").alias("t"))
    return windows.playhead(frames, "seq", "frame", "t", F.lit(1), F.lit(100).cast("long"))


# Top-k


@query("stats_largest_topk", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def stats_largest_topk(spark, sf_dir):
    return topk.largest(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("recent_runs", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def recent_runs(spark, sf_dir):
    return topk.newest(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@query("log_tail", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def log_tail(spark, sf_dir):
    return topk.tail(_t(spark, sf_dir, "events").select("event_id"), "event_id", 9999)


@query("take_report", "SELECT count(*) AS count, least(count(*), 100) AS listed, count(*) > 100 AS cut FROM events")
def take_report(spark, sf_dir):
    return topk.take_report(_t(spark, sf_dir, "events"), "event_id", 0)


# Sets


@query("union_of_providers", """SELECT name, provider FROM (SELECT 'a__' || c_name AS name, 'a' AS provider FROM customer UNION ALL SELECT 'b__' || s_name, 'b' FROM supplier) ORDER BY name, provider LIMIT 1000""")
def union_of_providers(spark, sf_dir):
    parts = {"a": _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "b": _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))}
    return sets.union_of_providers(parts, "name")


@query("endpoint_template", r"""SELECT DISTINCT regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '/[0-9]+$', '/{id}') AS path FROM pages""")
def endpoint_template(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"), S.templatize_path(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)).alias("path"))
    return sets.distinct_first(pages, ["host", "path"], ["page_id"]).select("host", "path")


@query("sorted_distinct", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def sorted_distinct(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return rows.select("l_orderkey", F.array_join(sets.sorted_distinct(F.col("f")), ",").alias("flags"))


@query("membership_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def membership_difference(spark, sf_dir):
    return joins.missing(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("category_list", "SELECT DISTINCT split_part(p_brand, '#', 1) AS category FROM part")
def category_list(spark, sf_dir):
    return sets.categories(_t(spark, sf_dir, "part"), "p_brand", "#")


@query("upsert_keep_first", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 2 = 1")
def upsert_keep_first(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sets.upsert_keep_first(customers.where("c_custkey % 2 = 0"), customers.withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


@query("replace_by_path", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def replace_by_path(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sets.replace_by(customers, customers.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


@query("cookie_merge", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def cookie_merge(spark, sf_dir):
    return sets.last_value_of(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


# Scalar functions


@query("json_pointer", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_pointer(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", S.json_pointer(F.col("props"), "/k").alias("k"))


@query("csv_quote", """SELECT doc_id, CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_quote(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", S.csv_field(F.col("text")).alias("field"))


@query("md_cells", "SELECT doc_id, replace(replace(text, '|', '\\|'), chr(10), '<br>') AS cell FROM documents")
def md_cells(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", S.md_cell(F.col("text")).alias("cell"))


@query("text_budget", "SELECT doc_id, CASE WHEN length(text) > 200 THEN text[:200] || '…' ELSE text END AS short, substr(text, 1, 6) || '****' AS masked FROM documents")
def text_budget(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", S.truncate_budget(F.col("text"), 200).alias("short"), S.secret_mask(F.col("text")).alias("masked"))


@query("line_counts", "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS n FROM documents")
def line_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", S.line_count(F.col("text")).alias("n"))


@query("digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark, sf_dir):
    t = F.col("text").cast("binary")
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"))


@query("stable_ids", "SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] AS id FROM (SELECT c_custkey, md5('own:' || c_name) AS h FROM customer)")
def stable_ids(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", S.stable_id("own", F.col("c_name")).alias("id"))


@query("phone_scan", r"SELECT doc_id, unnest(regexp_extract_all(text, '1[3-9][0-9]{9}')) AS phone FROM documents")
def phone_scan(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("1[3-9][0-9]{9}"), F.lit(0))).alias("phone"))


@query("page_hosts", r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages")
def page_hosts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))


@query("slugs", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", S.sanitize_ident(F.col("p_name"), "x").alias("slug"))


@query("unit_conversion", "SELECT p_partkey, (2 * 127 * CAST(p_size AS BIGINT) + 72) // (2 * 72) AS hmm FROM part")
def unit_conversion(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", S.to_hundredth_mm(F.col("p_size").cast("string"), "twip").alias("hmm"))


@query("serial_dates", "SELECT p_partkey, strftime(DATE '1899-12-30' + CAST(p_partkey + 100 AS INT), '%Y-%m-%d') AS iso FROM part")
def serial_dates(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", S.serial_to_iso((F.col("p_partkey") + 100).cast("double")).alias("iso"))


@query("cell_addresses", """SELECT p_partkey, CASE WHEN c < 26 THEN chr(CAST(65 + c AS INT)) WHEN c < 702 THEN chr(CAST(64 + c // 26 AS INT)) || chr(CAST(65 + c % 26 AS INT))
    ELSE chr(CAST(64 + (c // 26 - 1) // 26 AS INT)) || chr(CAST(65 + (c // 26 - 1) % 26 AS INT)) || chr(CAST(65 + c % 26 AS INT)) END || (1 + p_partkey // 16384) AS a1 FROM (SELECT p_partkey, p_partkey % 16384 AS c FROM part)""")
def cell_addresses(spark, sf_dir):
    """Parts laid out in rows of a sheet's 16384 columns."""
    row, col = F.call_function("div", F.col("p_partkey"), F.lit(16384)), F.col("p_partkey") % 16384
    return _t(spark, sf_dir, "part").select("p_partkey", S.address(row, col).alias("a1"))


# Graphs and iteration


LINKS = """SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM {orders} UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM {lineitem} UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM {lineitem}
    UNION SELECT 'c' || o_custkey, 'p' || (o_custkey % 97) FROM {orders} UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM {customer} UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM {supplier}"""


@query("graph_levels", f"""WITH RECURSIVE e AS ({LINKS.format(orders='orders', lineitem='lineitem', customer='customer', supplier='supplier')}),
    w AS (SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node) SELECT node, CAST(max(level) AS BIGINT) AS level, 'ready' AS state FROM w GROUP BY node""")
def graph_levels(spark, sf_dir):
    """Nations, customers, orders, parts and suppliers, with links that skip a level."""
    tables = {t: _t(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier")}
    return graph.levels(spark.sql(LINKS, **tables))


TRADE = """SELECT c_nationkey AS src, s_nationkey AS dst FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
    GROUP BY c_nationkey, s_nationkey HAVING count(*) % 13 = 0 AND (c_nationkey > s_nationkey OR count(*) % 2 = 0)"""


@query("graph_cycles", f"""WITH RECURSIVE e AS ({TRADE.format(lineitem='lineitem', orders='orders', customer='customer', supplier='supplier')}), n AS (SELECT n_nationkey AS node FROM nation),
    r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), c AS (SELECT a FROM r WHERE a = b),
    k AS (SELECT node, node IN (SELECT a FROM c) OR node IN (SELECT b FROM r WHERE a IN (SELECT a FROM c)) AS stuck, node IN (SELECT a FROM c) OR node IN (SELECT b FROM r WHERE a IN (SELECT a FROM c)) AND node IN (SELECT a FROM r WHERE b IN (SELECT a FROM c)) AS core FROM n),
    w AS (SELECT node, 0 AS level FROM k WHERE NOT stuck UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node JOIN k ON k.node = e.dst AND NOT stuck)
    SELECT k.node, CAST(max(level) AS BIGINT) AS level, CASE WHEN core THEN 'cycle' WHEN stuck THEN 'behind' ELSE 'ready' END AS state FROM k LEFT JOIN w ON k.node = w.node GROUP BY k.node, core, stuck""")
def graph_cycles(spark, sf_dir):
    """Which nations can be put in an order, where a nation comes before those that it bought so many lines of."""
    tables = {t: _t(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier")}
    return graph.levels(spark.sql(TRADE, **tables), _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")))


BOUGHT = """SELECT event_id AS node, CASE WHEN event_id % 40 > 0 THEN event_id - 1 - user_id % least(4, event_id % 40) END AS parent, CAST(floor(value) AS BIGINT) % 5 AS place, CAST(floor(value) AS BIGINT) AS value FROM {}"""
CLOSURE = f"""t AS (SELECT * FROM ({BOUGHT.format('events')})), w AS (SELECT node, node AS up, parent, 0 AS depth, [(place, node)] AS path FROM t UNION ALL SELECT w.node, t.node, t.parent, w.depth + 1, list_prepend((t.place, t.node), w.path) FROM w JOIN t ON w.parent = t.node),
    r AS (SELECT node, up AS root, depth, path FROM w WHERE parent IS NULL), s AS (SELECT up AS node, count(*) AS size, CAST(sum(t.value) AS BIGINT) AS total FROM w JOIN t USING (node) GROUP BY up),
    shape AS (SELECT r.node, root, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS pre, size, total FROM r JOIN s USING (node))"""


@query("shape_tree", f"WITH RECURSIVE {CLOSURE} SELECT node, root, depth, pre, size, total FROM shape")
def shape_tree(spark, sf_dir):
    """Every forty events a tree, in which an event hangs on one of the four before it."""
    return tree.shape(spark.sql(BOUGHT.format("{events}"), events=_t(spark, sf_dir, "events")))


@query("shape_totals", f"""WITH RECURSIVE {CLOSURE}, x AS (SELECT * FROM shape JOIN (SELECT event_id AS node, event_type AS kind FROM events) USING (node) WHERE depth > 0), k AS (SELECT root, kind, min(pre) AS first FROM x GROUP BY 1, 2)
    SELECT root, count(*) AS shapes_total, count(*) FILTER (depth = 1) AS top_level, count(*) FILTER (depth > 1) AS nested, count(*) FILTER (kind = 'view') AS groups, max(depth) - 1 AS max_depth, (SELECT string_agg(kind, ' ' ORDER BY first) FROM k WHERE k.root = x.root) AS kinds_seen FROM x GROUP BY root""")
def shape_totals(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    shaped = tree.shape(spark.sql(BOUGHT.format("{events}"), events=events))
    return tree.totals(shaped, events.select(F.col("event_id").alias("node"), F.col("event_type").alias("kind")), "view").withColumn("kinds_seen", F.array_join("kinds_seen", " "))


@query("group_tally", f"""WITH RECURSIVE {CLOSURE}, p AS (SELECT DISTINCT parent FROM t WHERE parent IS NOT NULL), x AS (SELECT shape.*, shape.node IN (SELECT parent FROM p) AS is_group, value AS span, event_type = 'error' AS hidden FROM shape JOIN events ON event_id = shape.node WHERE depth > 0)
    SELECT root, count(*) FILTER (is_group) AS group_elements, count(*) FILTER (NOT is_group AND depth > 1) AS members, CAST(coalesce(sum(floor(span)) FILTER (NOT is_group AND depth > 1), 0) AS BIGINT) AS covered,
    CAST(coalesce(sum(floor(span)) FILTER (NOT is_group AND depth > 1 AND hidden), 0) AS BIGINT) AS hidden, coalesce(max(depth - 1) FILTER (NOT is_group AND depth > 1), 0) AS max_level FROM x GROUP BY root""")
def group_tally(spark, sf_dir):
    """Events on which others hang are groups, the rest members."""
    events = _t(spark, sf_dir, "events")
    nodes = spark.sql(BOUGHT.format("{events}"), events=events)
    shaped = tree.shape(nodes)
    held = nodes.where("parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("g")).distinct()
    facts = events.select(F.col("event_id").alias("node"), F.floor("value").alias("span"), (F.col("event_type") == "error").alias("hidden")).join(held, "node", "left")
    return tree.group_tally(shaped, facts.select("node", F.coalesce("g", F.lit(False)).alias("is_group"), "span", "hidden"))


@query("terminal_rows", "SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'error')) AS n_terminal, count(*) FILTER (event_type IN ('purchase', 'error')) = 1 AS ok FROM events GROUP BY 1")
def terminal_rows(spark, sf_dir):
    from lakewright.streaming import feeds

    events = _t(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "purchase", "Done").when(F.col("event_type") == "error", "Error").otherwise("Tick"))
    return feeds.terminal_check(events, "user_id", "kind")


RUNS = """SELECT user_id AS run, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'Done' WHEN event_type = 'error' THEN 'Error' ELSE 'Tick' END AS kind FROM {}"""


@query("missing_terminals", f"""WITH e AS ({RUNS.format('events')}), l AS (SELECT run, max(seq) AS s, max_by(kind, seq) AS k FROM e GROUP BY run), o AS (SELECT c_custkey AS run, c_custkey % 3 = 0 AS ok, c_name AS result, c_mktsegment AS message FROM customer WHERE c_custkey % 5 < 4)
    SELECT run, seq, kind, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS INT) AS code, CAST(NULL AS VARCHAR) AS message FROM e UNION ALL
    SELECT coalesce(l.run, o.run), coalesce(s, -1) + 1, CASE WHEN ok THEN 'Done' ELSE 'Error' END, CASE WHEN ok THEN result END, CASE WHEN ok THEN NULL ELSE 1 END, CASE WHEN NOT coalesce(ok, false) THEN coalesce(message, 'ended without an outcome') END
    FROM l FULL JOIN o ON l.run = o.run WHERE coalesce(k, '') NOT IN ('Done', 'Error')""")
def missing_terminals(spark, sf_dir):
    """Every user a run; customers of the same number hold what it returned, but for one in five."""
    from lakewright.streaming import feeds

    none = lambda kind: F.lit(None).cast(kind)
    events = spark.sql(RUNS.format("{events}"), events=_t(spark, sf_dir, "events")).withColumns({"result": none("string"), "code": none("int"), "message": none("string")})
    outcomes = _t(spark, sf_dir, "customer").where("c_custkey % 5 < 4").select(F.col("c_custkey").alias("run"), (F.col("c_custkey") % 3 == 0).alias("ok"), F.col("c_name").alias("result"), F.col("c_mktsegment").alias("message"))
    return feeds.with_terminals(events, outcomes, "run", "seq", "kind")


@query("content_store", """WITH p AS (SELECT source || ':' || doc_id % 40 AS name, doc_id % 9 AS version, sha256(text) AS blob, doc_id // 7 AS "at", text FROM documents)
    SELECT name, max((("at"), version, blob))[2] AS version, max((("at"), version, blob))[3] AS blob, (SELECT count(DISTINCT blob) FROM p) AS blobs FROM p GROUP BY name""")
def content_store(spark, sf_dir):
    """Documents as packages; the second half is put into a store that holds the first."""
    from lakewright.sources import files

    name = F.concat_ws(":", "source", (F.col("doc_id") % 40).cast("string"))
    packs = _t(spark, sf_dir, "documents").select("doc_id", name.alias("name"), (F.col("doc_id") % 9).alias("version"), F.col("text").cast("binary").alias("bytes"), F.call_function("div", F.col("doc_id"), F.lit(7)).alias("at"))
    blobs, names = files.content_store(packs.where("doc_id % 2 = 0").drop("doc_id"), packs.where("doc_id % 2 = 1").drop("doc_id"))
    return names.join(F.broadcast(blobs.agg(F.count("*").alias("blobs"))))


# Pages and pixels

HTML_LINKS = r"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 0))) AS BIGINT) AS n_links FROM pages"""


@query("distilled_links", HTML_LINKS)
def distilled_links(spark, sf_dir):
    from lakewright.functions import html

    pages = _t(spark, sf_dir, "pages").select("page_id", html.distil("url", "html").alias("d"))
    return pages.select("page_id", F.size("d.links").cast("long").alias("n_links"))


@query("distilled_titles")
def distilled_titles(spark, sf_dir):
    from lakewright.functions import html

    pages = _t(spark, sf_dir, "pages").select("page_id", html.distil("url", "html").alias("d"))
    return pages.select("page_id", "d.title", F.size("d.sections").cast("long").alias("n_sections"), F.size("d.tables").cast("long").alias("n_tables"))


NAV_ITEMS = r"""regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a [^>]*>([^<]*)</a>', 1)"""
DECODED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("selector_texts", rf"""SELECT page_id, {DECODED.format(f"array_to_string({NAV_ITEMS}, ' ')")} AS nav, {DECODED.format(f"array_to_string({NAV_ITEMS}, chr(10))")} AS items,
    {DECODED.format("array_to_string(list_transform(regexp_extract_all(html, '<div class=.ad.>([^<]*)</div>', 1), lambda x: replace(x, chr(10), ' ')), chr(10))")} AS ads FROM pages""")
def selector_texts(spark, sf_dir):
    pages = dom.read(_t(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    found = [dom.selected_texts(pages, s).select("page_id", F.array_join("texts", "\n").alias(c)) for c, s in (("nav", "nav"), ("items", "nav > ul > li a[href], nav li > a"), ("ads", "div.ad"))]
    return found[0].join(found[1], "page_id").join(found[2], "page_id")


PIXELS = "SELECT l_suppkey AS image_id, l_orderkey % 40 AS x, l_linenumber AS y, CAST(floor(l_quantity * 5) AS BIGINT) AS r, CAST(floor(l_discount * 1000) AS BIGINT) AS g, CAST(floor(l_tax * 1000) AS BIGINT) AS b FROM {}"


@query("palette_pick", f"""WITH c AS (SELECT image_id, r, g, b, count(*) AS n FROM ({PIXELS.format('lineitem')}) GROUP BY 1, 2, 3, 4), p AS (SELECT * FROM (VALUES ('low', 20, 20, 20), ('mid', 100, 50, 40), ('high', 240, 90, 70)) p(name, pr, pg, pb)),
    m AS (SELECT image_id, name, sum(CASE WHEN r = pr AND g = pg AND b = pb THEN n ELSE 0 END) AS exact, sum(n) AS near FROM c JOIN p ON greatest(abs(r - pr), abs(g - pg), abs(b - pb)) <= 12 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY exact > 0 DESC, CASE WHEN exact > 0 THEN exact ELSE near END DESC, name DESC) AS place FROM m)
    SELECT i.image_id, k.name, CASE WHEN k.name IS NULL THEN 'none' WHEN exact > 0 THEN 'exact' ELSE 'near' END AS how FROM (SELECT DISTINCT image_id FROM c) i LEFT JOIN k ON i.image_id = k.image_id AND place = 1""")
def palette_pick(spark, sf_dir):
    from lakewright.operators import images

    palette = spark.createDataFrame([("low", 20, 20, 20), ("mid", 100, 50, 40), ("high", 240, 90, 70)], "name string, r int, g int, b int")
    return images.pick_color(spark.sql(PIXELS.format("{lineitem}"), lineitem=_t(spark, sf_dir, "lineitem")), palette, 12)


@query("dominant_colors")
def dominant_colors(spark, sf_dir):
    from lakewright.operators import images

    return images.dominant_colors(spark.sql(PIXELS.format("{lineitem}"), lineitem=_t(spark, sf_dir, "lineitem")), 24)


LIFE = "SELECT DISTINCT CAST(l_partkey * 7 % 1009 AS BIGINT) AS x, CAST((l_orderkey * 5 + l_linenumber) % 997 AS BIGINT) AS y FROM {}"


@query("life_step", f"""WITH c AS ({LIFE.format('lineitem')}), t AS (SELECT x + dx AS x, y + dy AS y, dx = 0 AND dy = 0 AS own FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))
    SELECT x, y FROM t WHERE x BETWEEN 0 AND 1008 AND y BETWEEN 0 AND 996 GROUP BY x, y HAVING count(*) FILTER (NOT own) = 3 OR count(*) FILTER (NOT own) = 2 AND bool_or(own)""")
def life_step(spark, sf_dir):
    from lakewright.operators import images

    return images.life_step(spark.sql(LIFE.format("{lineitem}"), lineitem=_t(spark, sf_dir, "lineitem")), 1009, 997)


@query("connected_components")
def connected_components(spark, sf_dir):
    from lakewright.operators import images

    cells = LIFE.format("{lineitem}").replace("DISTINCT", "DISTINCT CAST(l_suppkey % 4 AS BIGINT) AS image_id,")
    return images.components(spark.sql(cells, lineitem=_t(spark, sf_dir, "lineitem")))


@query("progress_blocks", """SELECT user_id, CAST(block AS BIGINT) AS block, max_by(value, event_id) FILTER (event_type = 'view') AS view FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER
    (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM events) GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase')""")
def progress_blocks(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("=", "event_type", F.col("value").cast("string")).alias("line"))
    blocks = windows.marker_blocks(events, ["user_id"], "event_id", "line", "purchase")
    return blocks.select("user_id", "block", F.try_element_at("fields", F.lit("view")).cast("double").alias("view"))


@query("first_free_text", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE lang END), ''), source) AS v FROM documents")
def first_free_text(spark, sf_dir):
    v = S.first_non_empty(F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("lang")), F.col("source"))
    return _t(spark, sf_dir, "documents").select("doc_id", v.alias("v"))


# Records


@query("positional_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 20")
def positional_lookup(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 20).alias("at"))
    return records.positional(customers, "at", _t(spark, sf_dir, "nation"), "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("reverse_lookup", """SELECT c_custkey, CASE WHEN a.name IS NOT NULL THEN 'attachment' ELSE 'field' END AS source, coalesce(a.name, f.name) AS name FROM customer
    LEFT JOIN (SELECT n_nationkey AS v, n_name AS name FROM nation WHERE n_nationkey < 8) a ON c_nationkey = a.v LEFT JOIN (SELECT r_regionkey AS v, r_name AS name FROM region) f ON c_nationkey = f.v WHERE a.name IS NOT NULL OR f.name IS NOT NULL""")
def reverse_lookup(spark, sf_dir):
    attachments = _t(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("name"))
    fields = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("value"), F.col("r_name").alias("name"))
    return records.reverse_lookup(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", attachments, fields).drop("c_nationkey")


@query("apply_bindings", """SELECT c_name AS param, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE n_name END AS value FROM customer LEFT JOIN nation ON c_custkey % 2 = 1 AND n_nationkey = c_custkey % 40
    WHERE c_custkey % 2 = 0 OR n_name IS NOT NULL""")
def apply_bindings(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    bindings = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("param"), F.when(even, "const").otherwise("ref").alias("kind"), F.when(even, F.col("c_mktsegment")).otherwise((F.col("c_custkey") % 40).cast("string")).alias("target"))
    return records.apply_bindings(bindings, _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("value")))


@query("recipe_fallback", """SELECT c_custkey AS request, coalesce(o.o_orderkey, f.k) AS recipe FROM customer LEFT JOIN orders o ON o.o_orderkey = c_custkey * 400
    LEFT JOIN (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey""")
def recipe_fallback(spark, sf_dir):
    wanted = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), (F.col("c_custkey") * 400).alias("id"), F.col("c_custkey").alias("host"), F.lit("c").alias("command"))
    recipes = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("host"), F.lit("c").alias("command"), F.col("o_orderdate").alias("last_used"))
    return records.by_id_or_newest(wanted, recipes)


@query("update_where_known", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'final' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where_known(spark, sf_dir):
    known = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("final").alias("c_mktsegment")).distinct()
    return records.update_where_known(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", known, "c_mktsegment")


@query("greedy_claim")
def greedy_claim(spark, sf_dir):
    offers = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("key"), (F.col("l_partkey") % 5).alias("item"), F.col("l_suppkey").alias("priority"))
    return records.greedy_claim(offers, "l_orderkey")


@query("depth_tally", "SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS span, max(l_linenumber) AS deepest FROM lineitem GROUP BY 1")
def depth_tally(spark, sf_dir):
    return records.depth_tally(_t(spark, sf_dir, "lineitem").withColumn("q", F.floor("l_quantity")), ["l_suppkey"], "l_linenumber", "q")


@query("json_key_sizes", "SELECT event_id, CAST(json_array_length('[' || event_id || ',2,3]') AS INT) AS n_a, 2 AS n_b, CAST(NULL AS INT) AS n_c FROM events")
def json_key_sizes(spark, sf_dir):
    skeleton = F.concat(F.lit('{"a": ['), F.col("event_id").cast("string"), F.lit(',2,3], "b": {"x": 1, "y": 2}, "c": 5}'))
    return records.key_sizes(_t(spark, sf_dir, "events").select("event_id", skeleton.alias("s")), "s", ["a", "b", "c"]).drop("s")


@query("markdown_tables", """SELECT n_regionkey, '| n_name | n_nationkey |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1""")
def markdown_tables(spark, sf_dir):
    return records.markdown_table(_t(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", ["n_name", "n_nationkey"])


@query("response_markdown")
def response_markdown(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.lit("text/html").alias("content_type"), F.col("html").alias("body"))
    return records.extract_response(pages, "auto").select("page_id", "extracted")


@query("alias_search", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%eco%' OR lower(p_type) LIKE '%eco%'")
def alias_search(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_type", "p_brand").alias("aliases"))
    return records.find_by_title_or_alias(parts, "p_name", "aliases", "*ECO*").select("p_partkey")


@query("json_result", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_result(spark, sf_dir):
    return records.json_rows(_t(spark, sf_dir, "region"), ["r_regionkey", "r_name"])
