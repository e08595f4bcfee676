"""Part tables against plain versions."""

import random

import duckdb
from pyspark.sql import functions as F

from lakewright.functions import html
from lakewright.operators import aggregates, listings, parts, records
from lakewright.streaming import feeds


def test_threads(spark):
    comments = spark.createDataFrame([("d", 0, "p"), ("d", 1, "q"), ("d", 2, None), ("d", 3, "p"), ("e", 0, "p")], "doc string, at int, para_id string")
    ext = spark.createDataFrame([("d", 0, "p", "1", None), ("d", 1, "p", "0", "q"), ("d", 2, "q", None, "p"), ("d", 3, "zz", "1", None), ("e", 0, "p", "0", "gone")], "doc string, at int, para_id string, done string, parent string")
    ids = spark.createDataFrame([("d", 0, "q", None), ("f", 0, "p", "9")], "doc string, at int, para_id string, durable_id string")
    threads = parts.comment_threads(comments, ext, ids)
    got = {(r["doc"], r["at"]): (r["ex_found"], r["id_found"], r["done"], r["parent_para_id"], r["replies_to"]) for r in threads.collect()}
    assert got == {("d", 0): (True, False, True, None, None), ("d", 1): (True, True, None, "p", 0), ("d", 2): (False, False, None, None, None), ("d", 3): (True, False, True, None, None), ("e", 0): (True, False, False, "gone", None)}
    totals = {r["doc"]: r.asDict() for r in parts.thread_totals(threads, ext, ids).collect()}
    assert {k: totals["d"][k] for k in ("comments_total", "paras_with_para_id", "ext_total", "ext_matched", "ext_orphans", "ids_orphans", "ex_without_done", "replies_total", "replies_dangling")} == {
        "comments_total": 4, "paras_with_para_id": 3, "ext_total": 4, "ext_matched": 2, "ext_orphans": 2, "ids_orphans": 0, "ex_without_done": 1, "replies_total": 1, "replies_dangling": 0,
    }
    assert totals["e"]["replies_dangling"] == 1 and totals["f"]["comments_total"] == 0 and totals["f"]["ids_orphans"] == 1
    assert parts.thread_totals(parts.comment_threads(comments.limit(0), ext.limit(0), ids.limit(0)), ext.limit(0), ids.limit(0)).count() == 0


def ledger(rows):
    """The counters of one group by looking at all pairs."""
    good = [r for r in rows if None not in r[1:5]]
    norm = [(at, min(a, c), min(b, d), max(a, c), max(b, d), a > c or b > d, text) for at, a, b, c, d, text in good]
    over = sum(any(e[0] < x[0] and not e[5] and e[1] <= x[3] and x[1] <= e[3] and e[2] <= x[4] and x[2] <= e[4] for e in norm) for x in norm)
    own = [x for x in norm if not x[5]]
    cells = [(x[3] - x[1] + 1) * (x[4] - x[2] + 1) for x in own]
    distinct = len({x[1:5] for x in own})
    return (len(rows), len(rows) - len(good), distinct, over, cells.count(1), sum(c - 1 for c in cells), sum(x[6] for x in own), len(good) - distinct)


def test_ledger(spark):
    draw = random.Random(5)
    at = lambda: None if draw.random() < 0.04 else draw.randrange(60)
    groups = {g: [(k, *(a := (at(), at())), *((x if x is None or draw.random() < 0.3 else x + draw.randrange(-1, 20)) for x in a), draw.random() < 0.5) for k in range(n)] for g, n in (("a", 60), ("b", 25), ("c", 1))}
    groups["copies"] = [(k, 1, 1, 2, 2, True) for k in range(300)]
    groups["bad"] = [(0, None, 1, 2, 2, True)]
    rows = [(g, *r) for g, part in groups.items() for r in part]
    df = spark.createDataFrame(rows, "g string, at int, r0 int, c0 int, r1 int, c1 int, has_text boolean")
    names = ("total", "bad_refs", "distinct_ranges", "overlapping", "solo", "covered_cells", "anchors_with_text", "duplicated")
    assert {r["g"]: tuple(r[n] for n in names) for r in parts.merge_ledger(df, ["g"]).collect()} == {g: ledger(part) for g, part in groups.items()}
    assert parts.merge_ledger(df.limit(0), ["g"]).count() == 0


def test_csv(spark):
    cells = spark.createDataFrame([(1, 0, 1, "b,c", False), (1, 0, 0, "a", False), (1, 1, 0, None, True), (2, 0, 0, 'say "x"', None)], "t int, row int, col int, text string, covered boolean")
    got = {r["t"]: (r["rows"], r["columns"], r["widths"], r["ragged"], r["empty_cells"], r["covered_cells"], r["csv"]) for r in parts.table_csv(cells, ["t"]).collect()}
    assert got == {1: (2, 2, [2, 1], True, 1, 1, 'a,"b,c"\n\n'), 2: (1, 1, [1], False, 0, 0, '"say ""x"""\n')}


def test_hops(spark):
    shapes = spark.createDataFrame([("s", 0, True, 1), ("s", 1, True, None), ("s", 2, True, 9), ("s", 3, False, 1), ("lost", 0, True, 1)], "slide string, at int, is_placeholder boolean, idx int")
    layouts = spark.createDataFrame([("s", 0, "one"), ("s", 1, "two")], "slide string, at int, layout string")
    book = spark.createDataFrame([("one", 0, None, "title"), ("one", 1, 1, "body"), ("one", 2, 1, "late"), ("two", 0, 9, "x")], "layout string, at int, idx int, kind string")
    hops = parts.placeholder_hops(shapes, layouts, book)
    assert {(r["slide"], r["at"]): r["matched_kind"] for r in hops.collect()} == {("s", 0): "body", ("s", 1): "title", ("s", 2): None, ("s", 3): None, ("lost", 0): None}
    assert tuple(parts.hop_totals(hops).first()) == (5, 4, 2, 2, 1)


PAGE = "<p>before any heading</p><h1>One</h1><p>short</p><p>a longer paragraph</p><ul><li>an item of a list</ul><h3>Two <b>x</b></h3><blockquote>said by somebody</blockquote>"


def test_sections(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string").select("id", html.blocks("html").alias("b"))
    got = [tuple(r) for r in parts.numbered_sections(df, "id", "b").orderBy("id", "section_no").collect()]
    assert got == [
        (1, 1, "p", "before any heading", None, "before any heading"),
        (1, 2, "h1", "One", "One", "# One"),
        (1, 3, "p", "a longer paragraph", "One", "a longer paragraph"),
        (1, 4, "li", "an item of a list", "One", "- an item of a list"),
        (1, 5, "h3", "Two x", "Two x", "### Two x"),
        (1, 6, "blockquote", "said by somebody", "Two x", "> said by somebody"),
    ]


def test_sections_of_the_pages(spark):
    """Numbers run from 1 without gaps, texts are those of the distilled page, headings the last one above."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    want = {r["page_id"]: r["s"] for r in pages.select("page_id", html.distil("url", "html")["sections"].alias("s")).collect()}
    got = {}
    for r in parts.numbered_sections(pages.select("page_id", html.blocks("html").alias("b")), "page_id", "b").orderBy("page_id", "section_no").collect():
        mine = got.setdefault(r["page_id"], [])
        mine.append((r["section_no"], r["tag"], r["text"], r["heading"]))
    assert {k: [x[2] for x in v] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    for v in got.values():
        above = None
        for k, (no, tag, text, heading) in enumerate(v, 1):
            above = text if tag in ("h1", "h2", "h3", "h4") else above
            assert no == k and heading == above


def test_totals(spark):
    grid = spark.createDataFrame([(0.5, 3), (0.1, 1)], "score double, n long")
    assert abs(aggregates.grid_overall(grid).first()[0] - 0.4) < 1e-12 and aggregates.grid_overall(grid.limit(0)).first()[0] is None
    assert aggregates.nested_total(spark.createDataFrame([([1, 2],), (None,), ([],)], "a array<int>"), ["a"]).first()[0] == 2


def test_tail(spark):
    log = spark.createDataFrame([("j", k, f"l{k}") for k in range(10)], "job string, seq long, line string")
    jobs = spark.createDataFrame([("j", 3, False, 1), ("k", 0, True, None), ("m", 0, False, None)], "job string, consumed long, running boolean, exit_code int")
    got = sorted(map(tuple, feeds.tail_events(log, jobs, "job", 4).collect()))
    assert got == [*[("j", k, "line", f"l{k}") for k in range(6, 10)], ("j", 10, "done", "1"), ("m", 0, "done", None)]


def test_json_lines(spark, tmp_path):
    rows = [("a", 1, "Tick"), ("a", 2, "Done"), ("a", 3, "Tick"), ("b", 1, "Tick")]
    events = feeds.until_terminal(spark.createDataFrame(rows, "run string, seq int, kind string"), "run", "seq", F.col("kind").isin("Done", "Error"))
    events.write.json(str(tmp_path / "in"))
    for _ in range(2):  # started again, it writes nothing twice
        feeds.json_lines_sink(spark.readStream.schema("run string, seq int, kind string").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = duckdb.sql(f"SELECT run, seq, kind FROM read_json('{tmp_path}/out/*.json', format = 'newline_delimited')").fetchall()
    assert sorted(got) == [("a", 1, "Tick"), ("a", 2, "Done"), ("b", 1, "Tick")]


def test_pivots(spark):
    sheets = spark.createDataFrame([("b", 0, "One", "r1"), ("b", 1, "Two", "r8"), ("b", 2, "Three", None)], "book string, at int, name string, rid string")
    rels = spark.createDataFrame([("b", 0, "r1", "w/a.xml"), ("b", 1, "r1", "w/late.xml"), ("b", 2, "r2", "c/1.xml")], "book string, at int, rid string, target string")
    held = spark.createDataFrame([("b", "w/a.xml", 0, "p1"), ("b", "xl/worksheets/sheet2.xml", 0, "p1"), ("b", "xl/worksheets/sheet3.xml", 0, "p2")], "book string, sheet_part string, at int, target string")
    caches = spark.createDataFrame([("b", 0, "7", "none"), ("b", 1, "7", "r2")], "book string, at int, cache_id string, rid string")
    pivots = spark.createDataFrame([("b", "p1", "A", "7"), ("b", "p2", "B", None), ("b", "p3", "C", "8")], "book string, part string, name string, cache_id string")
    got = sorted(map(tuple, parts.pivot_sources(sheets, rels, held, caches, pivots).collect()))
    assert got == [("b", "p1", "A", "Two", "xl/worksheets/sheet2.xml", "c/1.xml"), ("b", "p2", "B", "Three", "xl/worksheets/sheet3.xml", None), ("b", "p3", "C", None, None, None)]


def test_apis(spark):
    page = """<p>fetch('/api/x')</p><script>fetch("/a/b?c=1"); axios.post ( `https://h/z`); r.open("GET", '/o'); k = "/v2/{id}/x"; k2 = "/v2/{id}/x"; n = '/plain'</script><script></script>"""
    df = spark.createDataFrame([(page,), ("",), (None,)], "html string")
    assert [r[0] for r in df.select(parts.discovered_apis(F.col("html"))).collect()] == [["/a/b", "/o", "/v2/{id}/x", "https://h/z"], [], None]


def test_greedy_claim(spark):
    """Each key in order takes its best item that is free: a plain loop over made-up offers."""
    draw = random.Random(3)
    offers = list({(g, k, draw.randrange(6), draw.randrange(4)) for g in "ab" for k in range(8) for _ in range(3)})
    want = []
    for g in "ab":
        taken = set()
        for k in range(8):
            free = sorted((p, i) for og, ok, i, p in offers if (og, ok) == (g, k) and i not in taken)
            if free:
                taken.add(free[0][1])
                want.append((g, k, free[0][1]))
    got = records.greedy_claim(spark.createDataFrame(offers, "g string, key int, item int, priority int"), "g")
    assert sorted(map(tuple, got.collect())) == want


def test_claims_of_large_groups(spark, monkeypatch):
    """Small groups take turns in a task, without a checkpoint of their offers; a large one beside them gives what turns give."""
    from lakewright.plans import scan

    draw = random.Random(8)
    # A key gives an item no priority or some, and of equal offers the least known one counts.
    offers = [(g, k, draw.randrange(9), draw.choice((None, 0, 1, 2, 3))) for g, n in (("a", 300), ("b", 12), ("c", 5)) for k in range(n) for _ in range(4)]
    offers += [(None, 1, 1, 1), ("b", None, 1, 1), ("b", 1, None, 1)]
    want = []
    for g, n in (("a", 300), ("b", 12), ("c", 5)):
        taken = set()
        for k in range(n):
            best = {}
            for _, _, i, p in (o for o in offers if o[:2] == (g, k) and o[2] is not None):
                best.setdefault(i, []).append(p)
            ranked = sorted((min([p for p in ps if p is not None], default=-1), i) for i, ps in best.items() if i not in taken)
            if ranked:
                taken.add(ranked[0][1])
                want.append((g, k, ranked[0][1]))
    df = spark.createDataFrame(offers, "g string, key int, item int, priority int")
    assert sorted(map(tuple, records.greedy_claim(df, "g").collect())) == want
    monkeypatch.setattr(scan, "CHUNK", 200)
    monkeypatch.setattr(scan, "SAMPLE", 50)
    assert sorted(map(tuple, records.greedy_claim(df, "g").collect())) == want
    made = []
    monkeypatch.setattr(records, "checkpointed", lambda d: made.append(d) or d)
    assert sorted(map(tuple, records.greedy_claim(df.where("g <> 'a'"), "g").collect())) == [w for w in want if w[0] != "a"] and not made


def test_custom_order(spark):
    df = spark.createDataFrame([("z", 1), ("b", 2), ("a", 9), ("b", 1), (None, 0)], "tag string, n int")
    assert [tuple(r) for r in records.ordered_by_custom(df, "tag", ["b", "a"], "n").collect()][:3] == [("b", 1), ("b", 2), ("a", 9)]


def test_shared_targets(spark):
    """Books name the shelf of their targets; the query never writes a list out once a book."""
    refs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 7), (4, 7), (None, 7), (2, None)], "book long, ref long")
    books = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (4, None)], "book long, shelf long")
    held = spark.createDataFrame([(0, 7), (0, 7), (1, 8)], "shelf long, key long")
    got = listings.three_states(refs, books, held, "book", "ref", "shelf")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 7, True), (1, 8, False), (2, 7, False), (3, 7, None), (4, 7, False), (None, 7, None), (2, None, False)], key=repr)


def test_states_stay_linear(spark, tmp_path):
    """As many customers and parts as make a join by remainder 13 million rows."""
    from lakewright import queries as base

    spark.range(20_000).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20_000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1000).selectExpr("id AS o_orderkey", "id * 7 % 20000 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = base.queries()["resolved_states"](spark, str(tmp_path))
    on = [e for e in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in e]
    assert len(on) == 3 and all("_custkey" in e or "__key" in e for e in on)
    assert {tuple(r) for r in found.collect()} == {(o * 7 % 20000, o, None if o * 7 % 20000 % 4 == 0 else o % 400 % 30 == o * 7 % 20000 % 30) for o in range(1000)}


def test_issues_without_broadcast(spark):
    """Lists that are small before they are taken apart are never sent around."""
    ids = spark.range(3).selectExpr("id AS project")
    projects = ids.selectExpr("project", "array('a', 'b', 'b', NULL) AS chapters")
    files = ids.where("project > 0").selectExpr("project", "explode(array('b', 'c', 'c', NULL)) AS name")
    blocks = ids.selectExpr("project", "array('u', 'v', 'v', NULL) AS uris")
    manifest = ids.where("project < 2").selectExpr("project", "explode(array('v', 'w')) AS uri")
    got = listings.project_issues(projects, files, blocks, manifest)
    want = [(p, "error", "no file", n) for p in range(3) for n in ("a", "b", None) if n != "b" or p == 0]
    want += [(p, "warning", "not in order", n) for p in (1, 2) for n in ("c", None)]
    want += [(p, "warning", "not in manifest", n) for p in range(3) for n in ("u", "v") if n == "u" or p == 2]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
