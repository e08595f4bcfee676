"""Joins and counters over tables of document parts: comments, merged ranges, table cells, placeholders, page blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.functions import scalars as S
from lakewright.operators.joins import first_of_each, rect_overlaps


def _n(condition) -> object:
    return F.count_if(condition).cast("long")


def comment_threads(comments: DataFrame, ext: DataFrame, ids: DataFrame) -> DataFrame:
    """Each comment (doc, at, para_id) with its extension (done, parent), its lasting id, and the comment that it replies to.

    Of several extensions, ids or comments with one paragraph the first by ``at`` counts. A comment without a
    paragraph finds nothing; ``replies_to`` is null for a parent that no comment has.
    """
    first = lambda df: first_of_each(df.where("para_id is not null"), ["doc", "para_id"], ["at"])
    e = first(ext).select("doc", "para_id", F.lit(True).alias("ex_found"), F.col("done").alias("done_written"), F.col("parent").alias("parent_para_id"))
    i = first(ids).select("doc", "para_id", F.lit(True).alias("id_found"), "durable_id")
    owner = first(comments).select("doc", F.col("para_id").alias("parent_para_id"), F.col("at").alias("replies_to"))
    rows = comments.select("doc", "at", "para_id").join(e, ["doc", "para_id"], "left").join(i, ["doc", "para_id"], "left").join(owner, ["doc", "parent_para_id"], "left")
    found = [F.coalesce(c, F.lit(False)).alias(c) for c in ("ex_found", "id_found")]
    return rows.select("doc", "at", "para_id", *found, "done_written", (F.col("done_written") == "1").alias("done"), "parent_para_id", "replies_to", "durable_id")


def thread_totals(threads: DataFrame, ext: DataFrame, ids: DataFrame) -> DataFrame:
    """Counters of each document: what matched, and orphans in both directions."""
    per = threads.groupBy("doc").agg(
        F.count(F.lit(1)).alias("comments_total"),
        F.count("para_id").alias("paras_with_para_id"),
        F.count_distinct(F.when(F.col("ex_found"), F.col("para_id"))).alias("ext_matched"),
        F.count_distinct(F.when(F.col("id_found"), F.col("para_id"))).alias("ids_matched"),
        F.count("done_written").alias("done_written_total"),
        _n(F.col("done")).alias("done_true"),
        _n(~F.col("done")).alias("done_false"),
        _n(F.col("ex_found") & F.col("done_written").isNull()).alias("ex_without_done"),
        F.count("parent_para_id").alias("replies_total"),
        _n(F.col("parent_para_id").isNotNull() & F.col("replies_to").isNull()).alias("replies_dangling"),
    )
    size = lambda df, name: df.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    both = per.join(size(ext, "ext_total"), "doc", "full_outer").join(size(ids, "ids_total"), "doc", "full_outer").na.fill(0)
    orphans = [(F.col(f"{p}_total") - F.col(f"{p}_matched")).alias(f"{p}_orphans") for p in ("ext", "ids")]
    return both.select("*", *orphans)


def merge_ledger(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Counters of merged ranges (by, at, r0, c0, r1, c1, has_text), a null corner being a bad reference.

    A range overlaps if it shares a cell with one of smaller ``at`` that isn't reversed. Reversed ranges count in
    nothing but ``total``, ``overlapping`` and, as they have no name of their own, ``duplicated``. Equal ranges are
    one before ranges meet, so that many copies of one range aren't paired with each other.
    """
    corner = {f: F.least(f, t) for f, t in (("r0", "r1"), ("c0", "c1"))}
    other = {t: F.greatest(f, t) for f, t in (("r0", "r1"), ("c0", "c1"))}
    bad = F.col("r0").isNull() | F.col("c0").isNull() | F.col("r1").isNull() | F.col("c1").isNull()
    flips = (F.col("r0") > F.col("r1")) | (F.col("c0") > F.col("c1"))
    good = ranges.where(~bad).select(*by, "at", "has_text", flips.alias("flips"), *[c.alias(n) for n, c in {**corner, **other}.items()])
    box = F.struct("r0", "c0", "r1", "c1")
    boxes = good.groupBy(*by, box.alias("id")).agg(F.min(F.when(~F.col("flips"), F.col("at"))).alias("first"))
    pairs = rect_overlaps(boxes.select(*by, "id", F.col("id.r0").alias("x0"), F.col("id.c0").alias("y0"), F.col("id.r1").alias("x1"), F.col("id.c1").alias("y1")), by)
    near = pairs.unionByName(pairs.select(*by, F.col("later").alias("earlier"), F.col("earlier").alias("later")))
    met = near.join(boxes.withColumnRenamed("id", "earlier"), [*by, "earlier"]).select(*by, F.col("later").alias("id"), "first").unionByName(boxes)
    earliest = met.groupBy(*by, "id").agg(F.min("first").alias("earliest"))
    cells = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    rows = good.withColumns({"id": box, "cells": cells}).join(earliest, [*by, "id"], "left")
    proper = ~F.col("flips")
    sums = rows.groupBy(*by).agg(
        F.count_distinct(F.when(proper, F.col("id"))).alias("distinct_ranges"),
        _n(F.col("earliest") < F.col("at")).alias("overlapping"),
        _n(proper & (F.col("cells") == 1)).alias("solo"),
        F.coalesce(F.sum(F.when(proper, F.col("cells") - 1)), F.lit(0)).cast("long").alias("covered_cells"),
        _n(proper & F.col("has_text")).alias("anchors_with_text"),
    )
    total = ranges.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), _n(bad).alias("bad_refs"))
    out = total.join(sums, by, "left").na.fill(0)
    return out.withColumn("duplicated", F.col("total") - F.col("bad_refs") - F.col("distinct_ranges"))


def table_csv(cells: DataFrame, by: list[str]) -> DataFrame:
    """Each table of cells (by, row, col, text, covered) as CSV text with line ends LF; rows keep their own widths.

    Returns rows, columns (of the widest row), widths, ragged, empty_cells, covered_cells and csv. A null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    each = cells.select(*by, "row", F.struct("col", S.csv_field(text).alias("field")).alias("cell"), (text == "").alias("empty"), F.coalesce("covered", F.lit(False)).alias("covered"))
    lines = each.groupBy(*by, "row").agg(F.array_sort(F.collect_list("cell")).alias("cells"), _n(F.col("empty")).alias("empty"), _n(F.col("covered")).alias("covered"))
    line = F.struct("row", F.array_join(F.transform("cells", lambda c: c["field"]), ",").alias("line"), F.size("cells").alias("width"))
    tables = lines.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum("empty").alias("empty_cells"), F.sum("covered").alias("covered_cells"))
    widths = F.transform("lines", lambda x: x["width"])
    return tables.select(
        *by,
        F.size("lines").cast("long").alias("rows"),
        F.array_max(widths).cast("long").alias("columns"),
        widths.alias("widths"),
        (F.array_min(widths) < F.array_max(widths)).alias("ragged"),
        "empty_cells",
        "covered_cells",
        F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("csv"),
    )


def placeholder_hops(shapes: DataFrame, layouts: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Shapes (slide, at, is_placeholder, idx) with the first placeholder of their index in their slide's layout.

    ``layouts`` is (slide, at, layout), the first of a slide counts; ``placeholders`` is (layout, at, idx, kind). A
    placeholder without an index goes by index 0; other shapes match nothing.
    """
    layout = first_of_each(layouts, ["slide"], ["at"]).select("slide", "layout")
    zero = lambda c: F.coalesce(c, F.lit(0))
    book = first_of_each(placeholders.withColumn("__idx", zero("idx")), ["layout", "__idx"], ["at"]).select("layout", "__idx", F.col("kind").alias("matched_kind"), F.lit(True).alias("__hit"))
    rows = shapes.withColumn("__idx", F.when(F.col("is_placeholder"), zero("idx"))).join(layout, "slide", "left").join(book, ["layout", "__idx"], "left")
    return rows.withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__idx", "__hit")


def hop_totals(hops: DataFrame) -> DataFrame:
    """(shape_total, with_ph, hop_found, hop_missing, no_idx_written) in one row."""
    ph = F.col("is_placeholder")
    return hops.agg(F.count(F.lit(1)).alias("shape_total"), _n(ph).alias("with_ph"), _n(ph & F.col("matched")).alias("hop_found"), _n(ph & ~F.col("matched")).alias("hop_missing"), _n(ph & F.col("idx").isNull()).alias("no_idx_written"))


def numbered_sections(pages: DataFrame, key: str, blocks: str) -> DataFrame:
    """(key, section_no, tag, text, heading, markdown) of the blocks (tag, text) of each page, numbered from 1 in page order.

    ``heading`` is the last h1 to h4 at or above a section, null before the first.
    """
    each = pages.select(key, F.posexplode(blocks).alias("__i", "__b")).select(key, (F.col("__i") + 1).cast("long").alias("section_no"), "__b.tag", "__b.text")
    is_heading = F.col("tag").rlike("^h[1-4]$")
    above = Window.partitionBy(key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.repeat(F.lit("#"), F.substring("tag", 2, 1).try_cast("int"))
    mark = F.when(is_heading, F.concat(head, F.lit(" "))).when(F.col("tag") == "li", "- ").when(F.col("tag") == "blockquote", "> ").otherwise("")
    return each.select("*", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(above).alias("heading"), F.concat(mark, "text").alias("markdown"))


def pivot_sources(sheets: DataFrame, rels: DataFrame, sheet_rels: DataFrame, caches: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each pivot table (book, part, name, cache_id) with the sheet that shows it and the part of its cache.

    ``sheets`` (book, at, name, rid) find their part by ``rels`` (book, at, rid, target), else it is sheet{n}.xml by their
    place in the book; ``sheet_rels`` (book, sheet_part, at, target) says which pivot tables a sheet holds, the last sheet
    wins; ``caches`` (book, at, cache_id, rid) that no relation resolves are left out. Of equal ids the first counts.
    """
    target = first_of_each(rels, ["book", "rid"], ["at"]).select("book", "rid", "target")
    place = F.row_number().over(Window.partitionBy("book").orderBy("at"))
    named = sheets.withColumn("__n", place).join(target, ["book", "rid"], "left")
    part = F.coalesce("target", F.concat(F.lit("xl/worksheets/sheet"), F.col("__n").cast("string"), F.lit(".xml")))
    named = named.select("book", F.col("__n"), F.col("name").alias("sheet"), part.alias("sheet_part"))
    held = named.join(sheet_rels.select("book", "sheet_part", "at", F.col("target").alias("part")), ["book", "sheet_part"])
    owner = held.groupBy("book", "part").agg(F.max_by(F.struct("sheet", "sheet_part"), F.struct("__n", "at")).alias("o")).select("book", "part", "o.*")
    cache = first_of_each(caches.join(target, ["book", "rid"]), ["book", "cache_id"], ["at"]).select("book", "cache_id", F.col("target").alias("cache_part"))
    return pivots.join(owner, ["book", "part"], "left").join(cache, ["book", "cache_id"], "left").select("book", "part", "name", "sheet", "sheet_part", "cache_part")


# Where a script calls an interface, and what a path of one looks like.
API_CALL = r"""(?:(?:fetch|axios\.(?:get|post|put|delete))\s*\(?|\.open\([^,]+,)\s*['"`]((?:/|https?://)[^'"`\s?]+)"""
API_PATH = r"""['"`](/(?:api|v[0-9]+)/[a-zA-Z0-9_/{}-]+)['"`]"""


def discovered_apis(page) -> object:
    """The interface addresses in a page's scripts, each once, sorted: string arguments of calls, quoted paths of interfaces."""
    scripts = F.regexp_extract_all(page, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    found = lambda s: F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in (API_CALL, API_PATH)])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(scripts, found))))


def formula_edges(cells: DataFrame, by: str, cell: str, formula: str) -> DataFrame:
    """(by, cell, needs), each once: the cells of the same sheet that a formula refers to, ranges cell by cell, without dollar signs.

    References to other sheets are left out; a cell that needs itself is an edge, too. ``graph.levels`` orders such edges and finds
    cycles. A range of a whole sheet has 17 billion cells: those of more than RANGE_CELLS are an error."""
    bare = F.regexp_replace(formula, r"[A-Za-z_][A-Za-z0-9_]*!\$?[A-Z]{1,3}\$?[0-9]+(:\$?[A-Z]{1,3}\$?[0-9]+)?", " ")
    refs = cells.select(by, cell, F.explode(S.formula_refs(bare)).alias("ref"))
    ends = F.split(F.replace("ref", F.lit("$"), F.lit("")), ":")
    both = refs.select(by, cell, S.split_ref(ends[0]).alias("a"), S.split_ref(F.coalesce(F.get(ends, F.lit(1)), ends[0])).alias("b"))
    span = lambda f: F.sequence(F.least(f"a.{f}", f"b.{f}"), F.greatest(f"a.{f}", f"b.{f}"))
    size = (F.abs(F.col("a.row") - F.col("b.row")) + 1).cast("long") * (F.abs(F.col("a.col") - F.col("b.col")) + 1)
    rows = F.when(size > RANGE_CELLS, F.raise_error(F.lit(f"a range of more than {RANGE_CELLS} cells")).cast("array<int>")).otherwise(span("row"))
    each = both.select(by, cell, F.explode(rows).alias("row"), span("col").alias("cols")).select(by, cell, "row", F.explode("cols").alias("col"))
    return each.select(by, cell, S.address(F.col("row"), F.col("col")).alias("needs")).distinct()


#: Cells of the largest range that is taken apart.
RANGE_CELLS = 1 << 20
