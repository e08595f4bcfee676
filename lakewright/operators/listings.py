"""Positional and nested selects: rules and their styles, atlas listings, frames of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions import scalars as S


def rule_styles(rules: DataFrame, styles: DataFrame) -> DataFrame:
    """The rules (book, sheet, at, style_id) with ``elements``, what the style at that place in the book's list holds.

    ``styles``: (book, at, element), one row for each element, in order of ``seq``. A rule without a number, or with one that the list
    doesn't reach, has null; a style without elements is in the list if it has a row with a null element."""
    listed = styles.groupBy(F.col("book").alias("__book"), F.col("at").alias("__at")).agg(F.array_sort(F.collect_list(F.when(F.col("element").isNotNull(), F.struct("seq", "element")))).alias("e"))
    met = rules.join(listed, (F.col("book") == F.col("__book")) & (F.col("style_id") == F.col("__at")), "left")
    return met.select(*rules.columns, F.transform("e", lambda x: x["element"]).alias("elements"))


def atlas_names(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """(by, order, kind, name): the pages and regions of atlas listings, given line by line.

    A name is a line without a colon that isn't indented; it names a page if it is a file's first name or stands behind a blank line or
    at the start, else a region. Lines that begin with # count for nothing, not even between a blank line and a name. The lines of
    one file are ordered in one task, as listings are small; files spread."""
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    rows = lines.select(by, order, F.col(line).alias("__line"), bare.alias("name")).where(~F.startswith("name", F.lit("#")))
    kind = F.when(F.col("name") == "", "blank").when(F.contains("name", F.lit(":")) | F.substring("__line", 1, 1).isin(" ", "\t"), "other").otherwise("name")
    upto = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("__kind", kind).withColumns({"__last": F.lag("__kind").over(upto), "__names": F.count_if(F.col("__kind") == "name").over(upto.rowsBetween(Window.unboundedPreceding, 0))})
    page = F.col("__last").isNull() | (F.col("__last") == "blank") | (F.col("__names") == 1)
    return rows.where(F.col("__kind") == "name").select(by, order, F.when(page, "page").otherwise("region").alias("kind"), "name")


def atlas_counts(names: DataFrame, by: str) -> DataFrame:
    """(by, page_count, region_count) of ``atlas_names``; a file without names has no row."""
    return names.groupBy(by).agg(F.count_if(F.col("kind") == "page").alias("page_count"), F.count_if(F.col("kind") == "region").alias("region_count"))


def frames(poses: DataFrame, title: str, sequences: str, pattern: str, index: int | None = None) -> DataFrame:
    """The poses whose title matches a name pattern in any case, a row for each frame: all columns but the sequences, ``direction`` (the
    place of its sequence), ``index`` (its place there) and ``frame``; with ``index`` the frames of that number alone.

    ``sequences``: array of arrays of frames. A pose without frames, or whose sequences end before the number, has no rows."""
    kept = poses.where(F.coalesce(S.glob_match(F.col(title), pattern, ignore_case=True), F.lit(False)))
    own = [c for c in poses.columns if c != sequences]
    each = kept.select(*own, F.posexplode(sequences).alias("direction", "__frames"))
    if index is not None:
        return each.where(F.size("__frames") > index).select(*own, "direction", F.lit(index).alias("index"), F.get("__frames", F.lit(index)).alias("frame"))
    return each.select(*own, "direction", F.posexplode("__frames").alias("index", "frame"))


def providers_with_status(parts: dict[str, DataFrame], name: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The providers that gave rows, and one status row each: (provider, n, ok, message); one that can't be read is an error there, and
    the others go on. An action for each provider, as only a read tells."""
    good, rows = {}, []
    for provider, df in parts.items():
        try:
            n = df.select(name).count()
        except Exception as e:  # noqa: BLE001  whatever a provider's reader raises is its status
            rows.append((provider, 0, False, str(e).split("\n")[0][:200]))
            continue
        good[provider] = df
        rows.append((provider, n, True, None))
    spark = next(iter(parts.values())).sparkSession
    return good, spark.createDataFrame(rows, "provider string, n long, ok boolean, message string")


def three_states(refs: DataFrame, books: DataFrame, held: DataFrame, by: str, ref: str, shelf: str | None = None) -> DataFrame:
    """The references with ``resolved``: whether their book (by) holds them, null if there is no such book among ``books``.

    ``held``: (by, key), the targets of the books. Books that share their targets name a ``shelf``, one each, and ``held`` is (shelf,
    key) then, so that no list is written out once a book."""
    share = shelf or by
    known = books.select(F.col(by).alias("__by"), F.col(share).alias("__shelf"), F.lit(True).alias("__book")).distinct()
    found = held.select(F.col(share).alias("__in"), F.col("key").alias("__key")).distinct().withColumn("__found", F.lit(True))
    placed = refs.join(known, refs[by] == known["__by"], "left")
    met = placed.join(found, (F.col("__shelf") == F.col("__in")) & (refs[ref] == found["__key"]), "left")
    return met.select(*[refs[c] for c in refs.columns], F.when(F.col("__book"), F.coalesce("__found", F.lit(False))).alias("resolved"))


def insert_and_keep(rows: DataFrame, new: DataFrame, key: str, order: list[str], keep: int) -> DataFrame:
    """The newest ``keep`` rows after ``new`` has been put behind ``rows``, with keys that go on from the largest, in ``order``.

    Only the last ``keep`` of the new rows can stay, and they are numbered from the end, so that no more than these are ordered in one
    place: two top-k selections, whatever the sizes. Columns of ``new`` beyond those of ``rows`` go."""
    top, n = rows.agg(F.max(key)).first()[0] or 0, new.count()
    last = new.orderBy(*[F.desc(c) for c in order]).limit(keep)
    back = F.row_number().over(Window.orderBy(*[F.desc(c) for c in order]))
    numbered = last.withColumn(key, (F.lit(top + n + 1) - back).cast(rows.schema[key].dataType))
    both = rows.orderBy(F.desc(key)).limit(keep).unionByName(numbered.select(*rows.columns))
    return both.orderBy(F.desc(key)).limit(keep)


def bookmark_pairs(starts: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """One row a document: starts_total, ends_total, closed, open_starts, orphan_ends, hidden, names and duplicate_names.

    ``starts``: (by, id, name), ``ends``: (by, id), both with repeats. A start is closed if any end of its document has its id; an id
    that isn't written pairs with nothing. ``hidden``: names that begin with an underscore; ``duplicate_names``: names that stand
    on several starts."""
    known = lambda df: df.where("id is not null").select(by, "id").distinct().withColumn("__met", F.lit(1))
    n = F.count(F.lit(1))
    opened = starts.join(known(ends), [by, "id"], "left").groupBy(by, "name").agg(n.alias("n"), F.count("__met").alias("closed"))
    named = F.col("name").isNotNull()
    per = opened.groupBy(by).agg(F.sum("n").alias("starts_total"), F.sum("closed").alias("closed"), F.coalesce(F.sum(F.when(F.startswith("name", F.lit("_")), F.col("n"))), F.lit(0)).alias("hidden"), F.count_if(named).alias("names"), F.count_if(named & (F.col("n") > 1)).alias("duplicate_names"))
    shut = ends.join(known(starts), [by, "id"], "left").groupBy(by).agg(n.alias("ends_total"), F.count_if(F.col("__met").isNull()).alias("orphan_ends"))
    both = per.join(shut, by, "full").na.fill(0)
    return both.select(by, "starts_total", "ends_total", "closed", (F.col("starts_total") - F.col("closed")).alias("open_starts"), "orphan_ends", "hidden", "names", "duplicate_names")


def project_issues(projects: DataFrame, files: DataFrame, blocks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(project, severity, what, name): chapters in a project's order that have no file are errors, files that the order lacks and
    sources of blocks that the manifest lacks are warnings, each once.

    ``projects``: (project, chapters), an array; ``files``: (project, name); ``blocks``: (project, uris), an array for each block;
    ``manifest``: (project, uri)."""
    listed = projects.select("project", F.explode("chapters").alias("name"), F.lit(1).alias("side"))
    there = files.select("project", "name", F.lit(2).alias("side"))
    used = blocks.select("project", F.explode("uris").alias("name"), F.lit(1).alias("side")).where("name is not null")
    held = manifest.select("project", F.col("uri").alias("name"), F.lit(2).alias("side"))
    # Both sides are summed by name: a join would send one around if its size before the lists are taken apart looks small.
    sides = lambda a, b: a.unionByName(b).groupBy("project", "name").agg(F.min("side").alias("least"), F.max("side").alias("most"))
    issue = lambda df, severity, what: df.select("project", F.lit(severity).alias("severity"), F.lit(what).alias("what"), "name")
    known = F.col("project").isNotNull() & F.col("name").isNotNull()
    chapters = sides(listed, there).where((F.col("least") == F.col("most")) | ~known)
    lacking = F.explode(F.array_compact(F.array(F.when(F.col("least") == 1, F.struct(F.lit("error"), F.lit("no file"))), F.when(F.col("most") == 2, F.struct(F.lit("warning"), F.lit("not in order"))))))
    out = chapters.select("project", lacking.alias("i"), "name").select("project", F.col("i.col1").alias("severity"), F.col("i.col2").alias("what"), "name")
    sources = sides(used, held).where((F.col("least") == 1) & ((F.col("most") == 1) | ~known))
    return out.unionByName(issue(sources, "warning", "not in manifest"))
