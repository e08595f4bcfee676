"""Pages as rows: elements with pre-order intervals, selectors as structural joins over them.

``read`` is the only step that looks at markup. Everything else is relational: a node's descendants are the rows of its page
whose ``pre`` lies in (pre, last], its children those whose ``parent`` is its ``pre``, its text is the page's runs
``run_from`` to ``run_from + n_runs``. A page is the unit of partitioning; pages of a hot site spread like any others.

Edge cases: a null or empty page has no elements and no runs. Repeated keys are kept apart only if the caller makes the key
unique; rows of one key are one page.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.functions.html import SILENT, Tree
from lakewright.session import checkpointed

ELEMENT = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("pre", "last", "parent", "depth")]
    + [T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(c, T.IntegerType()) for c in ("run_from", "n_runs")]
)
PAGE = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("runs", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("hush", T.IntegerType())])))])


def page_rows(page: str) -> dict:
    """The elements of a page in order, numbered from 1 (0 is the page), and its runs of text, white space as one blank, each
    with the number of the innermost script or the like around it (0: none), which hides it from what stands further out."""
    elements: list[list] = []
    runs: list[dict] = []
    todo: list = [(c, 0, 1, 0) for c in reversed(Tree(page).root.children)]
    while todo:
        node, parent, depth, hush = todo.pop()
        if node is None:  # all below the element of number ``parent`` has been read
            row = elements[parent - 1]
            row[1], row[7] = len(elements), len(runs) - row[6]
        elif isinstance(node, str):
            if text := " ".join(node.split()):
                runs.append({"text": text, "hush": hush})
        else:
            elements.append([len(elements) + 1, 0, parent, depth, node.tag, node.attrs, len(runs), 0])
            here = len(elements)
            todo.append((None, here, 0, 0))
            todo.extend((c, here, depth + 1, here if node.tag in SILENT else hush) for c in reversed(node.children))
    return {"elements": [dict(zip(ELEMENT.names, e, strict=True)) for e in elements], "runs": runs}


@F.pandas_udf(PAGE)
def read_udf(page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_rows(p or "") for p in page], columns=PAGE.names)


class Pages:
    """The elements (key, pre, last, parent, depth, tag, attrs, run_from, n_runs) and runs (key, runs) of some pages."""

    def __init__(self, elements: DataFrame, runs: DataFrame, key: str) -> None:
        self.elements, self.runs, self.key = elements, runs, key


def read(pages: DataFrame, key: str, html: str = "html") -> Pages:
    """Read the pages once, into the checkpoint folder, so that several selectors can go by the same rows."""
    both = checkpointed(pages.select(key, read_udf(html).alias("page")))
    return Pages(both.select(key, F.inline("page.elements")), both.select(key, "page.runs"), key)


_STEP = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]|(\*)")


def chains(selector: str) -> list[list[tuple[str, str]]]:
    """The alternatives of a selector, each as (combinator, simple selector) from the outermost on; ">" is a child."""
    out = []
    for alternative in selector.split(","):
        steps = re.sub(r"\s*>\s*", " >", alternative.strip()).split()
        if steps:
            out.append([(">" if s.startswith(">") else " ", s.lstrip(">")) for s in steps])
    return out


def matches(simple: str) -> Column:
    """Whether an element row is what a simple selector names: tag, #id, .class, [attr], [attr=value] or *, one after another."""
    hit, attrs = F.lit(True), F.col("attrs")
    for kind, name, attr, value, _ in _STEP.findall(simple):
        if attr:
            held = F.try_element_at(attrs, F.lit(attr.lower()))
            hit = hit & ((held == value) if f"[{attr}=" in simple and value else held.isNotNull())
        elif kind == "#":
            hit = hit & (F.try_element_at(attrs, F.lit("id")) == name)
        elif kind == ".":
            hit = hit & F.array_contains(F.split(F.try_element_at(attrs, F.lit("class")), r"\s+"), name)
        elif name:
            hit = hit & (F.col("tag") == name.lower())
    return F.coalesce(hit, F.lit(False))


def inside(elements: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """The elements that lie within any of ``outer``: a containment join of intervals that nest, by one pass over both in
    order. Of the outer ones that began before, that which ends last decides."""
    rows = elements.withColumn("__reach", F.lit(None).cast("int")).unionByName(outer.select(*elements.columns, F.col("last").alias("__reach")))
    order = Window.partitionBy(key).orderBy("pre", F.col("__reach").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.withColumn("__far", F.max("__reach").over(order))
    return reached.where("__reach is null and __far >= pre").select(*elements.columns)


def children(elements: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """The elements whose parent is one of ``outer``."""
    return elements.join(outer.select(key, F.col("pre").alias("parent")), [key, "parent"], "left_semi").select(*elements.columns)


def select(pages: Pages, selector: str) -> DataFrame:
    """The elements that a selector finds, each once: simple selectors are filters, descendants and children joins, commas a
    union."""
    found = None
    for (_, first), *rest in chains(selector):
        hits = pages.elements.where(matches(first))
        for combinator, simple in rest:
            hits = (children if combinator == ">" else inside)(pages.elements.where(matches(simple)), hits, pages.key)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return pages.elements.limit(0)
    return found.dropDuplicates([pages.key, "pre"]) if len(chains(selector)) > 1 else found


def texts(pages: Pages, elements: DataFrame) -> DataFrame:
    """The elements with ``text``: their runs in page order, a blank between; empty if there are none."""
    joined = elements.join(pages.runs, pages.key)
    own = F.filter(F.slice("runs", F.col("run_from") + 1, F.col("n_runs")), lambda r: r["hush"] < F.col("pre"))
    return joined.select(*elements.columns, F.array_join(F.transform(own, lambda r: r["text"]), " ").alias("text"))


def selected_texts(pages: Pages, selector: str) -> DataFrame:
    """(key, texts): the texts of what a selector finds in each page, in page order; an empty list where it finds nothing."""
    found = texts(pages, select(pages, selector)).groupBy(pages.key).agg(F.array_sort(F.collect_list(F.struct("pre", "text"))).alias("t"))
    every = pages.runs.select(pages.key).join(found, pages.key, "left")
    return every.select(pages.key, F.coalesce(F.col("t.text"), F.array().cast("array<string>")).alias("texts"))
