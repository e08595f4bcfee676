"""Counters of workbooks over tables of their cells, strings, styles and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators.parts import merge_ledger

#: Counters of what stands beside the cells, a row each in ``features``.
FEATURES = ["merged", "hidden_rows", "hidden_cols", "comments", "charts", "conditional_rules", "validations", "links", "pictures"]


def cell_totals(cells: DataFrame, strings: DataFrame, styles: DataFrame) -> DataFrame:
    """One row a book of cells (book, kind, style, value, formula, inline): sixteen counters.

    ``kind`` and ``style`` are as written, null if they aren't: a cell without a kind is a number, one without a style has style 0.
    ``strings``: (book, at, rich, preserved), the shared strings; ``styles``: (book, style, bold, filled, wrapped, format), what a style
    number comes to. ``inline``: null, or struct (rich, preserved) of the cell's own string. A number outside the strings or
    styles counts as neither. Looks that aren't written are null and don't count."""
    kind = F.coalesce("kind", F.lit("n"))
    at = F.when(kind == "s", F.when(F.col("value").rlike("^[0-9]+$"), F.col("value").try_cast("long")))
    keyed = cells.withColumns({"__at": at, "__style": F.coalesce("style", F.lit(0)).cast("long"), "__kind": kind})
    text = strings.select("book", F.col("at").cast("long").alias("__at"), F.col("rich").alias("__rich"), F.col("preserved").alias("__kept"))
    look = styles.select("book", F.col("style").cast("long").alias("__style"), "bold", "filled", "wrapped", S.format_kind(F.col("format")).alias("__shows"))
    rows = keyed.join(text, ["book", "__at"], "left").join(look, ["book", "__style"], "left")
    own = lambda f, shared: F.when(F.col("__kind") == "inlineStr", F.col(f"inline.{f}")).otherwise(F.col(shared))
    number = S.coerce_number(F.col("value")).isNotNull()
    return rows.groupBy("book").agg(
        F.count(F.lit(1)).alias("cells"), F.count("formula").alias("formulas"), F.count_if((F.col("__kind") != "s") & number).alias("numeric"),
        F.count_if(F.col("__kind") == "s").alias("shared_strings"), F.count("inline").alias("inline_strings"), F.count_if(F.col("__shows").isin("date", "datetime", "time")).alias("dates"),
        F.count_if(F.contains("formula", F.lit("HYPERLINK("))).alias("hyperlink_formulas"), F.count_if(F.col("__kind") == "e").alias("error_cells"), F.count_if(F.col("__kind") == "str").alias("string_result_cells"),
        F.count("kind").alias("cells_with_written_type"), F.count_if(own("rich", "__rich")).alias("cells_with_runs"), F.count_if(own("preserved", "__kept")).alias("cells_with_preserved_space"),
        F.count_if("bold").alias("cells_bold"), F.count_if("filled").alias("cells_filled"), F.count_if("wrapped").alias("cells_wrapped"), F.count_if(F.col("style").isNull()).alias("cells_without_style_written"),
    )


def totals(cells: DataFrame, strings: DataFrame, styles: DataFrame, features: DataFrame, merges: DataFrame) -> DataFrame:
    """``cell_totals`` with the counters of FEATURES, from features (book, feature), and of merged ranges (see ``merge_ledger``; by book):
    one row for each book that has anything, 0 where it has none."""
    beside = features.groupBy("book").agg(*[F.count_if(F.col("feature") == f).alias(f) for f in FEATURES])
    ranges = merge_ledger(merges, ["book"]).select("book", F.col("distinct_ranges").alias("merges_ranges"), F.col("covered_cells").alias("merges_covered"), F.col("overlapping").alias("merges_overlapping"))
    out = cell_totals(cells, strings, styles).join(beside, "book", "full").join(ranges, "book", "full")
    return out.na.fill(0, [c for c in out.columns if c != "book"])
