"""Lookups, mappings and reports over records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators.joins import first_of_each
from lakewright.plans.scan import begins, chunked, sorted_groups, whole
from lakewright.session import checkpointed


def positional(df: DataFrame, at: str, book: DataFrame, index: str, value: str) -> DataFrame:
    """Each row with the entry at its position of a book; null beyond its ends."""
    entries = book.select(F.col(index).alias("__i"), F.col(value).alias(value))
    return df.join(entries, df[at] == F.col("__i"), "left").drop("__i")


def reverse_lookup(values: DataFrame, value: str, attachments: DataFrame, fields: DataFrame) -> DataFrame:
    """(value, source, name) of each value that an attachment, or else a field, holds; the smallest name of several."""
    both = attachments.select(F.col("value").alias("__v"), "name", F.lit(0).alias("__p"), F.lit("attachment").alias("source")).unionByName(
        fields.select(F.col("value").alias("__v"), "name", F.lit(1).alias("__p"), F.lit("field").alias("source"))
    )
    best = first_of_each(both, ["__v"], ["__p", "name"])
    return values.join(best, values[value] == F.col("__v")).select(*values.columns, "source", "name")


def apply_bindings(bindings: DataFrame, vault: DataFrame) -> DataFrame:
    """(param, value): a constant binding gives its own value, one by reference that of the vault; what the vault lacks is dropped."""
    held = vault.select(F.col("name").alias("__n"), F.col("value").alias("__held"))
    out = bindings.join(held, (F.col("kind") == "ref") & (F.col("target") == F.col("__n")), "left")
    return out.select("param", F.when(F.col("kind") == "const", F.col("target")).otherwise(F.col("__held")).alias("value")).where("value is not null")


def by_id_or_newest(wanted: DataFrame, recipes: DataFrame) -> DataFrame:
    """Each request (request, id, host, command) with the recipe of its id, else the newest of its host and command."""
    exact = wanted.join(recipes.select("id", F.col("id").alias("exact")), "id", "left")
    newest = recipes.groupBy("host", "command").agg(F.max_by("id", F.struct("last_used", "id")).alias("newest"))
    return exact.join(newest, ["host", "command"], "left").select("request", F.coalesce("exact", "newest").alias("recipe"))


def update_where_known(df: DataFrame, key: str, known: DataFrame, value: str) -> DataFrame:
    """``value`` of the rows whose key is known replaced; others are left alone."""
    new = known.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(True).alias("__known"))
    out = df.join(new, df[key] == F.col("__k"), "left")
    return out.withColumn(value, F.when(F.col("__known"), F.col("__v")).otherwise(F.col(value))).drop("__k", "__v", "__known")


def _claims(group: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted groups the offers that are taken when keys take turns."""

    def claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in whole(batches, [group]):
            turns, starts = begins(rows, [group, "key"]).tolist(), set(first.tolist())
            item, bare = rows.column("item").to_pylist(), rows.column("__bare").to_pylist()
            taken, kept = set(), []
            for i, end in zip(turns, [*turns[1:], rows.num_rows], strict=True):
                if i in starts:
                    taken = set()
                places = range(i, end)
                if bare[end - 1]:  # offers without a priority come first, if the item has none with one
                    known = {item[k] for k in places if not bare[k]}
                    places = [k for k in places if bare[k] and item[k] not in known] + [k for k in places if not bare[k]]
                for k in places:
                    if item[k] not in taken:
                        taken.add(item[k])
                        kept.append(k)
                        break
            yield from rows.select([group, "key", "item"]).take(pa.array(kept, pa.int64())).to_batches()

    return claims


def greedy_claim(offers: DataFrame, group: str) -> DataFrame:
    """(group, key, item) from offers (group, key, item, priority): keys in order take their best item that no earlier key has taken.

    A group is sorted and its keys take turns, in one task. One too large for that (``plans.scan``) goes by deferred acceptance: every key
    asks for its best item, an item keeps the smallest key that asks, and those that it sends away ask for their next best, until
    nobody is sent away. As all items rank the keys alike, that ends where taking turns does. A round is a sum by item, and a key's own
    offers are all that is ever ordered together. Offers with a null group, key or item are left out; of a key's equal offers one counts."""
    given = offers.where(f"`{group}` is not null and key is not null and item is not null").select(group, "key", "item", "priority")
    dealt, large = chunked(given, [group], ["key", "item"])
    if not large:
        return _by_turns(given, group)
    cut = dealt.groupBy(F.col(group).alias("__b")).agg(F.max("__chunk").alias("__most")).where("__most > 0").select("__b")
    same = F.col(group).eqNullSafe(F.col("__b"))
    small = given.join(F.broadcast(cut), same, "left_anti")
    return _by_turns(small, group).unionByName(_deferred(given.join(F.broadcast(cut), same, "left_semi"), group))


def _by_turns(offers: DataFrame, group: str) -> DataFrame:
    kinds = dict(offers.dtypes)
    rows = sorted_groups(offers.select(group, "key", "item", "priority", F.col("priority").isNull().alias("__bare")), [group], ["key", F.asc_nulls_last("priority"), "item"]).drop("priority")
    return rows.mapInArrow(_claims(group), f"`{group}` {kinds[group]}, key {kinds['key']}, item {kinds['item']}")


def _deferred(offers: DataFrame, group: str) -> DataFrame:
    best = offers.groupBy(group, "key", "item").agg(F.min("priority").alias("priority"))
    place = F.row_number().over(Window.partitionBy(group, "key").orderBy("priority", "item"))
    ranked = checkpointed(best.select(group, "key", "item", place.alias("place")))
    asking = ranked.select(group, "key").distinct().withColumn("place", F.lit(1))
    while True:
        asked = asking.join(ranked, [group, "key", "place"])
        kept = asked.groupBy(group, "item").agg(F.min("key").alias("__key"))
        held = checkpointed(asked.join(kept, [group, "item"]).select(group, "key", "item", "place", (F.col("key") == F.col("__key")).alias("kept")))
        if not held.where("not kept").limit(1).count():
            return held.select(group, "key", "item")
        asking = held.select(group, "key", F.when(F.col("kept"), F.col("place")).otherwise(F.col("place") + 1).alias("place"))


def depth_tally(nodes: DataFrame, by: list[str], depth: str, span: str) -> DataFrame:
    """(by, n, span, deepest) of nested groups that are listed with their depth."""
    return nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(span).cast("long").alias("span"), F.max(depth).alias("deepest"))


def key_sizes(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """For each key the number of elements of the array, or of keys of the object, that stands there; null for anything else."""
    at = lambda k: F.get_json_object(json, f"$.{k}")
    size = lambda k: F.coalesce(F.json_array_length(at(k)), F.size(F.json_object_keys(at(k))).cast("int"))
    return df.select("*", *[F.when(at(k).rlike(r"^\s*[\[{]"), size(k)).alias(f"n_{k}") for k in keys])


def markdown_table(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """(by, markdown): the rows of each group as a Markdown table."""
    cells = F.concat(F.lit("| "), F.array_join(F.array(*[S.md_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), " | "), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}"
    lines = df.select(*by, F.struct(order, cells.alias("line")).alias("r")).groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return lines.select(*by, F.concat(F.lit(head + "\n"), F.array_join(F.transform("r", lambda r: r["line"]), "\n")).alias("markdown"))


def json_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))


def extract_response(df: DataFrame, mode: str, selector: str = "a", budget: int = 0) -> DataFrame:
    """``extracted`` from (url, content_type, body) by mode: raw, json, links, tables, selector, markdown or auto."""
    from lakewright.functions import html

    page = html.distil("url", "body")
    is_json = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("json"))
    modes = {
        "raw": lambda: F.col("body"),
        "json": lambda: F.when(F.try_parse_json("body").isNotNull(), F.col("body")),
        "links": lambda: F.to_json(page["links"]),
        "tables": lambda: F.to_json(page["tables"]),
        "selector": lambda: F.to_json(html.selected_texts(selector)("body")),
        "markdown": lambda: html.markdown_page(page["sections"], page["links"]),
        "auto": lambda: F.when(is_json, F.col("body")).otherwise(html.markdown_page(page["sections"], page["links"])),
    }
    if mode not in modes:
        raise ValueError(f"no mode {mode}")
    return df.withColumn("extracted", S.truncate_budget(modes[mode](), budget))


def find_by_title_or_alias(df: DataFrame, title: str, aliases: str, pattern: str) -> DataFrame:
    """Rows whose title, or any alias, matches a name pattern in any case."""
    hit = S.glob_match(F.col(title), pattern, ignore_case=True) | F.exists(aliases, lambda a: S.glob_match(a, pattern, ignore_case=True))
    return df.where(F.coalesce(hit, F.lit(False)))


def ordered_by_custom(df: DataFrame, tag: str, order: list[str], inner: Column | str) -> DataFrame:
    """Rows by the place of their tag in a list, unknown tags and null last, then by ``inner``."""
    at = F.nullif(F.array_position(F.array(*[F.lit(t) for t in order]), F.col(tag)), F.lit(0))
    return df.orderBy(F.coalesce(at, F.lit(len(order) + 1)), inner)
