"""JSON documents as rows of paths and values, and pointers that are data themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.session import checkpointed


def pointer_path(pointer: Column) -> Column:
    """The steps of a JSON pointer: empty ones dropped, ``~1`` a slash, then ``~0`` a tilde. Null, or without steps: the document."""
    steps = F.filter(F.split(F.coalesce(pointer, F.lit("")), "/"), lambda s: s != "")
    return F.transform(steps, lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def shred(df: DataFrame, ids: list[str], json: str) -> DataFrame:
    """(ids, path, value, kind): one row for every value in a document, the document itself at the empty path.

    ``path`` is the steps to it, elements of arrays by their number from 0; ``value`` its JSON text, strings without quotes; ``kind``
    its type. A null member is a row with a null value; what isn't JSON gives no rows. A step for each level of the deepest document,
    each written to the checkpoint folder."""
    level = checkpointed(df.select(*ids, F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null"))
    out = None
    columns = ", ".join(f"`{c}`" for c in ids)
    while True:
        kind = F.schema_of_variant("v")
        scalar = F.try_variant_get("v", "$", "string")
        rows = level.select(*ids, "path", F.when(kind == "STRING", scalar).when(kind != "VOID", F.to_json("v")).alias("value"), F.regexp_extract(kind, "^[A-Z]+", 0).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
        inner = level.where(kind.rlike("^(OBJECT|ARRAY)<"))
        if not inner.limit(1).count():
            return out
        # Members of objects by key, of arrays by number.
        sql = f"SELECT {columns}, concat(path, array(coalesce(e.key, cast(e.pos AS string)))) AS path, e.value AS v FROM {{inner}}, LATERAL variant_explode(v) AS e"
        level = checkpointed(df.sparkSession.sql(sql, inner=inner))


def pick(shredded: DataFrame, ids: list[str], pointers: DataFrame, pointer: str) -> DataFrame:
    """The rows of ``pointers`` (ids, pointer ...) with ``value``, what stands there in the document of the same ids; null if nothing does.

    An equi-join on ids and path, so that every row can have a pointer of its own."""
    wanted = pointers.withColumn("__path", pointer_path(F.col(pointer)))
    held = shredded.select(*[F.col(c).alias(f"__{c}") for c in ids], F.col("path").alias("__at"), F.col("value").alias("__value"))
    on = F.col("__path") == F.col("__at")
    for c in ids:
        on = on & (wanted[c] == held[f"__{c}"])
    return wanted.join(held, on, "left").select(*[wanted[c] for c in pointers.columns], F.col("__value").alias("value"))
