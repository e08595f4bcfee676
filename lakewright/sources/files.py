"""File inventories, JSON folders, traffic logs and API descriptions as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.sources import ranges

# Folders that an inventory passes over, in any case.
SKIP_DIRS = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "target", "dist", "build", ".cache", "$recycle.bin", "system volume information")


def inventory(spark: SparkSession, root: str, max_depth: int | None = None, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """(path, rel, name, ext, depth, size, modified) of the files below a folder, without reading their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    bare = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() and c not in "/_" and ord(c) < 128 else c for c in bare) + "/", "")
    parts = F.split(rel, "/")
    out = files.select("path", rel.alias("rel"), F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.slice(parts, 1, F.size(parts) - 1).alias("__dirs"))
    out = out.where(~F.exists("__dirs", lambda d: F.lower(d).isin(*skip))).drop("__dirs")
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    return out.withColumn("ext", S.ext_of(F.col("name")))


def top_level(rel: Column) -> Column:
    """First folder of a relative path, ``(root)`` for a file at the top."""
    return F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise("(root)")


def text_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, line) of the files below a folder that are UTF-8; others are passed over."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    body = F.try_validate_utf8(F.col("content").cast("string"))
    good = raw.select("path", F.regexp_replace(body, "\n$", "").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("content") > 0))
    return good.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def capped(spark: SparkSession, root: str, cap: int) -> DataFrame:
    """(path, size, bytes, truncated): at most ``cap`` bytes of each file, and no others are read; 0 is no limit, the least is 1024."""
    return ranges.capped(spark, root, cap)


def json_folder(spark: SparkSession, root: str, schema: str, newest: str) -> DataFrame:
    """One row for each readable ``*.json`` of a folder, newest first; bad files are passed over."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(root).orderBy(F.desc(newest), F.input_file_name())


HAR = "log struct<entries: array<struct<startedDateTime: string, request: struct<method: string, url: string, queryString: array<struct<name: string, value: string>>>, response: struct<status: int, content: struct<mimeType: string, size: long>>>>>"


def har_requests(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """(method, host, path, template, query, status, mime) of the requests of traffic logs, without static files."""
    entries = spark.read.schema(HAR).option("multiLine", "true").json(path).select(F.explode("log.entries").alias("e"))
    url = F.col("e.request.url")
    out = entries.select(
        F.upper("e.request.method").alias("method"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"),
        F.transform("e.request.queryString", lambda q: q["name"]).alias("query"), F.col("e.response.status").alias("status"), F.col("e.response.content.mimeType").alias("mime"),
    ).where(F.col("host").isNotNull() & ~S.is_static_asset(F.col("path")))
    out = out.withColumn("template", S.templatize_path(F.col("path")))
    return out.where(F.col("host") == host) if host else out


def openapi_operations(spark: SparkSession, path: str) -> DataFrame:
    """(path, method, operation_id, summary, parameters) of API descriptions, one row for each path and method."""
    docs = spark.read.option("wholetext", "true").text(path).select(F.parse_json("value").alias("v"))
    return spark.sql(
        """SELECT p.key AS path, upper(m.key) AS method, variant_get(m.value, '$.operationId', 'string') AS operation_id,
             variant_get(m.value, '$.summary', 'string') AS summary,
             coalesce(transform(try_variant_get(m.value, '$.parameters', 'array<variant>'), x -> try_variant_get(x, '$.name', 'string')), array()) AS parameters
           FROM {docs}, LATERAL variant_explode(variant_get(v, '$.paths', 'variant')) AS p, LATERAL variant_explode(p.value) AS m
           WHERE m.key IN ('get', 'post', 'put', 'patch', 'delete', 'head', 'options')""",
        docs=docs,
    )


def content_store(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put packages (name, version, bytes, at): blobs by SHA-256, each once, and for each name the last written blob.

    Ties in ``at`` go by the greater version, then blob. ``feeds.put_stream`` is its streaming form."""
    both = old.unionByName(new).withColumn("blob", F.sha2("bytes", 256))
    blobs = both.groupBy("blob").agg(F.first("bytes").alias("bytes"))
    names = both.groupBy("name").agg(F.max(F.struct("at", "version", "blob")).alias("x")).select("name", "x.version", "x.blob")
    return blobs, names
