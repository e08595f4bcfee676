"""Search and selection over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _contains(value: Column, needle: str, ignore_case: bool) -> Column:
    if not needle:
        raise ValueError("the pattern is empty")
    return F.contains(F.lower(value), F.lit(needle.lower())) if ignore_case else F.contains(value, F.lit(needle))


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, line) of every line; a last line end makes no line."""
    body = F.when(F.col(text).endswith("\n"), F.expr(f"substring({text}, 1, length({text}) - 1)")).otherwise(F.col(text))
    each = df.where(F.length(text) > 0).select(key, F.posexplode(F.split(body, "\n")).alias("at", "line"))
    return each.select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def grep(df: DataFrame, key: str, needle: str, ignore_case: bool = False) -> DataFrame:
    """The lines that hold a literal; the texts without it are left out before they are split."""
    hit = df.where(_contains(F.col("text"), needle, ignore_case))
    return lines(hit, key).where(_contains(F.col("line"), needle, ignore_case))


def grep_totals(df: DataFrame, key: str, needle: str, ignore_case: bool = False) -> DataFrame:
    """(files scanned, match_count) without the rows."""
    per = F.size(F.filter(F.split("text", "\n"), lambda line: _contains(line, needle, ignore_case)))
    return df.agg(F.count(F.col(key)).alias("files"), F.coalesce(F.sum(per), F.lit(0)).cast("long").alias("match_count"))


def grep_first(df: DataFrame, key: str, needle: str, limit: int = 40) -> DataFrame:
    """The first hits by key and line, trimmed."""
    found = grep(df, key, needle).orderBy(key, "line_no").limit(limit)
    return found.select(key, "line_no", F.trim("line").alias("line"))


def suffix_first(df: DataFrame, name: str, suffix: str, limit: int = 40) -> DataFrame:
    return df.where(F.col(name).endswith(suffix)).orderBy(name).limit(limit)


def find(df: DataFrame, name: Column, size: Column, glob: Column | None = None, exts: list[str] | None = None, ext: Column | None = None, low: int | None = None, high: int | None = None, limit: int = 0, order: list[str] | None = None) -> DataFrame:
    """Name pattern, extension list and size range (ends included); 0 is no limit. Sorted before the limit, so repeatable."""
    if low is not None and high is not None and low > high:
        raise ValueError("the smallest size is above the largest")
    out = df if glob is None else df.where(glob)
    if exts is not None and ext is not None:
        out = out.where(ext.isin([e.lower().lstrip(".") for e in exts]))
    if low is not None:
        out = out.where(size >= low)
    if high is not None:
        out = out.where(size <= high)
    out = out.orderBy(*(order or [name]))
    return out.limit(limit) if limit else out


def ascii_contains(value: Column, needle: str) -> Column:
    """Contains with A-Z folded and nothing else."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(value, upper, lower), F.lit(needle.translate(str.maketrans(upper, lower))))


def line_window(df: DataFrame, key: str, offset: int, limit: int, default: int = 200) -> DataFrame:
    """A window of each text's lines from ``offset`` (from 0); a limit of 0 is the default."""
    first, count = max(offset, 0), limit or default
    return lines(df, key).where((F.col("line_no") > first) & (F.col("line_no") <= first + count))


def nth(array: Column, n: int) -> Column:
    """The n-th element from 1; raises beyond the ends."""
    return F.when((F.lit(n) >= 1) & (F.size(array) >= n), F.try_element_at(array, F.lit(n))).otherwise(F.raise_error(F.lit(f"section {n} is out of range")).cast("string"))


def replace_once(value: Column, needle: str, replacement: str) -> Column:
    """Struct (matches, text): the text with the needle replaced if it occurs exactly once, else null."""
    matches = ((F.length(value) - F.length(F.replace(value, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
    return F.struct(matches.alias("matches"), F.when(matches == 1, F.replace(value, F.lit(needle), F.lit(replacement))).alias("text"))


def catalog_search(df: DataFrame, query: str, fields: list[str], synonyms: dict[str, str] | None = None) -> DataFrame:
    """Rows of which some field, or some element of an array field, contains the query in any case."""
    q = query.strip().lower()
    q = (synonyms or {}).get(q, q)
    kinds = dict(df.dtypes)
    hit = F.lit(False)
    for f in fields:
        hit = hit | (F.exists(F.col(f), lambda x: F.contains(F.lower(x), F.lit(q))) if kinds[f].startswith("array") else F.contains(F.lower(F.col(f)), F.lit(q)))
    return df.where(F.coalesce(hit, F.lit(False)))


def violations(df: DataFrame, rules: dict[str, Column], first_only: bool = True) -> DataFrame:
    """Each row with its broken rules by name, in the order given; with ``first_only`` the first one."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("violation", F.get(broken, F.lit(0))) if first_only else df.withColumn("violations", broken)
