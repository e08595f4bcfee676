"""Scalar functions as Spark columns; those that need Python say so. Null in, null out, unless stated."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024 up to TB, one decimal, ties to even; whole bytes below 1024."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = F.bround(n.cast("double") / 1024.0**k, 1)
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", value), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNotNull(), out)


def ext_of(path: Column) -> Column:
    """Lower-case extension of the file name; ``(none)`` without one; a leading dot makes none."""
    ext = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]+)$", 1))
    return F.when(ext == "", "(none)").otherwise(ext)


def glob_match(name: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``*`` any run, ``?`` one character, all else literal, over the whole name."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern))
    return name.rlike(f"{'(?iu)' if ignore_case else ''}(?s)^{body}$")


def affix_name(name: Column, prefix: str = "", suffix: str = "", find: str = "", replace: str = "", ignore_case: bool = False) -> Column:
    """A renamed file: all ``find`` in the stem replaced, then prefix and suffix set around it, unless they are there."""
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    if find:
        target = re.sub(r"([\\$])", r"\\\1", replace)
        stem = F.regexp_replace(stem, f"{'(?iu)' if ignore_case else ''}{re.escape(find)}", target)
    if prefix:
        stem = F.when(stem.startswith(prefix), stem).otherwise(F.concat(F.lit(prefix), stem))
    if suffix:
        stem = F.when(stem.endswith(suffix), stem).otherwise(F.concat(stem, F.lit(suffix)))
    return F.concat(stem, ext)


def csv_field(value: Column) -> Column:
    """Quoted, with doubled quotes, only if it holds a quote, a comma or a line end."""
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def md_cell(value: Column) -> Column:
    """A Markdown table cell: pipes escaped, line ends as <br>."""
    return F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", "<br>")


def collapse_ws(value: Column) -> Column:
    """Runs of Unicode white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def truncate_budget(value: Column, budget: int, mark: str = "…") -> Column:
    """At most ``budget`` characters and the mark; 0 is no limit."""
    if not budget:
        return value
    return F.when(F.length(value) > budget, F.concat(F.substring(value, 1, budget), F.lit(mark))).otherwise(value)


def line_count(value: Column) -> Column:
    """Lines of a text; a last line end adds none, an empty text has none."""
    ends = F.regexp_count(value, F.lit("\n"))
    return F.when(value == "", 0).otherwise(ends + F.when(value.endswith("\n"), 0).otherwise(1)).cast("long")


def secret_mask(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 6), F.lit("****"))


def first_non_empty(*values: Column) -> Column:
    """The first value, trimmed, that is not blank."""
    return F.coalesce(*[F.nullif(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), F.lit("")) for v in values])


def sanitize_ident(value: Column, fallback: str) -> Column:
    """ASCII letters and digits in lower case, other runs as one dash, none at the ends; the fallback if nothing is left or before a digit."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]+", "-"), "^-|-$", ""))
    return F.when(slug == "", fallback).when(slug.rlike("^[0-9]"), F.concat(F.lit(f"{fallback}-"), slug)).otherwise(slug)


def templatize_path(path: Column) -> Column:
    """Digit-only segments and hex or dashed ones of 32 or more become {id}, {id2}, ...; empty ones go."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    is_id = lambda s: s.rlike("^[0-9]+$") | (s.rlike("^[0-9a-fA-F-]+$") & (F.length(s) >= 32))
    before = lambda i: F.size(F.filter(F.slice(segments, 1, i + 1), is_id))
    name = lambda i: F.concat(F.lit("{id"), F.when(before(i) > 1, before(i).cast("string")).otherwise(""), F.lit("}"))
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s, i: F.when(is_id(s), name(i)).otherwise(s)), "/"))


def json_pointer(value: Column, pointer: str) -> Column:
    """RFC 6901 by a fixed pointer, as get_json_object gives it; empty segments are dropped."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/") if p]
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)
    return F.get_json_object(value, path)


def is_static_asset(path: Column) -> Column:
    # Suffixes of static files.
    return path.rlike(r"(?i)\.(js|mjs|css|png|jpg|jpeg|gif|svg|webp|ico|woff|woff2|ttf|eot|map|mp4|webm)$")


# Media types by extension.
MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "json": "application/json",
}


def guess_mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext_of(path)), F.lit("application/octet-stream"))


def cn_phone(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "").rlike("^1[3-9][0-9]{9}$")


# Alphabet, weights and check characters of two national standards.
USCC_CHARS, USCC_WEIGHTS = "0123456789ABCDEFGHJKLMNPQRTUWXY", (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
ID_WEIGHTS, ID_CHECKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"


def _weighted(code: Column, chars: str, weights: tuple[int, ...]) -> Column:
    places = F.transform(F.split(F.substring(code, 1, len(weights)), ""), lambda c: F.call_function("instr", F.lit(chars), c) - 1)
    products = F.zip_with(places, F.array(*[F.lit(w) for w in weights]), lambda p, w: p * w)
    return F.aggregate(products, F.lit(0), lambda s, p: s + p)


def uscc_valid(value: Column) -> Column:
    """An 18-character organisation code with the right check character (weights modulo 31)."""
    code = F.upper(F.trim(value))
    check = F.substring(F.lit(USCC_CHARS), (31 - _weighted(code, USCC_CHARS, USCC_WEIGHTS) % 31) % 31 + 1, F.lit(1))
    return code.rlike(f"^[{USCC_CHARS}]{{17}}.$") & (check == F.substring(code, 18, 1))


def cn_id_valid(value: Column) -> Column:
    """An 18-character identity number with the right check character (weights modulo 11)."""
    code = F.upper(F.trim(value))
    check = F.substring(F.lit(ID_CHECKS), _weighted(code, "0123456789", ID_WEIGHTS) % 11 + 1, F.lit(1))
    return code.rlike("^[0-9]{17}.$") & (check == F.substring(code, 18, 1))


def stable_id(namespace: str, name: Column) -> Column:
    """A UUID-shaped id from the MD5 of ``namespace:name``."""
    h = F.md5(F.concat(F.lit(f"{namespace}:"), name).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def normalize_hash(value: Column) -> Column:
    """A bare lower-case SHA-256 from an optional ``sha256:`` prefix; null if it isn't one."""
    bare = F.lower(F.regexp_replace(value, "^sha256:", ""))
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def address(row: Column, col: Column) -> Column:
    """A1 name of a zero-based cell, columns up to three letters (bijective base 26)."""
    letter = lambda n: F.chr(n % 26 + 65)
    one = letter(col)
    two = F.concat(letter(F.floor(col / 26) - 1), one)
    three = F.concat(letter(F.floor((F.floor(col / 26) - 1) / 26) - 1), letter(F.floor(col / 26) - 1), one)
    return F.concat(F.when(col < 26, one).when(col < 702, two).otherwise(three), (row + 1).cast("string"))


def split_ref(ref: Column) -> Column:
    """Struct (row, col), zero-based, of an A1 reference with or without dollar signs; null if it is none."""
    bare = F.upper(F.replace(ref, F.lit("$"), F.lit("")))
    letters, digits = F.regexp_extract(bare, "^([A-Z]{1,3})([0-9]+)$", 1), F.regexp_extract(bare, "^([A-Z]{1,3})([0-9]+)$", 2)
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64) - 1
    return F.when(letters != "", F.struct((digits.try_cast("int") - 1).alias("row"), col.alias("col")))


# Number formats that a spreadsheet names by number alone.
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)",
    8: "$#,##0.00_);[Red]($#,##0.00)", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm",
    17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.##",
}


def builtin_format(number: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BUILTIN_FORMATS.items() for x in pair])
    return F.try_element_at(table, number.cast("int"))


def format_kind(code: Column) -> Column:
    """What a number format shows: percent, datetime, date, time, currency, general or number."""
    bare = F.lower(F.regexp_replace(code, r"""(?s)"[^"]*("|$)|'[^']*('|$)|\\.?|\[[^\]]*(\]|$)""", ""))
    time = bare.rlike("h|s|am/pm|a/p")
    date = bare.rlike("y|d") | (bare.contains("m") & ~time)
    kind = F.when(bare.contains("%"), "percent").when(date & time, "datetime").when(date, "date").when(time, "time")
    kind = kind.when(bare.rlike("[$¥￥€]"), "currency").when((bare == "") | (bare == "general"), "general").otherwise("number")
    return F.when(code.isNotNull(), kind)


def serial_to_iso(value: Column, year1904: bool = False) -> Column:
    """ISO text of a spreadsheet's day number; day 60 of the 1900 system is the day 1900-02-29 that never was."""
    days = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("int")
    base = F.lit(24107) if year1904 else F.when(days < 60, 25568).otherwise(25569)
    date = F.date_format(F.date_from_unix_date(days - base), "yyyy-MM-dd")
    seconds = F.floor((value - days) * 86400 + 0.5).cast("long") % 86400
    clock = F.format_string("T%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds / 60).cast("int") % 60, (seconds % 60).cast("int"))
    out = F.when(seconds > 0, F.concat(date, clock)).otherwise(date)
    return out if year1904 else F.when(days == 60, "1900-02-29").otherwise(out)


def filetime(ticks: Column) -> Column:
    """Timestamp of 100 ns ticks since 1601."""
    whole = ticks - F.pmod(ticks, F.lit(10))  # a double would lose the last microseconds
    return F.timestamp_micros(F.call_function("div", whole, F.lit(10)) - F.lit(11644473600000000))


def normalize_path(path: Column) -> Column:
    """``.`` and empty segments dropped, ``..`` takes the one before."""
    empty = F.array().cast("array<string>")
    fold = F.aggregate(F.split(path, "/"), empty, lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.array_join(fold, "/")


def coerce_flag(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("true", "1", "yes", "on", "是")


def coerce_number(value: Column) -> Column:
    """A plain decimal number; null for anything else (no type suffix as in ``1d``)."""
    text = F.trim(value)
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def infer_kind(value: Column) -> Column:
    """flag, number or text, by a sample's text."""
    return F.when(value.isin("true", "false"), "flag").when(coerce_number(value).isNotNull(), "number").otherwise("text")


def decode_rk(packed: Column) -> Column:
    """A spreadsheet's packed number: bit 0 divides by 100, bit 1 marks a 30-bit integer.

    The other form holds the upper half of a double, put together here from sign, exponent and mantissa.
    """
    bits = packed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    signed = F.when(bits >= 2**31, bits - 2**32).otherwise(bits)
    whole = F.floor(signed / 4).cast("double")
    clear = bits.bitwiseAND(F.lit(0xFFFFFFFC))
    exponent = F.shiftright(clear, 20).bitwiseAND(F.lit(0x7FF))
    mantissa = clear.bitwiseAND(F.lit(0xFFFFF)).cast("double") / 2.0**20
    size = F.when(exponent == 0, mantissa * 2.0**-1022).otherwise((1 + mantissa) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))
    real = F.when(clear >= 2**31, -size).otherwise(size)
    value = F.when(bits.bitwiseAND(F.lit(2)) != 0, whole).otherwise(real)
    return F.when(bits.bitwiseAND(F.lit(1)) != 0, value / 100).otherwise(value)


def srt_millis(stamp: Column) -> Column:
    """Milliseconds of ``H:MM:SS,mmm``."""
    part = lambda k: F.regexp_extract(stamp, r"^\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*$", k).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def ass_time(millis: Column) -> Column:
    """``H:MM:SS.cc`` of milliseconds."""
    cs = F.floor(millis / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def story_line(line: Column) -> Column:
    """Struct (kind, who, mood, text) of a line of a story script; plain text is narration."""
    trimmed = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    pattern = r"(?s)^([^:：]*)[:：](.*)$"
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    head, text = strip(F.regexp_extract(trimmed, pattern, 1)), strip(F.regexp_extract(trimmed, pattern, 2))
    mooded = r"(?s)^(.*)[（(]([^（(]*)[）)]$"
    who = F.when(head.rlike(mooded), strip(F.regexp_extract(head, mooded, 1))).otherwise(head)
    mood = F.when(head.rlike(mooded), strip(F.regexp_extract(head, mooded, 2))).otherwise("")
    none = F.lit(None).cast("string")
    row = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.alias("who"), b.alias("mood"), c.alias("text"))
    return (
        F.when(trimmed == "", row("blank", none, none, none))
        .when(trimmed.startswith(";"), row("comment", none, none, strip(F.substring(trimmed, F.lit(2), F.length(trimmed)))))
        .when(trimmed.startswith("##"), row("fragment", none, none, strip(F.regexp_replace(trimmed, "^##+", ""))))
        .when(trimmed.startswith("#"), row("chapter", none, none, strip(F.substring(trimmed, F.lit(2), F.length(trimmed)))))
        .when(trimmed.startswith("!"), row("directive", none, none, strip(F.substring(trimmed, F.lit(2), F.length(trimmed)))))
        .when(trimmed.rlike(pattern) & head.isin("旁白", "心理", "n", "narration"), row("narration", none, none, text))
        .when(trimmed.rlike(pattern), row("dialogue", who, mood, text))
        .otherwise(row("narration", none, none, trimmed))
    )


def parse_region(text: Column, width: int, height: int) -> Column:
    """Array [x1, y1, x2, y2] of ``X1,Y1,X2,Y2``, clamped and in order; null if malformed or empty."""
    parts = F.transform(F.split(text, ","), lambda p: F.when(F.trim(p).rlike("^[+-]?[0-9]+$"), F.trim(p).try_cast("long")))
    at = lambda k, hi: F.greatest(F.lit(0).cast("long"), F.least(F.get(parts, F.lit(k)), F.lit(hi).cast("long")))
    x1, y1, x2, y2 = at(0, width), at(1, height), at(2, width), at(3, height)
    ok = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull())
    box = F.array(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))
    return F.when(ok & (x1 != x2) & (y1 != y2), box)


def formula_refs(formula: Column) -> Column:
    """Cell references and ranges of a formula in order, without those in string literals."""
    bare = F.regexp_replace(formula, '"[^"]*("|$)', " ")
    return F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_$:.!])(?:[A-Za-z_][A-Za-z0-9_]*!)?(\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?)(?![A-Za-z0-9_(])"), F.lit(1))


#: Units as a ratio to 0.01 mm.
UNITS = {"twip": (127, 72), "emu": (127, 45720), "cm": (1000, 1), "mm": (100, 1), "in": (2540, 1), "pt": (635, 18)}


def to_hundredth_mm(value: Column, unit: str) -> Column:
    """0.01 mm, half up, of a decimal text of at most 9 whole and 6 fractional digits; null otherwise. Integers all through."""
    num, den = UNITS[unit]
    whole, rest = F.regexp_extract(value, r"^(\d{1,9})(?:\.(\d{1,6}))?$", 1), F.regexp_extract(value, r"^(\d{1,9})(?:\.(\d{1,6}))?$", 2)
    a = F.concat(whole, F.rpad(rest, 6, "0")).try_cast("long") * F.lit(2 * num).cast("long")
    b = den * 1_000_000
    return F.when(whole != "", F.call_function("div", a + F.lit(b).cast("long"), F.lit(2 * b).cast("long")))


def outline_level(own: Column, by_name: Column, by_style: Column) -> Column:
    """Struct (level, source): own value, else the style name's, else the style's; 9 is body text, without a level."""
    raw = F.coalesce(own, by_name, by_style)
    source = F.when(own.isNotNull(), "own").when(by_name.isNotNull(), "style_name").when(by_style.isNotNull(), "style")
    return F.struct(F.when(raw != 9, raw).alias("level"), source.alias("source"))


def fit_size(width: Column, height: Column, most: int) -> Column:
    """Struct (width, height) that fits into a square: never larger, whole numbers, at least 1."""
    side = F.greatest(width, height)
    scaled = lambda v: F.greatest(F.floor(v * most / side), F.lit(1)).cast("long")
    return F.when(side <= most, F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))).otherwise(F.struct(scaled(width).alias("width"), scaled(height).alias("height")))


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 join; the reference itself where that fails (Python: no built-in joins URLs)."""

    def one(b, r):
        try:
            return urljoin(b, r)
        except ValueError:
            return r

    return pd.Series([None if b is None or r is None else one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys; null if it isn't JSON (Python: to_json keeps the order of keys)."""

    def one(v):
        try:
            return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return value.map(lambda v: None if v is None else one(v))


def content_id(value: Column) -> Column:
    """SHA-256, in hex, of a JSON text's canonical form: the same for any order of keys and any white space; null if it isn't JSON."""
    return F.sha2(canonical_json(value).cast("binary"), 256)


def _fnv1a(values: pd.Series, offset: int, prime: int, bits: int) -> pd.Series:
    """FNV-1a of a batch, one byte of all values at a time, the longest values first so that the others drop out."""
    raw = [v if isinstance(v, bytes) else b"" if v is None else v.encode() for v in values]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    sizes = np.array([len(raw[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
    first = np.cumsum(sizes) - sizes
    kind = np.uint64 if bits == 64 else np.uint32
    h = np.full(len(raw), offset, kind)
    for place in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -place, side="left"))  # values longer than the place
        h[:n] = (h[:n] ^ data[first[:n] + place].astype(kind)) * kind(prime)
    out: list[str | None] = [None] * len(raw)
    for i, x in zip(order, h.tolist(), strict=True):
        out[i] = f"{x:0{bits // 4}x}"
    return pd.Series([None if v is None else x for v, x in zip(values, out, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def fnv1a64(value: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, in hex (numpy: Spark's integer product raises on overflow)."""
    return _fnv1a(value, 0xCBF29CE484222325, 0x100000001B3, 64)


@F.pandas_udf(T.StringType())
def fnv1a32(value: pd.Series) -> pd.Series:
    """FNV-1a, 32 bits, in hex."""
    return _fnv1a(value, 0x811C9DC5, 0x1000193, 32)


@F.pandas_udf(T.StringType())
def summarize_json(value: pd.Series) -> pd.Series:
    """The first five keys of an object as ``key: value``, and how many more there are."""

    def one(v):
        try:
            found = json.loads(v)
        except ValueError:
            return None
        if not isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False)
        shown = ", ".join(f"{k}: {x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)}" for k, x in list(found.items())[:5])
        return shown + (f" (+{len(found) - 5} more)" if len(found) > 5 else "")

    return value.map(lambda v: None if v is None else one(v))
