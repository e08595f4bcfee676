"""Containers and office documents as rows: magic numbers by SQL, members and parts by small Python functions.

Each Python function takes the bytes of one file and gives an array of structs, which Spark explodes;
all counting, joining and checking after that is DataFrame work. Broken files give no rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.functions import scalars as S

# Formats by their first bytes, in hex, in the order in which they are tried.
MAGIC = [
    ("elf", "7F454C46"), ("dex", "6465780A"), ("png", "89504E470D0A1A0A"), ("gif", "474946383761"), ("gif", "474946383961"), ("jpeg", "FFD8FF"), ("pdf", "255044462D"), ("wasm", "0061736D"),
    ("sqlite", "53514C69746520666F726D6174203300"), ("cab", "4D534346"), ("7z", "377ABCAF271C"), ("rar", "526172211A07"), ("xar", "78617221"), ("matroska", "1A45DFA3"), ("gzip", "1F8B"), ("bzip2", "425A68"),
    ("xz", "FD377A585A00"), ("zstd", "28B52FFD"), ("lz4", "04224D18"), ("woff", "774F4646"), ("woff2", "774F4632"), ("rpm", "EDABEEDB"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("ar", "213C617263683E0A"),
    ("ole", "D0CF11E0A1B11AE1"), ("rtf", "7B5C727466"), ("zip", "504B0304"), ("zip", "504B0506"), ("macho", "CFFAEDFE"), ("macho", "CEFAEDFE"), ("macho", "FEEDFACE"), ("macho", "FEEDFACF"), ("java_class", "CAFEBABE"), ("mz", "4D5A"), ("bmp", "424D"),
]


def identify(content: Column) -> Column:
    """Format by magic number; also tar, RIFF and ISO media, whose mark stands further in; null if unknown."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar").when(F.hex(F.substring(content, 5, 4)) == "66747970", "isobmff")
    out = out.when(head.startswith("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp").when(head.startswith("52494646"), "riff")
    for name, magic in MAGIC:
        out = out.when(head.startswith(magic), name)
    return out


def image_size(content: Column) -> Column:
    """Struct (width, height) of PNG, GIF and BMP, from header bytes alone; null for others."""
    byte = lambda i: F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("long")
    big = lambda i: ((byte(i) * 256 + byte(i + 1)) * 256 + byte(i + 2)) * 256 + byte(i + 3)
    small = lambda i, n: sum((byte(i + k) * F.lit(256**k) for k in range(1, n)), byte(i))
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    kind = identify(content)
    return F.when(kind == "png", pair(big(17), big(21))).when(kind == "gif", pair(small(7, 2), small(9, 2))).when(kind == "bmp", pair(small(19, 4), small(23, 4)))


def _rows(schema: str):
    """A pandas UDF giving an array of structs from a generator over the bytes of one file."""

    def wrap(generate):
        kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}
        fields = [T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]

        @F.pandas_udf(T.ArrayType(T.StructType(fields)))
        def run(content: pd.Series) -> pd.Series:
            names = [c.split()[0] for c in schema.split(", ")]

            def one(b):
                try:
                    return [dict(zip(names, row, strict=True)) for row in generate(bytes(b))] if b else []
                except (zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError, KeyError, ValueError, EOFError, zlib.error, NotImplementedError, RuntimeError):
                    return []

            return content.map(one)

        return run

    return wrap


def _members(b: bytes):
    if b[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(b)) as t:
            for k, m in enumerate(t):
                yield k, m.name, m.size, None, m.isdir(), None
    else:
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            for k, m in enumerate(z.infolist()):
                yield k, m.filename, m.file_size, m.compress_size, m.is_dir(), m.is_dir() or zlib.crc32(z.read(m)) == m.CRC


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(node, name: str):
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _words(node, ends=("p", "h")):
    """Text of each paragraph below a node, in order."""
    for p in node.iter():
        if _local(p.tag) in ends:
            text = "".join((x.text or "") if _local(x.tag) in ("t", "span", "a", *ends) else "\t" if _local(x.tag) == "tab" else "" for x in p.iter())
            yield text


def _paragraphs(b: bytes):
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = z.namelist()
        parts = [n for n in ("word/document.xml", "content.xml") if n in names]
        parts += sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        k = 0
        for part in parts:
            for text in _words(ElementTree.fromstring(z.read(part))):
                yield k, part, text
                k += 1


def _ref(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def _cells(b: bytes):
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = z.namelist()
        if "content.xml" in names:
            for table in ElementTree.fromstring(z.read("content.xml")).iter():
                if _local(table.tag) != "table":
                    continue
                row = -1
                for r in (x for x in table.iter() if _local(x.tag) == "table-row"):
                    row += 1
                    col = 0
                    for c in (x for x in r if _local(x.tag) in ("table-cell", "covered-table-cell")):
                        text = "\n".join(_words(c))
                        if text or _attr(c, "value") is not None:
                            yield _attr(table, "name"), row, col, _attr(c, "value-type") or "string", text, _attr(c, "value"), _attr(c, "formula")
                        col += int(_attr(c, "number-columns-repeated") or 1)
            return
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rels = {_attr(r, "Id"): _attr(r, "Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _local(sheet.tag) != "sheet":
                continue
            target = posixpath.normpath(posixpath.join("xl", rels[_attr(sheet, "id")])).lstrip("/")
            for c in ElementTree.fromstring(z.read(target)).iter():
                if _local(c.tag) != "c":
                    continue
                inner = {_local(x.tag): x for x in c}
                kind, raw = c.get("t") or "n", inner["v"].text if "v" in inner else None
                if kind == "s":
                    at = int(raw)
                    text = shared[at] if 0 <= at < len(shared) else f"#shared {at} is out of range"
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                else:
                    text = raw
                yield sheet.get("name"), *_ref(c.get("r")), kind, text, raw if kind == "n" else None, inner["f"].text if "f" in inner else None


def _relationships(b: bytes):
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for n in z.namelist():
            if n.endswith(".rels"):
                folder = posixpath.dirname(posixpath.dirname(n))
                source = posixpath.join(folder, posixpath.basename(n)[:-5]) if posixpath.basename(n) != ".rels" else ""
                for r in ElementTree.fromstring(z.read(n)):
                    external = r.get("TargetMode") == "External"
                    target = r.get("Target") or ""
                    path = target if external else posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/")
                    yield source, r.get("Id"), (r.get("Type") or "").rpartition("/")[2], path, external


def _types(b: bytes):
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for x in ElementTree.fromstring(z.read("[Content_Types].xml")):
            yield _local(x.tag), (x.get("Extension") or x.get("PartName") or "").lstrip("/"), x.get("ContentType")


def _properties(b: bytes):
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for part in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "meta.xml"):
            if part in z.namelist():
                for x in ElementTree.fromstring(z.read(part)).iter():
                    if x.text and x.text.strip() and not len(x):
                        yield part, _attr(x, "name") or _local(x.tag), x.text.strip()


members_udf = _rows("seq long, member string, size long, packed long, is_dir boolean, crc_ok boolean")(_members)
paragraphs_udf = _rows("seq long, part string, text string")(_paragraphs)
cells_udf = _rows("sheet string, row long, col long, kind string, text string, number string, formula string")(_cells)
relationships_udf = _rows("source string, id string, kind string, target string, external boolean")(_relationships)
types_udf = _rows("kind string, name string, content_type string")(_types)
properties_udf = _rows("part string, name string, value string")(_properties)


def explode_rows(files: DataFrame, udf, key: str = "path", content: str = "content") -> DataFrame:
    """One row for each struct that a function of this module gives for a file."""
    return files.select(key, F.explode(udf(content)).alias("r")).select(key, "r.*")


def package_report(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, parts, missing_targets, untyped_parts, unpointed_parts): the integrity of office packages, by joins of their tables."""
    members = explode_rows(files, members_udf, key).where("not is_dir").select(key, F.col("member").alias("target"))
    rels, types = explode_rows(files, relationships_udf, key), explode_rows(files, types_udf, key)
    inner = rels.where("not external").select(key, "target").distinct()
    missing = inner.join(members, [key, "target"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("missing_targets"))
    parts = members.where("target <> '[Content_Types].xml'").withColumn("ext", F.lower(F.regexp_extract("target", r"\.([^./]+)$", 1)))
    override = types.where("kind = 'Override'").select(key, F.col("name").alias("target"))
    default = types.where("kind = 'Default'").select(key, F.lower("name").alias("ext"))
    untyped = parts.join(override, [key, "target"], "left_anti").join(default, [key, "ext"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("untyped_parts"))
    unpointed = parts.where("ext <> 'rels'").join(inner, [key, "target"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("unpointed_parts"))
    out = members.groupBy(key).agg(F.count(F.lit(1)).alias("parts"))
    for found in (missing, untyped, unpointed):
        out = out.join(found, key, "left")
    return out.na.fill(0)


def sheet_totals(cells: DataFrame, key: str = "path") -> DataFrame:
    """(key, sheet, cells, texts, numbers, formulas, rows, cols) of exploded cells."""
    return cells.groupBy(key, "sheet").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("number").isNull()).alias("texts"), F.count("number").alias("numbers"), F.count("formula").alias("formulas"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")
    )


def sheet_csv(cells: DataFrame, key: str = "path") -> DataFrame:
    """(key, sheet, csv): RFC 4180 text of each sheet, squared to its used range; grouped a row at a time first."""
    used = cells.groupBy(key, "sheet").agg(F.max("col").alias("last"))
    field = F.map_from_entries(F.collect_list(F.struct("col", S.csv_field(F.coalesce("text", F.lit(""))).alias("f"))))
    rows = cells.groupBy(key, "sheet", "row").agg(field.alias("fields")).join(used, [key, "sheet"])
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda c: F.coalesce(F.try_element_at("fields", c), F.lit(""))), ",")
    lines = rows.select(key, "sheet", "row", line.alias("line"), "last")
    by_row = lines.groupBy(key, "sheet").agg(F.max("row").alias("end"), F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("m"), F.max("last").alias("last"))
    blank = F.repeat(F.lit(","), F.col("last").cast("int"))
    body = F.transform(F.sequence(F.lit(0).cast("long"), F.col("end")), lambda r: F.coalesce(F.try_element_at("m", r), blank))
    return by_row.select(key, "sheet", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("csv"))
