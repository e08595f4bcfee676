"""Registered queries of scalar functions over columns of the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewright.functions import scalars as S
from lakewright.operators import windows
from lakewright.registry import query, table


def _spliced(name: str, key: str, parts: list[str], wanted: list[str], f, result: str = "VARCHAR", source: str = "part", columns: str = "p_partkey") -> None:
    """A query (columns, x, y): x one of several SQL expressions over a table's columns, by turns, y the function of it; the
    SQL has an expression of its own for each."""
    pick = lambda options, kind: f"CASE {' '.join(f'WHEN {key} = {i} THEN {o}' for i, o in enumerate(options))} END" if kind is None else f"CAST(CASE {' '.join(f'WHEN {key} = {i} THEN {o}' for i, o in enumerate(options))} END AS {kind})"

    @query(name, f"SELECT {columns}, {pick(parts, None)} AS x, {pick(wanted, result)} AS y FROM {source}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(*columns.split(", "), F.expr(pick(parts, None)).alias("x")).withColumn("y", f(F.col("x")))


K = "CAST(p_partkey AS STRING)"
_spliced("static_assets", "p_partkey % 7", [f"concat('/', p_name, {x})" for x in ("'.JS'", "'.css'", "'.html'", "''", "'.js/'", "'.woff2'")] + ["CAST(NULL AS STRING)"], ["true", "true", "false", "false", "false", "true", "NULL"], S.is_static_asset, "BOOLEAN")
_spliced("media_types", "p_partkey % 6", [f"concat('a/', p_name, {x})" for x in ("'.PDF'", "'.jpeg'", "''", "'.tar.txt'", "'.json'")] + ["concat('.', p_type)"], ["'application/pdf'", "'image/jpeg'", "'application/octet-stream'", "'text/plain'", "'application/json'", "'application/octet-stream'"], S.guess_mime)
ZEROS = "repeat('0', CAST(p_size % 4 + 1 AS INT))"
_spliced("format_kinds", "p_partkey % 11", [f"concat({ZEROS}, '.00%')", f"concat('yyyy-mm-', {ZEROS})", "concat('h:mm', repeat(':ss', CAST(p_size % 2 AS INT)))", "concat('m/d/yy', ' ', 'h:mm')", f"concat('\"', p_name, ' day\"', {ZEROS})", f"concat('[Red]$', {ZEROS})", "''", "'General'", "'mm:ss'", f"concat('#,##', {ZEROS})", "CAST(NULL AS STRING)"],
         ["'percent'", "'date'", "'time'", "'datetime'", "'number'", "'currency'", "'general'", "'general'", "'time'", "'number'", "NULL"], S.format_kind)


@query("builtin_formats", f"SELECT p_partkey, list_extract(map_extract(map({list(S.BUILTIN_FORMATS)}, {list(S.BUILTIN_FORMATS.values())}), p_size % 50), 1) AS y FROM part")
def builtin_formats(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.builtin_format(F.col("p_size") % 50).alias("y"))


_spliced("normalized_paths", "p_partkey % 6", ["concat(p_type, '/./', p_name, '/../x')", "concat('../', p_name)", "concat('/', p_type, '//', p_name, '/')", "''", "concat(p_type, '/', p_name, '/../../..')", "concat('./', p_name, '/', p_size, '/..')"],
         ["p_type || '/x'", "p_name", "p_type || '/' || p_name", "''", "''", "p_name"], S.normalize_path)
_spliced("flags", "p_partkey % 8", ["'TRUE'", "' yes '", "CAST(p_size % 2 AS STRING)", "'on'", "'是'", "'no'", "p_name", "CAST(NULL AS STRING)"], ["true", "true", "p_size % 2 = 1", "true", "true", "false", "false", "NULL"], S.coerce_flag, "BOOLEAN")
_spliced("numbers", "p_partkey % 7", [f"concat({K}, 'd')", f"concat(' ', {K}, '.5 ')", f"concat({K}, 'e3')", "concat('-.', CAST(p_size % 10 AS STRING))", "p_name", "''", f"concat('+', {K})"], ["NULL", "p_partkey + 0.5", "p_partkey * 1000.0", "(p_size % 10) / -10.0", "NULL", "NULL", "p_partkey"], S.coerce_number, "DOUBLE")
_spliced("inferred_kinds", "p_partkey % 6", ["CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END", K, f"concat({K}, '.5e2')", f"concat({K}, 'f')", "p_name", "''"], ["'flag'", "'number'", "'number'", "'text'", "'text'", "'text'"], S.infer_kind)

BYTES = "list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))"


def _fnv(offset: int, prime: int, bits: int) -> str:
    return f"lower(lpad(to_hex(CAST(list_reduce(list_prepend(CAST({offset} AS HUGEINT), {BYTES}), lambda h, b: (xor(h, b) * {prime}) % {1 << bits}) AS UBIGINT)), {bits // 4}, '0'))"


@query("fnv_hashes", f"SELECT c_custkey, {_fnv(0xCBF29CE484222325, 0x100000001B3, 64)} AS wide, {_fnv(0x811C9DC5, 0x1000193, 32)} AS narrow FROM customer")
def fnv_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.fnv1a64(F.col("c_name")).alias("wide"), S.fnv1a32(F.col("c_name")).alias("narrow"))


CRC_STEP = "list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda i: CAST(0 AS HUGEINT))), lambda r, z: xor(r // 2, CAST(3988292384 AS HUGEINT) * (r % 2)))"


@query("crc_checksums", f"SELECT c_custkey, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS HUGEINT), {BYTES}), lambda h, b: {CRC_STEP}), CAST(4294967295 AS HUGEINT)) AS BIGINT) AS crc FROM customer")
def crc_checksums(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("crc"))


BARE, HOST = "regexp_replace(url, '[?#].*$', '')", "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"
REFS = ["concat('g', page_id)", "concat('../up/', page_id)", "concat('/top?q=', page_id)", "concat('//other.example/', page_id)", "concat('#s', page_id)", "concat('https://z.example/', page_id)", "concat('?n=', page_id)", "''"]
JOINED = [f"regexp_replace({BARE}, '/[^/]*$', '/') || 'g' || page_id", f"regexp_replace(regexp_replace({BARE}, '/[^/]*$', ''), '/[^/]*$', '/') || 'up/' || page_id", f"{HOST} || '/top?q=' || page_id", "regexp_extract(url, '^[a-z]+:', 0) || '//other.example/' || page_id", "regexp_replace(url, '#.*$', '') || '#s' || page_id", "'https://z.example/' || page_id", f"{BARE} || '?n=' || page_id", "url"]
CASE = lambda options: f"CASE {' '.join(f'WHEN page_id % 8 = {i} THEN {o}' for i, o in enumerate(options))} END"


@query("resolved_urls", f"SELECT page_id, {CASE(JOINED)} AS y FROM pages")
def resolved_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.resolve_url(F.col("url"), F.expr(CASE(REFS))).alias("y"))


@query("json_summaries", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a: ' || event_id || ', b: ' || event_type || ', c: ' || user_id || ', d: [1, ' || user_id || '], e: null (+1 more)' WHEN 1 THEN 'k: ' || json_extract_string(props, '$.k') WHEN 2 THEN '[' || event_id || ', 2]' END AS y FROM events")
def json_summaries(spark, sf_dir):
    six = """concat('{"a":', event_id, ',"b":"', event_type, '","c":', user_id, ',"d":[1,', user_id, '],"e":null,"f":6}')"""
    text = F.expr(f"CASE event_id % 4 WHEN 0 THEN {six} WHEN 1 THEN props WHEN 2 THEN concat('[', event_id, ',2]') ELSE event_type END")
    return table(spark, sf_dir, "events").select("event_id", S.summarize_json(text).alias("y"))


BOX = ["least(greatest(CAST(p_partkey % 130 - 20 AS BIGINT), 0), 100)", "least(greatest(CAST(p_size AS BIGINT), 0), 50)", "least(greatest(CAST(p_partkey % 90 AS BIGINT), 0), 100)", "least(greatest(CAST(p_size - p_partkey % 60 AS BIGINT), 0), 50)"]


@query("regions", f"SELECT p_partkey, CASE WHEN p_partkey % 9 < 7 AND {BOX[0]} <> {BOX[2]} AND {BOX[1]} <> {BOX[3]} THEN '[' || least({BOX[0]}, {BOX[2]}) || ', ' || least({BOX[1]}, {BOX[3]}) || ', ' || greatest({BOX[0]}, {BOX[2]}) || ', ' || greatest({BOX[1]}, {BOX[3]}) || ']' END AS y FROM part")
def regions(spark, sf_dir):
    text = F.expr("CASE WHEN p_partkey % 9 < 7 THEN concat(p_partkey % 130 - 20, ',', p_size, ', ', p_partkey % 90, ',', p_size - p_partkey % 60) WHEN p_partkey % 9 = 7 THEN concat(p_name, ',1,2,3') ELSE concat(p_size, ',1,2') END")
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_region(text, 100, 50).cast("string").alias("y"))


_spliced("formula_references", "p_partkey % 5", [f"concat('=A', {K}, '+$B$', {K}, '*SUM(C1:D', {K}, ')&\"E', {K}, '\"')", "concat('=LOG10(', CAST(p_size AS STRING), ')')", f"concat('=Sheet1!B', {K}, '-x')", "p_name", f"concat('=$A1:B$', {K}, ', AB', {K})"],
         ["'A' || p_partkey || ' $B$' || p_partkey || ' C1:D' || p_partkey", "''", "'B' || p_partkey", "''", "'$A1:B$' || p_partkey || ' AB' || p_partkey"], lambda c: F.array_join(S.formula_refs(c), " "))


CELLS = "SELECT l_suppkey AS book, 'A' || (l_orderkey % 60 + 1) AS cell, CASE l_linenumber % 4 WHEN 0 THEN '=A' || (l_partkey % 60 + 1) || '+$A$' || (l_partkey % 7 + 1) WHEN 1 THEN '=SUM(A' || (l_partkey % 50 + 1) || ':A' || (l_partkey % 50 + 3) || ')' WHEN 2 THEN '=Other!A' || (l_partkey % 60 + 1) || '*2' ELSE '=\"A1\"' END AS formula FROM {}"


@query("formula_edges", rf"""WITH f AS (SELECT DISTINCT * FROM ({CELLS.format('lineitem')})), r AS (SELECT book, cell, unnest(regexp_extract_all(regexp_replace(formula, '"[^"]*"', ' ', 'g'), '\$?[A-Z]+\$?[0-9]+(:\$?[A-Z]+\$?[0-9]+)?')) AS ref FROM f WHERE formula NOT LIKE '%Other!%'),
    p AS (SELECT book, cell, CAST(regexp_extract(replace(ref, '$', ''), '^A([0-9]+)', 1) AS INT) AS a, CAST(regexp_extract(replace(ref, '$', ''), 'A([0-9]+)$', 1) AS INT) AS b FROM r)
    SELECT DISTINCT book, cell, 'A' || unnest(range(a, b + 1)) AS needs FROM p""")
def formula_edges(spark, sf_dir):
    """Lines as formulas of a supplier's sheet: which cells each needs; what stands on another sheet isn't of this one."""
    from lakewright.operators import parts

    cells = spark.sql(CELLS.format("{lineitem}"), lineitem=table(spark, sf_dir, "lineitem")).distinct()
    return parts.formula_edges(cells, "book", "cell", "formula")


@query("outline_levels", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN nullif(p_size % 10, 9) WHEN p_partkey % 3 = 0 THEN nullif(p_partkey % 7 + 3, 9) WHEN p_partkey % 5 = 0 THEN NULL END AS level, CASE WHEN p_partkey % 2 = 0 THEN 'own' WHEN p_partkey % 3 = 0 THEN 'style_name' WHEN p_partkey % 5 = 0 THEN 'style' END AS source FROM part")
def outline_levels(spark, sf_dir):
    when = lambda n, v: F.when(F.col("p_partkey") % n == 0, v)
    found = S.outline_level(when(2, F.col("p_size") % 10), when(3, F.col("p_partkey") % 7 + 3), when(5, F.lit(9)))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("o")).select("p_partkey", "o.*")


STORY = ["concat('# ', p_name)", "concat('## ', p_name)", "concat('; ', p_name)", "concat(p_type, '（', p_brand, '）：', p_name)", "concat('旁白：', p_name)", "p_name", "'  '", "concat('!', p_name)", "concat(p_type, ': ', p_name)"]
TOLD = ["'chapter'", "'fragment'", "'comment'", "'dialogue'", "'narration'", "'narration'", "'blank'", "'directive'", "'dialogue'"]


@query("story_lines", f"""SELECT p_partkey, CASE {' '.join(f'WHEN p_partkey % 9 = {i} THEN {k}' for i, k in enumerate(TOLD))} END AS kind, CASE WHEN p_partkey % 9 IN (3, 8) THEN p_type END AS who,
    CASE WHEN p_partkey % 9 = 3 THEN p_brand WHEN p_partkey % 9 = 8 THEN '' END AS mood, CASE WHEN p_partkey % 9 <> 6 THEN p_name END AS text,
    (SELECT max(q.p_name) FROM part q WHERE q.p_partkey = p.p_partkey - p.p_partkey % 9) AS chapter FROM part p""")
def story_lines(spark, sf_dir):
    """Parts as the lines of a script, nine to a chapter; each line with the chapter that it stands in."""
    lines = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 9).alias("script"), F.expr(f"CASE {' '.join(f'WHEN p_partkey % 9 = {i} THEN {x}' for i, x in enumerate(STORY))} END").alias("line"))
    told = lines.select("p_partkey", "script", S.story_line(F.col("line")).alias("s")).select("p_partkey", "script", "s.*")
    return windows.filled(told, ["script"], "p_partkey", "text", F.col("kind") == "chapter", "chapter").drop("script")


SIZES = [("TB", 1024**4), ("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)]


@query("human_sizes", f"SELECT doc_id, CASE {' '.join(f'''WHEN n >= {k} THEN printf('%.1f {u}', round_even(n / CAST({k} AS DOUBLE), 1))''' for u, k in SIZES)} ELSE n || ' B' END AS size FROM (SELECT doc_id, CAST(n_chars AS BIGINT) * n_chars * n_chars AS n FROM documents)")
def human_sizes(spark, sf_dir):
    n = F.col("n_chars").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", S.human_size(n * n * n).alias("size"))


PATHS = "CASE p_partkey % 4 WHEN 0 THEN 'dir.d/' || p_name || '.' || p_type WHEN 1 THEN 'dir.d/' || p_name WHEN 2 THEN 'dir.d/.' || p_type ELSE p_name || '.tar.' || p_brand END"


@query("extensions", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 3 THEN lower(p_brand) ELSE '(none)' END AS ext FROM part")
def extensions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.ext_of(F.expr(PATHS)).alias("ext"))


@query("renamed_files", "SELECT p_partkey, 'new-' || replace(p_name, 'widget', 'gear') || '-v2.' || p_type AS name FROM part")
def renamed_files(spark, sf_dir):
    name = F.concat_ws(".", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", S.affix_name(name, "new-", "-v2", "widget", "gear").alias("name"))


@query("filetimes", "SELECT event_id, CAST(event_id * 1000000 + 25 AS BIGINT) AS micros FROM events")
def filetimes(spark, sf_dir):
    ticks = F.lit(116444736000000000) + F.col("event_id") * 10_000_000 + 257
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(S.filetime(ticks)).alias("micros"))


@query("collapsed_blanks", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def collapsed_blanks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.collapse_ws(F.col("text")).alias("text"))


def _accepted(code: Column, chars: str, valid) -> Column:
    """The check characters with which a code is valid."""
    return F.array_join(F.array(*[F.when(valid(F.concat(code, F.lit(c))), F.lit(c)) for c in chars]), "")


CODE = "lpad(CAST(c_custkey * 7919 + 11010519491231 AS VARCHAR), 17, '0')"
CHECK = "list_sum(list_transform(range(1, 18), lambda i: (instr('{chars}', substr(code, i, 1)) - 1) * {weights}[i]))"


@query("identity_checks", f"SELECT c_custkey, substr('{S.ID_CHECKS}', CAST({CHECK.format(chars='0123456789', weights=list(S.ID_WEIGHTS))} % 11 + 1 AS INT), 1) AS accepted FROM (SELECT c_custkey, {CODE} AS code FROM customer)")
def identity_checks(spark, sf_dir):
    code = F.lpad((F.col("c_custkey") * 7919 + 11010519491231).cast("string"), 17, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", _accepted(code, S.ID_CHECKS, S.cn_id_valid).alias("accepted"))


@query("organisation_checks", f"SELECT c_custkey, substr('{S.USCC_CHARS}', CAST((31 - {CHECK.format(chars=S.USCC_CHARS, weights=list(S.USCC_WEIGHTS))} % 31) % 31 + 1 AS INT), 1) AS accepted FROM (SELECT c_custkey, {CODE} AS code FROM customer)")
def organisation_checks(spark, sf_dir):
    code = F.lpad((F.col("c_custkey") * 7919 + 11010519491231).cast("string"), 17, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", _accepted(code, S.USCC_CHARS, S.uscc_valid).alias("accepted"))


@query("canonical_props", "SELECT event_id, '{\"a\":{\"k\":' || json_extract_string(props, '$.k') || '},\"b\":' || event_id || '}' AS json FROM events")
def canonical_props(spark, sf_dir):
    loose = F.concat(F.lit('{ "b": '), F.col("event_id").cast("string"), F.lit(', "a" : '), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", S.canonical_json(loose).alias("json"))


@query("bare_hashes", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN sha256(text) END AS hash FROM documents")
def bare_hashes(spark, sf_dir):
    h = F.sha2(F.col("text").cast("binary"), 256)
    written = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sha256:"), F.upper(h))).when(F.col("doc_id") % 3 == 1, h).otherwise(F.substring(h, 1, 63))
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_hash(written).alias("hash"))


@query("packed_numbers", "SELECT o_orderkey, CAST(-o_orderkey - 1 AS DOUBLE) AS whole, CAST(-o_orderkey - 1 AS DOUBLE) / 100 AS cents, CAST(1.5 AS DOUBLE) AS real FROM orders")
def packed_numbers(spark, sf_dir):
    n = (-F.col("o_orderkey") - 1) * 4
    return table(spark, sf_dir, "orders").select("o_orderkey", S.decode_rk(n + 2).alias("whole"), S.decode_rk(n + 3).alias("cents"), S.decode_rk(F.lit(0x3FF80000)).alias("real"))


@query("subtitle_times", "SELECT event_id, ms AS millis, printf('%d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms // 10 % 100) AS ass FROM (SELECT event_id, event_id * 1237 % 86400000 AS ms FROM events)")
def subtitle_times(spark, sf_dir):
    ms = F.col("event_id") * 1237 % 86_400_000
    part = lambda unit, base: F.floor(ms / unit) % base
    stamp = F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 24), part(60_000, 60), part(1000, 60), ms % 1000)
    read = table(spark, sf_dir, "events").select("event_id", S.srt_millis(stamp).alias("millis"))
    return read.withColumn("ass", S.ass_time(F.col("millis")))


@query("fitted_sizes", "SELECT w, h, CASE WHEN greatest(w, h) <= 512 THEN w ELSE greatest(w * 512 // greatest(w, h), 1) END AS fit_w, CASE WHEN greatest(w, h) <= 512 THEN h ELSE greatest(h * 512 // greatest(w, h), 1) END AS fit_h FROM (SELECT o_orderkey % 3000 + 1 AS w, o_custkey % 2000 + 1 AS h FROM orders)")
def fitted_sizes(spark, sf_dir):
    sides = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3000 + 1).alias("w"), (F.col("o_custkey") % 2000 + 1).alias("h"))
    fit = S.fit_size(F.col("w"), F.col("h"), 512)
    return sides.select("w", "h", fit["width"].alias("fit_w"), fit["height"].alias("fit_h"))
