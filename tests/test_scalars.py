"""Scalar functions on their edge cases."""

import hashlib
import struct

from pyspark.sql import functions as F

from lakewright.functions import scalars as S


def values(spark, data, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], f"x {kind}").select(f(F.col("x"))).collect()]


def test_human_size(spark):
    assert values(spark, [0, 1023, 1024, 1280, 1536, 1024**2, 5 * 1024**4, None], S.human_size, "long") == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.0 MB", "5.0 TB", None]


def test_names(spark):
    assert values(spark, ["a/b.JPG", "README", ".bashrc", "x.tar.gz", None], S.ext_of) == ["jpg", "(none)", "(none)", "gz", None]
    assert values(spark, ["a.jpg", "b.png", "xa.jpg.txt"], lambda c: S.glob_match(c, "*.j?g")) == [True, False, False]
    assert values(spark, ["a+b.txt", "aab.txt"], lambda c: S.glob_match(c, "a+*")) == [True, False]
    assert values(spark, ["cat.txt", "pre_cat.txt"], lambda c: S.affix_name(c, prefix="pre_")) == ["pre_cat.txt", "pre_cat.txt"]
    assert values(spark, ["Cat cat.txt"], lambda c: S.affix_name(c, find="cat", replace="$1", ignore_case=True)) == ["$1 $1.txt"]
    assert values(spark, ["a.pdf", "b"], S.guess_mime) == ["application/pdf", "application/octet-stream"]
    assert values(spark, ["/a/B.CSS", "/a.html"], S.is_static_asset) == [True, False]


def test_text(spark):
    assert values(spark, ['a"b', "a,b", "ab", "a\nb", None], S.csv_field) == ['"a""b"', '"a,b"', "ab", '"a\nb"', None]
    assert values(spark, ["a|b\r\nc"], S.md_cell) == ["a\\|b<br>c"]
    assert values(spark, ["  a \t b ", ""], S.collapse_ws) == ["a b", ""]
    assert values(spark, ["", "a", "a\n", "a\nb"], S.line_count) == [0, 1, 1, 2]
    assert values(spark, ["héllo"], lambda c: S.truncate_budget(c, 2)) == ["hé…"]
    assert values(spark, ["My App!", "9 lives", "--", "a__b"], lambda c: S.sanitize_ident(c, "cmd")) == ["my-app", "cmd-9-lives", "cmd", "a-b"]
    assert values(spark, ["/users/42/x/7", "/a//b/", "/" + "0a" * 16], S.templatize_path) == ["/users/{id}/x/{id2}", "/a/b", "/{id}"]
    assert values(spark, ["a/./b/../c", "../x"], S.normalize_path) == ["a/c", "x"]


def test_checksums(spark):
    chars = S.USCC_CHARS
    body = "91350100M000100Y4"
    check = chars[(31 - sum(chars.index(c) * w for c, w in zip(body, S.USCC_WEIGHTS)) % 31) % 31]
    assert values(spark, [body + check, body + ("0" if check != "0" else "1"), "short"], S.uscc_valid) == [True, False, False]
    digits = "11010519491231002"
    last = S.ID_CHECKS[sum(int(c) * w for c, w in zip(digits, S.ID_WEIGHTS)) % 11]
    assert values(spark, [digits + last, digits + ("1" if last != "1" else "2"), "x"], S.cn_id_valid) == [True, False, False]
    assert values(spark, [" 13812345678 ", "12812345678"], S.cn_phone) == [True, False]


def test_hashes(spark):
    h = hashlib.md5(b"ns:x").hexdigest()
    assert values(spark, ["x"], lambda c: S.stable_id("ns", c)) == [f"{h[:8]}-{h[8:12]}-4{h[13:16]}-8{h[17:20]}-{h[20:]}"]
    assert values(spark, ["sha256:" + "AB" * 32, "zz"], S.normalize_hash) == ["ab" * 32, None]
    assert values(spark, ["", "a"], S.fnv1a64) == ["cbf29ce484222325", "af63dc4c8601ec8c"]
    assert values(spark, ['{"b": 1, "a": {"d": 2, "c": "é"}}', "no"], S.canonical_json) == ['{"a":{"c":"é","d":2},"b":1}', None]
    assert values(spark, ['{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6}'], S.summarize_json) == ["a: 1, b: 2, c: 3, d: 4, e: 5 (+1 more)"]


def test_sheets(spark):
    assert values(spark, [0, 25, 26, 701, 702], lambda c: S.address(F.lit(0), c), "long") == ["A1", "Z1", "AA1", "ZZ1", "AAA1"]
    assert [r and (r["row"], r["col"]) for r in values(spark, ["A1", "$ab$10", "x"], S.split_ref)] == [(0, 0), (9, 27), None]
    assert values(spark, ["0%", "yyyy-mm-dd", "h:mm", "m/d/yy h:mm", '"d"0', "[Red]$0", "", "General", "mm:ss"], S.format_kind) == ["percent", "date", "time", "datetime", "number", "currency", "general", "general", "time"]
    assert values(spark, [59.0, 60.0, 61.0, 1.5, 43831.0], S.serial_to_iso, "double") == ["1900-02-28", "1900-02-29", "1900-03-01", "1900-01-01T12:00:00", "2020-01-01"]
    packed = struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32
    assert values(spark, [(7 << 2) | 2, (250 << 2) | 3, packed & ~3], S.decode_rk, "long") == [7.0, 2.5, 1.5]
    assert values(spark, ['=A1+$B$2*SUM(C1:D4)&"E5"'], S.formula_refs) == [["A1", "$B$2", "C1:D4"]]
    assert values(spark, ["1440", "1.5", "x", "1234567890"], lambda c: S.to_hundredth_mm(c, "twip")) == [2540, 3, None, None]


def test_others(spark):
    assert values(spark, ["1d", " 2.5 ", "1e3", "x"], S.coerce_number) == [None, 2.5, 1000.0, None]
    assert values(spark, ["是", "TRUE", "no"], S.coerce_flag) == [True, True, False]
    assert values(spark, ["00:01:02,345", "bad"], S.srt_millis) == [62345, None]
    assert values(spark, [62345], S.ass_time, "long") == ["0:01:02.34"]
    assert values(spark, ["30,5,10,25", "-5,0,999,9", "1,1,1,5", "1,2,3", "a,1,2,3"], lambda c: S.parse_region(c, 100, 50)) == [[10, 5, 30, 25], [0, 0, 100, 9], None, None, None]
    lines = values(spark, ["# One", "## part", "; note", "Ann（sad）：Hi", "旁白：calm", "plain", ""], S.story_line)
    assert [(r["kind"], r["who"], r["mood"], r["text"]) for r in lines][3:5] == [("dialogue", "Ann", "sad", "Hi"), ("narration", None, None, "calm")]
    assert [r["kind"] for r in lines] == ["chapter", "fragment", "comment", "dialogue", "narration", "narration", "blank"]
    assert values(spark, ["../e"], lambda c: S.resolve_url(F.lit("http://a.b/c/d"), c)) == ["http://a.b/e"]
