"""Files, containers and office documents from tiny fixtures built here."""

import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lakewright.functions import documents as D
from lakewright.functions import html as H
from lakewright.sources import files


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


RELS = '<Relationships xmlns="x"><Relationship Id="r1" Type="http://t/worksheet" Target="{}"/><Relationship Id="r2" Type="t/hyperlink" Target="http://e" TargetMode="External"/></Relationships>'
XLSX = zipped(
    {
        "[Content_Types].xml": '<Types xmlns="x"><Default Extension="rels" ContentType="r"/><Override PartName="/xl/workbook.xml" ContentType="w"/></Types>',
        "_rels/.rels": RELS.format("xl/workbook.xml"),
        "xl/_rels/workbook.xml.rels": RELS.format("worksheets/sheet1.xml"),
        "xl/workbook.xml": '<workbook xmlns:r="y"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row><c r="A3" t="s"><v>9</v></c><c r="B3"><f>C1*2</f><v>5</v></c></row></sheetData></worksheet>',
        "xl/sharedStrings.xml": "<sst><si><t>a,b</t></si></sst>",
    }
)
DOCX = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/></w:body></w:document>', "docProps/core.xml": "<c><creator>Ann</creator></c>"})


@pytest.fixture
def tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("d/a.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    return out.getvalue()


def test_identify(spark, tar):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    data = [XLSX, tar, png, b"%PDF-1.7", b"RIFF....WEBPVP8 ", b"nothing", b"GIF89a\x05\x00\x06\x00"]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(data)], "k int, content binary")
    rows = df.orderBy("k").select(D.identify(F.col("content")).alias("f"), D.image_size(F.col("content")).alias("s")).collect()
    assert [r["f"] for r in rows] == ["zip", "tar", "png", "pdf", "webp", None, "gif"]
    assert tuple(rows[2]["s"]) == (7, 9) and tuple(rows[6]["s"]) == (5, 6)


def test_office(spark, tar):
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in (("x", XLSX), ("d", DOCX), ("t", tar), ("bad", b"PK\x03\x04junk"))], "path string, content binary")
    members = D.explode_rows(df, D.members_udf).collect()
    assert {(r["path"], r["member"]) for r in members} >= {("t", "d/a.txt"), ("d", "word/document.xml")} and all(r["crc_ok"] is not False for r in members)
    assert [(r["text"]) for r in D.explode_rows(df.where("path = 'd'"), D.paragraphs_udf).collect()] == ["Hello there", ""]
    cells = D.explode_rows(df.where("path = 'x'"), D.cells_udf)
    assert sorted((r["row"], r["col"], r["text"], r["formula"]) for r in cells.collect()) == [(0, 0, "a,b", None), (0, 2, "2.5", None), (2, 0, "#shared 9 is out of range", None), (2, 1, "5", "C1*2")]
    assert D.sheet_csv(cells).first()["csv"] == '"a,b",,2.5\n,,\n#shared 9 is out of range,5,\n'
    assert D.sheet_totals(cells).first()["formulas"] == 1
    report = {r["path"]: r for r in D.package_report(df.where("path = 'x'")).collect()}["x"]
    assert (report["parts"], report["missing_targets"], report["untyped_parts"], report["unpointed_parts"]) == (6, 0, 2, 1)
    assert [(r["name"], r["value"]) for r in D.explode_rows(df, D.properties_udf).collect()] == [("creator", "Ann")]


def test_files(spark, tmp_path):
    for name, body in {"a.JPG": b"12345", "sub/b.jpg": b"1", "node_modules/c.jpg": b"1", "sub/deep/d.txt": b"x\ny\n", "bin.dat": b"\x00\x9f\x92\x96"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = {r["rel"]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.JPG", "sub/b.jpg", "sub/deep/d.txt", "bin.dat"} and rows["a.JPG"]["ext"] == "jpg" and rows["sub/deep/d.txt"]["depth"] == 2
    assert {r["rel"] for r in files.inventory(spark, str(tmp_path), 0).collect()} == {"a.JPG", "bin.dat"}
    assert [(r["line_no"], r["line"]) for r in files.text_lines(spark, str(tmp_path / "sub/deep")).collect()] == [(1, "x"), (2, "y")]
    assert files.text_lines(spark, str(tmp_path)).where("path like '%bin.dat'").count() == 0
    (tmp_path / "a.JPG").write_bytes(b"12" * 1000)
    part = files.capped(spark, str(tmp_path), 2).where("path like '%JPG'").first()  # the least cap is 1024
    assert bytes(part["bytes"]) == b"12" * 512 and part["truncated"]
    assert files.inventory(spark, str(tmp_path)).select(files.top_level(F.col("rel")).alias("t")).distinct().count() == 2


def test_traffic(spark, tmp_path):
    har = {"log": {"entries": [{"request": {"method": "get", "url": f"http://h.com{p}", "queryString": [{"name": "q", "value": "1"}]}, "response": {"status": 200, "content": {"mimeType": "text/html", "size": 1}}} for p in ("/users/42", "/a.css")]}}
    (tmp_path / "x.har").write_text(json.dumps(har))
    rows = files.har_requests(spark, str(tmp_path / "x.har"), "h.com").collect()
    assert [(r["method"], r["template"], r["query"]) for r in rows] == [("GET", "/users/{id}", ["q"])]
    (tmp_path / "api.json").write_text(json.dumps({"paths": {"/u/{id}": {"get": {"operationId": "one", "parameters": [{"name": "id"}]}, "x-note": {}}}}))
    rows = files.openapi_operations(spark, str(tmp_path / "api.json")).collect()
    assert [(r["path"], r["method"], r["operation_id"], r["parameters"]) for r in rows] == [("/u/{id}", "GET", "one", ["id"])]
    os.makedirs(tmp_path / "d")
    for k, body in enumerate(('{"id": "a", "at": 1}', '{"id": "b", "at": 2}', "{bad")):
        (tmp_path / "d" / f"{k}.json").write_text(body)
    assert [r["id"] for r in files.json_folder(spark, str(tmp_path / "d"), "id string, at long", "at").collect()] == ["b", "a"]


def test_content_store(spark):
    schema = "name string, version int, bytes binary, at int"
    old = spark.createDataFrame([("n", 1, bytearray(b"x"), 1)], schema)
    blobs, names = files.content_store(old, spark.createDataFrame([("n", 2, bytearray(b"y"), 2), ("m", 1, bytearray(b"x"), 3)], schema))
    assert blobs.count() == 2 and {r["name"]: r["version"] for r in names.collect()} == {"n": 2, "m": 1}


PAGE = '<html><head><title>T</title></head><body><h1>Head</h1><p>short</p><p class="a b">long enough text</p><a href="/x">L</a><a href="/x">L</a><a href="#y">no</a><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><form action="/go" method="post"><input name="q"><select name="s"></select></form></body></html>'


def test_distil(spark):
    df = spark.createDataFrame([("http://h/", PAGE), ("http://e/", None)], "url string, html string")
    one, none = df.select(H.distil("url", "html").alias("d")).collect()
    d = one["d"].asDict(recursive=True)
    assert d["title"] == "T" and d["links"] == [{"href": "http://h/x", "label": "L"}] and d["sections"] == ["Head", "long enough text"]
    assert d["tables"] == [{"headers": ["A", "B"], "rows": [["1", "2"]]}] and d["forms"] == [{"action": "/go", "method": "POST", "inputs": ["q", "s"]}]
    assert none["d"]["title"] == "http://e/"
    for selector, want in (("p.a", ["long enough text"]), ("table td, h1", ["Head", "1", "2"]), ("[name=q]", [""]), ("body table th", ["A", "B"]), ("div", [])):
        assert df.limit(1).select(H.selected_texts(selector)("html").alias("t")).first()["t"] == want
