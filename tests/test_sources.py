"""Packages, workbooks, classification and streams on small fixtures."""

import io
import zipfile

from pyspark.sql import functions as F

from foliate.functions import convert, edits, formula
from foliate.functions import markdown as md
from foliate.operators import grid, preservation, workbook
from foliate.sources import package
from foliate.streaming import documents

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(tmp_path, name="a.xlsx", extra=()):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="r"/><Override PartName="/xl/workbook.xml" ContentType="main"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Type="t" Target="worksheets/sheet1.xml"/><Relationship Id="y" Type="t" Target="https://example.org/" TargetMode="External"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>Ada</t></si><si><r><t>Gr</t></r><r><t>ace</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row r="3"><c r="AA3"><f>B2*2</f><v>20</v></c><c r="AB3" t="b"><v>1</v></c><c r="AC3" t="inlineStr"><is><t> x </t></is></c></row></sheetData></worksheet>')
        for path, content in extra:
            z.writestr(path, content)
    (tmp_path / name).write_bytes(buffer.getvalue())
    return str(tmp_path / name)


def test_cells(spark, tmp_path):
    got = {(r.row, r.col): (r.txt, r.num, r.formula) for r in package.read_cells(spark, book(tmp_path)).collect()}
    assert got == {(0, 0): ("Ada", None, None), (0, 1): ("Grace", None, None), (2, 26): ("20", 20.0, "=B2*2"), (2, 27): ("true", None, None), (2, 28): (" x ", None, None)}
    assert package.read_cells(spark, book(tmp_path), ["None"]).count() == 0


def test_round_trip(spark, tmp_path):
    rows = [(w, s, r, c, t, n, f) for w in ("a", "b") for s in ("S 1", "T&<\">") for r in (0, 1, 7) for c, t, n, f in ((0, " é\n<&>", None, None), (1, "10", 10.0, None), (30, "20", 20.0, "=B1*2&\"<\""), (800, "", None, None))]
    cells = spark.createDataFrame(rows, package.CELLS)
    for r in package.workbooks(cells).collect():
        (tmp_path / f"{r.wb}.xlsx").write_bytes(r.content)
    back = package.read_cells(spark, str(tmp_path / "*.xlsx")).withColumn("wb", F.regexp_extract("wb", r"([^/]*)\.xlsx\z", 1))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    assert package.problems(package.parts(spark, str(tmp_path / "*.xlsx"))).count() == 0
    assert package.workbooks(cells.where("false")).count() == 0


def test_parts(spark, tmp_path):
    parts = package.parts(spark, book(tmp_path)).cache()
    assert {r.path: r.content_type for r in package.listed(parts, "xl/w").collect()} == {"xl/workbook.xml": "main", "xl/worksheets/sheet1.xml": "application/xml"}
    assert sorted((r.source, r.id, r.target, r.external) for r in package.relationships(parts).collect()) == [("", "r1", "xl/workbook.xml", False), ("xl/workbook.xml", "x", "xl/worksheets/sheet1.xml", False), ("xl/workbook.xml", "y", "https://example.org/", True)]
    assert package.problems(parts).count() == 0
    part = package.read_part(parts, "xl/sharedStrings.xml", 1, 3).first()
    assert bytes(part.bytes) == b"sst"
    gone = parts.where("path = 'xl/worksheets/sheet1.xml'").select("wb", "path")
    assert [(r.problem, r.path) for r in package.problems(package.overlaid(parts, deletes=gone)).collect()] == [("dangling", "xl/worksheets/sheet1.xml")]
    assert package.transaction(parts, deletes=gone).count() == parts.count()
    new = parts.limit(1).select("wb", F.lit("xl/new.xml").alias("path"), F.lit(b"<a/>").alias("content"))
    assert package.transaction(parts, new).count() == parts.count() + 1


def test_classes(spark):
    changes = spark.createDataFrame([("a/x", "1", "2"), ("b/x", "1", "2"), ("c[1]", None, "2"), ("d", "1", None), ("e", "1", "2")], "path string, before string, after string")
    norms = [{"path": "b/*", "before": "1", "after": "2", "rationale": "r", "bidirectional": True, "evidence": "e"}, {"path": "e", "before": "1", "after": "2"}]
    out = preservation.classified(changes, ["a/?"], norms, ["c[[]1]"])
    assert {r.path: r.classification for r in out.collect()} == {"a/x": "REQUESTED", "b/x": "NORMALIZATION", "c[1]": "FIXTURE_GAP", "d": "UNAPPROVED_LOSS", "e": "VERIFIER_GAP"}
    v = preservation.verdict(out).first()
    assert (v.total, v.preservation_ok, v.truncated) == (5, False, False)
    assert preservation.verdict(out.where("path LIKE '%x'")).first().preservation_ok
    reports = spark.createDataFrame([("coverage", True), ("verification", True), ("backup", True)], "kind string, ok boolean")
    assert preservation.summary(reports).first().passed and not preservation.summary(reports.where("kind <> 'backup'")).first().passed


def test_cell_changes(spark):
    schema = "sheet string, row bigint, col int, txt string, num double, formula string"
    a = spark.createDataFrame([("S", 0, 0, "x", None, None), ("S", 1, 0, "1", 1.0, "=A1")], schema)
    b = spark.createDataFrame([("S", 0, 0, "y", None, None), ("S", 1, 0, "1", 1.0, "=A2")], schema)
    assert sorted(map(tuple, preservation.cell_changes(a, b).collect())) == [("S!0,0/txt", "x", "y"), ("S!1,0/formula", "=A1", "=A2")]


def test_formula_edges(spark):
    def run(text, f):
        return spark.range(1).select(F.lit(text).alias("f")).select(f(F.col("f"))).first()[0]

    gone = lambda f: formula.shifted(f, F.lit("S"), "S", rows=formula.deleted([1, 2]))
    assert run("=A2+A1:A5+3:3+A2:A3+B:C+'S'!A4+A5", gone) == "=#REF!+A1:A3+#REF!+#REF!+B:C+'S'!A2+A3"
    assert run('="A2"&A2&LOG10(A9)&Name1x', gone) == '="A2"&#REF!&LOG10(A7)&Name1x'
    assert run("A2", gone) == "A2" and run(None, gone) is None
    new = lambda f: formula.shifted(f, F.lit("S"), "S", columns=formula.inserted(25, 1))
    assert run("=Z1:AA1+$AA$2+5:6+AA:AB", new) == "=Z1:AB1+$AB$2+5:6+AB:AC"
    assert run("=A1+$A1", lambda f: formula.copied(f, 0, -1)) == "=#REF!+$A1"


def test_merge_overlap_raises(spark):
    import pytest

    regions = spark.createDataFrame([("S", 1, 0, 0, 3, 3)], "sheet string, id bigint, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    assert workbook.merge_cells(regions, "S", 2, 4, 0, 5, 0).count() == 2
    with pytest.raises(Exception, match="overlaps"):
        workbook.merge_cells(regions, "S", 2, 3, 3, 5, 5).collect()


def test_edits_leave_others(spark):
    docs = spark.createDataFrame([(1, "# A\n# A\n"), (2, None), (3, ""), (4, "x")], "doc bigint, text string")
    got = {r.doc: r.text for r in edits.delete_section(docs, "A").collect()}
    assert got == {1: "# A\n# A\n", 2: None, 3: "", 4: "x"}
    crlf = spark.createDataFrame([(1, "# A\r\nb\r\n# C\r\nd\r\n")], "doc bigint, text string")
    assert edits.rename_heading(crlf, "C", "D").first().text == "# A\r\nb\r\n# D\nd\r\n"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text(f"# T{i}\nbody\n")
    for _ in range(2):  # a second run finds nothing new
        documents.each_batch(documents.text_files(spark, str(tmp_path / "in")), md.headings, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["T0", "T1", "T2"]


def test_converters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'k,v\r\n1,"a, ""b"" | c\nd"\r\n2\r\n')
    (tmp_path / "a.json").write_bytes(b'\xef\xbb\xbf{"a": [1,\n2]}')
    assert convert.csv_files(spark, str(tmp_path / "a.csv")).first().text == '| k | v |\n| --- | --- |\n| 1 | a, "b" \\| c<br>d |\n| 2 |  |\n'
    assert convert.text_files(spark, str(tmp_path / "a.json")).first().text == '{"a": [1,\n2]}'
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, p="": f"<w:p><w:pPr>{p}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        cells = "".join(f"<w:tr><w:tc>{run(a)}</w:tc><w:tc>{run(b)}</w:tc></w:tr>" for a, b in (("h", "i"), ("1|", "2")))
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{run("Top", "<w:pStyle w:val=" + chr(34) + "Heading2" + chr(34) + "/>")}{run("text")}{run("item", "<w:numPr/>")}<w:tbl>{cells}</w:tbl></w:body></w:document>')
    assert package.to_markdown(spark, str(tmp_path / "a.docx")).first().text == "## Top\n\ntext\n\n- item\n\n| h | i |\n| --- | --- |\n| 1\\| | 2 |\n"
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="p" {r}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="slides/slide2.xml"/></Relationships>')
        for k in (1, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>T{k}</a:t></a:r></a:p><a:p/></p:sld>')
    assert package.to_markdown(spark, str(tmp_path / "a.pptx")).first().text == "## Slide 1\n\nT2\n\n## Slide 2\n\nT1\n"


def test_sheets_of_any_key(spark):
    """Rows in the order of numbers, texts, dates and times, with ties and nulls; sheets in a given order."""
    rows = [(k * 7 % 50, f"n{k * 11 % 40:02d}x", f"2024-01-{k % 28 + 1:02d}") for k in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, c string").withColumn("d", F.to_date("c")).withColumn("t", F.to_timestamp("c"))
    for key in ("a", "b", "d", "t"):
        got = [r.txt for r in grid.to_cells(df, "s", [key, "a", "b"], [key]).where("row > 0").orderBy("row").collect()]
        assert got == [r.x for r in df.orderBy(F.col(key).asc_nulls_first(), "a", "b").select(F.col(key).cast("string").alias("x")).collect()], key
    cells = spark.createDataFrame([("w", k, s, 0, 0, s, None, None) for k, s in enumerate(("Z", "A", "M"))], "wb string, ord int, sheet string, row bigint, col int, txt string, num double, formula string")
    content = package.workbooks(cells).first().content
    assert [n for n, _ in package._sheets(zipfile.ZipFile(io.BytesIO(content)))] == ["Z", "A", "M"]


def test_links_to_anchors_and_files(spark):
    docs = spark.createDataFrame([(1, "# A b\n[x](#a%2Db) [y]( #a-b) [z](#a%20b)\n[f](./d%20e.md#x) [g](http://h/i) [h](none.md) ![p](p.png?x)")], "doc bigint, text string")
    assert [r.target for r in md.missing_anchors(docs).collect()] == ["#a%20b"]
    files = spark.createDataFrame([("d e.md",), ("p.png",)], "path string")
    assert [r.target for r in md.missing_files(docs, files).collect()] == ["none.md"]
