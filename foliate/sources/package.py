"""Office packages (zip files of parts) as relations: parts, relationships, content types and a sheet's cells; and a writer of workbooks.

Files are read with the binaryFile source, one row a file; Python only unpacks zip files and their sheets, in streams of
small batches. Everything after that is native. A file is one task's work, as the format is a single zip stream.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = 8192
PARTS = "wb string, path string, content binary"
CELLS = "wb string, sheet string, row bigint, col int, txt string, num double, formula string"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _paragraph(node) -> str:
    """Text of a paragraph's runs, with tabs and line breaks."""
    mark = {"tab": "\t", "br": "\n"}
    return "".join(x.text or "" if _local(x.tag) == "t" else mark.get(_local(x.tag), "") for x in node.iter())


def _document(z: zipfile.ZipFile) -> str:
    """The body of a text document: headings by their style, list items, tables, paragraphs."""
    out = []
    for node in next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body"):
        if _local(node.tag) == "p":
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level, text = re.fullmatch(r"(?i)heading ?([1-6])", style), _paragraph(node).strip()
            item = any(_local(x.tag) == "numPr" for x in node.iter())
            if text:
                out.append("#" * (int(level[1]) if level else 1) + " " + text if level or style.lower() == "title" else "- " + text if item else text)
        elif _local(node.tag) == "tbl":
            rows = [["<br>".join(_paragraph(p) for p in c if _local(p.tag) == "p").replace("|", "\\|").replace("\n", "<br>") for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]
            if rows:
                out.append("\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]))
    return "\n\n".join(out) + "\n"


def _slides(z: zipfile.ZipFile) -> str:
    """The paragraphs of each slide, in the slides' order."""
    targets = {r.get("Id"): os.path.normpath("ppt/" + r.get("Target")) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
    out = []
    for k, s in enumerate((x for x in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(x.tag) == "sldId"), 1):
        texts = [_paragraph(p).strip() for p in ElementTree.fromstring(z.read(targets[s.get(_R)])).iter() if _local(p.tag) == "p"]
        out.append("\n\n".join([f"## Slide {k}", *(x for x in texts if x)]))
    return "\n\n".join(out) + "\n"


def to_markdown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """wb, text of text documents (docx) and presentations (pptx). A file that is neither raises an error."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for wb, content in zip(batch["wb"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"wb": [wb], "text": [_document(z) if "word/document.xml" in z.namelist() else _slides(z)]})

    return _files(spark, paths).mapInPandas(convert, "wb string, text string")


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("wb"), "content")


def parts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """wb, path, content of every part. A file that is no zip file raises an error."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for wb, content in zip(batch["wb"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"wb": [wb], "path": [name], "content": [z.read(name)]})

    return _files(spark, paths).mapInPandas(unpack, PARTS)


def listed(parts: DataFrame, prefix: str = "") -> DataFrame:
    """wb, path, size, sha256, content_type."""
    types = content_types(parts)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    named = types.where("kind = 'override'").select("wb", F.col("name").alias("path"), F.col("type").alias("o"))
    default = types.where("kind = 'default'").select("wb", F.col("name").alias("ext"), F.col("type").alias("d"))
    chosen = parts.where(F.col("path").startswith(prefix)).select("wb", "path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"), extension.alias("ext"))
    return chosen.join(named, ["wb", "path"], "left").join(default, ["wb", "ext"], "left").select("wb", "path", "size", "sha256", F.coalesce("o", "d").alias("content_type"))


def read_part(parts: DataFrame, path: str, offset: int = 0, max_bytes: int = 65_536) -> DataFrame:
    """wb, size, bytes: a range of a part's bytes (at most 262,144, the feature's own limit)."""
    return parts.where(F.col("path") == path).select("wb", F.octet_length("content").cast("bigint").alias("size"), F.substring("content", offset + 1, min(max_bytes, 262_144)).alias("bytes"))


def relationships(parts: DataFrame) -> DataFrame:
    """wb, source (empty for the package), id, type, target (a part's path unless external), external."""
    rels = parts.where(F.col("path").rlike(r"(^|/)_rels/[^/]*\.rels\z")).withColumn("x", F.decode("content", "UTF-8"))
    folder = F.regexp_extract("path", r"^(.*?)_rels/[^/]*\z", 1)
    source = F.concat(folder, F.regexp_extract("path", r"_rels/([^/]*)\.rels\z", 1))
    each = F.arrays_zip(*(F.xpath("x", F.lit(f"//*[local-name()='Relationship']/@{a}")).alias(a) for a in ("Id", "Type", "Target")))
    outside = F.xpath("x", F.lit("//*[local-name()='Relationship'][@TargetMode='External']/@Id"))
    flat = rels.select("wb", source.alias("source"), folder.alias("folder"), outside.alias("out"), F.explode(each).alias("r"))
    flat = flat.select("wb", "source", "folder", F.col("r.Id").alias("id"), F.col("r.Type").alias("type"), F.col("r.Target").alias("raw"), F.array_contains("out", F.col("r.Id")).alias("external"))
    steps = F.split(F.when(F.col("raw").startswith("/"), F.substring("raw", 2, 1_000_000)).otherwise(F.concat("folder", "raw")), "/")
    up = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((s == ".") | (s == ""), acc).otherwise(F.array_append(acc, s))
    path = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")
    return flat.select("wb", "source", "id", "type", F.when(F.col("external"), F.col("raw")).otherwise(path).alias("target"), "external")


def content_types(parts: DataFrame) -> DataFrame:
    """wb, kind (default or override), name (an extension or a path), type."""
    x = parts.where("path = '[Content_Types].xml'").withColumn("x", F.decode("content", "UTF-8"))

    def of(tag: str, key: str, kind: str) -> DataFrame:
        pairs = F.arrays_zip(*(F.xpath("x", F.lit(f"//*[local-name()='{tag}']/@{a}")).alias(a) for a in (key, "ContentType")))
        name = F.lower("p.Extension") if kind == "default" else F.regexp_replace("p.PartName", "^/", "")
        return x.select("wb", F.explode(pairs).alias("p")).select("wb", F.lit(kind).alias("kind"), name.alias("name"), F.col("p.ContentType").alias("type"))

    return of("Default", "Extension", "default").unionByName(of("Override", "PartName", "override"))


def overlaid(parts: DataFrame, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """parts with upserts (same columns) in place of theirs and without deletes (wb, path)."""
    out = parts
    for other in (deletes, upserts):
        if other is not None:
            out = out.join(other.select("wb", "path"), ["wb", "path"], "left_anti")
    return out.select("wb", "path", "content").unionByName(upserts.select("wb", "path", "content")) if upserts is not None else out


def problems(parts: DataFrame, required: tuple[str, ...] = ("[Content_Types].xml", "_rels/.rels")) -> DataFrame:
    """wb, problem, path: missing required parts, edges to parts that are not there, parts without a content type. A transaction is applied only where a workbook has none."""
    dangling = relationships(parts).where(~F.col("external")).select("wb", F.col("target").alias("path")).distinct().join(parts.select("wb", "path"), ["wb", "path"], "left_anti")
    wanted = parts.select("wb").distinct().select("wb", F.explode(F.array(*map(F.lit, required))).alias("path")).join(parts.select("wb", "path"), ["wb", "path"], "left_anti")
    untyped = listed(parts).where("content_type IS NULL AND path <> '[Content_Types].xml'").select("wb", "path")
    out = None
    for df, name in ((wanted, "missing"), (dangling, "dangling"), (untyped, "untyped")):
        one = df.select("wb", F.lit(name).alias("problem"), "path")
        out = one if out is None else out.unionByName(one)
    return out


def transaction(parts: DataFrame, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Parts after the edits where the workbook then has no problem; a workbook that would have one keeps its parts as they were."""
    after = overlaid(parts, upserts, deletes)
    bad = problems(after).select("wb").distinct()
    return after.join(bad, "wb", "left_anti").unionByName(parts.join(bad, "wb", "left_semi").select("wb", "path", "content"))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node) -> str:
    """Text of a string item without its phonetic runs."""
    return "".join(t.text or "" for child in node for t in ([child] if _local(child.tag) == "t" else child.iter() if _local(child.tag) == "r" else []) if _local(t.tag) == "t")


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and part paths in the workbook's order."""
    targets = {}
    for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        t = r.get("Target")
        targets[r.get("Id")] = t.lstrip("/") if t.startswith("/") else os.path.normpath("xl/" + t)
    return [(s.get("name"), targets[s.get(_R)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]


def _read(wb: str, content: bytes, wanted: set[str] | None) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELLS.split(", ")]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if _local(node.tag) == "si":
                        shared.append(_texts(node))
                        node.clear()
        rows: list[tuple] = []
        for sheet, path in _sheets(z):
            if (wanted and sheet not in wanted) or path not in z.namelist():
                continue
            with z.open(path) as f:
                at, col = -1, -1
                for event, node in ElementTree.iterparse(f, ("start", "end")):
                    tag = _local(node.tag)
                    if event == "start":
                        if tag == "row":
                            at, col = int(node.get("r", at + 2)) - 1, -1
                        continue
                    if tag == "row":
                        node.clear()
                    if tag != "c":
                        continue
                    ref, kind = node.get("r"), node.get("t", "n")
                    col = _column(ref) if ref else col + 1
                    parts_ = {_local(x.tag): x for x in node}
                    value = parts_["v"].text if "v" in parts_ else None
                    formula = "=" + (parts_["f"].text or "") if "f" in parts_ else None
                    text, num = value, None
                    if kind == "s" and value is not None:
                        text = shared[int(value)]
                    elif kind == "inlineStr":
                        text = _texts(parts_["is"]) if "is" in parts_ else ""
                    elif kind == "b":
                        text = {"1": "true", "0": "false"}.get(value, value)
                    elif kind == "n" and value is not None:
                        num = float(value)
                    node.clear()
                    if text is not None or formula is not None:
                        rows.append((wb, sheet, at, col, text, num, formula))
                    if len(rows) == _BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)


def read_cells(spark: SparkSession, paths: str | list[str], sheets: list[str] | None = None) -> DataFrame:
    """wb, sheet, row, col, txt, num, formula of workbooks; rows and columns count from 0. Only the named sheets are parsed. Text of a formula's cell is its last value."""
    wanted = set(sheets) if sheets else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for wb, content in zip(batch["wb"], batch["content"]):
                yield from _read(wb, content, wanted)

    return _files(spark, paths).mapInPandas(read, CELLS)


_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _letters(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(row: int, col: int, txt, num, formula) -> str:
    ref = f'r="{_letters(col)}{row + 1}"'
    if isinstance(formula, str) and formula:
        value = escape(_ILLEGAL.sub("", txt)) if isinstance(txt, str) else ""
        kind = ' t="str"' if value and num != num else ""
        return f"<c {ref}{kind}><f>{escape(_ILLEGAL.sub('', formula[1:]))}</f>{f'<v>{value}</v>' if value else ''}</c>"
    if num is not None and num == num and isinstance(txt, str):
        return f"<c {ref}><v>{escape(txt)}</v></c>"
    return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", txt or ""))}</t></is></c>'


def workbooks(cells: DataFrame) -> DataFrame:
    """wb, content: a workbook file for each wb, of cells with wb, sheet, row, col, txt, num, formula.

    Cells are sorted within a partition and streamed into the zip file, so a task holds one compressed workbook and a batch of cells.
    Sheets stand in the order of a column ord, or else of their names. Characters that XML can't hold are left out. An empty wb or sheet is no workbook.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wb = sheet = out = part = buffer = None
        row, names = -1, []

        def close_sheet() -> None:
            part.write(("</row>" if row >= 0 else "").encode() + b"</sheetData></worksheet>")
            part.close()

        def close_book() -> pd.DataFrame:
            close_sheet()
            head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
            out.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
            out.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed_ = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
            out.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{listed_}</sheets></workbook>')
            edges = "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            out.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{edges}</Relationships>')
            out.close()
            return pd.DataFrame({"wb": [wb], "content": [buffer.getvalue()]})

        for batch in batches:
            for c in batch.itertuples(index=False):
                if c.wb != wb:
                    if wb is not None:
                        yield close_book()
                    wb, sheet, names, buffer = c.wb, None, [], io.BytesIO()
                    out = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                if c.sheet != sheet:
                    if sheet is not None:
                        close_sheet()
                    sheet, row = c.sheet, -1
                    names.append(sheet)
                    part = out.open(f"xl/worksheets/sheet{len(names)}.xml", "w")
                    part.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                if c.row != row:
                    part.write((("</row>" if row >= 0 else "") + f'<row r="{c.row + 1}">').encode())
                    row = c.row
                part.write(_cell(c.row, c.col, c.txt, c.num, c.formula).encode())
        if wb is not None:
            yield close_book()

    place = F.col("ord") if "ord" in cells.columns else F.lit(0).alias("ord")
    chosen = cells.select("wb", place, "sheet", "row", "col", "txt", "num", "formula").where("wb IS NOT NULL AND sheet IS NOT NULL")
    dealt = chosen.repartition("wb").sortWithinPartitions("wb", "ord", "sheet", "row", "col").drop("ord")
    return dealt.mapInPandas(pack, "wb string, content binary")
