"""Markdown structure as relations: lines, fences, headings, blocks, tables, links. All in DataFrame functions.

A document table has doc (any key) and text. Lines count from 1, ranges are inclusive. A lone carriage return stays inside its
line, one at the end of a line is dropped. Per-document state (fences, tables) is one fold over the document's few marked lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The format's expressions and kinds of diagrams, fixed values.
HEADING = r"(?s)^(#{1,6})[ \t]+(.+?)(?:[ \t]+#+[ \t]*)?\z"
INLINE_LINK, IMAGE, REFERENCE = r"(?<!!)\[([^\]]*)\]\(([^)]+)\)", r"!\[([^\]]*)\]\(([^)]+)\)", r"^\s*\[([^\]]+)\]:\s*(\S+)"
WORDS = r"[\p{L}\p{N}_]+"
DIAGRAMS = ("mermaid", "plantuml", "puml", "dot", "graphviz")
_FAR = 2_147_483_647


def line_array(text: Column) -> Column:
    """One trailing line break adds no line; an empty text has none."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r+\z", "")))


def lines(docs: DataFrame) -> DataFrame:
    """doc, line, raw."""
    return docs.select("doc", F.posexplode(line_array(F.col("text"))).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}\p{M} _-]", ""), " ", "-")


def _fence_fold(marks: DataFrame) -> DataFrame:
    """marks: doc, line, fence (the run of marker characters), info. Returns doc, fences: array<struct<s, e, info>>; e is far for one that stays open."""
    item = F.struct("line", F.substring("fence", 1, 1).alias("m"), F.length("fence").alias("n"), "info")
    start = F.struct(F.lit(0).alias("s"), F.lit("").alias("m"), F.lit(0).alias("n"), F.lit("").alias("info"), F.array().cast("array<struct<s:int,e:int,info:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        closes = (acc["s"] > 0) & (acc["m"] == x["m"]) & (x["n"] >= acc["n"])
        done = F.array_append(acc["out"], F.struct(acc["s"].alias("s"), x["line"].alias("e"), acc["info"].alias("info")))
        idle = F.struct(F.lit(0).alias("s"), F.lit("").alias("m"), F.lit(0).alias("n"), F.lit("").alias("info"))
        opened = F.struct(x["line"].alias("s"), x["m"].alias("m"), x["n"].alias("n"), x["info"].alias("info"))
        state = F.when(closes, idle).when(acc["s"] == 0, opened).otherwise(F.struct(acc["s"].alias("s"), acc["m"].alias("m"), acc["n"].alias("n"), acc["info"].alias("info")))
        return F.struct(state["s"].alias("s"), state["m"].alias("m"), state["n"].alias("n"), state["info"].alias("info"), F.when(closes, done).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.when(acc["s"] > 0, F.array_append(acc["out"], F.struct(acc["s"].alias("s"), F.lit(_FAR).alias("e"), acc["info"].alias("info")))).otherwise(acc["out"])

    return marks.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("marks")).select("doc", F.aggregate("marks", start, step, finish).alias("fences"))


def headings(docs: DataFrame) -> DataFrame:
    """doc, line, level, title, slug, path, end_line (with subsections), own_end (without). Fenced lines and lines indented by four blanks or a tab are none."""
    every = lines(docs)
    flat = every.where(~F.col("raw").rlike("^(    |\t)")).withColumn("trimmed", F.regexp_replace("raw", r"^\s+", ""))
    marks = flat.where(F.col("trimmed").rlike("^[`~]{3,}")).select("doc", "line", F.regexp_extract("trimmed", "^([`~]{3,})", 1).alias("fence"), F.lit("").alias("info"))
    found = flat.where(F.col("trimmed").rlike(HEADING)).join(_fence_fold(marks), "doc", "left")
    inside = F.exists(F.coalesce("fences", F.array().cast("array<struct<s:int,e:int,info:string>>")), lambda f: (F.col("line") > f["s"]) & (F.col("line") < f["e"]))
    found = found.where(~inside).select("doc", "line", F.length(F.regexp_extract("trimmed", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("trimmed", HEADING, 2)).alias("title"))
    sizes = docs.select("doc", F.size(line_array(F.col("text"))).alias("total"))
    later = Window.partitionBy("doc").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.array(*(F.min(F.when(F.col("level") <= k, F.col("line"))).over(later) for k in range(1, 7)))
    last = [F.last(F.when(F.col("level") == k, F.struct("line", "title")), ignorenulls=True).over(upto) for k in range(1, 7)]
    found = found.withColumns({"next": F.element_at(ends, F.col("level")), "follow": F.min("line").over(later), "last": F.array(*last)})
    fits = [_ancestor(k) for k in range(1, 7)]
    path = F.filter(F.array(*fits), lambda t: t.isNotNull())
    return found.join(sizes, "doc").select("doc", "line", "level", "title", slug(F.col("title")).alias("slug"), path.alias("path"), F.coalesce(F.col("next") - 1, F.col("total")).alias("end_line"), F.coalesce(F.col("follow") - 1, F.col("total")).alias("own_end"))


def _ancestor(k: int) -> Column:
    """The title at level k of a heading's path: the last heading of that level, unless a higher one stands after it."""
    own = F.get("last", F.lit(k - 1))
    hidden = F.lit(False)
    for j in range(1, k):
        hidden = hidden | F.coalesce(F.get("last", F.lit(j - 1))["line"] > own["line"], F.lit(False))
    return F.when((F.lit(k) <= F.col("level")) & own.isNotNull() & ~hidden, own["title"])


def blocks(docs: DataFrame) -> DataFrame:
    """doc, idx, start_line, end_line, info, language, source: closed fences, at any indent."""
    every = lines(docs)
    mark = r"(?s)^\s*([`~]{3,})(.*)\z"
    marks = every.where(F.col("raw").rlike(mark)).select("doc", "line", F.regexp_extract("raw", mark, 1).alias("fence"), F.trim(F.regexp_extract("raw", mark, 2)).alias("info"))
    found = _fence_fold(marks).select("doc", F.posexplode(F.filter("fences", lambda f: f["e"] < _FAR)).alias("idx", "f"))
    arrays = docs.select("doc", line_array(F.col("text")).alias("all"))
    body = F.array_join(F.slice("all", F.col("f.s") + 1, F.col("f.e") - F.col("f.s") - 1), "\n")
    return found.join(arrays, "doc").select("doc", "idx", F.col("f.s").alias("start_line"), F.col("f.e").alias("end_line"), F.col("f.info").alias("info"), F.lower(F.coalesce(F.get(F.split("f.info", r"\s+"), F.lit(0)), F.lit(""))).alias("language"), body.alias("source"))


def cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+\z", ""), r"\|", -1), lambda c: F.trim(c))


def separator(row: Column) -> Column:
    return F.forall(cells(row), lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(r"^:?-{3,}:?\z"))


def tables(docs: DataFrame) -> DataFrame:
    """doc, tbl, header_line, last_line, rows: array of the table's raw lines (header, separator, body). A line with a pipe before a separator opens a table; lines with pipes extend it."""
    every = F.transform(line_array(F.col("text")), lambda x, i: F.struct((i + 1).alias("i"), x.contains("|").alias("pipe"), x.alias("raw")))
    start = F.struct(F.lit(0).alias("head"), F.lit(0).alias("prev"), F.lit(0).alias("last"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        open_, goes = acc["head"] > 0, x["pipe"] & (F.trim(x["raw"]) != "")
        opens = (acc["head"] == 0) & (acc["prev"] > 0) & x["pipe"] & separator(x["raw"])
        done = F.array_append(acc["out"], F.struct(acc["head"].alias("a"), acc["last"].alias("b")))
        return F.struct(
            F.when(open_ & goes, acc["head"]).when(opens, acc["prev"]).otherwise(0).alias("head"),
            F.when(~open_ & x["pipe"] & ~opens, x["i"]).otherwise(0).alias("prev"),
            F.when((open_ & goes) | opens, x["i"]).otherwise(0).alias("last"),
            F.when(open_ & ~goes, done).otherwise(acc["out"]).alias("out"),
        )

    finish = lambda acc: F.when(acc["head"] > 0, F.array_append(acc["out"], F.struct(acc["head"].alias("a"), acc["last"].alias("b")))).otherwise(acc["out"])
    found = docs.where(F.col("text").contains("|")).select("doc", line_array(F.col("text")).alias("all"), F.aggregate(every, start, step, finish).alias("t"))
    return found.select("doc", "all", F.posexplode("t").alias("tbl", "r")).select("doc", "tbl", F.col("r.a").alias("header_line"), F.col("r.b").alias("last_line"), F.slice("all", F.col("r.a"), F.col("r.b") - F.col("r.a") + 1).alias("rows"))


def table_cells(docs: DataFrame) -> DataFrame:
    """doc, tbl, row (0: header), col, value: of header and body, values as text."""
    body = tables(docs).select("doc", "tbl", F.posexplode(F.concat(F.slice("rows", 1, 1), F.slice("rows", 3, F.size("rows")))).alias("row", "raw"))
    return body.select("doc", "tbl", "row", F.posexplode(cells(F.col("raw"))).alias("col", "value"))


def links(docs: DataFrame) -> DataFrame:
    """doc, line, kind (inline, reference, image), text, target."""
    every = lines(docs)

    def found(pattern: str, kind: str) -> DataFrame:
        both = F.arrays_zip(F.regexp_extract_all("raw", F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all("raw", F.lit(pattern), F.lit(2)).alias("target"))
        return every.where(F.col("raw").rlike(pattern)).select("doc", "line", F.explode(both).alias("x")).select("doc", "line", F.lit(kind).alias("kind"), F.col("x.text").alias("text"), F.col("x.target").alias("target"))

    return found(INLINE_LINK, "inline").unionByName(found(IMAGE, "image")).unionByName(found(REFERENCE, "reference"))


def stats(docs: DataFrame) -> DataFrame:
    """doc, bytes, lines, words, minutes."""
    words = F.regexp_count("text", F.lit(WORDS)).cast("bigint")
    return docs.select("doc", F.octet_length("text").cast("bigint").alias("bytes"), F.size(line_array(F.col("text"))).cast("bigint").alias("lines"), words.alias("words"), F.greatest(F.lit(1), F.bround(words / 200)).cast("bigint").alias("minutes"))


def search(docs: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, max_results: int = 50) -> DataFrame:
    """doc, line, raw, spans: the first max_results lines of each document that match (max_results is the feature's own limit)."""
    pattern = query if regex else r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    pattern = pattern if case_sensitive else "(?iu)" + pattern
    # the whole text is tested first: documents without a match are never split into lines
    hit = lines(docs.where(F.col("text").rlike(pattern))).where(F.col("raw").rlike(pattern))
    first = F.row_number().over(Window.partitionBy("doc").orderBy("line"))
    return hit.withColumn("k", first).where(F.col("k") <= max_results).select("doc", "line", "raw", F.regexp_count("raw", F.lit(pattern)).cast("bigint").alias("spans"))


def read_near(docs: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """doc, line, raw: the lines round each document's first match."""
    all_lines = line_array(F.col("text"))
    at = F.array_position(F.transform(all_lines, lambda x: x.rlike(pattern)), True).cast("int")
    found = docs.where(F.col("text").rlike(pattern)).select("doc", all_lines.alias("all"), at.alias("at")).where("at > 0")
    low = F.greatest(F.col("at") - before, F.lit(1))
    return found.select("doc", low.alias("low"), F.posexplode(F.slice("all", low, F.col("at") + after - low + 1)).alias("k", "raw")).select("doc", (F.col("low") + F.col("k")).alias("line"), "raw")


def read_range(docs: DataFrame, start: int, end: int) -> DataFrame:
    """doc, line, raw: lines start to end, inclusive."""
    return docs.select("doc", F.posexplode(F.slice(line_array(F.col("text")), start, end - start + 1)).alias("k", "raw")).select("doc", (F.col("k") + start).alias("line"), "raw")


def normalized_levels(docs: DataFrame, max_increment: int = 1) -> DataFrame:
    """doc, line, level, new_level: jumps clamped against the previous new level, the first heading at level 1."""
    per = headings(docs).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "level"))).alias("h"))
    start = F.struct(F.lit(0).alias("prev"), F.array().cast("array<struct<line:int,level:int,new_level:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.when(acc["prev"] == 0, 1).otherwise(F.least(x["level"], acc["prev"] + max_increment))
        return F.struct(new.alias("prev"), F.array_append(acc["out"], F.struct(x["line"].alias("line"), x["level"].alias("level"), new.alias("new_level"))).alias("out"))

    return per.select("doc", F.explode(F.aggregate("h", start, step, lambda a: a["out"])).alias("x")).select("doc", "x.*")


def toc(docs: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """doc, line, entry."""
    return headings(docs).where(F.col("level").between(low, high)).select("doc", "line", F.concat(F.repeat(F.lit("  "), F.col("level") - low), F.lit("- ["), "title", F.lit("](#"), "slug", F.lit(")")).alias("entry"))


def missing_anchors(docs: DataFrame) -> DataFrame:
    """doc, line, target: links to an anchor of their own document that no heading has. Targets are stripped and percent signs decoded."""
    bare = F.trim("target")
    raw = F.replace(F.substring(bare, F.lit(2), F.length(bare)), F.lit("+"), F.lit("%2B"))
    asked = links(docs).where(bare.startswith("#") & (F.length(bare) > 1)).withColumn("anchor", F.coalesce(F.try_url_decode(raw), F.substring(bare, F.lit(2), F.length(bare))))
    return asked.join(headings(docs).select("doc", F.col("slug").alias("anchor")).distinct(), ["doc", "anchor"], "left_anti").select("doc", "line", "target")


def missing_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc, line, target: links to files (no address, no anchor alone) whose path, without anchor and query, is none of files (path)."""
    bare = F.regexp_replace(F.trim("target"), r"[#?].*\z", "")
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare), r"^(\./)+", "")
    asked = links(docs).where(~F.trim("target").rlike(r"(?i)^([a-z][a-z0-9+.-]*:|//|#)")).withColumn("path", path)
    return asked.where("path <> ''").join(files.select("path").distinct(), "path", "left_anti").select("doc", "line", "target")


def table_lines(docs: DataFrame, index: int = 0, kind: str = "csv") -> DataFrame:
    """doc, row, line: a document's table of that index as lines of CSV (row 0 the header) or as one JSON object a body row (missing cells empty)."""
    found = tables(docs).where(F.col("tbl") == index).select("doc", cells(F.get("rows", F.lit(0))).alias("header"), F.transform(F.slice("rows", 3, F.size("rows")), cells).alias("body"))
    field = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    if kind == "json":
        pairs = found.select("doc", "header", F.posexplode("body").alias("row", "v"))
        return pairs.select("doc", (F.col("row") + 1).alias("row"), F.to_json(F.map_from_entries(F.transform("header", lambda h, i: F.struct(h.alias("key"), F.coalesce(F.get("v", i), F.lit("")).alias("value"))))).alias("line"))
    rows = found.select("doc", F.posexplode(F.concat(F.array("header"), "body")).alias("row", "v"))
    return rows.select("doc", "row", F.array_join(F.transform("v", field), ",").alias("line"))


def rendered(table: Column) -> Column:
    """A pipe table's line of array<string> values; pipes and line breaks inside are escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(table, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit("<br>"))), " | "), F.lit(" |"))


def replace_lines(docs: DataFrame, start: int, end: int, replacement: str) -> DataFrame:
    """doc, text: lines start to end replaced."""
    a = line_array(F.col("text"))
    new = F.array_join(F.concat(F.slice(a, 1, start - 1) if start > 1 else F.slice(a, 1, 0), F.array(F.lit(replacement)), F.slice(a, end + 1, F.size(a))), "\n")
    return docs.select("doc", F.when(F.size(a) >= end, new).otherwise(F.col("text")).alias("text"))


def _front(text: Column) -> tuple[Column, Column]:
    """The lines, and the place of the line that closes the front matter among those after the first (0 or null: none)."""
    a = line_array(text)
    return a, F.array_position(F.transform(F.slice(a, 2, F.size(a)), lambda x: F.trim(x)), "---").cast("int")


def front_matter(docs: DataFrame) -> DataFrame:
    """doc, key, value: of a block of key: value lines between two lines ---, the first of which is line 1. Comments and empty lines are none,
    of repeated keys the last counts, one pair of equal quotes goes, true and false and [a, b] are written as JSON."""
    a, end = _front(F.col("text"))
    rows = docs.select("doc", a.alias("a"), end.alias("end")).where((F.trim(F.get("a", F.lit(0))) == "---") & (F.col("end") > 0))
    each = rows.select("doc", F.posexplode(F.slice("a", 2, F.col("end") - 1)).alias("k", "raw")).where(F.col("raw").contains(":") & ~F.trim("raw").startswith("#"))
    bare = lambda v: F.regexp_replace(v, r"""(?s)^(["'])(.*)\1\z""", "$2")
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    each = each.select("doc", "k", F.trim(F.substring_index("raw", ":", 1)).alias("key"), F.trim(F.regexp_replace("raw", r"(?s)^[^:]*:", "")).alias("v"))
    items = F.filter(F.transform(F.split(F.regexp_replace("v", r"^\[|\]\z", ""), ",", -1), lambda x: bare(F.trim(x))), lambda x: x != "")
    value = F.when(F.lower("v").isin("true", "false"), F.lower("v")).when(F.col("v").rlike(r"(?s)^\[.*\]\z"), F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))).otherwise(bare(F.col("v")))
    return each.groupBy("doc", "key").agg(F.max_by(value, "k").alias("value"))


def set_front_matter(docs: DataFrame, changes: dict[str, str | None]) -> DataFrame:
    """doc, text: keys set (behind the others) or, for None, deleted; a document without front matter gets one. Lines of other keys stay as they are."""
    a, end = _front(F.col("text"))
    has = F.coalesce((F.trim(F.get(a, F.lit(0))) == "---") & (end > 0), F.lit(False))
    old = F.when(has, F.slice(a, F.lit(2), F.greatest(end - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(old, lambda x: ~F.trim(F.substring_index(x, ":", 1)).isin(list(changes)) | ~x.contains(":"))
    new = F.array(*(F.lit(f"{k}: {v}") for k, v in changes.items() if v is not None)).cast("array<string>")
    body = F.when(has, F.slice(a, end + 2, F.size(a))).otherwise(a)
    mark = F.array(F.lit("---"))
    return docs.select("doc", F.concat(F.array_join(F.concat(mark, kept, new, mark, body), "\n"), F.lit("\n")).alias("text"))
