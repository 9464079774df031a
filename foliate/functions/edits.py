"""Edits of Markdown documents as DataFrame functions: sections, tables, fenced blocks, links, splits and merges.

A document table has doc and text; an edit returns doc, text of every document. A section is named by its heading's title, or by a list
of titles: the heading's whole path (without regard to case unless exact). A document in which no heading or more than one has the title stays as it is. Lines that an edit
doesn't touch keep their bytes; an added block always stands on lines of its own; an edited text ends with a line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import markdown as md

_FENCE = r"^\s*([`~]{3,})"
#: File endings by language, fixed values.
ENDINGS = {"python": ".py", "py": ".py", "javascript": ".js", "js": ".js", "typescript": ".ts", "ts": ".ts", "bash": ".sh", "sh": ".sh", "json": ".json"}


def raw_lines(text: Column) -> Column:
    """Lines with their carriage returns."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def _text(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit("")).otherwise(F.concat(F.array_join(a, "\n"), F.lit("\n")))


def _block(text: str) -> Column:
    return F.array(*(F.lit(x) for x in text.split("\n")))


def _splice(a: Column, first: Column, last: Column, block: Column | None) -> Column:
    """Lines first to last replaced; last = first - 1 inserts before first."""
    parts = [F.slice(a, F.lit(1), first - 1), F.slice(a, last + 1, F.size(a))]
    return F.concat(parts[0], block, parts[1]) if block is not None else F.concat(*parts)


def _named(title: str | list[str], exact: bool) -> Column:
    """Whether a heading has the title or, for a list, the path."""
    if isinstance(title, str):
        return F.col("title") == title if exact else F.lower("title") == title.lower()
    path, asked = F.array_join("path", "\n"), "\n".join(title)  # titles hold no line ends
    return path == asked if exact else F.lower(path) == asked.lower()


def located(docs: DataFrame, title: str | list[str], exact: bool = False, name: str = "h") -> DataFrame:
    """docs with a struct column (line, level, end_line, own_end) of the one heading with the title, else null."""
    found = md.headings(docs).where(_named(title, exact)).groupBy("doc").agg(F.count("*").alias("__n"), F.first(F.struct("line", "level", "end_line", "own_end")).alias(name)).where("__n = 1").drop("__n")
    return docs.join(found, "doc", "left")


def problems(docs: DataFrame, title: str | list[str], exact: bool = False) -> DataFrame:
    """doc, problem (missing or ambiguous): the documents that an edit by this title leaves as they are."""
    n = docs.select("doc").join(md.headings(docs).where(_named(title, exact)).groupBy("doc").agg(F.count("*").alias("n")), "doc", "left")
    return n.where("n IS NULL OR n > 1").select("doc", F.when(F.col("n").isNull(), "missing").otherwise("ambiguous").alias("problem"))


def _edited(df: DataFrame, lines: Column, asked: Column) -> DataFrame:
    return df.select("doc", F.when(asked, _text(lines)).otherwise(F.col("text")).alias("text"))


def _end(subsections: bool) -> Column:
    return F.col("h.end_line") if subsections else F.col("h.own_end")


def section(docs: DataFrame, title: str | list[str], exact: bool = False, include_heading: bool = True, include_subsections: bool = True) -> DataFrame:
    """doc, text of the section, for documents that have it."""
    first = F.col("h.line") + (0 if include_heading else 1)
    return located(docs, title, exact).where("h IS NOT NULL").select("doc", F.array_join(F.slice(md.line_array(F.col("text")), first, _end(include_subsections) - first + 1), "\n").alias("text"))


def replace_section(docs: DataFrame, title: str | list[str], content: str, exact: bool = False, include_heading: bool = False, include_subsections: bool = True) -> DataFrame:
    first = F.col("h.line") + (0 if include_heading else 1)
    return _edited(located(docs, title, exact), _splice(raw_lines(F.col("text")), first, _end(include_subsections), _block(content.rstrip("\n"))), F.col("h").isNotNull())


def delete_section(docs: DataFrame, title: str | list[str], exact: bool = False, include_subsections: bool = True) -> DataFrame:
    return _edited(located(docs, title, exact), _splice(raw_lines(F.col("text")), F.col("h.line"), _end(include_subsections), None), F.col("h").isNotNull())


def append_to_section(docs: DataFrame, title: str | list[str], content: str, position: str = "end", exact: bool = False, blank_lines: bool = True) -> DataFrame:
    """The block goes to the section's start (an empty line before it) or end (one after it)."""
    at = F.col("h.line") + 1 if position == "start" else F.col("h.end_line") + 1
    text = content.strip("\n")
    if blank_lines:
        text = "\n" + text if position == "start" else text + "\n"
    return _edited(located(docs, title, exact), _splice(raw_lines(F.col("text")), at, at - 1, _block(text)), F.col("h").isNotNull())


def insert_section(docs: DataFrame, title: str, content: str, parent: str | list[str] | None = None, position: str = "end", level: int | None = None, exact: bool = False) -> DataFrame:
    """A new section with one empty line on either side, under a parent (one level deeper) or at the document's start or end."""
    body = content.strip("\n")
    a = raw_lines(F.col("text"))
    if parent is None:
        df, asked, at = docs, F.lit(True), (F.lit(1) if position == "start" else F.size(a) + 1)
        head = F.lit("#" * (level or 1) + " " + title)
    else:
        df = located(docs, parent, exact)
        asked, at = F.col("h").isNotNull(), (F.col("h.line") + 1 if position == "start" else F.col("h.end_line") + 1)
        depth = F.lit(level) if level else F.least(F.col("h.level") + 1, F.lit(6))
        head = F.concat(F.repeat(F.lit("#"), depth), F.lit(" " + title))
    before = F.array_join(F.slice(a, F.lit(1), at - 1), "\n")
    after = F.array_join(F.slice(a, at, F.size(a)), "\n")
    new = F.concat(head, F.lit("\n" + body if body else ""))
    before = F.when(before == "", before).otherwise(F.concat(F.regexp_replace(before, r"\n+\z", ""), F.lit("\n\n")))
    text = F.concat(before, new, F.when(after == "", F.lit("\n")).otherwise(F.concat(F.lit("\n\n"), after, F.lit("\n"))))
    return df.select("doc", F.when(asked, text).otherwise(F.col("text")).alias("text"))


def update_toc(docs: DataFrame, low: int = 1, high: int = 3, start: str = "<!-- md-tools-toc:start -->", end: str = "<!-- md-tools-toc:end -->") -> DataFrame:
    """doc, text: the entries stand between two marked lines, in place of what was there; without the marks they and the entries come first."""
    per = md.toc(docs, low, high).groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "entry"))), lambda x: x["entry"]).alias("toc"))
    a, bare = raw_lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, r"\r+\z", ""))
    first, last = (F.array_position(F.transform(a, bare), mark).cast("int") for mark in (start, end))
    block = F.concat(F.array(F.lit(start)), F.coalesce("toc", F.array().cast("array<string>")), F.array(F.lit(end)))
    there = F.coalesce((first > 0) & (last > first), F.lit(False))
    new = F.when(there, _splice(a, F.greatest(first, F.lit(1)), last, block)).otherwise(F.concat(block, F.array(F.lit("")), a))
    return docs.join(per, "doc", "left").select("doc", _text(new).alias("text"))


def normalize_headings(docs: DataFrame, max_increment: int = 1) -> DataFrame:
    """doc, text, changed: headings at their normalised levels, all other lines as they are."""
    moved = md.normalized_levels(docs, max_increment).where("level <> new_level").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("line", "new_level"))).alias("m"))
    level = lambda i: F.element_at("m", i + 1)
    new = F.transform(raw_lines(F.col("text")), lambda x, i: F.when(level(i).isNull(), x).otherwise(F.concat(F.regexp_extract(x, r"^(\s*)", 1), F.repeat(F.lit("#"), level(i)), F.regexp_extract(x, r"(?s)^\s*#{1,6}(.*)\z", 1))))
    return docs.join(moved, "doc", "left").select("doc", F.when(F.col("m").isNull(), F.col("text")).otherwise(_text(new)).alias("text"), F.coalesce(F.size("m"), F.lit(0)).alias("changed"))


def rename_heading(docs: DataFrame, title: str | list[str], new: str, exact: bool = False) -> DataFrame:
    head = F.concat(F.repeat(F.lit("#"), F.col("h.level")), F.lit(" " + new.strip()))
    return _edited(located(docs, title, exact), _splice(raw_lines(F.col("text")), F.col("h.line"), F.col("h.line"), F.array(head)), F.col("h").isNotNull())


def shifted(lines: Column, delta: Column) -> Column:
    """Headings outside fences moved by delta levels; a level outside 1 to 6 raises an error."""
    start = F.struct(F.lit("").alias("m"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        bare = F.regexp_replace(x, r"\r+\z", "")
        run = F.regexp_extract(bare, _FENCE, 1)
        fence, mark = run != "", F.substring(run, 1, 1)
        closes = fence & (acc["n"] > 0) & (mark == acc["m"]) & (F.length(run) >= acc["n"])
        opens = fence & (acc["n"] == 0)
        heading = ~fence & (acc["n"] == 0) & bare.rlike(r"(?s)^\s*#{1,6}[ \t]+.+\z")
        level = F.length(F.regexp_extract(bare, r"^\s*(#{1,6})", 1)) + delta
        moved = F.concat(F.regexp_extract(bare, r"^(\s*)#", 1), F.repeat(F.lit("#"), level), F.regexp_extract(bare, r"(?s)^\s*#{1,6}([ \t]+.+)\z", 1))
        moved = F.when(level.between(1, 6), moved).otherwise(F.raise_error(F.lit("a heading would leave levels 1 to 6")))
        return F.struct(
            F.when(closes, F.lit("")).when(opens, mark).otherwise(acc["m"]).alias("m"),
            F.when(closes, F.lit(0)).when(opens, F.length(run)).otherwise(acc["n"]).alias("n"),
            F.array_append(acc["out"], F.when(heading, moved).otherwise(bare)).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def set_heading_level(docs: DataFrame, title: str | list[str], level: int, exact: bool = False) -> DataFrame:
    """The heading gets the level; the headings under it move along."""
    a = raw_lines(F.col("text"))
    inside = F.slice(a, F.col("h.line"), F.col("h.end_line") - F.col("h.line") + 1)
    return _edited(located(docs, title, exact), _splice(a, F.col("h.line"), F.col("h.end_line"), shifted(inside, F.lit(level) - F.col("h.level"))), F.col("h").isNotNull())


def move_section(docs: DataFrame, title: str | list[str], target: str | list[str], position: str = "after", under: bool = False, exact: bool = False) -> DataFrame:
    """A section goes before or after another one, or under it (at its start or end) one level deeper. A target inside the section changes nothing."""
    df = located(located(docs, title, exact), target, exact, "t")
    a = raw_lines(F.col("text"))
    block = F.slice(a, F.col("h.line"), F.col("h.end_line") - F.col("h.line") + 1)
    if under:
        block = shifted(block, F.least(F.col("t.level") + 1, F.lit(6)) - F.col("h.level"))
    at = F.col("t.line") if position == "before" else F.col("t.line") + 1 if under and position == "start" else F.col("t.end_line") + 1
    block = F.concat(F.array(F.lit("")), F.split(F.regexp_replace(F.array_join(block, "\n"), r"^\n+|\n+\z", ""), "\n", -1))
    size = F.col("h.end_line") - F.col("h.line") + 1
    rest = _splice(a, F.col("h.line"), F.col("h.end_line"), None)
    # a target that holds the section or stands behind it: its end lies that much earlier once the section is out
    at = F.when(at > F.col("h.line"), F.greatest(at - size, F.col("h.line"))).otherwise(at)
    asked = F.col("h").isNotNull() & F.col("t").isNotNull() & ~F.col("t.line").between(F.col("h.line"), F.col("h.end_line"))
    return _edited(df, _splice(rest, at, at - 1, block), F.coalesce(asked, F.lit(False)))


def replace_text(docs: DataFrame, find: str, replacement: str, regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    """doc, text, replaced. Replacement is taken literally unless regex, then $1 names a group."""
    pattern = find if regex else r"\Q" + find.replace(r"\E", r"\E\\E\Q") + r"\E"
    pattern = pattern if case_sensitive else "(?iu)" + pattern
    new = replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return docs.select("doc", F.regexp_replace("text", pattern, new).alias("text"), F.regexp_count("text", F.lit(pattern)).cast("bigint").alias("replaced"))


def rewrite_links(docs: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """doc, text: targets of links and images that equal a key become its value. One pass over the text, so no target is rewritten twice."""
    both = r"(?s)!?\[[^\]]*\]\([^)]+\)"
    pieces = F.regexp_extract_all("text", F.lit(both + r"|."), F.lit(0))
    table = F.create_map(*(F.lit(x) for kv in replacements.items() for x in kv))
    target = lambda x: F.regexp_extract(x, r"(?s)\]\(([^)]+)\)\z", 1)
    new = F.transform(pieces, lambda x: F.when((F.length(x) > 1) & F.map_contains_key(table, target(x)), F.concat(F.regexp_extract(x, r"(?s)^(.*\]\()[^)]+\)\z", 1), F.element_at(table, target(x)), F.lit(")"))).otherwise(x))
    return docs.select("doc", F.when(F.col("text").rlike(both), F.array_join(new, "")).otherwise(F.col("text")).alias("text"))


def alignments(separator: Column, columns: Column) -> Column:
    """left, right or center of each column; missing ones are left."""
    one = lambda c: F.when(c.rlike("^:.*:\\z"), "center").when(c.rlike(":\\z"), "right").otherwise("left")
    got = F.transform(md.cells(separator), lambda c: one(F.replace(c, F.lit(" "), F.lit(""))))
    return F.slice(F.concat(got, F.array_repeat(F.lit("left"), columns)), F.lit(1), columns)


def _fit(row: Column, n: Column) -> Column:
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def render_table(header: Column, rows: Column, aligned: Column) -> Column:
    """Lines of a padded pipe table; rows get the header's number of cells. Of an odd blank in a centred cell, the left gets more when the width is odd."""
    n = F.size(header)
    body = F.transform(rows, lambda r: _fit(r, n))
    width = F.transform(header, lambda h, i: F.greatest(F.lit(3), F.length(h), F.coalesce(F.array_max(F.transform(body, lambda r: F.length(F.get(r, i)))), F.lit(0))))

    def pad(v: Column, i: Column) -> Column:
        w, side = F.get(width, i), F.get(aligned, i)
        gap = w - F.length(v)
        left = F.floor(gap / 2).cast("int") + F.when((gap % 2 == 1) & (w % 2 == 1), 1).otherwise(0)
        blank = lambda k: F.repeat(F.lit(" "), k.cast("int"))
        return F.when(side == "right", F.concat(blank(gap), v)).when(side == "center", F.concat(blank(left), v, blank(gap - left))).otherwise(F.concat(v, blank(gap)))

    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, pad), " | "), F.lit(" |"))
    rule = F.transform(aligned, lambda s, i: F.concat(F.when(s == "right", "").otherwise(":"), F.repeat(F.lit("-"), F.get(width, i)), F.when(s == "left", "").otherwise(":")))
    return F.concat(F.array(line(header), F.concat(F.lit("| "), F.array_join(rule, " | "), F.lit(" |"))), F.transform(body, line))


def _with_table(docs: DataFrame, index: int) -> DataFrame:
    t = md.tables(docs).where(F.col("tbl") == index).select("doc", "header_line", "last_line", md.cells(F.get("rows", F.lit(0))).alias("header"), F.get("rows", F.lit(1)).alias("rule"), F.transform(F.slice("rows", 3, F.size("rows")), md.cells).alias("body"))
    return docs.join(t.withColumn("aligned", alignments(F.col("rule"), F.size("header"))), "doc", "left")


def edit_table(docs: DataFrame, op: str = "format", index: int = 0, row: int | None = None, col: int | None = None, value: str = "", values: list[str] | None = None, align: str = "left", reverse: bool = False) -> DataFrame:
    """op: format, set_cell, add_row, add_col, del_row, del_col, sort, set_align, on each document's table of that index. Sort is by string and stable."""
    header, body, aligned = F.col("header"), F.col("body"), F.col("aligned")
    n, given = F.size(header), F.array(*(F.lit(v) for v in values or [])).cast("array<string>")
    without = lambda a: F.filter(a, lambda _, i: i != col)
    if op == "set_cell":
        body = F.transform(body, lambda r, i: F.when(i == row, F.transform(_fit(r, n), lambda v, j: F.when(j == col, F.lit(value)).otherwise(v))).otherwise(r))
    elif op == "add_row":
        body = F.array_append(body, given)
    elif op == "add_col":
        body = F.transform(body, lambda r, i: F.array_append(_fit(r, n), F.coalesce(F.get(given, i), F.lit(""))))
        header, aligned = F.array_append(header, F.lit(value or "Column")), F.array_append(aligned, F.lit(align))
    elif op == "del_row":
        body = F.filter(body, lambda _, i: i != row)
    elif op == "del_col":
        header, aligned, body = without(header), without(aligned), F.transform(body, without)
    elif op == "sort":
        keyed = F.transform(body, lambda r, i: F.struct(F.coalesce(F.get(r, F.lit(col)), F.lit("")).alias("k"), (-i if reverse else i).alias("i"), r.alias("r")))
        body = F.transform(F.sort_array(keyed, not reverse), lambda x: x["r"])
    elif op == "set_align":
        aligned = F.transform(aligned, lambda s, j: F.when(j == col, F.lit(align)).otherwise(s))
    elif op != "format":
        raise ValueError(f"no such operation on a table: {op}")
    lines = _splice(raw_lines(F.col("text")), F.col("header_line"), F.col("last_line"), render_table(header, body, aligned))
    return _edited(_with_table(docs, index), lines, F.col("header_line").isNotNull())


def insert_block(docs: DataFrame, block: Column, title: str | list[str] | None = None, position: str = "end", exact: bool = False) -> DataFrame:
    """Lines (array<string>) at the start or end of the document or of a section."""
    a = raw_lines(F.col("text"))
    if title is None:
        at, df, asked = (F.lit(1) if position == "start" else F.size(a) + 1), docs, F.lit(True)
    else:
        df = located(docs, title, exact)
        at, asked = (F.col("h.line") + 1 if position == "start" else F.col("h.end_line") + 1), F.col("h").isNotNull()
    return _edited(df, _splice(a, at, at - 1, block), asked)


def insert_table(docs: DataFrame, header: list[str], rows: list[list[str]], title: str | list[str] | None = None, position: str = "end", aligned: list[str] | None = None) -> DataFrame:
    literal = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    body = F.array(*(literal(r) for r in rows)) if rows else F.array().cast("array<array<string>>")
    lines = render_table(literal(header), body, literal(aligned or ["left"] * len(header)))
    return insert_block(docs, F.concat(F.array(F.lit("")), lines, F.array(F.lit(""))), title, position)


def insert_code_block(docs: DataFrame, source: str, info: str = "", title: str | list[str] | None = None, position: str = "end") -> DataFrame:
    return insert_block(docs, _block("\n```" + info.strip() + "\n" + source.strip("\n") + "\n```"), title, position)


def replace_code_block(docs: DataFrame, source: str, index: int = 0, languages: list[str] | None = None) -> DataFrame:
    """The body of the document's block of that index (among blocks of the languages) becomes source; fence and info stay."""
    found = md.blocks(docs)
    found = found.where(F.col("language").isin(languages)) if languages else found
    per = found.groupBy("doc").agg(F.get(F.sort_array(F.collect_list(F.struct("start_line", "end_line"))), F.lit(index)).alias("b"))
    lines = _splice(raw_lines(F.col("text")), F.col("b.start_line") + 1, F.col("b.end_line") - 1, _block(source.strip("\n")))
    return _edited(docs.join(per, "doc", "left"), lines, F.col("b").isNotNull())


def diagrams(docs: DataFrame) -> DataFrame:
    """doc, idx (among the document's diagrams), start_line, end_line, language, source."""
    from pyspark.sql import Window

    found = md.blocks(docs).where(F.col("language").isin(*md.DIAGRAMS))
    return found.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("start_line")) - 1).select("doc", "idx", "start_line", "end_line", "language", "source")


def images(docs: DataFrame) -> DataFrame:
    """doc, line, alt, src."""
    return md.links(docs).where("kind = 'image'").select("doc", "line", F.col("text").alias("alt"), F.col("target").alias("src"))


def document_map(docs: DataFrame) -> DataFrame:
    """doc, headings, tables, diagrams (without puml), code_blocks, links, images: counts of every document."""
    facts = md.headings(docs).select("doc", F.lit("headings").alias("k"))
    for df, k in ((md.tables(docs), "tables"), (md.blocks(docs), "code_blocks"), (md.blocks(docs).where("language IN ('mermaid', 'plantuml', 'dot', 'graphviz')"), "diagrams")):
        facts = facts.unionByName(df.select("doc", F.lit(k).alias("k")))
    facts = facts.unionByName(md.links(docs).select("doc", F.when(F.col("kind") == "image", "images").otherwise("links").alias("k")))
    names = ["headings", "tables", "diagrams", "code_blocks", "links", "images"]
    counts = facts.groupBy("doc").agg(*(F.count_if(F.col("k") == k).alias(k) for k in names))
    return docs.select("doc").join(counts, "doc", "left").fillna(0, names)


def tangle(docs: DataFrame, language: str | None = None) -> DataFrame:
    """doc, path, content: a file a block, named by file= in its info or by number and language. A path that leaves the folder raises an error."""
    from pyspark.sql import Window

    found = md.blocks(docs)
    found = found.where(F.col("language") == language.lower()) if language else found
    number = F.row_number().over(Window.partitionBy("doc").orderBy("start_line"))
    named = F.regexp_replace(F.regexp_extract("info", r"^\S+.*\sfile=(\S+)", 1), "^[\"']+|[\"']+\\z", "")
    ending = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ENDINGS.items() for x in kv)), F.col("language")), F.lit(".txt"))
    path = F.when(named != "", named).otherwise(F.concat(F.lit("block_"), F.col("number").cast("string"), ending))
    safe = ~F.col("path").rlike(r"^/|(^|/)\.\.(/|\z)")
    return found.withColumn("number", number).withColumn("path", path).select("doc", F.when(safe, F.col("path")).otherwise(F.raise_error(F.lit("a block's path leaves the folder"))).alias("path"), F.concat("source", F.lit("\n")).alias("content"))


def split(docs: DataFrame, level: int = 1) -> DataFrame:
    """doc, path, text: a part for each heading of the level, with its subsections."""
    from pyspark.sql import Window

    found = md.headings(docs).where(F.col("level") == level).withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("line")))
    number = F.when(F.col("i") < 10, F.concat(F.lit("0"), F.col("i").cast("string"))).otherwise(F.col("i").cast("string"))
    name = F.when(F.col("slug") == "", F.concat(F.lit("section-"), F.col("i").cast("string"))).otherwise(F.col("slug"))
    body = F.concat(F.array_join(F.slice(md.line_array(F.col("text")), F.col("line"), F.col("end_line") - F.col("line") + 1), "\n"), F.lit("\n"))
    return found.join(docs, "doc").select("doc", F.concat(number, F.lit("-"), name, F.lit(".md")).alias("path"), body.alias("text"))


def merge(docs: DataFrame, group: str, order: str, heading_offset: int = 0, separator: str = "\n") -> DataFrame:
    """group, text: documents of a group (one output file, so it must fit a row) in the order of a column."""
    text = _text(shifted(raw_lines(F.col("text")), F.lit(heading_offset))) if heading_offset else F.col("text")
    parts = docs.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.regexp_replace(text, r"^\n+|\n+\z", "").alias("t")))).alias("p"))
    return parts.select(group, F.concat(F.array_join(F.transform("p", lambda x: x["t"]), separator), F.lit("\n")).alias("text"))


def to_html(docs: DataFrame, body_only: bool = True) -> DataFrame:
    """doc, html: headings, paragraphs and code between lines of three backticks; an open fence drops its lines."""
    escape = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("code"), F.array().cast("array<string>").alias("out"))
    head = r"(?s)^(#{1,6})\s+(.+)\z"

    def step(acc: Column, x: Column) -> Column:
        fence, none = x.startswith("```"), F.array().cast("array<string>")
        n, title = F.length(F.regexp_extract(x, head, 1)).cast("string"), F.regexp_extract(x, head, 2)
        tag = F.when(x.rlike(head), F.concat(F.lit("<h"), n, F.lit(' id="'), md.slug(title), F.lit('">'), escape(title), F.lit("</h"), n, F.lit(">"))).when(F.trim(x) != "", F.concat(F.lit("<p>"), escape(x), F.lit("</p>")))
        done = F.concat(F.lit("<pre><code>"), escape(F.array_join(acc["code"], "\n")), F.lit("</code></pre>"))
        out = F.when(fence & acc["inside"], F.array_append(acc["out"], done)).when(~fence & ~acc["inside"] & tag.isNotNull(), F.array_append(acc["out"], tag)).otherwise(acc["out"])
        return F.struct((acc["inside"] != fence).alias("inside"), F.when(acc["inside"] & ~fence, F.array_append(acc["code"], x)).otherwise(none).alias("code"), out.alias("out"))

    body = F.array_join(F.aggregate(md.line_array(F.col("text")), start, step, lambda acc: acc["out"]), "\n")
    page = body if body_only else F.concat(F.lit("<!doctype html>\n<html><body>\n"), body, F.lit("\n</body></html>\n"))
    return docs.select("doc", page.alias("html"))
