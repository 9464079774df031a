"""Registered queries of Markdown edits. Each customer is a small document; the SQL states the edited text from the table's columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import edits
from foliate.plans.registry import _query, _table


def _sql(lines: str) -> str:
    """Lines with {column} as an SQL text that ends with a line break."""
    parts = [p for line in lines.split("\n") for p in [*(x for x in re.split(r"(\{\w+\})", line) if x), "\n"]]
    return " || ".join("chr(10)" if p == "\n" else p[1:-1] if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'" for p in parts)


def _column(lines: str) -> Column:
    return F.concat(*(F.col(p[1:-1]) if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in re.split(r"(\{\w+\})", lines + "\n") if p))


def _docs(spark: SparkSession, sf_dir: str, lines: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), _column(lines).alias("text"))


def _expects(*columns: str) -> str:
    return "SELECT c_custkey AS doc, " + ", ".join(columns) + " FROM customer"


def _edit(lines: str):
    return _query(_expects(_sql(lines) + " AS text"))


CARD = "# {c_name}\nintro\n## Alpha\na\n### Beta\nb\n```md\n# not one\n```\n## Gamma\nc {c_mktsegment}"
GRID = "{c_name}\n\n| item | n |\n|---|---:|\n| b | 7 |\n| {c_mktsegment}xxxxxxxxxx | 10 |\n| a |\n\nend"
CODE = "# Code\n```python file=src/x.py\nprint({c_custkey_text})\n```\n~~~mermaid\ngraph {c_name}\n~~~\n![logo]({c_name}.png) and [site](old)\n```puml\nA\n```"


def _code(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("c_custkey_text", F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("doc"), _column(CODE).alias("text"))


def _code_sql(lines: str) -> str:
    return _sql(lines).replace("c_custkey_text", "CAST(c_custkey AS VARCHAR)")


@_edit("## Alpha\na\n### Beta\nb\n```md\n# not one\n```")
def read_markdown_section(spark, sf_dir):
    return edits.section(_docs(spark, sf_dir, CARD), "alpha").withColumn("text", F.concat("text", F.lit("\n")))


@_edit("# {c_name}\nintro\n## Alpha\nnew\n## Gamma\nc {c_mktsegment}")
def replace_markdown_section(spark, sf_dir):
    return edits.replace_section(_docs(spark, sf_dir, CARD), "Alpha", "new\n")


@_edit("# {c_name}\nintro\n## Alpha\na\n### Beta\nb\n```md\n# not one\n```\n\n### Delta\nd\n\n## Gamma\nc {c_mktsegment}")
def md_insert_section(spark, sf_dir):
    return edits.insert_section(_docs(spark, sf_dir, CARD), "Delta", "d", parent="Alpha")


@_edit("# {c_name}\nintro\n## Gamma\nc {c_mktsegment}")
def md_delete_section(spark, sf_dir):
    return edits.delete_section(_docs(spark, sf_dir, CARD), "Alpha")


@_edit("# {c_name}\nintro\n## Alpha\na\n### Beta\nb\n```md\n# not one\n```\nmore\n\n## Gamma\nc {c_mktsegment}")
def md_append_to_section(spark, sf_dir):
    return edits.append_to_section(_docs(spark, sf_dir, CARD), "Beta", "more")


@_edit("# {c_name}\nintro\n## Alpha\na\n### Beta 2\nb\n```md\n# not one\n```\n## Gamma\nc {c_mktsegment}")
def md_rename_heading(spark, sf_dir):
    return edits.rename_heading(_docs(spark, sf_dir, CARD), "beta", "Beta 2")


@_edit("# {c_name}\nintro\n#### Alpha\na\n##### Beta\nb\n```md\n# not one\n```\n## Gamma\nc {c_mktsegment}")
def md_set_heading_level(spark, sf_dir):
    return edits.set_heading_level(_docs(spark, sf_dir, CARD), "Alpha", 4)


@_edit("# {c_name}\nintro\n## Alpha\na\n## Gamma\nc {c_mktsegment}\n\n### Beta\nb\n```md\n# not one\n```")
def md_move_section(spark, sf_dir):
    return edits.move_section(_docs(spark, sf_dir, CARD), "Beta", "Gamma", under=True)


@_query(_expects("replace(" + _sql(CARD) + ", 'a', '$1') AS text", "CAST(length(" + _sql(CARD) + ") - length(replace(" + _sql(CARD) + ", 'a', '')) AS BIGINT) AS replaced"))
def md_replace_text(spark, sf_dir):
    return edits.replace_text(_docs(spark, sf_dir, CARD), "a", "$1")


@_query(_expects("CAST(4 AS BIGINT) AS headings", "CAST(0 AS BIGINT) AS tables", "CAST(0 AS BIGINT) AS diagrams", "CAST(1 AS BIGINT) AS code_blocks", "CAST(0 AS BIGINT) AS links", "CAST(0 AS BIGINT) AS images"))
def md_get_document_map(spark, sf_dir):
    return edits.document_map(_docs(spark, sf_dir, CARD))


#: Cells of GRID's first column are as wide as the segment and ten letters more.
_WIDE = "(length(c_mktsegment) + 10)"


def _grid_sql(rows: list[tuple[str, str]], second: int = 3, rule: str = "':'", head: str = "item") -> str:
    """Of a two-column table: first cells are SQL texts, padded to the wide cell; second ones stand at the right."""
    line = lambda a, b: f"'| ' || rpad({a}, CAST({_WIDE} AS INT), ' ') || ' | ' || lpad('{b}', {second}, ' ') || ' |' || chr(10)"
    parts = [_sql("{c_name}\n"), line(f"'{head}'", "n"), f"'| :' || repeat('-', CAST({_WIDE} AS INT)) || ' | {'-' * second}:' || ' |' || chr(10)", *(line(a, b) for a, b in rows), _sql("\nend")]
    return " || ".join(parts)


_LONG = "c_mktsegment || 'xxxxxxxxxx'"


@_query(_expects(_grid_sql([("'b'", "7"), (_LONG, "10"), ("'a'", "")]) + " AS text"))
def md_format_table(spark, sf_dir):
    return edits.edit_table(_docs(spark, sf_dir, GRID))


@_query(_expects(_grid_sql([("'b'", "7"), (_LONG, "10"), ("'a'", ""), ("'z'", "1000")], second=4) + " AS text"))
def md_edit_table(spark, sf_dir):
    return edits.edit_table(_docs(spark, sf_dir, GRID), "add_row", values=["z", "1000"])


@_query(_expects(_grid_sql([("'b'", "7"), (_LONG, "10"), ("'a'", "")]) + " AS text"))
def md_edit_table_sort(spark, sf_dir):
    return edits.edit_table(_docs(spark, sf_dir, GRID), "sort", col=1, reverse=True)


@_edit(CARD + "\n\n| k   | value |\n| :--- | -----: |\n| x   |     1 |\n")
def md_insert_table(spark, sf_dir):
    return edits.insert_table(_docs(spark, sf_dir, CARD), ["k", "value"], [["x", "1"]], aligned=["left", "right"])


@_query(_expects("0 AS idx", "5 AS start_line", "'mermaid' AS language", "'graph ' || c_name AS source") + " UNION ALL SELECT c_custkey, 1, 9, 'puml', 'A' FROM customer")
def md_list_diagrams(spark, sf_dir):
    return edits.diagrams(_code(spark, sf_dir)).select("doc", "idx", "start_line", "language", "source")


@_query(_expects("'A' AS source"))
def md_read_diagram(spark, sf_dir):
    return edits.diagrams(_code(spark, sf_dir)).where("idx = 1").select("doc", "source")


@_edit(CARD + "\n\n```mermaid\ngraph TD\n```")
def md_insert_diagram(spark, sf_dir):
    return edits.insert_code_block(_docs(spark, sf_dir, CARD), "graph TD", "mermaid")


@_query(_expects(_code_sql(CODE.replace("graph {c_name}", "graph LR\nx")) + " AS text"))
def md_replace_diagram(spark, sf_dir):
    from foliate.functions.markdown import DIAGRAMS

    return edits.replace_code_block(_code(spark, sf_dir), "graph LR\nx", 0, list(DIAGRAMS))


@_query(_expects(_code_sql(CODE.replace("\nA\n", "\nB\n")) + " AS text"))
def md_replace_code_block(spark, sf_dir):
    return edits.replace_code_block(_code(spark, sf_dir), "B", 2)


@_edit("# {c_name}\nintro\n## Alpha\na\n### Beta\n\n```sql\nselect 1\n```\nb\n```md\n# not one\n```\n## Gamma\nc {c_mktsegment}")
def md_insert_code_block(spark, sf_dir):
    return edits.insert_code_block(_docs(spark, sf_dir, CARD), "select 1", "sql", "Beta", "start")


@_query(_expects("8 AS line", "'logo' AS alt", "c_name || '.png' AS src"))
def md_list_images(spark, sf_dir):
    return edits.images(_code(spark, sf_dir))


@_query(_expects(_code_sql(CODE.replace("(old)", "(new)")) + " AS text"))
def md_rewrite_links(spark, sf_dir):
    return edits.rewrite_links(_code(spark, sf_dir), {"old": "new", "new": "never"})


@_query(_expects("'src/x.py' AS path", "'print(' || CAST(c_custkey AS VARCHAR) || ')' || chr(10) AS content") + " UNION ALL SELECT c_custkey, 'block_2.txt', 'graph ' || c_name || chr(10) FROM customer UNION ALL SELECT c_custkey, 'block_3.txt', 'A' || chr(10) FROM customer")
def md_tangle(spark, sf_dir):
    return edits.tangle(_code(spark, sf_dir))


@_query(_expects("'01-alpha.md' AS path", _sql("## Alpha\na\n### Beta\nb\n```md\n# not one\n```") + " AS text") + " UNION ALL SELECT c_custkey, '02-gamma.md', " + _sql("## Gamma\nc {c_mktsegment}") + " FROM customer")
def md_split(spark, sf_dir):
    return edits.split(_docs(spark, sf_dir, CARD), 2)


@_query("SELECT n_regionkey, string_agg('## ' || n_name || chr(10) || 'x', chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation GROUP BY n_regionkey")
def md_merge(spark, sf_dir):
    docs = _table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat(F.lit("# "), "n_name", F.lit("\nx\n")).alias("text"))
    return edits.merge(docs, "n_regionkey", "n_nationkey", heading_offset=1, separator="\n\n")


@_query(_expects("""'<h1 id="' || replace(lower(c_name), '#', '') || '">' || c_name || '</h1>' || chr(10) || '<p>a &lt;b&gt; &amp; c</p>' || chr(10) || '<pre><code># x' || chr(10) || '</code></pre>' AS html"""))
def md_to_html(spark, sf_dir):
    return edits.to_html(_docs(spark, sf_dir, "# {c_name}\n\na <b> & c\n```py\n# x\n\n```"))


@_query(_expects("8 AS line", "'old' AS target") + " WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 8, c_name || '.png' FROM customer")
def md_check_internal_links(spark, sf_dir):
    from foliate.functions import markdown as md

    docs, files = _code(spark, sf_dir), spark.createDataFrame([("old",)], "path string")
    return md.missing_files(docs.where("doc % 2 = 0"), files).unionByName(md.missing_files(docs.where("doc % 2 = 1"), files.where("false")))


TWICE = "# A\n## Setup\na\n# B\n## Setup\nb {c_name}"


@_edit("# A\n## Setup\na\n# B\n## Setup\nnew")
def replace_section_by_path(spark, sf_dir):
    return edits.replace_section(_docs(spark, sf_dir, TWICE), ["b", "setup"], "new")


@_query(_expects("'ambiguous' AS problem"))
def section_problems(spark, sf_dir):
    return edits.problems(_docs(spark, sf_dir, TWICE), "Setup")


@_edit("<!-- md-tools-toc:start -->\n- [A](#a)\n  - [Setup](#setup)\n- [B](#b)\n  - [Setup](#setup)\n<!-- md-tools-toc:end -->\n\n" + TWICE)
def md_update_toc_text(spark, sf_dir):
    return edits.update_toc(edits.update_toc(_docs(spark, sf_dir, TWICE)))


@_query(_expects(_sql("# A\n## Too Deep {c_name}\n```\n#### x\n```\n### c") + " AS text", "1 AS changed"))
def md_normalize_headings_text(spark, sf_dir):
    return edits.normalize_headings(_docs(spark, sf_dir, "# A\n#### Too Deep {c_name}\n```\n#### x\n```\n### c"))


@_edit("---\nb: [x, y]\n# note: x\ntitle: New\n---\nbody {c_name}")
def md_frontmatter_set(spark, sf_dir):
    from foliate.functions import markdown as md

    return md.set_front_matter(_docs(spark, sf_dir, "---\ntitle: Old\nb: [x, y]\nc: 1\n# note: x\n---\nbody {c_name}"), {"title": "New", "c": None})


@_query(_expects("unnest(['title', 'b', 'flag', 'q']) AS key", "unnest(['Two', '[\"x\", \"y z\"]', 'true', c_name]) AS value"))
def md_frontmatter_kinds(spark, sf_dir):
    from foliate.functions import markdown as md

    return md.front_matter(_docs(spark, sf_dir, "---\ntitle: One\nb: [x, 'y z']\n# note: x\nflag: TRUE\ntitle: Two\nq: \"{c_name}\"\n---\nbody"))
