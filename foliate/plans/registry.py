"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and each one's SQL on the same tables.

Structural Markdown queries run on a report that is rendered from region, nation and supplier and parsed back; their SQL
computes the same facts from the tables, without any parsing. Sheet queries run on orders as a sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import markdown as md
from foliate.operators import grid


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc (region key), text: a heading a region, a section a nation with a table of its suppliers, a code block and two links."""
    supplier, nation, region = (_table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    row = md.rendered(F.array(F.col("s_suppkey").cast("string"), "s_name"))
    rows = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    key = F.col("n_nationkey").cast("string")
    section = F.concat(
        F.lit("## "), "n_name", F.lit("\n\n| key | name |\n| --- | :--- |\n"), F.coalesce(F.concat("rows", F.lit("\n")), F.lit("")),
        F.lit("\n```sql\nselect "), key, F.lit("\n```\nSee ["), "n_name", F.lit("](#"), md.slug(F.col("n_name")), F.lit(") and [x](#missing-"), key, F.lit(").\n"),
    )
    sections = nation.join(rows, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", section.alias("s")))), lambda x: x["s"]), "").alias("body"))
    return region.join(sections, "r_regionkey").select(F.col("r_regionkey").cast("bigint").alias("doc"), F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "body").alias("text"))


#: Of each nation in the report: its section's first line and its number of suppliers.
_SECTIONS = """n AS (SELECT n.n_nationkey, n.n_name, n.n_regionkey, r.r_name, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS k FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey),
sec AS (SELECT *, CAST(3 + coalesce(sum(9 + k) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line,
  CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS idx FROM n)"""
_LINES = "l AS (SELECT doc_id AS doc, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) AS line FROM documents WHERE length(text) > 0)"

_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.to_cells(_table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS), "orders", ["o_orderkey"], _ORDER_COLUMNS)


_CELLS = """r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row, CAST(o_orderkey AS VARCHAR) AS c0, CAST(o_custkey AS VARCHAR) AS c1, o_orderstatus AS c2, o_orderpriority AS c3 FROM orders),
h AS (SELECT CAST(0 AS BIGINT) AS row, 'o_orderkey' AS c0, 'o_custkey' AS c1, 'o_orderstatus' AS c2, 'o_orderpriority' AS c3 UNION ALL SELECT * FROM r),
cells AS (SELECT row, 0 AS col, c0 AS txt FROM h UNION ALL SELECT row, 1, c1 FROM h UNION ALL SELECT row, 2, c2 FROM h UNION ALL SELECT row, 3, c3 FROM h)"""

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@_query(rf"""WITH {_LINES}, m AS (SELECT doc, line, raw, row_number() OVER (PARTITION BY doc ORDER BY line) AS k FROM l WHERE regexp_matches(raw, '(?i)licen[sc]e'))
SELECT doc, CAST(line AS INT) AS line, raw, CAST(len(regexp_extract_all(raw, '(?i)licen[sc]e')) AS BIGINT) AS spans FROM m WHERE k <= 3""")
def md_search(spark, sf_dir):
    return md.search(_docs(spark, sf_dir), "licen[sc]e", regex=True, max_results=3)


@_query(rf"""SELECT doc_id AS doc, CAST(strlen(text) AS BIGINT) AS bytes, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) END AS BIGINT) AS lines,
CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS BIGINT) AS words, CAST(greatest(1, round_even(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) / 200, 0)) AS BIGINT) AS minutes FROM documents""")
def md_stats(spark, sf_dir):
    return md.stats(_docs(spark, sf_dir))


@_query(f"WITH {_LINES} SELECT doc, CAST(line AS INT) AS line, raw FROM l WHERE line BETWEEN 2 AND 4")
def md_read_range(spark, sf_dir):
    return md.read_range(_docs(spark, sf_dir), 2, 4)


@_query(f"WITH {_LINES}, m AS (SELECT doc, min(line) AS first_hit FROM l WHERE contains(raw, '@') GROUP BY doc) SELECT l.doc, CAST(line AS INT) AS line, raw FROM l JOIN m ON l.doc = m.doc AND line BETWEEN first_hit - 2 AND first_hit + 1")
def md_read_near(spark, sf_dir):
    return md.read_near(_docs(spark, sf_dir), "@", 2, 1)


@_query("SELECT p_partkey, replace(regexp_replace(lower(trim(p_name || ' (' || p_brand || ')')), '[^\\p{L}\\p{N}\\p{M} _-]', '', 'g'), ' ', '-') AS slug FROM part")
def md_get_anchor(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", md.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@_query(f"""WITH {_SECTIONS} SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(line AS INT) AS line, 2 AS level, n_name AS title, r_name || '/' || n_name AS path, CAST(line + 8 + k AS INT) AS end_line FROM sec
UNION ALL SELECT CAST(n_regionkey AS BIGINT), 1, 1, r_name, r_name, CAST(2 + sum(9 + k) AS INT) FROM n GROUP BY n_regionkey, r_name""")
def markdown_outline(spark, sf_dir):
    return md.headings(_report(spark, sf_dir)).select("doc", "line", "level", "title", F.array_join("path", "/").alias("path"), "end_line")


@_query(f"WITH {_SECTIONS} SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(idx AS INT) AS tbl, CAST(line + 2 AS INT) AS header_line, CAST(line + 3 + k AS INT) AS last_line FROM sec")
def md_list_tables(spark, sf_dir):
    return md.tables(_report(spark, sf_dir)).select("doc", "tbl", "header_line", "last_line")


@_query(f"""WITH {_SECTIONS}, s AS (SELECT n_regionkey, idx, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row FROM sec JOIN supplier ON s_nationkey = n_nationkey)
SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(idx AS INT) AS tbl, CAST(row AS INT) AS row, 0 AS col, CAST(s_suppkey AS VARCHAR) AS value FROM s UNION ALL
SELECT CAST(n_regionkey AS BIGINT), CAST(idx AS INT), CAST(row AS INT), 1, s_name FROM s UNION ALL
SELECT CAST(n_regionkey AS BIGINT), CAST(idx AS INT), 0, 0, 'key' FROM sec UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(idx AS INT), 0, 1, 'name' FROM sec""")
def md_read_table(spark, sf_dir):
    return md.table_cells(_report(spark, sf_dir))


@_query(f"WITH {_SECTIONS} SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(idx AS INT) AS idx, CAST(line + 5 + k AS INT) AS start_line, CAST(line + 7 + k AS INT) AS end_line, 'sql' AS language, 'select ' || n_nationkey AS source FROM sec")
def md_extract_code_blocks(spark, sf_dir):
    return md.blocks(_report(spark, sf_dir)).select("doc", "idx", "start_line", "end_line", "language", "source")


@_query(f"""WITH {_SECTIONS} SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(line + 8 + k AS INT) AS line, 'inline' AS kind, n_name AS text, '#' || replace(lower(n_name), ' ', '-') AS target FROM sec
UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(line + 8 + k AS INT), 'inline', 'x', '#missing-' || n_nationkey FROM sec""")
def md_list_links(spark, sf_dir):
    return md.links(_report(spark, sf_dir))


@_query(f"WITH {_SECTIONS} SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(line + 8 + k AS INT) AS line, '#missing-' || n_nationkey AS target FROM sec")
def md_validate_links(spark, sf_dir):
    return md.missing_anchors(_report(spark, sf_dir))


@_query(f"""WITH {_SECTIONS} SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(line AS INT) AS line, '  - [' || n_name || '](#' || replace(lower(n_name), ' ', '-') || ')' AS entry FROM sec
UNION ALL SELECT DISTINCT CAST(n_regionkey AS BIGINT), 1, '- [' || r_name || '](#' || replace(lower(r_name), ' ', '-') || ')' FROM n""")
def md_update_toc(spark, sf_dir):
    return md.toc(_report(spark, sf_dir))


@_query("SELECT c_custkey AS doc, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def md_frontmatter(spark, sf_dir):
    text = F.concat(F.lit("---\nname: "), "c_name", F.lit("\nsegment: '"), "c_mktsegment", F.lit("'\n---\n# x\nkey: none\n"))
    return md.front_matter(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), text.alias("text")))


@_query("SELECT c_custkey AS doc, '# ' || c_name || chr(10) || 'new' || chr(10) || 'c' AS text FROM customer")
def md_patch_lines(spark, sf_dir):
    return md.replace_lines(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.concat(F.lit("# "), "c_name", F.lit("\na\nb\nc\n")).alias("text")), 2, 3, "new")


@_query("""SELECT c_custkey AS doc, line, level, new_level FROM customer, (SELECT 1 AS line, 2 AS level, 1 AS new_level UNION ALL SELECT 2, 4, 2 UNION ALL SELECT 3, 4, 3 UNION ALL SELECT 4, 1, 1 UNION ALL SELECT 5, 6, 2) t""")
def md_normalize_headings(spark, sf_dir):
    return md.normalized_levels(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit("## a\n#### b\n#### c\n# d\n###### e").alias("text")))


@_query(f"WITH {_CELLS} SELECT row, col, txt FROM cells WHERE row BETWEEN 5 AND 24 AND col BETWEEN 1 AND 3 UNION ALL SELECT unnest(generate_series(5::BIGINT, 24)), 4, NULL")
def excel_read_range(spark, sf_dir):
    return grid.read_range(_sheet(spark, sf_dir), *grid.bounds("orders!$B$6:$E$25"))


@_query(f"WITH {_CELLS} SELECT 'orders' AS sheet, row, txt FROM cells WHERE col = 3 AND row >= 10 AND row < 500")
def excel_get_column(spark, sf_dir):
    return grid.column(_sheet(spark, sf_dir), 3, 10, 500)


@_query(f"WITH {_CELLS} SELECT 'orders' AS sheet, row, col, txt FROM cells WHERE contains(lower(txt), 'urgent') ORDER BY row, col LIMIT 100")
def excel_find_cells(spark, sf_dir):
    return grid.find_cells(_sheet(spark, sf_dir), "URGENT")


@_query(f"WITH {_CELLS} SELECT row, c0 || ',' || c1 || ',' || c2 || ',' || c3 AS line FROM h WHERE c2 = 'P'")
def excel_find_rows(spark, sf_dir):
    return grid.find_rows(_sheet(spark, sf_dir), 2, value="P").select("row", F.array_join("values", ",").alias("line"))


@_query(f"WITH {_CELLS} SELECT 'orders' AS sheet, max(row) + 1 AS n_rows, CAST(4 AS BIGINT) AS n_cols, count(*) AS non_empty, CAST(0 AS BIGINT) AS formulas FROM cells")
def excel_get_workbook_summary(spark, sf_dir):
    return grid.summary(_sheet(spark, sf_dir))


@_query(f"WITH {_CELLS} SELECT 'orders' AS sheet, col, round_even(greatest(8.0, least(60.0, max(length(txt)) * CAST(1.1 AS DOUBLE) + 2)), 1) AS width FROM cells GROUP BY col")
def excel_autofit_cols(spark, sf_dir):
    return grid.autofit(_sheet(spark, sf_dir))


@_query(f"WITH {_CELLS} SELECT row, '| ' || c0 || ' | ' || c1 || ' | ' || c2 || ' |' AS line FROM h WHERE row <= 50")
def excel_to_markdown_range(spark, sf_dir):
    return grid.to_markdown(_sheet(spark, sf_dir), 0, 0, 50, 2)


@_query(f"""WITH t AS (SELECT n_regionkey, n_nationkey FROM nation a WHERE (SELECT count(*) FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey) = 1)
SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS row, s_suppkey || ',' || s_name AS line FROM t JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT CAST(n_regionkey AS BIGINT), 0, 'key,name' FROM t""")
def md_table_export(spark, sf_dir):
    return md.table_lines(_report(spark, sf_dir), 1)


@_query(f"""WITH t AS (SELECT n_regionkey, n_nationkey FROM nation a WHERE (SELECT count(*) FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey) = 1)
SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS row, '{{"key":"' || s_suppkey || '","name":"' || s_name || '"}}' AS line FROM t JOIN supplier ON s_nationkey = n_nationkey""")
def md_table_export_json(spark, sf_dir):
    return md.table_lines(_report(spark, sf_dir), 1, "json")


@_query(f"WITH {_CELLS} SELECT row + CASE WHEN row > 10 THEN 2 ELSE 0 END + CASE WHEN row > 100 THEN 3 ELSE 0 END AS row, col, txt FROM cells")
def excel_insert_rows(spark, sf_dir):
    return grid.insert_rows(_sheet(spark, sf_dir), [(10, 2), (100, 3)]).select("row", "col", "txt")


@_query(f"WITH {_CELLS} SELECT row - CASE WHEN row > 3 THEN 1 ELSE 0 END - CASE WHEN row > 40 THEN 2 ELSE 0 END AS row, col, txt FROM cells WHERE row NOT IN (3, 39, 40)")
def excel_delete_rows(spark, sf_dir):
    return grid.delete_rows(_sheet(spark, sf_dir), [40, 3, 39]).select("row", "col", "txt")


@_query(f"WITH {_CELLS} SELECT row, CASE WHEN col > 1 THEN col - 1 ELSE col END AS col, txt FROM cells WHERE col <> 1")
def excel_delete_column(spark, sf_dir):
    return grid.delete_column(_sheet(spark, sf_dir), 1).select("row", "col", "txt")


@_query(f"WITH {_CELLS} SELECT row, CASE WHEN col > 1 THEN col + 1 ELSE col END AS col, txt FROM cells")
def excel_insert_column(spark, sf_dir):
    return grid.insert_column(_sheet(spark, sf_dir), 1).select("row", "col", "txt")


@_query(f"WITH {_CELLS} SELECT row, col, CASE WHEN row = 4 AND col = 2 THEN 'new' ELSE txt END AS txt FROM cells UNION ALL SELECT CAST(2 AS BIGINT), 9, 'far'")
def excel_edit_cells(spark, sf_dir):
    edits = spark.createDataFrame([("orders", 4, 2, 1, "old", None), ("orders", 4, 2, 2, "new", None), ("orders", 2, 9, 1, "far", None)], "sheet string, row bigint, col int, seq int, txt string, num double")
    return grid.edit_cells(_sheet(spark, sf_dir), edits).select("row", "col", "txt")


@_query(f"WITH {_CELLS} SELECT row, col, CASE WHEN row BETWEEN 2 AND 9 AND col BETWEEN 1 AND 2 THEN NULL ELSE txt END AS txt FROM cells")
def excel_clear_range(spark, sf_dir):
    return grid.clear_range(_sheet(spark, sf_dir), 2, 1, 9, 2).select("row", "col", "txt")


@_query(f"WITH {_CELLS} SELECT row, col, CASE WHEN col = 1 AND row BETWEEN 1 AND 60 THEN CAST(10 + (row - 1) * 5 AS DOUBLE) ELSE TRY_CAST(txt AS DOUBLE) END AS num FROM cells")
def excel_fill_column(spark, sf_dir):
    return grid.fill_column(_sheet(spark, sf_dir), 1, 1, 60, 10.0, 5.0).select("row", "col", "num")


@_query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'modified' END AS change, o_orderstatus AS before, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'X' END AS after FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderstatus = 'P')
UNION ALL SELECT -1, 'added', NULL, 'Z'""")
def excel_diff_package(spark, sf_dir):
    before = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    after = before.where("k % 7 <> 0").withColumn("value", F.when(F.col("value") == "P", "X").otherwise(F.col("value"))).unionByName(spark.createDataFrame([(-1, "Z")], "k bigint, value string"))
    return grid.differences(before, after, ["k"])


@_query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_nationkey AS sheet, CAST(c_custkey % 40 AS BIGINT) AS r1, CAST(c_custkey % 7 AS BIGINT) AS c1 FROM customer)
SELECT CAST(a.sheet AS VARCHAR) AS sheet, a.id AS a, b.id AS b FROM c a JOIN c b ON a.sheet = b.sheet AND a.id < b.id AND a.r1 <= b.r1 + 3 AND b.r1 <= a.r1 + 3 AND a.c1 <= b.c1 + 1 AND b.c1 <= a.c1 + 1""")
def excel_merge_overlaps(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    r1, c1 = (F.col("c_custkey") % 40).cast("bigint"), (F.col("c_custkey") % 7).cast("bigint")
    return grid.overlapping(c.select(F.col("c_nationkey").cast("string").alias("sheet"), F.col("c_custkey").cast("bigint").alias("id"), r1.alias("r1"), c1.alias("c1"), (r1 + 3).alias("r2"), (c1 + 1).alias("c2")))


from foliate.plans import md_edits, workbooks  # noqa: E402, F401
