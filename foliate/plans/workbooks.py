"""Registered queries of workbooks: sheets are the nations, facts are the customers' properties, cells are orders or customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import formula
from foliate.operators import features as ft
from foliate.operators import workbook as wb
from foliate.plans.registry import _query, _table


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("sheet"), F.when(F.col("n_nationkey") % 5 == 1, "hidden").otherwise("visible").alias("state"))


_S = "s AS (SELECT CAST(n_nationkey AS INT) AS ord, n_name AS sheet, CASE WHEN n_nationkey % 5 = 1 THEN 'hidden' ELSE 'visible' END AS state FROM nation)"


@_query(f"WITH {_S} SELECT CASE WHEN ord >= 3 THEN ord + 1 ELSE ord END AS ord, sheet, state FROM s UNION ALL SELECT 3, 'New', 'visible'")
def excel_add_sheet(spark, sf_dir):
    return wb.add_sheet(_sheets(spark, sf_dir), "New", 3)


@_query(f"WITH {_S} SELECT CASE WHEN ord > 4 THEN ord - 1 ELSE ord END AS ord, sheet, state FROM s WHERE ord <> 4")
def excel_delete_sheet(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    return wb.delete_sheet(sheets, sheets.where("ord = 4").first().sheet)


@_query(f"WITH {_S} SELECT CASE WHEN ord = 2 THEN 7 WHEN ord BETWEEN 3 AND 7 THEN ord - 1 ELSE ord END AS ord, sheet, state FROM s")
def excel_move_sheet(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    return wb.move_sheet(sheets, sheets.where("ord = 2").first().sheet, 7)


@_query(f"WITH {_S} SELECT ord, CASE WHEN ord = 0 THEN 'First' ELSE sheet END AS sheet, state FROM s")
def excel_rename_sheet(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    return wb.rename_sheet(sheets, sheets.where("ord = 0").first().sheet, "First")


@_query(f"WITH {_S} SELECT ord, sheet, CASE WHEN ord = 1 THEN 'visible' ELSE state END AS state FROM s")
def excel_set_sheet_state(spark, sf_dir):
    sheets = _sheets(spark, sf_dir)
    return wb.set_sheet_state(sheets, sheets.where("ord = 1").first().sheet, "visible")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer two properties of a row, a name, a table, a link, a comment and a style."""
    key, sheet = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    fact = lambda *x: F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(("sheet", "feature", "item", "key", "value"), x, strict=True)))
    each = F.array(
        fact(sheet, "row", key, "name", F.col("c_name")), fact(sheet, "row", key, "segment", F.col("c_mktsegment")), fact("", "name", F.concat(F.lit("Item_"), key), "ref", F.concat(F.lit("Data!$A$"), key)),
        fact(sheet, "table", F.concat(F.lit("Tab_"), key), "ref", F.concat(F.lit("A1:B"), key)), fact(sheet, "link", F.concat(F.lit("A"), key), "target", F.concat(F.lit("https://example.org/"), key)),
        fact(sheet, "comment", F.concat(F.lit("B"), key), "text", F.col("c_name")), fact("", "style", F.concat(F.lit("Style "), key), "bold", "true"),
    )
    return _table(spark, sf_dir, "customer").select(F.explode(each).alias("x")).select("x.*")


_FACTS = """f AS (SELECT CAST(c_nationkey AS VARCHAR) AS sheet, 'row' AS feature, CAST(c_custkey AS VARCHAR) AS item, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'row', CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer
UNION ALL SELECT '', 'name', 'Item_' || c_custkey, 'ref', 'Data!$A$' || c_custkey FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'table', 'Tab_' || c_custkey, 'ref', 'A1:B' || c_custkey FROM customer
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'link', 'A' || c_custkey, 'target', 'https://example.org/' || c_custkey FROM customer UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'comment', 'B' || c_custkey, 'text', c_name FROM customer UNION ALL SELECT '', 'style', 'Style ' || c_custkey, 'bold', 'true' FROM customer)"""
#: The sheet of customer 7, whose things the tools change.
_AT = "(SELECT CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 7)"


def _feature(name: str, change, gone: str, new: list[tuple[str, str, str, str]], sheet: str = _AT) -> None:
    """change(facts, sheet of customer 7). gone: SQL of the facts that go; new: feature, item, key, value of those that come, on the sheet."""

    def query(spark, sf_dir):
        at = str(_table(spark, sf_dir, "customer").where("c_custkey = 7").first().c_nationkey)
        return change(_facts(spark, sf_dir), at)

    query.__name__ = name
    rows = "".join(f" UNION ALL SELECT {sheet}, " + ", ".join("'" + x.replace("'", "''") + "'" for x in row) for row in new)
    _query(f"WITH {_FACTS} SELECT * FROM f WHERE NOT ({gone})" + rows)(query)


_BOOK, _NONE = "''", "false"
_HERE = f"sheet = {_AT} AND "
_feature("excel_add_defined_name", lambda f, at: ft.add_name(f, "Total", "=Data!$A$1"), _NONE, [("name", "Total", "ref", "Data!$A$1")], _BOOK)
_feature("excel_update_defined_name", lambda f, at: ft.update_name(f, "Item_7", {"ref": "Data!$B$2", "hidden": True}), "item = 'Item_7'", [("name", "Item_7", "ref", "Data!$B$2"), ("name", "Item_7", "hidden", "true")], _BOOK)
_feature("excel_delete_defined_name", lambda f, at: ft.delete_name(f, "ITEM_7"), "item = 'Item_7'", [])
_feature("excel_list_defined_names", lambda f, at: f.where("feature = 'name'"), "feature <> 'name'", [])
_feature("excel_add_table", lambda f, at: ft.add_table(f, at, "Scores", "$B$1:E9", ["k", None, None, "K"], [None, "head"], "Medium 2"), _NONE, [("table", "Scores", *x) for x in (("ref", "B1:E9"), ("column.1", "k"), ("column.2", "head"), ("column.3", "Column3"), ("column.4", "K2"), ("style", "Medium 2"))])
_feature("excel_update_table", lambda f, at: ft.update_table(f, "tab_7", {"name": "Renamed", "ref": "A1:C9", "columns": ["a"]}), "item = 'Tab_7'", [("table", "Renamed", *x) for x in (("ref", "A1:C9"), ("column.1", "a"), ("column.2", "Column2"), ("column.3", "Column3"))])
_feature("excel_delete_table", lambda f, at: ft.delete_table(f, "Tab_7"), "item = 'Tab_7'", [])
_feature("excel_list_tables", lambda f, at: f.where((F.col("feature") == "table") & (F.col("sheet") == at)), f"feature <> 'table' OR sheet <> {_AT}", [])
_feature("excel_set_hyperlink", lambda f, at: ft.set_hyperlink(f, at, "$A$7", display="x"), _NONE, [("link", "A7", "display", "x")])
_feature("excel_remove_hyperlink", lambda f, at: ft.remove_from_cell(f, at, "link", "A7"), _HERE + "feature = 'link' AND item = 'A7'", [])
_feature("excel_set_comment", lambda f, at: ft.set_comment(f, at, "B7", "it's here", "me"), _HERE + "feature = 'comment' AND item = 'B7'", [("comment", "B7", "text", "it's here"), ("comment", "B7", "author", "me")])
_feature("excel_remove_comment", lambda f, at: ft.remove_from_cell(f, at, "comment", "B7"), _HERE + "feature = 'comment' AND item = 'B7'", [])
_feature("excel_add_named_style", lambda f, at: ft.add_style(f, "Mine", {"italic": True}), _NONE, [("style", "Mine", "italic", "true")], _BOOK)
_feature("excel_update_named_style", lambda f, at: ft.update_style(f, "Style 7", {"bold": None, "italic": True}), "item = 'Style 7'", [("style", "Style 7", "italic", "true")], _BOOK)
_feature("excel_delete_named_style", lambda f, at: ft.delete_style(f, "Style 7", f.sparkSession.createDataFrame([("Style 8",)], "style string")), "item = 'Style 7'", [])
_feature("excel_set_dimension", lambda f, at: ft.set_sizes(f, at, "row", {7: 20}), _NONE, [("row", "7", "height", "20")])
_feature("excel_set_row_height", lambda f, at: ft.set_sizes(ft.set_sizes(f, at, "row", {9: 5}), at, "row", {7: 31.5, 9: None}), _NONE, [("row", "7", "height", "31.5")])
_feature("excel_set_column_width", lambda f, at: ft.set_sizes(f, at, "col", {"AB": 14, "0": 9.5}), _NONE, [("col", "27", "width", "14"), ("col", "0", "width", "9.5")])
_feature("excel_freeze_panes", lambda f, at: ft.freeze_panes(ft.freeze_panes(f, at, 1, 1), at, 5, 0), _NONE, [("pane", "", *x) for x in (("ySplit", "5"), ("topLeftCell", "A6"), ("activePane", "bottomLeft"), ("state", "frozen"))])
_feature("excel_set_data_validation", lambda f, at: ft.set_validation(f, at, "D10:D2 F1", options=["a", "b"]), _NONE, [("validation", "D2:D10 F1", *x) for x in (("type", "list"), ("formula1", '"a,b"'), ("allowBlank", "true"))])
_feature("excel_set_formula", lambda f, at: ft.set_formula(ft.set_formula(f, at, "C1", "=A1", cached=4, policy="value"), at, "$C$1", "SUM(B2:B5)"), _NONE, [("formula", "C1", "text", "=SUM(B2:B5)"), ("formula", "C1", "type", "normal")])
_feature("excel_set_auto_filter", lambda f, at: ft.set_auto_filter(ft.set_auto_filter(f, at, "A1:F10", {0: "x", 5: "y"}), at, columns={5: None, 1: "z"}), _NONE, [("filter", "", "ref", "A1:F10"), ("filter", "", "column.0", "x"), ("filter", "", "column.1", "z")])
_feature("excel_set_ignored_errors", lambda f, at: ft.set_ignored_errors(f, at, [{"sqref": "B2:A1", "numberStoredAsText": True}], "replace"), _NONE, [("ignored", "A1:B2", "numberStoredAsText", "true")])
_feature("excel_set_calculation_properties", lambda f, at: wb.patch(wb.patch(f, "", "calc", "", {"calcMode": "manual", "iterate": True}), "", "calc", "", {"calcMode": "auto", "iterate": None}), _NONE, [("calc", "", "calcMode", "auto")], _BOOK)
_feature("excel_set_workbook_properties", lambda f, at: ft.set_workbook_properties(f, {"date1904": True}, "keep_dates"), _NONE, [("workbook", "", "date1904", "true"), ("workbook", "", "datePolicy", "keep_dates")], _BOOK)
_feature("excel_set_document_properties", lambda f, at: ft.set_document_properties(f, {"title": "t"}, custom={"Project": "x"}, modified="2026-01-01T00:00:00Z"), _NONE, [("core", "", "title", "t"), ("core", "", "modified", "2026-01-01T00:00:00Z"), ("custom", "", "Project", "x")], _BOOK)
_feature("excel_set_workbook_protection", lambda f, at: wb.patch(f, "", "protection", "", {"lockStructure": True}), _NONE, [("protection", "", "lockStructure", "true")], _BOOK)
_feature("excel_set_workbook_views", lambda f, at: ft.set_views(ft.set_views(f, "", [{"activeTab": 0}, {"activeTab": 2}]), "", [{"activeTab": 1}], "patch"), _NONE, [("view", "0", "activeTab", "1"), ("view", "1", "activeTab", "2")], _BOOK)
_feature("excel_get_workbook_views", lambda f, at: ft.set_views(f, "", [{"activeTab": 3}]).where("feature = 'view' AND sheet = ''"), "true", [("view", "0", "activeTab", "3")], _BOOK)
_feature("excel_set_sheet_properties", lambda f, at: wb.patch(f, at, "sheet", "", {"tabColor": "FF0000"}), _NONE, [("sheet", "", "tabColor", "FF0000")])
_feature("excel_set_sheet_views", lambda f, at: ft.set_views(ft.set_views(f, at, [{"zoomScale": 50}]), at, [{"zoomScale": 80}]), _NONE, [("view", "0", "zoomScale", "80")])
_feature("excel_get_sheet_views", lambda f, at: ft.set_views(f, at, [{"zoomScale": 80}]).where((F.col("feature") == "view") & (F.col("sheet") == at)), "true", [("view", "0", "zoomScale", "80")])
_feature("excel_set_row_properties", lambda f, at: wb.patch(f, at, "row", "7", {"segment": None, "hidden": True}), _HERE + "feature = 'row' AND item = '7' AND key = 'segment'", [("row", "7", "hidden", "true")])
_feature("excel_set_page_setup", lambda f, at: wb.patch(f, at, "page", "", {"orientation": "landscape"}), _NONE, [("page", "", "orientation", "landscape")])
_feature("excel_set_print_options", lambda f, at: wb.patch(f, at, "print", "", {"gridLines": True}), _NONE, [("print", "", "gridLines", "true")])
_feature("excel_set_header_footer", lambda f, at: ft.set_header_footer(f, at, {"oddHeader": {"left": "a", "center": "b"}}), _NONE, [("header", "oddHeader", "left", "a"), ("header", "oddHeader", "center", "b")])
_feature("excel_set_print_titles", lambda f, at: ft.set_print_titles(f, "Data 1", (0, 1), (0, 27)), _NONE, [("print", "", "titleColumns", "$A:$AB"), ("print", "", "titleRows", "$1:$2"), ("name", "_xlnm.Print_Titles", "ref", "'Data 1'!$A:$AB,'Data 1'!$1:$2")], "'Data 1'")
_feature("excel_set_sheet_protection", lambda f, at: ft.set_sheet_protection(f, at, {"formatCells": False}, True), _NONE, [("protection", "", "sheet", "true"), ("protection", "", "formatCells", "false")])
_feature("excel_set_protected_ranges", lambda f, at: ft.set_protected_ranges(ft.set_protected_ranges(f, at, [{"name": "r", "sqref": "B2:A1"}, {"name": "s", "sqref": "C1"}]), at, [{"name": "s", "delete": True}], "patch"), _NONE, [("protected", "r", "sqref", "A1:B2")])


@_query(f"WITH {_FACTS} SELECT * FROM f UNION ALL SELECT '3', 'print', '', 'area', 'A1:B2,D1:D9' UNION ALL SELECT '3', 'name', '_xlnm.Print_Area', 'ref', '''3''!A1:B2,''3''!D1:D9'")
def excel_set_print_area(spark, sf_dir):
    return wb.print_area(_facts(spark, sf_dir), "3", ["A1:B2", "D1:D9"])


@_query(f"WITH {_FACTS} SELECT * FROM f UNION ALL SELECT '3', 'row_break', unnest(['4', '9']), 'man', 'true' UNION ALL SELECT '3', 'breaks', 'row', unnest(['count', 'manualBreakCount']), '2'")
def excel_set_page_breaks(spark, sf_dir):
    return wb.page_breaks(_facts(spark, sf_dir), "3", "row", [4, 9])


def _semantic_sql(sheet: str) -> str:
    return f"WITH {_FACTS} SELECT feature, item, string_agg(key || '=' || value, ',' ORDER BY key) AS properties FROM f WHERE sheet = '{sheet}' GROUP BY ALL"


def _flat(df: DataFrame) -> DataFrame:
    pairs = F.transform(F.sort_array(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select("feature", "item", F.array_join(pairs, ",").alias("properties"))


@_query(_semantic_sql("3"))
def excel_get_sheet_semantics(spark, sf_dir):
    return _flat(wb.semantics(_facts(spark, sf_dir), "3"))


@_query("SELECT 'row' AS feature, CAST(c_custkey AS VARCHAR) AS item, 'name=' || c_name AS properties FROM customer")
def excel_get_workbook_semantics(spark, sf_dir):
    return _flat(wb.semantics(_facts(spark, sf_dir).where("key = 'name'").withColumn("sheet", F.lit("")), ""))


@_query(f"WITH {_FACTS} SELECT CASE WHEN key = 'name' THEN upper(value) ELSE value END AS value, sheet, feature, item, key FROM f WHERE key = 'name' OR sheet <> '3'")
def excel_facts_upsert(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    changes = facts.where("key = 'name' OR sheet = '3'").withColumn("value", F.when(F.col("key") == "name", F.upper("value")))
    return wb.upsert(facts, changes)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return wb.compacted(c.select(F.col("c_nationkey").cast("string").alias("sheet"), F.col("c_name").alias("id"), F.col("c_custkey").cast("int").alias("priority"), F.col("c_mktsegment").alias("rule")))


_R = "r AS (SELECT CAST(c_nationkey AS VARCHAR) AS sheet, c_name AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, c_name) AS INT) AS priority, c_mktsegment AS rule FROM customer)"


@_query(f"WITH {_R} SELECT * FROM r")
def excel_get_conditional_formats(spark, sf_dir):
    return _rules(spark, sf_dir)


@_query(f"WITH {_R} SELECT sheet, id, CAST(CASE WHEN sheet = '3' AND priority >= 2 THEN priority + 1 ELSE priority END AS INT) AS priority, rule FROM r UNION ALL SELECT '3', 'new', 2, 'A1>0'")
def excel_add_conditional_format(spark, sf_dir):
    return wb.add_rule(_rules(spark, sf_dir), "3", "new", "A1>0", 2)


@_query(f"WITH {_R}, x AS (SELECT id, priority FROM r WHERE sheet = '3' AND priority = 2) SELECT sheet, r.id, CAST(r.priority - CASE WHEN sheet = '3' AND r.priority > 2 THEN 1 ELSE 0 END AS INT) AS priority, rule FROM r WHERE NOT (sheet = '3' AND r.priority = 2)")
def excel_delete_conditional_format(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    return wb.delete_rule(rules, "3", rules.where("sheet = '3' AND priority = 2").first().id)


@_query(f"WITH {_R} SELECT sheet, id, CAST(CASE WHEN sheet = '3' AND priority = 2 THEN 1 WHEN sheet = '3' AND priority = 1 THEN 2 ELSE priority END AS INT) AS priority, CASE WHEN sheet = '3' AND priority = 2 THEN 'new' ELSE rule END AS rule FROM r")
def excel_update_conditional_format(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    id = rules.where("sheet = '3' AND priority = 2").first().id
    return wb.add_rule(wb.delete_rule(rules, "3", id), "3", id, "new", 1)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet a nation; a row a customer; a name and a segment."""
    from pyspark.sql import Window

    c = _table(spark, sf_dir, "customer").withColumn("row", (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("bigint"))
    values = F.array(F.col("c_name"), F.col("c_mktsegment"))
    return c.select(F.col("c_nationkey").cast("string").alias("sheet"), "row", F.posexplode(values).alias("col", "txt"))


_C = """k AS (SELECT CAST(c_nationkey AS VARCHAR) AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row, c_name, c_mktsegment FROM customer),
c AS (SELECT sheet, row, 0 AS col, c_name AS txt FROM k UNION ALL SELECT sheet, row, 1, c_mktsegment FROM k)"""


@_query(f"WITH {_C} SELECT row, c_name || '|' || c_mktsegment AS line FROM k WHERE sheet = '3' AND row >= 1 AND row < 4")
def excel_get_rows(spark, sf_dir):
    return wb.get_rows(_cells(spark, sf_dir), "3", 1, 4).select("row", F.array_join("values", "|").alias("line"))


@_query(f"WITH {_C} SELECT row, c_name || '|' || c_mktsegment AS line FROM k WHERE sheet = '3' AND row BETWEEN 1 AND 4")
def excel_clone_rows(spark, sf_dir):
    return wb.get_rows(_cells(spark, sf_dir), "3", 1, 5).select("row", F.array_join("values", "|").alias("line"))


@_query(f"WITH {_C} SELECT sheet, row, col, txt FROM c WHERE sheet = '3' AND row = 1 AND col = 0")
def excel_get_cell(spark, sf_dir):
    return _cells(spark, sf_dir).where("sheet = '3' AND row = 1 AND col = 0")


@_query(f"WITH {_C} SELECT sheet, row, c_name || '|' || c_mktsegment AS line, (SELECT max(row) >= 3 FROM k x WHERE x.sheet = k.sheet) AS truncated_rows FROM k WHERE row < 3")
def excel_get_sheet_preview(spark, sf_dir):
    return wb.preview(_cells(spark, sf_dir), 3, 2).select("sheet", "row", F.array_join("values", "|").alias("line"), "truncated_rows")


@_query(f"WITH {_C} SELECT sheet, row + CASE WHEN sheet = '3' AND row > 2 THEN 1 ELSE 0 END AS row, col, txt FROM c UNION ALL SELECT sheet, 3, col, txt FROM c WHERE sheet = '3' AND row = 0")
def excel_copy_row(spark, sf_dir):
    return wb.copy_row(_cells(spark, sf_dir), "3", 0, 2)


@_query(f"WITH {_C} SELECT sheet, row + CASE WHEN sheet = '3' AND row > 1 THEN 4 ELSE 0 END AS row, col, txt FROM c UNION ALL SELECT sheet, unnest([2, 3, 4, 5]), col, txt FROM c WHERE sheet = '3' AND row = 1")
def excel_fill_rows(spark, sf_dir):
    return wb.fill_rows(_cells(spark, sf_dir), "3", 1, 1, 4)


@_query(f"WITH {_C} SELECT sheet, row, col + CASE WHEN sheet = '3' AND col > 0 THEN 1 ELSE 0 END AS col, txt FROM c UNION ALL SELECT sheet, row, 1, txt FROM c WHERE sheet = '3' AND col = 1")
def excel_copy_column(spark, sf_dir):
    return wb.copy_column(_cells(spark, sf_dir), "3", 1, 0)


@_query(f"WITH {_C} SELECT sheet, row, col, txt FROM c UNION ALL SELECT 'Copy', row, col, txt FROM c WHERE sheet = '3'")
def excel_copy_sheet(spark, sf_dir):
    return wb.copy_sheet(_cells(spark, sf_dir), "3", "Copy")


def _style(name: str, style: dict, clears: str | None = None) -> None:
    def query(spark, sf_dir):
        cells = _cells(spark, sf_dir).withColumn("style", F.create_map(F.lit("bold"), F.lit("true")))
        out = wb.set_style(cells, "3", 0, 0, 2, 0, style)
        return out.select("sheet", "row", "col", F.array_join(F.transform(F.sort_array(F.map_entries("style")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("style"))

    query.__name__ = name
    want = ",".join(f"{k}={v}" for k, v in sorted(({"bold": "true"} | style).items()) if v is not None)
    _query(f"WITH {_C} SELECT sheet, row, col, CASE WHEN sheet = '3' AND row <= 2 AND col = 0 THEN '{want}' ELSE 'bold=true' END AS style FROM c")(query)


_style("excel_set_style", {"bold": None, "size": "12"})
_style("excel_set_font_color", {"color": "FF0000"})
_style("excel_set_strike", {"strike": "true"})
_style("excel_set_borders", {"border.top": "thin", "border.left": "thin"})
_style("excel_set_cell_style_semantics", {"applyFont": "true"})


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    return _table(spark, sf_dir, "customer").select(F.lit("S").alias("sheet"), k.alias("id"), (k * 5).alias("r1"), F.lit(1).cast("bigint").alias("c1"), (k * 5 + k % 4).alias("r2"), F.lit(1).cast("bigint").alias("c2"))


_G = "g AS (SELECT 'S' AS sheet, c_custkey AS id, c_custkey * 5 AS r1, CAST(1 AS BIGINT) AS c1, c_custkey * 5 + c_custkey % 4 AS r2, CAST(1 AS BIGINT) AS c2 FROM customer)"


@_query(f"WITH {_G} SELECT * FROM g UNION ALL SELECT 'S', -1, 0, 5, 1000000, 6")
def excel_merge_cells(spark, sf_dir):
    return wb.merge_cells(_regions(spark, sf_dir), "S", -1, 0, 5, 1_000_000, 6)


@_query(f"""WITH {_G}, d AS (SELECT unnest([10, 16, 17, 25, 35, 36, 37, 38]) AS g), x AS (SELECT sheet, id, c1, c2, r1 - (SELECT count(*) FROM d WHERE d.g < r1) AS r1, r2 - (SELECT count(*) FROM d WHERE d.g <= r2) AS r2 FROM g)
SELECT sheet, id, r1, c1, r2, c2 FROM x WHERE r1 < r2""")
def excel_delete_rows_merges(spark, sf_dir):
    return wb.regions_after_delete(_regions(spark, sf_dir), "S", [10, 16, 17, 25, 35, 36, 37, 38], single=False)


@_query(f"WITH {_G} SELECT sheet, id, r1 + CASE WHEN r1 >= 16 THEN 3 ELSE 0 END AS r1, c1, r2 + CASE WHEN r2 >= 16 THEN 3 ELSE 0 END AS r2, c2 FROM g")
def excel_insert_rows_merges(spark, sf_dir):
    return wb.regions_after_insert(_regions(spark, sf_dir), "S", 16, 3)


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("=SUM(B"), k, F.lit(":$C$"), (F.col("c_custkey") + 3).cast("string"), F.lit(")+IF(Other!A"), k, F.lit('>0,"B5",LOG10(\'My Data\'!$D'), k, F.lit("))"))
    return _table(spark, sf_dir, "customer").select("c_custkey", text.alias("f"))


def _formula_sql(a: str, b: str, other: str, mine: str) -> str:
    return f"SELECT c_custkey, '=SUM(' || {a} || {b} || ')+IF(' || {other} || '>0,\"B5\",LOG10(' || {mine} || '))' AS f FROM customer"


_K = "CAST(c_custkey AS VARCHAR)"
_PLAIN = (f"'B' || {_K}", "':$C$' || CAST(c_custkey + 3 AS VARCHAR)", f"'Other!A' || {_K}", f"'''My Data''!$D' || {_K}")


@_query(_formula_sql("'B' || CAST(CASE WHEN c_custkey > 20 THEN c_custkey + 2 ELSE c_custkey END AS VARCHAR)", "':$C$' || CAST(CASE WHEN c_custkey + 3 > 20 THEN c_custkey + 5 ELSE c_custkey + 3 END AS VARCHAR)", *_PLAIN[2:]))
def excel_formula_insert_rows(spark, sf_dir):
    return _formulas(spark, sf_dir).select("c_custkey", formula.shifted(F.col("f"), F.lit("Main"), "main", rows=formula.inserted(19, 2)).alias("f"))


@_query("WITH d AS (SELECT c_custkey, c_custkey - 1 AS i FROM customer) SELECT c_custkey, '=SUM(B' || CAST(i - CASE WHEN i > 9 THEN 1 ELSE 0 END - CASE WHEN i > 10 THEN 1 ELSE 0 END + 1 AS VARCHAR) || ':$C$' || CAST(i + 3 - CASE WHEN i + 3 >= 9 THEN 1 ELSE 0 END - CASE WHEN i + 3 >= 10 THEN 1 ELSE 0 END + 1 AS VARCHAR) || ')+IF(Other!A' || CAST(c_custkey AS VARCHAR) || '>0,\"B5\",LOG10(''My Data''!$D' || CAST(c_custkey AS VARCHAR) || '))' AS f FROM d")
def excel_formula_delete_rows(spark, sf_dir):
    return _formulas(spark, sf_dir).select("c_custkey", formula.shifted(F.col("f"), F.lit("Main"), "Main", rows=formula.deleted([10, 9])).alias("f"))


@_query(_formula_sql(_PLAIN[0], _PLAIN[1], "'Other!#REF!'", _PLAIN[3]))
def excel_formula_delete_column(spark, sf_dir):
    return _formulas(spark, sf_dir).select("c_custkey", formula.shifted(F.col("f"), F.lit("Main"), "Other", columns=formula.deleted([0])).alias("f"))


@_query(_formula_sql(_PLAIN[0], _PLAIN[1], _PLAIN[2], f"'''New ''''1''!$D' || {_K}"))
def excel_formula_rename_sheet(spark, sf_dir):
    return _formulas(spark, sf_dir).select("c_custkey", formula.sheet_renamed(F.col("f"), "My Data", "New '1").alias("f"))


@_query(_formula_sql(_PLAIN[0], _PLAIN[1], f"'#REF!A' || {_K}", _PLAIN[3]))
def excel_formula_delete_sheet(spark, sf_dir):
    return _formulas(spark, sf_dir).select("c_custkey", formula.sheet_deleted(F.col("f"), "Other").alias("f"))


@_query(_formula_sql("'C' || CAST(c_custkey + 2 AS VARCHAR)", _PLAIN[1], "'Other!B' || CAST(c_custkey + 2 AS VARCHAR)", "'''My Data''!$D' || CAST(c_custkey + 2 AS VARCHAR)"))
def excel_formula_copy(spark, sf_dir):
    return _formulas(spark, sf_dir).select("c_custkey", formula.copied(F.col("f"), 2, 1).alias("f"))


@_query("""SELECT CASE WHEN n <= 1 THEN 0 ELSE n END AS line, text FROM (SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS n, '| ' || n_nationkey || ' | ' || n_name || ' |' AS text FROM nation)
UNION ALL SELECT 0, '| n_nationkey | n_name |' UNION ALL SELECT 1, '| --- | --- |'""")
def convert_to_markdown(spark, sf_dir):
    from foliate.functions import convert

    return convert.table_to_markdown(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


def _html_sql() -> str:
    from foliate.functions.convert import HTML_STEPS

    out = "html"
    for pattern, replacement in HTML_STEPS:
        quoted = [x.replace("'", "''") for x in (pattern, replacement)]
        out = f"regexp_replace({out}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return f"SELECT page_id, {out} AS text FROM pages"


@_query(_html_sql())
def html_to_markdown(spark, sf_dir):
    from foliate.functions import convert

    return _table(spark, sf_dir, "pages").select("page_id", convert.html_to_markdown(F.col("html")).alias("text"))


@_query("""WITH x AS (SELECT o_orderkey, o_orderstatus AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS a FROM orders), c AS (SELECT * FROM x WHERE a <> b)
SELECT count(*) AS total, count(*) FILTER (o_orderkey < 1000) AS requested, CAST(0 AS BIGINT) AS normalization, CAST(0 AS BIGINT) AS fixture_gap, CAST(0 AS BIGINT) AS verifier_gap, count(*) FILTER (o_orderkey >= 1000) AS unapproved_loss, count(*) FILTER (o_orderkey >= 1000) = 0 AS preservation_ok, count(*) > 200 AS truncated FROM c""")
def excel_verify_preservation(spark, sf_dir):
    from foliate.operators import preservation

    orders = _table(spark, sf_dir, "orders")
    sheet = lambda v: orders.select(F.lit("S").alias("sheet"), F.col("o_orderkey").cast("bigint").alias("row"), F.lit(0).alias("col"), v.alias("txt"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("formula"))
    after = F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))
    changes = preservation.cell_changes(sheet(F.col("o_orderstatus")), sheet(after))
    return preservation.verdict(preservation.classified(changes, ["S!?,0/txt", "S!??,0/txt", "S!???,0/txt"]))
