"""Tools on features change what is there and refuse what isn't."""

import pytest

from foliate.operators import features as ft
from foliate.plans import registry, workbooks

SF = "/root/testdata/sf0.001"
CHANGES = [n for n in registry.QUERIES if n.startswith(("excel_add_", "excel_update_", "excel_delete_", "excel_remove_", "excel_set_")) and n.endswith(("_name", "_table", "_hyperlink", "_comment", "_style", "_dimension", "_height", "_width", "_validation", "_formula", "_filter", "_errors", "_properties", "_protection", "_views", "_setup", "_options", "_footer", "_titles", "_ranges", "_area", "_breaks"))]


def test_every_tool_changes_something(spark):
    before = set(map(tuple, workbooks._facts(spark, SF).collect()))
    assert len(CHANGES) > 30
    for name in CHANGES:
        assert set(map(tuple, registry.QUERIES[name](spark, SF).collect())) != before, name


def test_refusals(spark):
    facts = workbooks._facts(spark, SF).cache()
    used = spark.createDataFrame([("style 8",)], "style string")
    refused = [
        lambda: ft.add_name(facts, "ITEM_7", "x"), lambda: ft.add_name(facts, "_xlnm.Print_Area", "x"), lambda: ft.add_name(facts, "A1", "x"), lambda: ft.update_name(facts, "none", {}), lambda: ft.delete_name(facts, "Item_7", "3"),
        lambda: ft.add_table(facts, "3", "tab_7", "A1:B2"), lambda: ft.add_table(facts, "3", "Item_7", "A1:B2"), lambda: ft.add_table(facts, "3", "n", "A1:B1"), lambda: ft.update_table(facts, "Tab_7", {"name": "Tab_8"}), lambda: ft.delete_table(facts, "none"),
        lambda: ft.set_hyperlink(facts, "3", "Z99", display="x"), lambda: ft.remove_from_cell(facts, "3", "link", "Z99"), lambda: ft.set_comment(facts, "3", "A1", "x", comment_type="threaded"),
        lambda: ft.add_style(facts, "normal", {}), lambda: ft.update_style(facts, "none", {}), lambda: ft.delete_style(facts, "Normal", used), lambda: ft.delete_style(facts, "Style 8", used),
        lambda: ft.set_sizes(facts, "3", "row", {"B": 3}), lambda: ft.set_sizes(facts, "3", "col", {"B": 300}), lambda: ft.freeze_panes(facts, "3", -1, 0), lambda: ft.area("A0"),
        lambda: ft.set_validation(facts, "3", "A1", {"type": "whole", "operator": "between", "formula1": 1}), lambda: ft.set_validation(facts, "3", "A1", {"type": "list"}, mode="patch"), lambda: ft.set_auto_filter(facts, "3", columns={0: "x"}), lambda: ft.set_auto_filter(facts, "3", "A1:B2", {2: "x"}),
        lambda: ft.set_workbook_properties(facts, {"date1904": True}), lambda: ft.set_views(facts, "", []), lambda: ft.set_header_footer(facts, "3", {"odd": {}}), lambda: ft.set_print_titles(facts, "3", (2, 1)),
        lambda: ft.set_sheet_protection(facts, "3", {"other": 1}), lambda: ft.set_sheet_protection(facts, "3", {"password": "x", "saltValue": "y"}), lambda: ft.set_protected_ranges(facts, "3", [{"name": "x"}]), lambda: ft.set_formula(facts, "3", "A1", "x", policy="other"),
    ]
    for k, f in enumerate(refused):
        with pytest.raises(ValueError):
            f()
            pytest.fail(f"{k} was taken")
