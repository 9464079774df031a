"""What the tools on a workbook's features accept, and the facts that they leave: one function a tool, over the facts of operators.workbook.

Arguments that the format doesn't allow, things that are not there and names that are taken raise ValueError at once; that asks for one small read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.operators import workbook as wb
from foliate.operators.grid import bounds

#: Attributes of a sheet's protection, fixed values.
SHEET_LOCKS = ("sheet", "objects", "scenarios", "formatCells", "formatColumns", "formatRows", "insertColumns", "insertRows", "insertHyperlinks", "deleteColumns", "deleteRows", "selectLockedCells", "sort", "autoFilter", "pivotTables", "selectUnlockedCells")
SHEET_HASHES = ("algorithmName", "hashValue", "saltValue", "spinCount")
#: Parts of a header or footer, fixed values.
SECTIONS = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")
VALIDATIONS = ("none", "whole", "decimal", "list", "date", "time", "textLength", "custom")


def _fail(wrong: bool, message: str) -> None:
    if wrong:
        raise ValueError(message)


def letters(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def area(ref: str) -> str:
    """An A1 range with its corners in order and without $; one cell stays one cell."""
    _fail(not re.fullmatch(r"(?i)\$?[a-z]{1,3}\$?[1-9][0-9]{0,6}(:\$?[a-z]{1,3}\$?[1-9][0-9]{0,6})?", ref), f"{ref} is no range of cells")
    r1, c1, r2, c2 = bounds(ref)
    first, last = f"{letters(c1)}{r1 + 1}", f"{letters(c2)}{r2 + 1}"
    return first if first == last else f"{first}:{last}"


def areas(sqref: str) -> str:
    return " ".join(area(x) for x in sqref.split())


def _one(feature: str, item: str, sheet: str | None = None) -> Column:
    here = (F.col("feature") == feature) & (F.lower("item") == item.lower())
    return here if sheet is None else here & (F.col("sheet") == sheet)


def _there(facts: DataFrame, which: Column) -> bool:
    return not facts.where(which).isEmpty()


# names


def _scope(sheet: str | None) -> str:
    return sheet or ""


def add_name(facts: DataFrame, name: str, value: str, sheet: str | None = None) -> DataFrame:
    """A name is unique in its scope whatever its case; the format's own names are set by their tools."""
    _fail(name.startswith("_xlnm."), "the name is reserved")
    _fail(not re.fullmatch(r"[^\W\d][\w.\\?]*|\\[\w.\\?]*", name) or bool(re.fullmatch(r"(?i)[a-z]{1,3}[0-9]+|[rc]|r[0-9]*c[0-9]*", name)), "the name is no name")
    _fail(_there(facts, _one("name", name, _scope(sheet))), "there is such a name in the scope")
    return wb.patch(facts, _scope(sheet), "name", name, {"ref": value.removeprefix("=")})


def update_name(facts: DataFrame, name: str, updates: dict, sheet: str | None = None) -> DataFrame:
    _fail(not _there(facts, _one("name", name, _scope(sheet))), "there is no such name in the scope")
    return wb.patch(facts, _scope(sheet), "name", name, updates)


def delete_name(facts: DataFrame, name: str, sheet: str | None = None) -> DataFrame:
    which = _one("name", name, _scope(sheet))
    _fail(not _there(facts, which), "there is no such name in the scope")
    return facts.where(~which)


# tables


def column_names(given: list[str | None], headers: list[str | None], width: int) -> list[str]:
    """By place: the given name, else the header cell's text, else ColumnN; a name that is taken gets a number."""
    out: list[str] = []
    for k in range(width):
        base = next((str(x[k]) for x in (given, headers) if k < len(x) and x[k] not in (None, "")), f"Column{k + 1}")
        name, n = base, 2
        while name.lower() in [x.lower() for x in out]:
            name, n = f"{base}{n}", n + 1
        out.append(name)
    return out


def _table_facts(ref: str, columns: list[str | None], headers: list[str | None]) -> dict[str, object]:
    r1, c1, r2, c2 = bounds(area(ref))
    _fail(r2 <= r1, "a table has a header and a row at least")
    return {"ref": area(ref)} | {f"column.{k + 1}": name for k, name in enumerate(column_names(columns, headers, c2 - c1 + 1))}


def add_table(facts: DataFrame, sheet: str, name: str, ref: str, columns: list[str | None] | None = None, headers: list[str | None] | None = None, style: str | None = None) -> DataFrame:
    """A table's name is unique in the workbook, names of cells included."""
    _fail(_there(facts, _one("table", name) | _one("name", name)), "there is a table or a name like that")
    return wb.patch(facts, sheet, "table", name, _table_facts(ref, columns or [], headers or []) | ({"style": style} if style else {}))


def update_table(facts: DataFrame, name: str, updates: dict) -> DataFrame:
    """updates: name (a new one), ref (its columns keep their names by place), columns, style; None removes a style."""
    mine = facts.where(_one("table", name)).collect()  # a row a property of one table
    _fail(not mine, "there is no such table")
    new = updates.get("name", name)
    _fail(new.lower() != name.lower() and _there(facts, _one("table", new) | _one("name", new)), "there is a table or a name like that")
    old = {r.key: r.value for r in mine}
    kept = [old[k] for k in sorted((k for k in old if k.startswith("column.")), key=lambda k: int(k[7:]))]
    values = {k: v for k, v in old.items() if not k.startswith("column.") and k != "ref"} | {k: v for k, v in updates.items() if k not in ("name", "ref", "columns")}
    if kept or "columns" in updates:
        values |= _table_facts(updates.get("ref", old["ref"]), updates.get("columns", kept), [])
    else:
        values["ref"] = area(updates.get("ref", old["ref"]))
    return wb.patch(facts.where(~_one("table", name)), mine[0].sheet, "table", new, values)


def delete_table(facts: DataFrame, name: str) -> DataFrame:
    _fail(not _there(facts, _one("table", name)), "there is no such table")
    return facts.where(~_one("table", name))


# links and comments of cells


def set_hyperlink(facts: DataFrame, sheet: str, cell: str, target: str | None = None, location: str | None = None, display: str | None = None, tooltip: str | None = None) -> DataFrame:
    """What is given is set, the rest stays; a link leads somewhere."""
    given = {k: v for k, v in (("target", target), ("location", location), ("display", display), ("tooltip", tooltip)) if v is not None}
    old = facts.where(_one("link", area(cell), sheet) & F.col("key").isin("target", "location"))
    _fail(not (target or location) and old.isEmpty(), "a link needs a target or a location")
    return wb.patch(facts, sheet, "link", area(cell), given)


def set_comment(facts: DataFrame, sheet: str, cell: str, text: str, author: str = "", comment_type: str = "legacy") -> DataFrame:
    _fail(comment_type != "legacy", "threaded comments are not written")
    return wb.patch(facts, sheet, "comment", area(cell), {"text": text, "author": author})


def remove_from_cell(facts: DataFrame, sheet: str, feature: str, cell: str) -> DataFrame:
    """feature: link or comment. A cell without one raises an error."""
    _fail(not _there(facts, _one(feature, area(cell), sheet)), f"the cell has no {feature}")
    return facts.where(~_one(feature, area(cell), sheet))


# named styles


def add_style(facts: DataFrame, name: str, style: dict) -> DataFrame:
    _fail(name.lower() == "normal" or _there(facts, _one("style", name, "")), "there is such a style")
    return wb.patch(facts, "", "style", name, style)


def update_style(facts: DataFrame, name: str, updates: dict) -> DataFrame:
    _fail(not _there(facts, _one("style", name, "")), "there is no such style")
    return wb.patch(facts, "", "style", name, updates)


def delete_style(facts: DataFrame, name: str, used: DataFrame) -> DataFrame:
    """used: a column style of the names that cells have."""
    _fail(name.lower() == "normal", "the style Normal stays")
    _fail(not _there(facts, _one("style", name, "")), "there is no such style")
    _fail(not used.where(F.lower("style") == name.lower()).isEmpty(), "cells have the style")
    return facts.where(~_one("style", name, ""))


# sizes and panes


def set_sizes(facts: DataFrame, sheet: str, axis: str, sizes: dict[str | int, float | None]) -> DataFrame:
    """Heights by row or widths by column (letters or a number from 0); None gives the size up."""
    _fail(axis not in ("row", "col"), "an axis is row or col")
    for at, size in sizes.items():
        index = int(at) if str(at).isdigit() else bounds(f"{at}1")[1] if axis == "col" and str(at).isalpha() else -1
        _fail(index < 0, f"{at} names no {axis}")
        _fail(size is not None and not 0 <= size <= (409.5 if axis == "row" else 255), "the format has no such size")
        facts = wb.patch(facts, sheet, axis, str(index), {"height" if axis == "row" else "width": size})
    return facts


def freeze_panes(facts: DataFrame, sheet: str, row: int, col: int) -> DataFrame:
    """row and col: how many stay in sight; none of either ends the freeze."""
    _fail(row < 0 or col < 0, "rows and columns count from 0")
    facts = wb.remove(facts, sheet, "pane")
    if not (row or col):
        return facts
    pane = "bottomRight" if row and col else "bottomLeft" if row else "topRight"
    return wb.patch(facts, sheet, "pane", "", {"xSplit": col or None, "ySplit": row or None, "topLeftCell": f"{letters(col)}{row + 1}", "activePane": pane, "state": "frozen"})


# validations, filters, ignored errors, protected ranges: things by their range or name


def _by_item(facts: DataFrame, sheet: str, feature: str, items: dict[str, dict | None], mode: str) -> DataFrame:
    """mode replace: no other thing of the feature stays; patch: things by item, None removes one."""
    _fail(mode not in ("replace", "patch"), "a mode is replace or patch")
    if mode == "replace":
        facts = wb.remove(facts, sheet, feature)
    for item, values in items.items():
        facts = wb.remove(facts, sheet, feature, item) if values is None else wb.patch(facts, sheet, feature, item, values)
    return facts


def set_validation(facts: DataFrame, sheet: str, sqref: str, rule: dict | None = None, options: list[str] | None = None, allow_blank: bool = True, mode: str = "append") -> DataFrame:
    """options: the values of a list. append sets a rule where none is, patch changes one, replace leaves no other."""
    if options is not None:
        _fail(any("," in x or '"' in x for x in options) or len(",".join(options)) > 255, "a list's values hold no comma or quote and have 255 characters in all")
        rule = {"type": "list", "formula1": '"' + ",".join(options) + '"'} | (rule or {})
    rule = {"allowBlank": allow_blank} | (rule or {})
    _fail(rule.get("type", "none") not in VALIDATIONS, "the format has no such kind of rule")
    _fail(rule.get("operator") in ("between", "notBetween") and "formula2" not in rule, "the rule needs two limits")
    _fail(mode not in ("append", "patch", "replace"), "a mode is append, patch or replace")
    there = _there(facts, _one("validation", areas(sqref), sheet))
    _fail(mode == "append" and there, "the range has a rule")
    _fail(mode == "patch" and not there, "the range has no rule")
    return _by_item(facts, sheet, "validation", {areas(sqref): rule}, "replace" if mode == "replace" else "patch")


def set_auto_filter(facts: DataFrame, sheet: str, ref: str | None = None, columns: dict[int, str | None] | None = None, mode: str = "patch") -> DataFrame:
    """columns: criteria by column of the range; None gives one up. Without a range there is no filter."""
    old = facts.where(_one("filter", "", sheet) & (F.col("key") == "ref")).first()
    _fail(not ref and (mode == "replace" or old is None), "a filter needs a range")
    _, c1, _, c2 = bounds(area(ref or old.value))
    _fail(any(not 0 <= k <= c2 - c1 for k in columns or {}), "the range has no such column")
    return _by_item(facts, sheet, "filter", {"": ({"ref": area(ref)} if ref else {}) | {f"column.{k}": v for k, v in (columns or {}).items()}}, mode)


def set_ignored_errors(facts: DataFrame, sheet: str, rules: list[dict], mode: str = "patch") -> DataFrame:
    _fail(any(not any(v for k, v in r.items() if k != "sqref") for r in rules), "a rule names an error")
    return _by_item(facts, sheet, "ignored", {areas(r["sqref"]): {k: v for k, v in r.items() if k != "sqref"} for r in rules}, mode)


def set_protected_ranges(facts: DataFrame, sheet: str, ranges: list[dict], mode: str = "replace") -> DataFrame:
    """ranges: name, sqref, further properties; delete=True removes one."""
    _fail(any(not r.get("name") or not (r.get("delete") or r.get("sqref")) for r in ranges), "a range needs a name and cells")
    return _by_item(facts, sheet, "protected", {r["name"]: None if r.get("delete") else {k: areas(v) if k == "sqref" else v for k, v in r.items() if k != "name"} for r in ranges}, mode)


# formulas


def set_formula(facts: DataFrame, sheet: str, cell: str, formula: str, kind: str = "normal", cached: object = None, policy: str = "clear") -> DataFrame:
    """policy: what becomes of the value a reader would show: clear, preserve, or value (cached)."""
    _fail(policy not in ("clear", "preserve", "value") or kind not in ("normal", "array", "shared", "dataTable"), "no such policy or kind")
    cache = {} if policy == "preserve" else {"cached": cached if policy == "value" else None}
    return wb.patch(facts, sheet, "formula", area(cell), {"text": "=" + formula.removeprefix("="), "type": kind} | cache)


# workbook, sheets, printing


def set_workbook_properties(facts: DataFrame, properties: dict, date_system: str | None = None) -> DataFrame:
    """A change of the dates' origin says what becomes of dates (date_system: keep_serials or keep_dates)."""
    old = facts.where(_one("workbook", "", "") & (F.col("key") == "date1904")).first()
    changes = "date1904" in properties and str(properties["date1904"] or False).lower() != (old.value if old else "false")
    _fail(changes and date_system not in ("keep_serials", "keep_dates"), "say what becomes of dates")
    return wb.patch(facts, "", "workbook", "", properties | ({"datePolicy": date_system} if changes else {}))


def set_views(facts: DataFrame, sheet: str, views: list[dict], mode: str = "replace") -> DataFrame:
    """Views by their place, of a sheet or (empty name) of the workbook."""
    _fail(mode == "replace" and not views, "there is one view at least")
    return _by_item(facts, sheet, "view", {str(k): v for k, v in enumerate(views)}, mode)


def set_document_properties(facts: DataFrame, core: dict | None = None, app: dict | None = None, custom: dict | None = None, modified: str | None = None) -> DataFrame:
    """modified: the time to be written as the last change; None leaves it."""
    for part, values in (("core", (core or {}) | ({"modified": modified} if modified else {})), ("app", app or {}), ("custom", custom or {})):
        facts = wb.patch(facts, "", part, "", values)
    return facts


def set_header_footer(facts: DataFrame, sheet: str, sections: dict[str, dict[str, str | None]]) -> DataFrame:
    """sections: of each of SECTIONS the texts at left, center and right."""
    _fail(any(s not in SECTIONS or set(v) - {"left", "center", "right"} for s, v in sections.items()), "no such section")
    for section, parts in sections.items():
        facts = wb.patch(facts, sheet, "header", section, parts)
    return facts


def set_print_titles(facts: DataFrame, sheet: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """Rows and columns (first and last, from 0) that each page repeats, and the name that holds them; none clears both."""
    quoted = "'" + sheet.replace("'", "''") + "'!"
    _fail(any(x and not 0 <= x[0] <= x[1] for x in (rows, columns)), "first and last stand the wrong way round")
    parts = ([f"${letters(columns[0])}:${letters(columns[1])}"] if columns else []) + ([f"${rows[0] + 1}:${rows[1] + 1}"] if rows else [])
    facts = wb.patch(facts, sheet, "print", "", {"titleColumns": parts[0] if columns else None, "titleRows": parts[-1] if rows else None})
    return wb.patch(facts, sheet, "name", "_xlnm.Print_Titles", {"ref": ",".join(quoted + x for x in parts) or None})


def set_sheet_protection(facts: DataFrame, sheet: str, properties: dict | None = None, enabled: bool | None = None) -> DataFrame:
    """Hashes are taken as they are: an old password hash or the parts of a new one, not both. enabled=False ends it."""
    given = properties or {}
    _fail(bool(set(given) - {*SHEET_LOCKS, *SHEET_HASHES, "password"}), "no such property")
    _fail("password" in given and bool(set(given) & set(SHEET_HASHES)), "one kind of hash at a time")
    if enabled is False:
        return wb.remove(facts, sheet, "protection")
    return wb.patch(facts, sheet, "protection", "", given | ({"sheet": True} if enabled else {}))
