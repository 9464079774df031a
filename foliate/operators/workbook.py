"""What a workbook has besides cells, as relations, and edits of them.

sheets: ord, sheet, state. facts: sheet (empty for the workbook), feature, item, key, value: one property of one thing, such as
(Data, row, 4, height, 20) or (, name, Total, ref, Data!$A$1). regions: sheet, id, r1, c1, r2, c2. All edits return whole relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT = ["sheet", "feature", "item", "key"]
STATES = ("visible", "hidden", "veryHidden")
#: Names the format keeps for itself.
RESERVED = ("_xlnm.Print_Area", "_xlnm.Print_Titles", "_xlnm._FilterDatabase")


# sheets


def add_sheet(sheets: DataFrame, name: str, position: int | None = None) -> DataFrame:
    """A sheet at the position, or last. A name that is there already (whatever its case) raises an error when the rows are read."""
    n = sheets.agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.lower("sheet") == name.lower(), 1)), F.lit(0)).alias("there"))
    at = F.col("n") if position is None else F.least(F.lit(position), F.col("n"))
    at = F.when(F.col("there") == 1, F.raise_error(F.lit("there is a sheet of that name"))).otherwise(at)
    new = n.select(at.cast("int").alias("ord"), F.lit(name).alias("sheet"), F.lit("visible").alias("state"))
    moved = sheets if position is None else sheets.withColumn("ord", F.col("ord") + F.when(F.col("ord") >= position, 1).otherwise(0))
    return moved.unionByName(new)


def _numbered(sheets: DataFrame, order: Column) -> DataFrame:
    # a workbook's sheets are few: the format's own limit is 65,535
    return sheets.withColumn("ord", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).cast("int"))


def delete_sheet(sheets: DataFrame, name: str) -> DataFrame:
    """The last sheet can't go: it stays."""
    many = sheets.withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return _numbered(many.where((F.col("sheet") != name) | (F.col("__n") == 1)).drop("__n"), F.col("ord"))


def move_sheet(sheets: DataFrame, name: str, position: int) -> DataFrame:
    rest = _numbered(sheets.where(F.col("sheet") != name), F.col("ord"))
    rest = rest.withColumn("ord", F.col("ord") + F.when(F.col("ord") >= position, 1).otherwise(0))
    return rest.unionByName(sheets.where(F.col("sheet") == name).withColumn("ord", F.lit(position).cast("int")))


def rename_sheet(df: DataFrame, old: str, new: str) -> DataFrame:
    """Of any relation with a column sheet; formulas are for formula.sheet_renamed."""
    return df.withColumn("sheet", F.when(F.col("sheet") == old, F.lit(new)).otherwise(F.col("sheet")))


def copy_sheet(df: DataFrame, name: str, new: str) -> DataFrame:
    """Of any relation with a column sheet: the sheet's rows once more under the new name."""
    return df.unionByName(df.where(F.col("sheet") == name).withColumn("sheet", F.lit(new)))


def set_sheet_state(sheets: DataFrame, name: str, state: str) -> DataFrame:
    """A state that would leave no sheet visible isn't set."""
    if state not in STATES:
        raise ValueError(f"state must be one of {STATES}")
    others = F.count_if((F.col("sheet") != name) & (F.col("state") == "visible")).over(Window.partitionBy(F.lit(0)))
    able = F.lit(state == "visible") | (others > 0)
    return sheets.withColumn("state", F.when((F.col("sheet") == name) & able, F.lit(state)).otherwise(F.col("state")))


# facts


def upsert(facts: DataFrame, changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """changes have the facts' columns, at most one row a key; a null value removes the fact. One full outer join on the keys."""
    keys = keys or FACT
    new = changes.select(*keys, F.struct(*(c for c in facts.columns if c not in keys)).alias("__new"))
    both = facts.select(*keys, F.struct(*(c for c in facts.columns if c not in keys)).alias("__old")).join(new, keys, "full_outer")
    held = both.select(*keys, F.coalesce("__new", "__old").alias("__v"))
    return held.select(*keys, *(F.col("__v")[c].alias(c) for c in facts.columns if c not in keys)).where("value IS NOT NULL")


def patch(facts: DataFrame, sheet: str, feature: str, item: str, values: dict[str, object | None]) -> DataFrame:
    """Properties of one thing set; None removes one. Values are kept as text, booleans as true and false."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    held = {k: text(v) for k, v in values.items()}
    if not held:
        return facts
    table = F.create_map(*(x for k, v in held.items() for x in (F.lit(k), F.lit(v).cast("string"))))
    here = (F.col("sheet") == sheet) & (F.col("feature") == feature) & (F.col("item") == item) & F.col("key").isin(list(held))
    new = facts.sparkSession.range(1).select(F.lit(sheet).alias("sheet"), F.lit(feature).alias("feature"), F.lit(item).alias("item"), F.explode(table).alias("key", "value")).where("value IS NOT NULL")
    # the changes are literals, so no join and no shuffle is needed
    return facts.where(~F.coalesce(here, F.lit(False))).select(*FACT, "value").unionByName(new)


def remove(facts: DataFrame, sheet: str, feature: str, item: str | None = None) -> DataFrame:
    here = (F.col("sheet") == sheet) & (F.col("feature") == feature)
    return facts.where(~(here if item is None else here & (F.col("item") == item)))


def replace(facts: DataFrame, sheet: str, feature: str, items: dict[str, dict[str, object]]) -> DataFrame:
    """All things of a feature replaced."""
    out = remove(facts, sheet, feature)
    for item, values in items.items():
        out = patch(out, sheet, feature, item, values)
    return out


def semantics(facts: DataFrame, sheet: str, features: list[str] | None = None) -> DataFrame:
    """feature, item, properties (map), digest: of a sheet or, for the empty name, the workbook. The digest doesn't depend on the properties' order."""
    chosen = facts.where(F.col("sheet") == sheet)
    chosen = chosen.where(F.col("feature").isin(features)) if features else chosen
    per = chosen.groupBy("feature", "item").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("p"))
    return per.select("feature", "item", F.map_from_entries("p").alias("properties"), F.sha2(F.to_json("p"), 256).alias("digest"))


def print_area(facts: DataFrame, sheet: str, areas: list[str]) -> DataFrame:
    """Sets the areas and the name that holds them; none clears both."""
    quoted = "'" + sheet.replace("'", "''") + "'!"
    joined = ",".join(quoted + a for a in areas) or None
    return patch(patch(facts, sheet, "print", "", {"area": ",".join(areas) or None}), sheet, "name", RESERVED[0], {"ref": joined})


def page_breaks(facts: DataFrame, sheet: str, axis: str, at: list[int]) -> DataFrame:
    """Replaces the manual breaks of an axis (row or col) and their counts."""
    out = replace(facts, sheet, f"{axis}_break", {str(i): {"man": True} for i in at})
    return patch(out, sheet, "breaks", axis, {"count": len(at), "manualBreakCount": len(at)})


# conditional formats: sheet, id, priority, rule


def add_rule(rules: DataFrame, sheet: str, id: str, rule: str, priority: int) -> DataFrame:
    """The rule gets the priority, the sheet's rules from there on move by one; priorities are then counted from 1 without gaps."""
    moved = rules.withColumn("priority", F.col("priority") + F.when((F.col("sheet") == sheet) & (F.col("priority") >= priority), 1).otherwise(0))
    new = rules.sparkSession.range(1).select(F.lit(sheet).alias("sheet"), F.lit(id).alias("id"), F.lit(priority).cast("int").alias("priority"), F.lit(rule).alias("rule"))
    return compacted(moved.unionByName(new))


def compacted(rules: DataFrame) -> DataFrame:
    order = Window.partitionBy("sheet").orderBy("priority", "id")
    return rules.withColumn("priority", F.row_number().over(order))


def delete_rule(rules: DataFrame, sheet: str, id: str) -> DataFrame:
    return compacted(rules.where((F.col("sheet") != sheet) | (F.col("id") != id)))


# styles: sheet, row, col, style (map of text to text)


def set_style(cells: DataFrame, sheet: str, r1: int, c1: int, r2: int, c2: int, style: dict[str, str | None]) -> DataFrame:
    """Properties of every cell of a rectangle patched; None removes one, the others stay. cells keep their further columns."""
    inside = (F.col("sheet") == sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2)
    old = F.coalesce("style", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(style)))
    new = {k: v for k, v in style.items() if v is not None}
    merged = F.map_concat(kept, F.create_map(*(F.lit(x) for kv in new.items() for x in kv))) if new else kept
    return cells.withColumn("style", F.when(inside, merged).otherwise(F.col("style")))


# regions (merges, validations, formats): intervals that move with rows and columns


def _span(lo: Column, hi: Column, gone: list[int]) -> tuple[Column, Column]:
    """Exact ends after a deletion: first and last survivor; first > last where none survives."""
    asked = F.array(*map(F.lit, sorted(set(gone)))).cast("array<bigint>")
    return lo - F.size(F.filter(asked, lambda g: g < lo)), hi - F.size(F.filter(asked, lambda g: g <= hi))


def regions_after_delete(regions: DataFrame, sheet: str, gone: list[int], axis: str = "row", single: bool = True) -> DataFrame:
    """Regions of the sheet shrink and vanish with deleted rows (axis row) or columns (col). single=False drops what is left as one cell, as for merges."""
    lo, hi = ("r1", "r2") if axis == "row" else ("c1", "c2")
    a, b = _span(F.col(lo), F.col(hi), gone)
    here = F.col("sheet") == sheet
    out = regions.select("sheet", "id", *(F.when(here, {lo: a, hi: b}[c]).otherwise(F.col(c)).cast("bigint").alias(c) if c in (lo, hi) else c for c in ("r1", "c1", "r2", "c2")))
    out = out.where((F.col("r1") <= F.col("r2")) & (F.col("c1") <= F.col("c2")))
    return out if single else out.where((F.col("r1") < F.col("r2")) | (F.col("c1") < F.col("c2")))


def regions_after_insert(regions: DataFrame, sheet: str, at: int, count: int, axis: str = "row") -> DataFrame:
    """New rows stand before index at: a region that starts there moves, one that they fall into grows."""
    lo, hi = ("r1", "r2") if axis == "row" else ("c1", "c2")
    here = F.col("sheet") == sheet
    moved = lambda c: (F.col(c) + F.when(here & (F.col(c) >= at), count).otherwise(0)).alias(c)
    return regions.select("sheet", "id", *(moved(c) if c in (lo, hi) else c for c in ("r1", "c1", "r2", "c2")))


def merge_cells(regions: DataFrame, sheet: str, id: int, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """A region more; an overlap with one of the sheet's regions raises an error when the rows are read."""
    if (r1, c1) == (r2, c2):
        raise ValueError("a merge has two cells or more")
    meets = (F.col("sheet") == sheet) & (F.col("r1") <= r2) & (F.col("r2") >= r1) & (F.col("c1") <= c2) & (F.col("c2") >= c1)
    seen = regions.agg(F.coalesce(F.max(meets.cast("int")), F.lit(0)).alias("hit"))
    new = seen.select(F.when(F.col("hit") == 1, F.raise_error(F.lit("the merge overlaps another one"))).otherwise(F.lit(sheet)).cast("string").alias("sheet"), F.lit(id).cast("bigint").alias("id"), *(F.lit(v).cast("bigint").alias(k) for k, v in (("r1", r1), ("c1", c1), ("r2", r2), ("c2", c2))))
    return regions.select("sheet", "id", "r1", "c1", "r2", "c2").unionByName(new)


# rows and columns of cells


def get_rows(cells: DataFrame, sheet: str, start: int, end: int) -> DataFrame:
    """row, values by column: rows start to end, end exclusive."""
    chosen = cells.where((F.col("sheet") == sheet) & (F.col("row") >= start) & (F.col("row") < end))
    return chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "txt"))).alias("v")).select("row", F.transform("v", lambda x: x["txt"]).alias("values"))


def fill_rows(cells: DataFrame, sheet: str, template: int, after: int, count: int) -> DataFrame:
    """count copies of a row behind row `after`; what stands below moves down."""
    here = F.col("sheet") == sheet
    copies = cells.where(here & (F.col("row") == template)).withColumn("row", F.explode(F.sequence(F.lit(after + 1).cast("bigint"), F.lit(after + count).cast("bigint"))))
    moved = cells.withColumn("row", F.col("row") + F.when(here & (F.col("row") > after), count).otherwise(0))
    return moved.unionByName(copies)


def copy_row(cells: DataFrame, sheet: str, row: int, after: int) -> DataFrame:
    return fill_rows(cells, sheet, row, after, 1)


def copy_column(cells: DataFrame, sheet: str, col: int, after: int) -> DataFrame:
    here = F.col("sheet") == sheet
    moved = cells.withColumn("col", F.col("col") + F.when(here & (F.col("col") > after), 1).otherwise(0))
    return moved.unionByName(cells.where(here & (F.col("col") == col)).withColumn("col", F.lit(after + 1)))


def preview(cells: DataFrame, rows: int = 20, cols: int = 10) -> DataFrame:
    """sheet, row, values, truncated_rows: each sheet's top left corner (the feature's own limit)."""
    more = cells.groupBy("sheet").agg((F.max("row") >= rows).alias("truncated_rows"))
    top = cells.where((F.col("row") < rows) & (F.col("col") < cols)).groupBy("sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", "txt"))).alias("v"))
    return top.join(more, "sheet").select("sheet", "row", F.transform("v", lambda x: x["txt"]).alias("values"), "truncated_rows")
