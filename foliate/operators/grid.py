"""Sheets of cells. cells: sheet, row, col, txt, num (rows and columns count from 0; a cell that is absent is empty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(df: DataFrame, column: str) -> Column:
    """A number that never falls where the column's values rise: numbers and times as they are, of texts the first six bytes."""
    kind = dict(df.dtypes)[column]
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.unix_date(column).cast("double") if kind == "date" else F.col(column).cast("double")


def to_cells(df: DataFrame, sheet: str, order: list[str], columns: list[str]) -> DataFrame:
    """A table as a sheet: row 0 holds the names, rows from 1 on the values in the order of `order`, null first keys before all others.

    Row numbers come from counts by range of the order's first key, so that no task numbers the whole sheet: ranges end at
    quantiles of the key (of any type), more of them on larger clusters; rows are numbered within their range and moved by the
    counts of the ranges before.
    """
    n = max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("__key", _number(df, order[0]))
    cuts = sorted(set(rows.approxQuantile("__key", [k / n for k in range(1, n)], 0.2 / n)))
    # one literal text, however many cuts there are
    ends = F.split(F.lit(" ".join(map(repr, cuts))), " ").cast("array<double>") if cuts else F.array().cast("array<double>")
    rows = rows.withColumn("__part", F.when(F.col("__key").isNull(), -1).otherwise(F.size(F.filter(ends, lambda c: c <= F.col("__key"))))).drop("__key")
    per = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(per), F.lit(0)).alias("__before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    rows = rows.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn("row", (F.col("__inside") + F.col("__before")).cast("bigint"))
    values = F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("txt"), F.col(c).cast("string").try_cast("double").alias("num")) for i, c in enumerate(columns)))
    body = rows.select(F.lit(sheet).alias("sheet"), "row", F.explode(values).alias("v")).select("sheet", "row", "v.*")
    head = df.sparkSession.createDataFrame([(sheet, 0, i, c, None) for i, c in enumerate(columns)], "sheet string, row bigint, col int, txt string, num double")
    return head.unionByName(body)


def in_rectangle(r1: int, c1: int, r2: int, c2: int) -> Column:
    return F.col("row").between(r1, r2) & F.col("col").between(c1, c2)


def bounds(ref: str) -> tuple[int, int, int, int]:
    """Of an A1 range: first row, first column, last row, last column, from 0."""
    import re

    def one(x: str) -> tuple[int, int]:
        letters, number = re.fullmatch(r"([A-Z]+)([0-9]+)", x).groups()
        col = 0
        for c in letters:
            col = col * 26 + ord(c) - 64
        return int(number) - 1, col - 1

    parts = [one(x) for x in ref.rpartition("!")[2].replace("$", "").upper().split(":")]
    (a, b), (c, d) = parts[0], parts[-1]
    return min(a, c), min(b, d), max(a, c), max(b, d)


def column_name(col: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to three letters."""
    n = col + 1
    letter = lambda x: F.chr(x + 65)
    return F.when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(F.floor((n - 27) / 26)), letter((n - 27) % 26))).otherwise(F.concat(letter(F.floor((n - 703) / 676)), letter(F.floor((n - 703) / 26) % 26), letter((n - 703) % 26)))


def read_range(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """row, col, txt: every place of the rectangle, null where no cell is."""
    spark = cells.sparkSession
    grid = spark.range(r1, r2 + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(c1), F.lit(c2))).alias("col"))
    return grid.join(cells.where(in_rectangle(r1, c1, r2, c2)).select("row", "col", "txt"), ["row", "col"], "left")


def find_cells(cells: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, max_results: int = 100) -> DataFrame:
    """sheet, row, col, txt: the first max_results in the order of sheet, row, column (the feature's own limit)."""
    x = F.col("txt")
    hit = x.rlike(query if case_sensitive else "(?iu)" + query) if regex else (x.contains(query) if case_sensitive else F.lower(x).contains(query.lower()))
    return cells.where(hit).orderBy("sheet", "row", "col").limit(max_results).select("sheet", "row", "col", "txt")


def find_rows(cells: DataFrame, col: int, value: str | None = None, pattern: str | None = None) -> DataFrame:
    """row, values: rows whose cell in col equals value or matches pattern, as arrays by column."""
    asked = (F.col("txt") == value) if value is not None else F.col("txt").rlike(pattern)
    return as_rows(cells.join(cells.where((F.col("col") == col) & asked).select("sheet", "row"), ["sheet", "row"], "left_semi"))


def as_rows(cells: DataFrame) -> DataFrame:
    """sheet, row, values."""
    per = cells.groupBy("sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", "txt"))).alias("v"))
    return per.select("sheet", "row", F.transform("v", lambda x: x["txt"]).alias("values"))


def summary(cells: DataFrame) -> DataFrame:
    """sheet, n_rows, n_cols, non_empty, formulas."""
    return cells.groupBy("sheet").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).cast("bigint").alias("n_cols"), F.count_if(F.coalesce("txt", F.lit("")) != "").alias("non_empty"), F.count_if(F.col("txt").startswith("=")).alias("formulas"))


def column(cells: DataFrame, col: int, start: int, end: int) -> DataFrame:
    return cells.where((F.col("col") == col) & (F.col("row") >= start) & (F.col("row") < end)).select("sheet", "row", "txt")


def autofit(cells: DataFrame, least: float = 8.0, most: float = 60.0, font: float = 11.0) -> DataFrame:
    """sheet, col, width."""
    widest = cells.groupBy("sheet", "col").agg(F.max(F.length("txt") * (font / 11)).alias("w"))
    return widest.select("sheet", "col", F.bround(F.greatest(F.lit(least), F.least(F.lit(most), F.col("w") * 1.1 + 2)), 1).alias("width"))


def insert_rows(cells: DataFrame, inserts: list[tuple[int, int]]) -> DataFrame:
    """inserts: (after this row, how many), in the sheet's own numbering. Rows below move down."""
    moved = sum((F.when(F.col("row") > at, n).otherwise(0) for at, n in inserts), F.lit(0))
    return cells.withColumn("row", F.col("row") + moved)


def delete_rows(cells: DataFrame, rows: list[int]) -> DataFrame:
    gone = sorted(set(rows))
    below = F.size(F.filter(F.array(*map(F.lit, gone)).cast("array<bigint>"), lambda x: x < F.col("row")))
    return cells.where(~F.col("row").isin(gone)).withColumn("row", F.col("row") - below)


def delete_column(cells: DataFrame, col: int) -> DataFrame:
    return cells.where(F.col("col") != col).withColumn("col", F.col("col") - F.when(F.col("col") > col, 1).otherwise(0))


def insert_column(cells: DataFrame, after: int) -> DataFrame:
    return cells.withColumn("col", F.col("col") + F.when(F.col("col") > after, 1).otherwise(0))


def edit_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: sheet, row, col, seq, txt, num. The latest edit of a place holds; places outside extend the sheet."""
    last = edits.groupBy("sheet", "row", "col").agg(F.max_by(F.struct("txt", "num"), "seq").alias("e"))
    both = cells.withColumn("here", F.lit(True)).join(last, ["sheet", "row", "col"], "full_outer")
    return both.select("sheet", "row", "col", F.when(F.col("e").isNotNull(), F.col("e.txt")).otherwise(F.col("txt")).alias("txt"), F.when(F.col("e").isNotNull(), F.col("e.num")).otherwise(F.col("num")).alias("num"))


def clear_range(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    inside = in_rectangle(r1, c1, r2, c2)
    return cells.withColumns({"txt": F.when(~inside, F.col("txt")), "num": F.when(~inside, F.col("num"))})


def fill_column(cells: DataFrame, col: int, start: int, end: int, first: float, step: float) -> DataFrame:
    """Rows start to end (inclusive) get first, first + step, ..."""
    inside = in_rectangle(start, col, end, col)
    value = F.lit(first) + (F.col("row") - start) * step
    return cells.withColumns({"num": F.when(inside, value).otherwise(F.col("num")), "txt": F.when(inside, value.cast("string")).otherwise(F.col("txt"))})


def to_markdown(cells: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """row, line: the rectangle as lines of a pipe table."""
    escape = F.replace(F.replace(F.coalesce("txt", F.lit("")), F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit("<br>"))
    per = read_range(cells, r1, c1, r2, c2).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", escape.alias("t")))).alias("v"))
    return per.select("row", F.concat(F.lit("| "), F.array_join(F.transform("v", lambda x: x["t"]), " | "), F.lit(" |")).alias("line"))


def to_csv(cells: DataFrame) -> DataFrame:
    """sheet, row, line: fields quoted where they hold a quote, a comma or a line's end."""
    x = F.coalesce("txt", F.lit(""))
    field = F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    per = cells.groupBy("sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", field.alias("t")))).alias("v"))
    return per.select("sheet", "row", F.array_join(F.transform("v", lambda v: v["t"]), ",").alias("line"))


def differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (added, removed, modified), before, after: of facts with a value; equal facts don't appear."""
    both = before.select(*keys, F.col("value").alias("before"), F.lit(True).alias("was")).join(after.select(*keys, F.col("value").alias("after"), F.lit(True).alias("is")), keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", "before", "after")


def overlapping(regions: DataFrame) -> DataFrame:
    """regions: sheet, id, r1, c1, r2, c2. Pairs a < b that share a cell: within a sheet, by blocks of rows, so it's an equal join."""
    block = 64
    r = regions.withColumn("b", F.explode(F.sequence(F.expr(f"r1 div {block}"), F.expr(f"r2 div {block}"))))
    a, b = r.alias("a"), r.alias("b")
    on = (F.col("a.sheet") == F.col("b.sheet")) & (F.col("a.b") == F.col("b.b")) & (F.col("a.id") < F.col("b.id"))
    meets = (F.col("a.r1") <= F.col("b.r2")) & (F.col("b.r1") <= F.col("a.r2")) & (F.col("a.c1") <= F.col("b.c2")) & (F.col("b.c1") <= F.col("a.c2"))
    return a.join(b, on).where(meets).select(F.col("a.sheet").alias("sheet"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
