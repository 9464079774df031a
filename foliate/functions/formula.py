"""References in sheet formulas, rewritten with DataFrame functions: the text is cut into tokens and joined again, no Python on the executors.

Rows and columns count from 0 in arguments; formulas count rows from 1. Text in quotes, names of functions and references to
other sheets stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.operators.grid import column_name

_SHEET = r"(?:'(?:[^']|'')*'|[\p{L}_][\p{L}\p{N}_.]*)!"
_CELL, _ROWS, _COLS = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}", r"\$?[0-9]{1,7}:\$?[0-9]{1,7}", r"\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}"
_REF = rf"(?:{_SHEET})?(?:{_CELL}:{_CELL}|{_CELL}|{_ROWS}|{_COLS})(?![\p{{L}}\p{{N}}_.(!:])"
_TOKENS = rf'(?s)"(?:[^"]|"")*"|{_REF}|{_SHEET}|[\p{{L}}_\\][\p{{L}}\p{{N}}_.]*\(?|[0-9.]+|.'
ERROR = "#REF!"

Move = Callable[[Column, Column], Column]


def tokens(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(_TOKENS), F.lit(0))


def sheet_of(token: Column) -> Column:
    """The sheet's name without quotes; empty where none is written."""
    raw = F.regexp_extract(token, rf"^({_SHEET})", 1)
    bare = F.regexp_replace(raw, r"!\z", "")
    return F.when(bare.startswith("'"), F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit("''"), F.lit("'"))).otherwise(bare)


def column_index(letters: Column) -> Column:
    """A -> 0, AA -> 26."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1


def inserted(after: int, count: int) -> Move:
    """Indices behind `after` move on."""
    return lambda i, _: F.when(i > after, i + count).otherwise(i)


def deleted(gone: list[int]) -> Move:
    """Survivors close up; a span's start moves to the next survivor and its end to the one before (second argument: the index is an end)."""
    asked = F.array(*map(F.lit, sorted(set(gone)))).cast("array<int>")

    def move(i: Column, is_end: Column) -> Column:
        return i - F.size(F.filter(asked, lambda g: (g < i) | (is_end & (g == i))))

    return move


def _axis(token: Column, move: Move, rows: bool) -> Column:
    """A token's references moved on one axis, or the error where nothing of them is left."""
    prefix = F.regexp_extract(token, rf"^({_SHEET})", 1)
    body = F.substring(token, F.length(prefix) + 1, F.length(token))
    first, second = F.substring_index(body, ":", 1), F.substring_index(body, ":", -1)

    def index(x: Column) -> Column:
        return F.regexp_extract(x, "([0-9]+)", 1).try_cast("int") - 1 if rows else column_index(F.regexp_extract(x, "([A-Za-z]+)", 1))

    def put(x: Column, i: Column) -> Column:
        lead = r"^(\$?[A-Za-z]*\$?)" if rows else r"^(\$?)"
        rest = F.lit("") if rows else F.regexp_extract(x, r"^\$?[A-Za-z]+(.*)\z", 1)
        return F.concat(F.regexp_extract(x, lead, 1), (i + 1).cast("string") if rows else column_name(i), rest)

    span = body.contains(":")
    # of a single cell start and end are the same cell: it is gone when its end would lie before its start
    a, b = move(index(first), F.lit(False)), move(index(second), F.lit(True))
    kept = F.when(span, F.concat(put(first, a), F.lit(":"), put(second, b))).otherwise(put(first, a))
    has = body.rlike("[0-9]" if rows else "[A-Za-z]")
    return F.when(~has, token).when(a > b, F.concat(prefix, F.lit(ERROR))).otherwise(F.concat(prefix, kept))


def shifted(formula: Column, own_sheet: Column, edited_sheet: str, rows: Move | None = None, columns: Move | None = None) -> Column:
    """The formula after rows or columns of edited_sheet moved. Texts that don't start with = stay. Null stays null."""

    def one(t: Column) -> Column:
        sheet = sheet_of(t)
        of_it = F.when(sheet == "", F.lower(own_sheet)).otherwise(F.lower(sheet)) == edited_sheet.lower()
        moved = t
        if rows:
            moved = _axis(moved, rows, True)
        if columns:
            moved = F.when(moved.endswith(ERROR), moved).otherwise(_axis(moved, columns, False)) if rows else _axis(moved, columns, False)
        return F.when(t.rlike(rf"^(?:{_REF})\z") & of_it, moved).otherwise(t)

    return F.when(formula.startswith("="), F.array_join(F.transform(tokens(formula), one), "")).otherwise(formula)


def _quoted(name: str) -> str:
    import re

    plain = re.fullmatch(r"[^\W\d][\w.]*", name) and not re.fullmatch(r"(?i)\$?[a-z]{1,3}\$?\d+", name)
    return name + "!" if plain else "'" + name.replace("'", "''") + "'!"


def sheet_renamed(formula: Column, old: str, new: str) -> Column:
    """References to sheet old name sheet new; text in quotes stays."""

    def one(t: Column) -> Column:
        prefix = F.regexp_extract(t, rf"^({_SHEET})", 1)
        return F.when((prefix != "") & (F.lower(sheet_of(t)) == old.lower()), F.concat(F.lit(_quoted(new)), F.substring(t, F.length(prefix) + 1, F.length(t)))).otherwise(t)

    return F.when(formula.startswith("="), F.array_join(F.transform(tokens(formula), one), "")).otherwise(formula)


def sheet_deleted(formula: Column, name: str) -> Column:
    """References to a sheet that is gone become the error, followed by the cell they named."""

    def one(t: Column) -> Column:
        prefix = F.regexp_extract(t, rf"^({_SHEET})", 1)
        return F.when((prefix != "") & (F.lower(sheet_of(t)) == name.lower()), F.concat(F.lit(ERROR), F.substring(t, F.length(prefix) + 1, F.length(t)))).otherwise(t)

    return F.when(formula.startswith("="), F.array_join(F.transform(tokens(formula), one), "")).otherwise(formula)


def copied(formula: Column, down: Column | int, right: Column | int) -> Column:
    """The formula of a cell copied elsewhere: indices without $ move; one that leaves the sheet becomes the error."""

    def part(x: Column) -> Column:
        row, letters = F.regexp_extract(x, "([0-9]+)", 1), F.regexp_extract(x, "([A-Za-z]+)", 1)
        r = row.try_cast("int") - 1 + F.when(x.rlike(r"\$[0-9]"), 0).otherwise(F.lit(down) if isinstance(down, int) else down)
        c = column_index(letters) + F.when(x.rlike(r"^\$[A-Za-z]"), 0).otherwise(F.lit(right) if isinstance(right, int) else right)
        new_c = F.when(letters == "", "").when(c < 0, ERROR).otherwise(F.concat(F.regexp_extract(x, r"^(\$?)[A-Za-z]", 1), column_name(c)))
        new_r = F.when(row == "", "").when(r < 0, ERROR).otherwise(F.concat(F.regexp_extract(x, r"(\$?)[0-9]", 1), (r + 1).cast("string")))
        return F.concat(new_c, new_r)

    def one(t: Column) -> Column:
        prefix = F.regexp_extract(t, rf"^({_SHEET})", 1)
        body = F.substring(t, F.length(prefix) + 1, F.length(t))
        new = F.when(body.contains(":"), F.concat(part(F.substring_index(body, ":", 1)), F.lit(":"), part(F.substring_index(body, ":", -1)))).otherwise(part(body))
        return F.when(t.rlike(rf"^(?:{_REF})\z"), F.when(new.contains(ERROR), F.concat(prefix, F.lit(ERROR))).otherwise(F.concat(prefix, new))).otherwise(t)

    return F.when(formula.startswith("="), F.array_join(F.transform(tokens(formula), one), "")).otherwise(formula)
