"""Differences between two states of a workbook, classified, and the verdict on them. Changes have path, before, after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("REQUESTED", "NORMALIZATION", "FIXTURE_GAP", "VERIFIER_GAP", "UNAPPROVED_LOSS")


def glob(pattern: str) -> str:
    """A shell pattern (*, ?, [set]) as a regular expression over the whole path."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j + 1
        else:
            out += "\\" + c if not c.isalnum() and ord(c) < 128 else c
    return "(?s)^" + out + "\\z"


def _any(patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("path").rlike(glob(p))
    return out


def classified(changes: DataFrame, requested: list[str], normalizations: list[dict] | None = None, fixture_gaps: list[str] | None = None, verifier_gaps: list[str] | None = None) -> DataFrame:
    """changes with classification, the first class that fits in the order of CLASSES.

    A normalization has path, before, after and is complete with a rationale, bidirectional and evidence; an incomplete one that fits is a verifier gap.
    """
    rule, half = F.lit(False), F.lit(False)
    for n in normalizations or []:
        fits = F.col("path").rlike(glob(n["path"])) & F.col("before").eqNullSafe(F.lit(n.get("before"))) & F.col("after").eqNullSafe(F.lit(n.get("after")))
        if n.get("rationale") and n.get("bidirectional") and n.get("evidence"):
            rule = rule | fits
        else:
            half = half | fits
    label = F.when(_any(requested), CLASSES[0]).when(rule, CLASSES[1]).when(half, CLASSES[3]).when(_any(fixture_gaps or []), CLASSES[2]).when(_any(verifier_gaps or []), CLASSES[3]).otherwise(CLASSES[4])
    return changes.withColumn("classification", label)


def shortened(value: Column) -> Column:
    """Values over 1,600 characters as their first 1,400 and a digest."""
    return F.when(F.length(value) > 1600, F.concat(F.left(value, F.lit(1400)), F.lit("... sha256:"), F.sha2(value, 256))).otherwise(value)


def verdict(changes: DataFrame, max_differences: int = 200) -> DataFrame:
    """One row: counts a class, preservation_ok, truncated (more differences than a report shows)."""
    counts = [F.count_if(F.col("classification") == c).alias(c.lower()) for c in CLASSES]
    out = changes.agg(F.count("*").alias("total"), *counts)
    return out.withColumn("preservation_ok", (F.col("unapproved_loss") + F.col("fixture_gap") + F.col("verifier_gap")) == 0).withColumn("truncated", F.col("total") > max_differences)


def cell_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path (sheet!row,col/facet), before, after of cells whose text, number or formula differ; one full outer join."""
    facets, keys = ["txt", "num", "formula"], ["sheet", "row", "col"]
    a, b = (df.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in facets)).alias(n)) for df, n in ((before, "a"), (after, "b")))
    each = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"a.{f}").alias("before"), F.col(f"b.{f}").alias("after")) for f in facets))
    flat = a.join(b, keys, "full_outer").select(*keys, F.explode(each).alias("x")).where(~F.col("x.before").eqNullSafe(F.col("x.after")))
    return flat.select(F.format_string("%s!%d,%d/%s", "sheet", "row", "col", "x.f").alias("path"), "x.before", "x.after")


def newest_backups(backups: DataFrame, now: Column) -> DataFrame:
    """backups: path, backup, created_at, expires_at. The newest of each path that has not expired."""
    return backups.where(F.col("expires_at") > now).groupBy("path").agg(F.max_by("backup", "created_at").alias("backup"), F.max("created_at").alias("created_at"))


def summary(reports: DataFrame) -> DataFrame:
    """reports: kind (coverage, verification, backup), ok. One row: counts a kind and the gate, which needs every report good and one of each kind."""
    kinds = ("coverage", "verification", "backup")
    out = reports.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.coalesce(F.bool_and(F.coalesce("ok", F.lit(False))), F.lit(False)).alias("__ok"))
    return out.withColumn("passed", F.col("__ok") & (F.least(*kinds) > 0)).drop("__ok")
