"""Conversions to Markdown, all native: HTML pages, delimited and JSON tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import markdown as md

#: Steps in their order: pattern and replacement.
HTML_STEPS = [
    (r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|head)\b[^>]*>.*?</(script|style|head)>", ""),
    (r"\s+", " "),
    *((rf"(?i)<h{n}\b[^>]*>\s*", "\n\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i)<li\b[^>]*>\s*", "\n- "),
    (r"(?i)<br\s*/?>\s*", "\n"),
    (r"(?i)</?(b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(i|em)>", "*"),
    (r"""(?i)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>""", r"[\2](\1)"),
    (r"(?i)</?(p|div|article|section|nav|footer|header|ul|ol|table|tr|h[1-6])\b[^>]*>\s*", "\n\n"),
    (r"<[^>]+>", ""),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
    (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
]


def html_to_markdown(html: Column) -> Column:
    out = html
    for pattern, replacement in HTML_STEPS:
        out = F.regexp_replace(out, pattern, replacement.replace(r"\2", "$2").replace(r"\1", "$1"))
    return out


def table_to_markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """line numbers and lines of a pipe table: header, rule, rows in the order of columns. Rows are numbered by ranges, not in one task."""
    from foliate.operators import grid

    cells = grid.to_cells(df, "t", order, df.columns)
    per = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("txt", F.lit("")).alias("t")))).alias("v"))
    body = per.select(F.when(F.col("row") == 0, F.lit(0).cast("bigint")).otherwise(F.col("row") + 1).alias("line"), md.rendered(F.transform("v", lambda x: x["t"])).alias("text"))
    rule = df.sparkSession.createDataFrame([(1, "| " + " | ".join("---" for _ in df.columns) + " |")], "line bigint, text string")
    return body.unionByName(rule)


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc (path), text of text and JSON files as they are: UTF-8 with or without its mark."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.col("path").alias("doc"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))


def csv_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc (path), text: delimited files as pipe tables, the first record the header; quoted fields may hold commas, quotes (doubled) and line ends.

    A file is one text, so it is read by one task; records are found by one regular expression over it, natively.
    """
    docs = text_files(spark, paths)
    field = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
    records = F.filter(F.regexp_extract_all("text", F.lit(rf"({field}(?:,{field})*)(?:\r\n|\n|\r|\z)"), F.lit(1)), lambda r: r != "")
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    split = lambda r: F.transform(F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(rf",({field})"), F.lit(1)), bare)
    rows = docs.select("doc", F.transform(records, split).alias("r")).where(F.size("r") > 0)
    width = F.size(F.get("r", F.lit(0)))
    fit = lambda v: F.transform(F.slice(F.concat(v, F.array_repeat(F.lit(""), width)), F.lit(1), width), lambda c: F.regexp_replace(c, "\r\n|\r", "\n"))
    lines = F.concat(F.array(md.rendered(fit(F.get("r", F.lit(0)))), md.rendered(F.array_repeat(F.lit("---"), width))), F.transform(F.slice("r", F.lit(2), F.size("r")), lambda v: md.rendered(fit(v))))
    return rows.select("doc", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
