from pyspark.sql import functions as F

from foliate.functions import markdown as md

DOC = "# H1\nfoo\rbar\r\n## H2\n```py\n# no\n```\n    # indented\n### H4 ##\n# Last\n"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")


def test_lines(spark):
    got = [(r.line, r.raw) for r in md.lines(frame(spark, "a\nb\rc\r\n\nd\n")).orderBy("line").collect()]
    assert got == [(1, "a"), (2, "b\rc"), (3, ""), (4, "d")]
    assert md.lines(frame(spark, "", None)).count() == 0


def test_headings(spark):
    got = [(r.line, r.level, r.title, r.path, r.end_line) for r in md.headings(frame(spark, DOC)).orderBy("line").collect()]
    assert got == [(1, 1, "H1", ["H1"], 8), (3, 2, "H2", ["H1", "H2"], 8), (8, 3, "H4", ["H1", "H2", "H4"], 8), (9, 1, "Last", ["Last"], 9)]


def test_open_fence_hides_headings(spark):
    assert md.headings(frame(spark, "~~~~\n# a\n~~~\n# b")).count() == 0
    assert md.blocks(frame(spark, "~~~~\n# a\n~~~\n# b")).count() == 0


def test_slugs(spark):
    titles = ["Cài Đặt", "A  B", "Hello, World!", "a_b-c", " x "]
    got = [r.s for r in spark.createDataFrame(list(enumerate(titles)), "i int, t string").orderBy("i").select(md.slug(F.col("t")).alias("s")).collect()]
    assert got == ["cài-đặt", "a--b", "hello-world", "a_b-c", "x"]


def test_tables(spark):
    got = md.table_cells(frame(spark, "x | y\n--|--\n|B|A|\n|---|---:|\n|2|x|\n|1|y|\n\nz | w")).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.value) for r in got] == [(0, 0, "B"), (0, 1, "A"), (1, 0, "2"), (1, 1, "x"), (2, 0, "1"), (2, 1, "y")]


def test_links(spark):
    got = {(r.kind, r.text, r.target) for r in md.links(frame(spark, "[a](b) ![i](p.png)\n[r]: http://x y")).collect()}
    assert got == {("inline", "a", "b"), ("image", "i", "p.png"), ("reference", "r", "http://x")}
