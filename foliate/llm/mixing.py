"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents stand in a shuffled order (by a hash of the id) and form a stream of words that is run through at
most twice; equal blocks of `block` words divide it. Slot k of the schedule has the golden-ratio point frac(k * phi),
which falls into one source's stretch of the cumulative targets; the slot's rank within that source names the block
that it takes. Blocks that the schedule's last slots leave out follow at its end, and the last block of a source is cut at
its target, so a source's taken words are its target rounded.

All sums within a source go by buckets of the hash first (its leading bits, more of them for more rows; the order is that of the hash whatever
their number), so that a source with a third of all rows is no single task. Defined results: null texts have size 0 and are taken 0 times; a null source is a source, the last one;
equal rows are taken like different documents; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm import common

WEIGHTS, SHARE, REPEAT, BLOCK = (3, 1, 2), (3, 2), 2, 256
ROWS, CHUNK, CELLS = 20_000, 1 << 12, 1 << 12  # rows a bucket, slots a chunk, cells of the targets' line
GOLDEN, TURN = 2654435769, 1 << 32  # 2^32 / phi


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, quota, lo, hi: one row a source. lo, hi: its stretch of [0, 1) by target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int")).cast("bigint"))
    per = per.withColumn("cap", F.lit(REPEAT) * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    # sources fill up in the order of cap / weight; the first one that the level doesn't fill ends that
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"k": F.row_number().over(order), "over": F.lit(SHARE[0]) * F.col("total") - F.lit(SHARE[1]) * before, "under": F.lit(SHARE[1]) * F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    per = per.withColumn("fits", F.col("over") * F.col("w") <= F.col("under") * F.col("cap"))
    per = per.withColumn("at", F.min(F.when(F.col("fits"), F.struct("k", (F.col("over") / F.col("under")).alias("level")))).over(everything))
    per = per.withColumn("target", F.when(F.col("k") < F.col("at.k"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("at.level")))
    per = per.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), "cap"))
    upto = F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumns({"upto": upto, "all": F.sum("quota").over(everything)})
    return per.select("source", "source_size", "target", "quota", "upto", "all")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """source, rank, slot: the blocks in the order in which the mix takes them."""
    spark = sources.sparkSession
    total = sources.agg(F.max("all")).first()[0] or 0
    lo, hi = (F.col("upto") - F.col("quota")) * TURN / F.col("all"), F.col("upto") * TURN / F.col("all")
    spans = sources.where("quota > 0").select("source", F.ceil(F.col("quota") / block).alias("blocks"), F.ceil(lo).alias("lo"), F.ceil(hi).alias("hi"))
    cell = TURN // CELLS
    spans = spans.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"hi div {cell}"))))
    slots = spark.range(0, -(-total // block)).select(F.col("id").alias("slot"), ((F.col("id") % (TURN // 2)) * GOLDEN % TURN).alias("point"))
    slots = slots.withColumn("cell", F.expr(f"point div {cell}")).join(spans, "cell").where("point >= lo AND point < hi").select("source", "slot", "blocks", F.expr(f"slot div {CHUNK}").alias("chunk"))
    per = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ranks = per.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    same = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.chunk") == F.col("b.chunk")]
    ranked = slots.withColumn("inside", inside).alias("a").join(ranks.alias("b"), same).select("a.source", (F.col("inside") + F.col("before")).alias("rank"), "slot", "blocks").where("rank < blocks").drop("blocks")
    got = ranks.groupBy("source").agg(F.sum("n").alias("got"))
    late = spans.select("source", "blocks").distinct().alias("a").join(got.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "blocks", F.coalesce("got", F.lit(0)).alias("got")).where("got < blocks")
    late = late.select("source", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("rank"), F.lit(None).cast("bigint").alias("slot"))
    return ranked.unionByName(late)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row: doc_id, size, source, source_size, target, taken, first_slot (of the first block taken, null if that is in the end part)."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    sizes = common.staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key")), "sizes")
    sources = common.staged(targets(sizes), "targets")
    bits = max(10, (sizes.count() // ROWS).bit_length())
    # an arithmetic shift: buckets ascend with the hash
    rows = sizes.withColumn("bucket", F.shiftright("key", 64 - bits))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    per = per.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "bucket", "before", "source_size", "target", "quota")
    same = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.bucket") == F.col("b.bucket")]
    rows = rows.withColumn("inside", inside).alias("a").join(per.alias("b"), same).select("doc_id", "a.source", "size", "source_size", "target", "quota", (F.col("inside") + F.col("before")).alias("start"))

    runs = F.filter(F.array(*(F.col("start") + F.lit(k) * F.col("source_size") for k in range(REPEAT))), lambda s: (s < F.col("quota")) & (F.col("size") > 0))
    parts = rows.withColumn("run", F.explode_outer(runs)).withColumn("end", F.least(F.col("run") + F.col("size"), "quota"))
    parts = parts.withColumn("rank", F.explode_outer(F.when(F.col("run").isNotNull(), F.sequence(F.expr(f"run div {block}"), F.expr(f"(end - 1) div {block}")))))
    parts = parts.withColumn("words", F.least("end", (F.col("rank") + 1) * block) - F.greatest("run", F.col("rank") * block))
    plan = schedule(sources, block)
    same = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.rank") == F.col("b.rank")]
    got = parts.alias("a").join(plan.alias("b"), same, "left").select("doc_id", "a.source", "size", "source_size", "target", "start", F.when(F.col("b.rank").isNotNull(), F.col("words")).alias("words"), "slot")
    # rows without words share a start: they count as often as they are there
    sums = got.groupBy("doc_id", "source", "size", "source_size", "target", "start").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("again", F.explode(F.when(F.col("size") == 0, F.array_repeat(F.lit(0), F.col("n").cast("int"))).otherwise(F.array(F.lit(0))))).select("doc_id", "size", "source", "source_size", "target", "taken", "first_slot")


def repeated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them: each row as often as its taken words, by its size, round to; rows without words once. docs must have one row an id at most, else its rows are taken alike."""
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("bigint")
    taken = mix(docs, block).groupBy("doc_id", "size").agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1))))).cast("int")).alias("__times"))
    here = docs.withColumn("__size", words).alias("a").join(taken.withColumnsRenamed({"doc_id": "__id", "size": "__n"}).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__n")))
    return here.withColumn("__time", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select(*(F.col(f"a.`{c}`") for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


