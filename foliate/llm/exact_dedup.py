"""Exact deduplication by a keyed state that lives on disk and never expires.

The key is the SHA-256 digest of the normalised text. A stream runs over a staged table of (digest, locator) rows; its
state (RocksDB under the shared folder's checkpoint) holds, for each digest, the stable identifier and the content
locator (file and row) of the row that stays, and how many rows there were. With a `state` folder of one's own the state outlives the call: a
later call with new rows meets all earlier ones. Digests that more than one row has are hits: the full bytes of these texts, those of
an earlier call's row by its locator, are compared (least and greatest, which combine before the shuffle); texts that differ under
one digest are grouped by their bytes instead.

Defined results: a null text counts as empty; null ids come after all others; rows that are equal in everything are
told apart by the file and row where they lie, so one of them stays; an empty table gives an empty result; other
columns, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import common

HITS = 200_000  # as many digests are broadcast at most (38 bytes each)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, at: where the row lies (file and row). A table that isn't read from files is staged first."""
    take = lambda d: d.select("doc_id", "text", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    try:
        return take(docs)
    except AnalysisException:
        return take(common.staged(docs.select("doc_id", "text"), "located"))


def rank(text_length: Column, doc_id: Column, at: Column) -> Column:
    """Smallest first: most code points, then smallest id (null last), then place."""
    return F.struct((-text_length).alias("less"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), at.alias("at"))


def keyed_state(rows: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """One row for each key ever seen in the folder: n rows, the first rank. A stream with a disk-backed state that doesn't expire; each micro-batch writes the keys it changed."""
    spark = rows.sparkSession
    folder = folder or common.new_path(spark, "state")
    source, out = f"{folder}/keys", f"{folder}/said"
    rows.write.mode("append").parquet(source)
    # the stream's settings are its own: on disk, without files that are allocated ahead, as a store a partition is small
    own = spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": common.partitions(spark), "spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}.items():
        own.conf.set(k, v)
    changed = (
        own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100_000).parquet(source)
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    )
    query = (
        changed.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream")
        .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = f"{changed.select(*keys)._jdf.schema().toDDL()}, n bigint, first {rows.schema['rank'].dataType.simpleString()}"
    try:
        said = spark.read.schema(f"{schema}, batch bigint").parquet(out)
    except AnalysisException:  # no row ever came, so no batch ran
        return spark.createDataFrame([], schema)
    # a key's latest micro-batch holds its whole state
    return said.groupBy(*keys).agg(F.max("n").alias("n"), F.min("first").alias("first"))


def earlier_rows(docs: DataFrame, state: DataFrame) -> DataFrame:
    """digest, bytes of the rows that the state keeps in other files than those of docs, read by their locators."""
    spark = docs.sparkSession
    files = state.select(F.col("first.at.file").alias("file")).distinct().join(docs.select(F.col("at.file").alias("file")).distinct(), "file", "left_anti")
    paths = [r.file for r in files.collect()]  # a row a file
    if not paths:
        return spark.createDataFrame([], "digest string, bytes string")
    rows = located(spark.read.parquet(*paths)).join(state.select("digest", F.col("first.at").alias("at")), "at")
    return rows.select("digest", normalised(F.col("text")).alias("bytes"))


def dedup(docs: DataFrame, state: str | None = None) -> DataFrame:
    """One row for each row: doc_id, keep_id, group_size, kept, text_sha256, at (file and row). state: a shared folder whose state is kept and met again by later calls with further rows."""
    rows = located(docs)
    text = normalised(F.col("text"))
    digests = common.staged(rows.select("doc_id", "at", F.sha2(text, 256).alias("digest"), rank(F.length(F.coalesce("text", F.lit(""))), F.col("doc_id"), F.col("at")).alias("rank")), "digests")
    owners = common.staged(keyed_state(digests.select("digest", "rank"), ["digest"], state), "owners")

    # full bytes on hits: whether all texts of a digest are the same bytes, combined before anything is sent; few hits reach the texts, else all texts go
    hits = common.staged(owners.where("n > 1").select("digest", "first"), "hits")
    bytes_of = rows.select(F.sha2(text, 256).alias("digest"), text.alias("bytes"))
    if hits.count() <= HITS:
        bytes_of = bytes_of.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    if state:
        bytes_of = bytes_of.unionByName(earlier_rows(rows, hits))
    differ = common.staged(bytes_of.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("low <> high").select("digest"), "differ")

    plain = digests.join(owners, "digest").select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rank") == F.col("first")).alias("kept"), F.col("digest").alias("text_sha256"), "at")
    if differ.isEmpty():
        return plain
    by_bytes = digests.join(differ, "digest").join(rows.select("at", text.alias("bytes")), "at")
    apart = by_bytes.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    apart = by_bytes.join(apart, ["digest", "bytes"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rank") == F.col("first")).alias("kept"), F.col("digest").alias("text_sha256"), "at")
    return plain.join(differ.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti").select(apart.columns).unionByName(apart)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir)).drop("at")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    kept = dedup(docs).where("kept").select("at")
    try:
        here = docs.withColumn("__at", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException as e:
        raise ValueError("keep_first() needs a table that is read from files") from e
    return here.join(kept.withColumnRenamed("at", "__at"), "__at", "left_semi").drop("__at")


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
