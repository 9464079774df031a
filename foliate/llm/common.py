"""What the operators of this subpackage share: tables, staged tables, numbers of partitions."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: blank and the characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
FAN = 32
#: Bytes of a batch of rows with whole texts or sets on its way to a Python worker.
BATCH = 2 << 20
#: Where staged tables lie.
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies on a path that they share."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One of its own only where the session names none and all of it runs in one process, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliate-"))
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/foliate-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended: the folder's owner cleans it up
        pass


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile gives Python workers batches of at most BATCH bytes (one row at least). Else a task's texts come as one batch of up to 64 MB, of which the executor and its worker hold several copies."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if 0 < now <= BATCH:
        yield
        return
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, str(now))


def staged(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no more than its task. small: by small batches."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark) if small else nullcontext():
        df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of plans that are done go with their objects
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what staged wrote for these tables. Nothing that is still to run may read them."""
    for df in tables:
        if path := _STAGED.pop(df, None):
            drop_path(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and a number `row` for each row: its file's place among all paths, and its place in the file. So any scan of the table, however split, gives the same numbers. A table that isn't read from files is staged first."""
    place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")
    try:
        here = docs.select(*columns, *place)
    except AnalysisException:
        here = staged(docs.select(*columns), "numbered").select("*", *place)
    files = here.select("__file").distinct().select("__file", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__file")) - 1).cast("bigint").alias("__k"))
    files = staged(files, "files")  # a row a file
    few = files.count() <= 100_000
    here = here.join(F.broadcast(files) if few else files, "__file")
    return here.withColumn("row", F.shiftleft("__k", 40) + F.col("__at")).drop("__file", "__at", "__k")


def tree_sum(partials: DataFrame) -> np.ndarray | None:
    """The sum of the arrays of doubles in a column blob, one a partition of a plan without shuffles: FAN by FAN, so no task and not the driver gets more than FAN of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                x = np.frombuffer(blob)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    n = partials.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        partials = partials.repartition(n).mapInArrow(add, "blob binary")
    found = partials.collect()
    return sum((np.frombuffer(r.blob) for r in found[1:]), np.frombuffer(found[0].blob)) if found else None


def most(counts: DataFrame, column: str, bound: int) -> DataFrame:
    """The rows with the largest counts (1 or more), at most `bound` of them: whole steps of an eighth of a doubling, so that none of equal counts is cut off. What it decides from has a fixed size."""
    step = F.floor(F.log2(column) * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8 * 64 rows
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r.step):
        if held + r.n > bound:
            break
        held, least = held + r.n, r.step
    return counts.where(step >= least) if least is not None else counts.where("false")


def id_text(doc_id: Column) -> Column:
    return doc_id.cast("string")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, by mod; null for a null id."""
    return F.crc32(id_text(doc_id)) % F.lit(mod)


def labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """One row a document that has a label: doc_id, label. Of repeated rows the larger label counts; null labels are none."""
    return table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
