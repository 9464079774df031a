"""Document fingerprints: content-defined chunks and their digests.

A gear hash runs over the UTF-8 bytes (each byte adds a random word to the doubled hash, so a boundary depends on the last
32 bytes only). Cutting is normalised: between MIN and NORMAL bytes a boundary needs more zero bits than between NORMAL and MAX, which keeps
lengths close to NORMAL. A fingerprint is the text's sorted set of chunks, each digest with its length, as a string;
the likeness of A's to B's is the length of A's chunks that B has, by the length of all of A's: an insertion changes the
chunks round it and no others.

`neighbours` gives each document the next one in descending id (after the last: the first). Documents are dealt into
ranges of ids by approximate quantiles; each range also gets a copy of the document that follows its last one, so a
range is one sorted pass and every text moves once. Equal ids stand in the order of their texts. Null ids come last.
Defined results: a null text counts as empty; an empty text has an empty fingerprint, like any empty one (1) and unlike others (0); a single document is its
own next one; equal texts have equal fingerprints; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm import common

MIN, NORMAL, MAX, STRICT, LOOSE, SEED = 16, 48, 192, 7, 4, 20250
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, np.uint32)


def boundaries(raw: bytes) -> list[int]:
    """The ends of the chunks of a text's bytes, the last one included."""
    n = len(raw)
    if n <= MIN:
        return [n] if n else []
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # each step doubles the bytes that a place's hash covers
        later = h[k:] + (h[:-k] << np.uint32(k))
        h = np.concatenate([h[:k], later])
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0) + 1
    strict = (h[loose - 1] >> np.uint32(32 - STRICT)) == 0
    # of each candidate, the place of the next strict one
    next_strict = np.append(loose[strict], n + MAX)
    at_loose, at_strict = loose.tolist(), next_strict.tolist()
    at_loose.append(n + MAX)
    out, start, i, j = [], 0, 0, 0
    while n - start > MIN:
        low, mid, top = start + MIN, start + NORMAL, start + MAX
        while at_strict[j] < low:
            j += 1
        if at_strict[j] <= mid:
            end = at_strict[j]
        else:
            while at_loose[i] <= mid:
                i += 1
            end = min(at_loose[i], top)
        if end >= n:
            break
        out.append(end)
        start = end
    out.append(n)
    return out


def chunks(raw: bytes) -> dict[int, int]:
    """digest -> length."""
    digest, view, out, a = xxhash.xxh3_64_intdigest, memoryview(raw), {}, 0
    for b in boundaries(raw):
        out[digest(view[a:b], SEED) >> 24] = b - a
        a = b
    return out


def written(found: dict[int, int]) -> str:
    """ten hex digits of a digest and two of its length, sorted."""
    return " ".join([f"{d:010x}{n:02x}" for d, n in sorted(found.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's length that b's chunks hold."""
    if not a or not b:
        return float(not a and not b)
    return sum(a[d] for d in a.keys() & b.keys()) / sum(a.values())


def fingerprint(text: str | None) -> str:
    return written(chunks((text or "").encode("utf-8", "surrogatepass")))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """doc_id, text, grp, copy: sorted within grp; the row with copy = 1 ends each grp and is what follows its last document."""
    spark = docs.sparkSession
    n = groups or 4 * common.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) or []), reverse=True)
    # descending: group 0 has the largest ids, the last group the null ones too; blocks of cuts keep the search short
    width = max(1, math.isqrt(len(cuts)))
    # one literal text, however many cuts there are
    numbers = lambda values: F.split(F.lit(" ".join(str(int(c)) for c in values)), " ").cast("array<bigint>")
    above = lambda values: F.size(F.filter(values, lambda c: c > F.col("doc_id")))
    grp = F.lit(len(cuts))
    if cuts:
        block = above(numbers(cuts[min(k + width, len(cuts)) - 1] for k in range(0, len(cuts), width)))  # blocks that lie above as a whole
        inside = F.slice(numbers(cuts), block * width + 1, F.lit(width))
        grp = F.when(F.col("doc_id").isNull(), grp).otherwise(F.least(block * width + above(inside), grp))
    placed = docs.withColumn("grp", grp.cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.col("doc_id")).alias("down"), F.sha2("text", 256).alias("digest"))
    # a row a group: its first document's id, and the group that this document ends: the one before, of the first group the last
    tops = placed.select("grp", "doc_id").groupBy("grp").agg(F.max("doc_id").alias("top"))
    by_grp = Window.partitionBy(F.lit(0)).orderBy("grp")
    tops = common.staged(tops.withColumn("to", F.coalesce(F.lag("grp").over(by_grp), F.max("grp").over(Window.partitionBy(F.lit(0))))), "tops")
    first = placed.alias("p").join(F.broadcast(tops.alias("t")), (F.col("p.grp") == F.col("t.grp")) & F.col("p.doc_id").eqNullSafe(F.col("t.top"))).select("doc_id", "text", "to")
    heads = first.groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), order).alias("x")).select("x.*", F.col("to").alias("grp"), F.lit(1).alias("copy"))
    dealt = placed.withColumn("copy", F.lit(0)).unionByName(heads).repartitionById(len(cuts) + 1, F.col("grp"))
    return dealt.withColumn("digest", F.sha2("text", 256)).sortWithinPartitions("copy", F.col("doc_id").desc_nulls_last(), "digest").drop("digest")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """A row of SCHEMA for each document."""
    common.prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each document's text with the next one's."""
        last = None
        for batch in batches:
            for doc_id, text, grp, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "grp", "copy")), strict=True):
                here = (doc_id, text, chunks(text.encode("utf-8", "surrogatepass")))
                if last is not None and last[0] == grp:
                    yield last[1], here
                last = None if copy else (grp, here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for (doc_id, text, own), (_, following, theirs) in rows(batches):
            changed = edited(text, following).encode("utf-8", "surrogatepass")
            other = chunks(changed)
            out.append((doc_id, len(text), hashlib.sha256(changed).hexdigest(), written(own), written(other), likeness(own, other), likeness(own, theirs)))
            size += len(text)
            if len(out) >= 2000 or size > 8_000_000:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return neighbours(docs, groups).mapInArrow(run, SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(common.documents(spark, sf_dir))
