"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each bit that is set in over half of its shingles' XXH64. The distinct fingerprints
are dealt into tiles by the population counts of their four quarters: fingerprints within `radius` bits differ by at most
`radius` in the sum of those four counts' differences, so a tile meets only tiles whose counts lie that close (21 of 83,521 kinds), and all
others are skipped. Pairs of tiles are made of tile ids; each pair then gets the two tiles' fingerprints in one shuffle. Two
tiles are compared by one numpy exclusive-or and a bit count; of the links found, each
pair of tiles returns a spanning forest, which keeps every link's effect and never the square of a group. Tiles hold about TILE
fingerprints, however many share their counts. Components of the links are found over fingerprints, copies join them by equality.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; null ids
are never a component's id unless all of its ids are null; equal rows have equal results; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import common
from foliate.llm.components import components

SHINGLE, RADIUS, SEED, TILE = 3, 2, 42, 2048


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the shingles in order; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n > shingle:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Unsigned: the bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned; 0 for a text without words."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingles: tuple[int, ...] = (SHINGLE,)) -> DataFrame:
    """docs' columns other than text, and fp (signed), one for each size of shingles."""
    common.prepare(docs.sparkSession)
    other = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([[fingerprint(x, k) for k in shingles] for x in batch.column("text").to_pylist()], np.uint64).reshape(-1, len(shingles)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in other), pa.array(list(fps), pa.list_(pa.int64()))], [*other, "fp"])

    return docs.mapInArrow(run, docs.select(*other, F.array(F.lit(0).cast("bigint")).alias("fp")).schema)


def near(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences of the parts' counts that links may have, of each two opposite ones the one not below zero."""
    return [x for x in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, x)) <= radius and x >= (0,) * parts]


def forest(a: np.ndarray, b: np.ndarray, radii: tuple[int, ...]) -> list[tuple[int, int]]:
    """Of the links between the fingerprints in a's and b's rows (or within a, if they are the same), a spanning forest, as indices into a and b."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    i, j = np.nonzero(np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :]) <= radii[0])
    for k in range(1, len(radii)):
        held = np.bitwise_count(a[i, k] ^ b[j, k]) <= radii[k]
        i, j = i[held], j[held]
    if a is b:
        i, j = i[i < j], j[i < j]
    where = 0 if a is b else len(a)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(x), root(y + where)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def links(distinct: DataFrame, radii: tuple[int, ...] = (RADIUS,), tile: int = TILE) -> DataFrame:
    """distinct: fp, once each. Returns u, v: links whose components are those of all links. Wide radii leave the quarters' counts nothing to skip: there the whole's count is used."""
    spark, radius = distinct.sparkSession, radii[0]
    common.prepare(spark)
    parts = 4 if radius < 4 else 1
    bits = 64 // parts
    base = bits + 1
    first = F.get("fp", F.lit(0))
    counts = [F.bit_count(F.shiftrightunsigned(first, bits * k).bitwiseAND((1 << bits) - 1) if parts > 1 else first) for k in range(parts)]
    keyed = distinct.select("fp", sum((c * base**k for k, c in enumerate(counts)), F.lit(0)).cast("int").alias("kind"))
    sizes = keyed.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n"))  # at most 17^4 rows
    tiles = keyed.join(F.broadcast(sizes), "kind").groupBy("kind", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("tile")).agg(F.flatten(F.collect_list("fp")).alias("fps"))
    tiles = common.staged(tiles.select("kind", (F.shiftleft(F.col("kind").cast("bigint"), 32) + F.col("tile")).alias("id"), "fps"), "tiles")
    digits = [F.expr(f"(kind div {base**k}) % {base}") for k in range(parts)]
    moves = [F.struct(F.lit(sum(d * base**k for k, d in enumerate(x))).alias("by"), F.lit(not any(x)).alias("same"), F.array(*map(F.lit, x)).alias("d")) for x in near(radius, parts)]
    asks = tiles.select("kind", F.col("id").alias("a"), F.explode(F.array(*moves)).alias("m"), F.array(*digits).alias("q"))
    inside = F.forall(F.zip_with("q", "m.d", lambda q, d: q + d), lambda x: (x >= 0) & (x < base))
    asks = asks.where(inside).select((F.col("kind") + F.col("m.by")).alias("kind"), "a", F.col("m.same").alias("same"))
    pairs = asks.join(tiles.select("kind", F.col("id").alias("b")), "kind").where(~F.col("same") | (F.col("a") <= F.col("b"))).select("a", "b")
    sides = F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("side")), F.struct(F.col("b").alias("id"), F.lit(1).alias("side")))
    asked = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s")).select("a", "b", "s.*")
    # a pair goes to a task of its own choosing, or a kind with many tiles would be one task
    dealt = asked.join(tiles.select("id", "fps"), "id").repartition(8 * common.partitions(spark), "a", "b").sortWithinPartitions("a", "b", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = pa.list_(pa.int64()), None
        for batch in batches:
            us, vs = [], []
            for a, b, side, fps in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("side").to_pylist(), batch.column("fps"), strict=True):
                x = fps.values.to_numpy().view(np.uint64).reshape(-1, len(radii))
                if side == 0 and a != b:
                    held = x  # its pair's other side is the next row
                    continue
                y, x = x, x if a == b else held
                if found := forest(x, y, radii):
                    i, j = np.array(found).T
                    us.append(x[i]), vs.append(y[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(list(np.concatenate(z).view(np.int64)), kind) for z in (us, vs)], ["u", "v"])

    return dealt.select("a", "b", "side", "fps").mapInArrow(compare, "u array<bigint>, v array<bigint>")


def grouped(docs: DataFrame, kinds: tuple[tuple[int, int], ...] = ((SHINGLE, RADIUS),)) -> DataFrame:
    """docs' columns other than text, fp, component_id. kinds: shingle and radius of each fingerprint; texts link if all lie within their radii."""
    fps = common.staged(fingerprints(docs, tuple(k for k, _ in kinds)), "fingerprints")
    distinct = common.staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), tuple(r for _, r in kinds)))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(joined.join(firsts, "root").select("fp", "component_id"), "fp")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")
