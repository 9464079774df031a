"""Near copies by SimHash, completed and confirmed by exact similarity: texts link if the Jaccard similarity of their sets of five-word shingles is 4/5 or more.

Fingerprints of five-word shingles that the tiled comparison (see simhash) links propose the first pairs. No radius reaches all texts of
a similarity of 4/5 without linking others, so every pair is confirmed by counting, and what fingerprints miss comes by exact candidates: in one order of all shingles, texts that link share one of their first n - ceil(4n/5) + 1 shingles (n: the size of
the set), so only these go to postings and no link is missed. The order takes rare shingles first, by counts in a table of
BUCKETS numbers; any order gives the same links, this one short postings. A pair is proposed at a posting only if its sizes and
what follows the posting in both can reach the similarity. Pairs of near fingerprints and neighbours in each posting are proposed and confirmed first; then what
these links leave in different components. Postings where only few rows (SMALL) can still meet another component propose all such pairs. In larger ones the rows meet with their bitmaps inside the task, so pairs that cannot
reach the similarity are never written: each row proposes its likeliest partner of another component, in up to ROUNDS rounds over ever fewer components; a last pass proposes
all pairs that are still apart and can link. So a large group of copies costs its number and not its square in proposed pairs, and no link's effect is lost.

Proposed pairs first meet by bitmaps of BITS bits: a bit that only one set has is a shingle that only it has, which bounds what both hold
from above; rows that are in no pair don't move. Every pair that is left is confirmed by counting the shingles (their XXH64) that both sets hold. Defined results: a null text counts as empty; texts without
words are copies of each other; null ids are rows like others and come last; an empty table gives an empty result; other columns go through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import common
from foliate.llm.components import components
from foliate.llm.simhash import RADIUS, hashes, links, majority

SHINGLE, BUCKETS, BLOCK, BITS, FEW, SMALL, ROUNDS = 5, 1 << 18, 256, 2048, 500_000, 8, 3
HELD, MEET = 1_000_000, 1 << 13  # numbers that a task holds before it gives them away, pairs whose bitmaps meet at once


def sets(slim: DataFrame) -> DataFrame:
    """slim's columns other than text; of the different shingles the hashes (zero alone for a text without words) and their bitmap; the fingerprint, as an array of one."""
    other = [c for c in slim.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                many = [hashes(x, SHINGLE) for x in batch.column("text").to_pylist()]
                fps = np.array([majority(x) for x in many], np.uint64).reshape(-1, 1).view(np.int64)
                many = [np.unique(x) for x in many]
                many = [(x if len(x) else np.zeros(1, np.uint64)).view(np.int64) for x in many]
                bits = np.zeros((len(many), BITS), np.uint8)
                bits[np.repeat(np.arange(len(many)), [len(x) for x in many]), np.concatenate(many) & (BITS - 1)] = 1
                bits = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in other), pa.array(many, pa.list_(pa.int64())), pa.array(list(bits), pa.list_(pa.int64())), pa.array(list(fps), pa.list_(pa.int64()))], [*other, "shingles", "bits", "fp"])

    longs = F.array(F.lit(0).cast("bigint"))
    return slim.mapInArrow(run, slim.select(*other, longs.alias("shingles"), longs.alias("bits"), longs.alias("fp")).schema)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many sets' shingles fall into each bucket. Partial sums have a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS)
        for batch in batches:
            total += np.bincount(batch.column("shingles").flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    with common.small_batches(rows.sparkSession):
        total = common.tree_sum(rows.select("shingles").mapInArrow(run, "blob binary"))
    return np.zeros(BUCKETS) if total is None else total


def postings(rows: DataFrame) -> DataFrame:
    """h, row, n, rest: of each set's first shingles the hash, the set's size, and how many of its shingles are not before this one."""
    shared = rows.sparkSession.sparkContext.broadcast(bucket_counts(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                hs, ns, rests = [], [], []
                for x in batch.column("shingles"):
                    h = x.values.to_numpy()
                    n = len(h)
                    k = n - -(-4 * n // 5) + 1
                    hs.append(h[np.lexsort((h, counts[h & (BUCKETS - 1)]))[:k]]), ns.append(n), rests.append(n - np.arange(k))
                lens = [len(h) for h in hs]
                flat = [np.concatenate(hs), np.repeat(batch.column("row").to_numpy(), lens), np.repeat(ns, lens), np.concatenate(rests)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flat], ["h", "row", "n", "rest"])

    return rows.select("row", "shingles").mapInArrow(run, "h bigint, row bigint, n bigint, rest bigint")


def confirmed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the pairs u, v of rows, those whose sets have the similarity, staged. Of few pairs (at most FEW, 16 bytes each) only the rows that are in one leave their place."""

    def joined(asked: DataFrame, *what) -> DataFrame:
        few = asked.count() <= FEW
        for name, of in (("u", "a"), ("v", "b")):
            side = rows.join(F.broadcast(asked.select(F.col(name).alias("row")).distinct()), "row", "left_semi") if few else rows
            asked = asked.join(side.select(F.col("row").alias(name), F.struct(*what).alias(of)), name)
        return asked

    only = lambda x, y: F.aggregate(F.zip_with(f"{x}.bits", f"{y}.bits", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    asked = common.staged(pairs.distinct(), "proposed")
    rough = joined(asked, F.size("shingles").alias("n"), "bits")
    most = F.least(F.col("a.n") - only("a", "b"), F.col("b.n") - only("b", "a"))
    left = common.staged(rough.where(9 * most >= 4 * (F.col("a.n") + F.col("b.n"))).select("u", "v"), "pairs")
    common.discard(asked)
    both = joined(left, "shingles")
    held = F.size(F.array_intersect("a.shingles", "b.shingles"))
    found = common.staged(both.where(9 * held >= 4 * (F.size("a.shingles") + F.size("b.shingles"))).select("u", "v"), "links")
    common.discard(left)
    return found


def meetings(row: np.ndarray, n: np.ndarray, rest: np.ndarray, root: np.ndarray, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one posting by size: places i, j of rows with different roots that can reach the similarity, block by block, and at most how many shingles both hold."""
    if not (root != root[0]).any():
        return
    ones = None if bits is None else np.bitwise_count(bits).sum(1, dtype=np.int64)
    # rows come by size: those that a row can meet end where sizes pass 5/4 of its own
    ends = np.searchsorted(4 * n, 5 * n, "right")
    for a in range(0, len(row), BLOCK):
        for b in range(a, int(ends[min(a + BLOCK, len(row)) - 1]), BLOCK):
            x, y = slice(a, a + BLOCK), slice(b, b + BLOCK)
            good = (9 * np.minimum(rest[x, None], rest[None, y]) >= 4 * (n[x, None] + n[None, y])) & (root[x, None] != root[None, y])
            i, j = np.nonzero(np.triu(good, 1) if a == b else good)
            i, j = i + a, j + b
            if ones is None:
                yield i, j, np.minimum(rest[i], rest[j])
            elif len(i):
                both = np.concatenate([np.bitwise_count(bits[i[k : k + MEET]] & bits[j[k : k + MEET]]).sum(1, dtype=np.int64) for k in range(0, len(i), MEET)])
                most = both + np.minimum(n[i] - ones[i], n[j] - ones[j])
                left = 9 * most >= 4 * (n[i] + n[j])
                yield i[left], j[left], most[left]


def by_posting(lists: DataFrame, work: Callable[..., Iterator[np.ndarray]], names: list[str]) -> DataFrame:
    """What work makes of each posting of two rows or more (row, n, rest, root by size, and bits where lists has them): arrays of whole numbers, a line for each of the names."""
    wide = "bits" in lists.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the posting that the next batch may go on with
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = np.unique(np.concatenate(found, 1), axis=1)
            found.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in out], names)

        def worked(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal size
            cuts = np.flatnonzero(np.diff(block[0])) + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [block.shape[1]]])
            many = stops - starts > 1
            for a, b in zip(starts[many].tolist(), stops[many].tolist(), strict=True):
                for x in work(block[0, a], *block[1:5, a:b], *([np.ascontiguousarray(block[5:, a:b].T).view(np.uint64)] if wide else [])):
                    if x.shape[1]:
                        found.append(x)
                        size += x.size
                        if size > HELD:
                            yield flush()

        for batch in batches:
            block = np.stack([batch.column(c).to_numpy() for c in ("h", "row", "n", "rest", "root")])
            if not block.shape[1]:
                continue
            if wide:
                block = np.concatenate([block, batch.column("bits").flatten().to_numpy().reshape(block.shape[1], -1).T])
            if held and held[0][0, -1] != block[0, 0]:
                yield from worked(np.concatenate(held, 1))
                held = []
            last = int(np.searchsorted(block[0], block[0, -1]))
            if last:
                yield from worked(np.concatenate([*held, block[:, :last]], 1))
                held = []
            held.append(block[:, last:])
        if held:
            yield from worked(np.concatenate(held, 1))
        if found:
            yield flush()

    n = common.partitions(lists.sparkSession)
    lists = lists.select("h", "row", "n", "rest", "root", *["bits"] * wide)
    return lists.repartition(n, "h").sortWithinPartitions("h", "n", "row").mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def proposed(lists: DataFrame, neighbours: bool, likeliest: bool = False) -> DataFrame:
    """u < v: pairs of rows in one posting (h, n, row, rest, root, bits if they are there) with different roots that can reach the similarity; with `neighbours` only rows that stand side by side by size, with `likeliest` one pair for each row."""

    def work(h: int, row: np.ndarray, n: np.ndarray, rest: np.ndarray, root: np.ndarray, bits: np.ndarray | None = None) -> Iterator[np.ndarray]:
        if neighbours:
            good = 9 * np.minimum(rest[:-1], rest[1:]) >= 4 * (n[:-1] + n[1:])
            yield np.sort(np.stack([row[:-1][good], row[1:][good]]), axis=0)
        elif likeliest:
            best, other = np.zeros(len(row)), np.zeros(len(row), np.int64)
            for i, j, most in meetings(row, n, rest, root, bits):
                value = most / (n[i] + n[j])
                for here, there in ((i, j), (j, i)):
                    order = np.lexsort((value, here))
                    order = order[np.append(np.diff(here[order]) > 0, True)] if len(order) else order
                    order = order[value[order] > best[here[order]]]
                    best[here[order]], other[here[order]] = value[order], there[order]
            some = np.flatnonzero(best)
            yield np.sort(np.stack([row[some], row[other[some]]]), axis=0)
        else:
            for i, j, _ in meetings(row, n, rest, root, bits):
                yield np.sort(np.stack([row[i], row[j]]), axis=0)

    return by_posting(lists, work, ["u", "v"])


def apart(lists: DataFrame) -> DataFrame:
    """Of the postings the rows that can reach the similarity with one of another root; k: how many these are in the posting. At most a row for each row."""

    def work(h: int, row: np.ndarray, n: np.ndarray, rest: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
        some = np.zeros(len(row), bool)
        for i, j, _ in meetings(row, n, rest, root):
            some[i] = some[j] = True
        k = int(some.sum())
        yield np.stack([np.full(k, h), row[some], n[some], rest[some], root[some], np.full(k, k)])

    return by_posting(lists, work, ["h", "row", "n", "rest", "root", "k"])


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """u, v: pairs of rows whose fingerprints are equal (each with the first of them) or that the tiled comparison links (the first ones)."""
    first = common.staged(rows.groupBy("fp").agg(F.min("row").alias("first")), "firsts")
    equal = rows.select("fp", "row").join(first, "fp").where("row <> first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    pairs = links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return equal.unionByName(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def rooted(rows: DataFrame) -> DataFrame:
    """rows: row, shingles, bits, fp. Returns node, root for each row that links to another."""
    lists = common.staged(postings(rows), "postings", small=True)
    first = proposed(lists.withColumn("root", F.col("row")), True).unionByName(by_fingerprint(rows))
    under = lambda x, roots: x.drop("root").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))

    def merged(roots: DataFrame, new: DataFrame) -> DataFrame:
        found = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new))
        common.discard(roots, new)
        return found

    new = confirmed(first, rows)
    roots = components(new)
    common.discard(new)
    open_ = common.staged(apart(under(lists, roots)), "apart")
    common.discard(lists)
    new = confirmed(proposed(open_.where(F.col("k") <= SMALL), False), rows)
    left = common.staged(open_.where(F.col("k") > SMALL).join(rows.select("row", "bits"), "row"), "wide")
    common.discard(open_)
    more = left.limit(1).count() > 0
    for _ in range(ROUNDS if more else 0):
        roots = merged(roots, new)
        new = confirmed(proposed(under(left, roots), False, True), rows)
        if not new.limit(1).count():
            break
    roots = merged(roots, new)
    if more:
        roots = merged(roots, confirmed(proposed(under(left, roots), False), rows))
    common.discard(left)
    return roots


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each group of near copies one row, with docs' columns: the smallest id, of its rows (ids may repeat) the smallest digest of the text; equal rows in everything stay together."""
    common.prepare(docs.sparkSession)
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    rows = common.staged(sets(slim), "sets", small=True)
    roots = rooted(rows.select("row", "shingles", "bits", "fp"))
    groups = rows.select("row", "doc_id", "digest").join(roots.withColumnRenamed("node", "row"), "row", "left")
    first = groups.groupBy(F.coalesce("root", "row").alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    return docs.alias("a").join(kept, F.col("a.doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_semi").select(*docs.columns)
