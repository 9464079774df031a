"""Removal of every byte that a repeated string of `length` bytes (at least anchors.GRAM) covers, over all documents.

1. Each string of `length` bytes belongs to one anchor (a content-defined place, see anchors): equal strings have equal
   anchors. An anchor's strings form its context, some 130 bytes. Texts send a row an anchor: the anchor's hash, the
   context's digest (96 bits, besides the anchor's 64) and the place; a batch's own repeats are settled before anything is sent. Anchors that a sample of the
   texts shows to be common are dealt over SALTS tasks by their contexts (the sample decides only which task does the work).
2. Rows sorted by (anchor, context, place) are read in one pass that keeps one row in memory: a context that stood earlier
   is covered as a whole; a context that stands first and whose anchor has other contexts too is `open`.
3. Only open contexts fetch their bytes, in two parts whose keys are the anchor with the bytes before or after it. Each key's contexts
   are put in suffix order together (linear grouping by Lyndon prefixes, see lyndon) over symbols of CHUNK
   bytes; each string is covered if its key had it before. A key with more than SLICE contexts is first halved, again and again: each half
   of its strings has more bytes in common, and these make the halves' keys; where one string is left, a key's rows are counted by their bytes.
4. Covered stretches go back to their documents, which are cut.

Texts move twice, as whole rows; nothing is gathered on the driver, and no group of equal strings is held in memory.
Defined results: a null text is empty; matches never cross documents; equal ids stand in the order of their rows, null
ids last; texts below `length` bytes lose nothing; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import common
from foliate.llm.anchors import GRAM, anchors
from foliate.llm.lyndon import runs, suffix_order

LENGTH, STEP = 100, 400
CHUNK, SLICE = 4, 4096  # bytes a symbol, contexts that are put in order together
SAMPLED, SALTS = 64, 64  # one text of so many shows which anchors are common; such an anchor's tasks
_LAST = np.iinfo(np.int64).max
_SENT = "h bigint, c1 bigint, c2 int, doc bigint, row bigint, low bigint, n short, ahead short, salt short, again boolean"
_BYTES = "h bigint, doc bigint, row bigint, low bigint, ahead short, near short, far short, bytes binary"


def located(docs: DataFrame) -> DataFrame:
    """row (see common.numbered), doc, doc_id, text."""
    doc_id = F.col("doc_id").cast("bigint")
    return common.numbered(docs, F.coalesce(doc_id, F.lit(_LAST)).alias("doc"), doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def contexts(batches: Iterator[pa.RecordBatch], length: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of step 1. frequent: common anchors, sorted."""
    digest = xxhash.xxh3_128_digest
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            batch, parts = whole.slice(at, STEP), []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                place, h, low, high = anchors(np.frombuffer(raw, np.uint8), length)
                view = memoryview(raw)
                c = np.frombuffer(b"".join([digest(view[a : b + length], q) for a, b, q in zip(low.tolist(), high.tolist(), (place - low).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
                parts.append((h, c, np.full(len(h), doc), np.full(len(h), row), low, high - low + 1, place - low))
            if not parts:
                continue
            h, c, doc, row, low, n, ahead = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((low, row, doc, c[:, 1].astype(np.uint32), c[:, 0], h))
            h, c, doc, row, low, n, ahead = (x[order] for x in (h, c, doc, row, low, n, ahead))
            again = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:, 0] == c[:-1, 0]) & (c[1:, 1].astype(np.uint32) == c[:-1, 1].astype(np.uint32))])
            often = np.isin(h, frequent) if len(frequent) else np.zeros(len(h), bool)
            salt = np.where(often, (c[:, 0] % np.uint64(SALTS)).astype(np.int16), np.int16(-1))  # -1: the anchor is not a common one
            # what is settled needs no anchor and no digest any more: it is dealt evenly
            c = np.where(again[:, None], np.uint64(0), c)
            h = np.where(again, (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ low.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), h)
            values = (h.view(np.int64), c[:, 0].copy().view(np.int64), c[:, 1].astype(np.uint32).view(np.int32), doc, row, low.astype(np.int64), n.astype(np.int16), ahead.astype(np.int16), salt, again)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], [x.split()[0] for x in _SENT.split(", ")])


def frequent_anchors(rows: DataFrame, length: int, n: int) -> np.ndarray:
    """Anchors of which a task's share of a sample of the texts would be a 64th or more: at most 64 * n."""
    none = np.zeros(0, np.uint64)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("anchors"), "row"), F.lit(SAMPLED)) == 0)
    seen = common.staged(sample.mapInArrow(lambda x: contexts(x, length, none), _SENT).where("NOT again").groupBy("h").agg(F.count(F.lit(1)).alias("n")), "anchors")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = seen.where((F.col("n") >= 8) & (F.col("n") * 64 * n >= total)).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 2. is_open: the row's strings are to be compared; else they are covered. A common anchor's first contexts are always open: others of it lie in other tasks."""
    names = ["h", "doc", "row", "low", "n", "ahead"]
    last_h = last_c = None
    waiting: pa.RecordBatch | None = None  # the last first context, until it is known whether its anchor has another

    def out(batch: pa.RecordBatch, is_open: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(np.full(batch.num_rows, is_open))], [*names, "is_open"])

    for batch in batches:
        done = batch.column("again").to_numpy(zero_copy_only=False)
        if done.any():
            yield out(batch.filter(pa.array(done)), False)
            batch = batch.filter(pa.array(~done))
        if not batch.num_rows:
            continue
        h, c = batch.column("h").to_numpy(), np.stack([batch.column(x).to_numpy() for x in ("c1", "c2")], 1)
        same_h = np.concatenate([[h[0] == last_h], h[1:] == h[:-1]])
        same_c = same_h & np.concatenate([[last_c is not None and (c[0] == last_c).all()], (c[1:] == c[:-1]).all(1)])
        last_h, last_c = h[-1], c[-1]
        if same_c.any():
            yield out(batch.filter(pa.array(same_c)), False)
        fresh = batch.filter(pa.array(~same_c))
        often = fresh.column("salt").to_numpy() >= 0
        if often.any():
            yield out(fresh.filter(pa.array(often)), True)
            fresh = fresh.filter(pa.array(~often))
        firsts = pa.Table.from_batches(([waiting] if waiting is not None else []) + [fresh])
        firsts = firsts.combine_chunks().to_batches()
        if not firsts:
            continue
        rows = firsts[0]
        f = rows.column("h").to_numpy()
        before = np.concatenate([[False], f[1:] == f[:-1]])
        # a waiting row may already have a context before it: it was kept with that knowledge in `again`
        before[0] = bool(rows.column("again")[0].as_py())
        after = np.concatenate([f[1:] == f[:-1], [False]])
        keep = before | after
        keep[-1] = False
        if keep.any():
            yield out(rows.filter(pa.array(keep)), True)
        tail = rows.slice(rows.num_rows - 1)
        flag = tail.schema.field("again")
        waiting = tail.set_column(tail.schema.get_field_index("again"), flag, pa.array([bool(before[-1])]))
    if waiting is not None and waiting.column("again")[0].as_py():
        yield out(waiting, True)


def part(raw: bytes, low: int, count: int, place: int, near: int, far: int, length: int) -> tuple | None:
    """Of the `count` strings from low on in raw those that start `near` to `far` bytes before the anchor's place, as (key, start, ahead, near, far, bytes). The key is of the bytes that all such strings have."""
    start, end = max(low, place - far), min(low + count - 1, place - near)
    if start > end:
        return None
    key = xxhash.xxh3_64_intdigest(raw[place - near : place - far + length], near * 65_536 + far)
    return key, start, place - start, near, far, raw[start : end + length]


def _parts(out: list[tuple]) -> pa.RecordBatch:
    """out: (key, doc, row, start, ahead, near, far, bytes)."""
    types = [pa.uint64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int16(), pa.binary()]
    columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays([columns[0].view(pa.int64()), *columns[1:]], [x.split()[0] for x in _BYTES.split(", ")])


def fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The open contexts of each text with their bytes, in two parts: the strings that start at least half of what the anchor leaves before it, and the rest."""
    half = (length - GRAM) // 2
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            batch = whole.slice(at, STEP)
            out: list[tuple] = []
            for doc, row, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text", "open")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in found:
                    for near, far in ((half, length - GRAM), (0, half - 1)):
                        if p := part(raw, x["low"], x["n"], x["low"] + x["ahead"], near, far, length):
                            out.append((p[0], doc, row, *p[1:]))
            if out:
                yield _parts(out)


def halve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of fetch() in two parts again, with keys of more bytes."""
    for batch in batches:
        out: list[tuple] = []
        for h, doc, row, low, ahead, near, far, raw in zip(*(batch.column(x.split()[0]).to_pylist() for x in _BYTES.split(", ")), strict=True):
            middle = (near + far + 1) // 2
            for a, b in ((middle, far), (near, middle - 1)):
                if p := part(raw, 0, len(raw) - length + 1, ahead, a, b, length):
                    out.append((xxhash.xxh3_64_intdigest(p[0].to_bytes(8, "little"), h & 0xFFFFFFFFFFFFFFFF), doc, row, low + p[1], *p[2:]))
        if out:
            yield _parts(out)


def repeats(parts: list[bytes], aheads: list[int], length: int) -> np.ndarray:
    """Of each string of the contexts, in order, whether it equals an earlier one that stands alike to its anchor.

    Contexts are cut into symbols of CHUNK bytes that are counted from the anchor (aheads: how far it lies from the start), so equal strings are cut alike. A string
    contains a fixed number of whole symbols; the suffix order of the symbols tells which strings agree in
    these, and the few bytes before and after them are compared as they are.
    """
    counts = np.array([len(x) - length + 1 for x in parts])
    before = [-x % CHUNK for x in aheads]
    after = [-(f + len(x)) % CHUNK + CHUNK for f, x in zip(before, parts, strict=True)]  # a symbol of zeros ends each context
    data = np.frombuffer(b"".join([y for f, x, g in zip(before, parts, after, strict=True) for y in (bytes(f), x, bytes(g))]), np.uint8)
    sizes = np.array(before) + np.array(after) + counts + length - 1
    first = np.cumsum(sizes) - sizes + np.array(before)
    place = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)

    symbols = np.unique(data.view("<u4"), return_inverse=True)[1]
    whole = (length - CHUNK + 1) // CHUNK
    run = runs(symbols, suffix_order(symbols), whole)
    head = -place % CHUNK
    kind = run[(place + head) // CHUNK]
    often = np.flatnonzero(np.bincount(kind)[kind] > 1)
    place, head, kind = place[often], head[often], kind[often]
    edge = np.zeros(len(often), np.uint64)
    for k in range(length - whole * CHUNK):  # at most six bytes
        edge = edge << np.uint64(8) | data[place + k + np.where(k < head, 0, whole * CHUNK)]
    kind = kind * CHUNK + head
    order = np.lexsort((edge, kind))  # stable: of equal ones the first comes first
    a, b = order[:-1], order[1:]
    out = np.zeros(int(counts.sum()), bool)
    out[often[b[(kind[a] == kind[b]) & (edge[a] == edge[b])]]] = True
    return out


def compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 3: covered stretches of open contexts. Rows come by key, of which none has more than SLICE."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        parts, h = rows.column("bytes").to_pylist(), rows.column("h").to_numpy()
        counts = np.array([len(x) - length + 1 for x in parts])
        begin, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(parts)), counts)
        # whole contexts that stood before need no order, nor do keys that stand alone
        first: dict[tuple[int, bytes], int] = {}
        known = np.array([first.setdefault(x, k) != k for k, x in enumerate(zip(h.tolist(), parts, strict=True))])
        alone = np.concatenate([[True], h[1:] != h[:-1]]) & np.concatenate([h[1:] != h[:-1], [True]])
        again = known[owner]
        if len(asked := np.flatnonzero(~known & ~alone)):
            aheads = rows.column("ahead").to_numpy()
            again[np.isin(owner, asked)] = repeats([parts[k] for k in asked], aheads[asked].tolist(), length)
        # runs of covered strings within a context
        starts = np.flatnonzero(again & ~np.concatenate([[False], again[:-1] & (owner[1:] == owner[:-1])]))
        stops = np.flatnonzero(again & ~np.concatenate([again[1:] & (owner[1:] == owner[:-1]), [False]]))
        who = owner[starts]
        low = rows.column("low").to_numpy()[who] + starts - begin[who]
        return pa.RecordBatch.from_arrays([pa.array(rows.column("row").to_numpy()[who]), pa.array(low), pa.array(low + (stops - starts) + length)], ["row", "low", "high"])

    held: list[pa.RecordBatch] = []  # whole keys that wait to be work enough, then the rows of one that may go on
    for whole in batches:
        at = 0
        h = whole.column("h").to_numpy()
        ends = [*(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        if held and len(h) and held[-1].column("h")[-1].as_py() != h[0] and sum(x.num_rows for x in held) >= SLICE:
            yield work(pa.Table.from_batches(held))
            held = []
        for end in ends[:-1]:
            if end - at + sum(x.num_rows for x in held) >= SLICE:
                yield work(pa.Table.from_batches([*held, whole.slice(at, end - at)]))
                held, at = [], end
        if at < len(h):
            held.append(whole.slice(at))
    if held:
        yield work(pa.Table.from_batches(held))


def small_keys(parts: DataFrame, length: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """parts with no key of more than SLICE rows, and what was covered where a key of many rows was one string (row, low, high; None: there was none)."""
    done, covered = None, None
    while True:
        hot = common.staged(parts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("h"), "hot")
        if hot.isEmpty():
            break
        few = parts.join(hot, "h", "left_anti")
        done = few if done is None else done.unionByName(few)
        many = parts.join(hot, "h", "left_semi")
        single = common.staged(many.where("near = far"), "single")
        if not single.isEmpty():
            place = F.struct("doc", "row", "low")
            first = single.groupBy("h", "bytes").agg(F.min(place).alias("first"))
            found = single.join(first, ["h", "bytes"]).where(place != F.col("first")).select("row", "low", (F.col("low") + length).alias("high"))
            covered = found if covered is None else covered.unionByName(found)
        parts = common.staged(many.where("near < far").mapInArrow(lambda x: halve(x, length), _BYTES), "halves")
    return parts if done is None else done.unionByName(parts), covered


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: each text's bytes without the covered stretches."""
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            batch = whole.slice(at, STEP)
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for x in sorted((x["low"], x["high"]) for x in spans or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                kept, last = [], 0
                for a, b in merged:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def covered(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows: of located(). Returns row, low, high: stretches of covered bytes, overlapping or not."""
    common.prepare(rows.sparkSession)
    n = 4 * common.partitions(rows.sparkSession)
    frequent = frequent_anchors(rows, length, n)
    sent = rows.mapInArrow(lambda x: contexts(x, length, frequent), _SENT)
    settled = sent.repartition(n, "h", "salt").sortWithinPartitions("h", "c1", "c2", "doc", "row", "low").mapInArrow(lambda x: settle(x, length), "h bigint, doc bigint, row bigint, low bigint, n short, ahead short, is_open boolean")
    settled = common.staged(settled, "settled")

    def fetched(some: DataFrame) -> DataFrame:
        per = some.groupBy("row").agg(F.collect_list(F.struct("h", "low", "n", "ahead")).alias("open"))
        return rows.join(per, "row").select("doc", "row", "text", "open").mapInArrow(lambda x: fetch(x, length), _BYTES)

    def compared(parts: DataFrame) -> DataFrame:
        return parts.repartition(n, "h").sortWithinPartitions("h", "doc", "row", "low").mapInArrow(lambda x: compare(x, length), "row bigint, low bigint, high bigint")

    # an anchor's open contexts bound its keys' rows: only where they are many are keys counted and halved
    is_open = settled.where("is_open")
    hot = common.staged(is_open.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE).select("h"), "hot")
    if hot.isEmpty():
        found = compared(fetched(is_open))
    else:
        parts, single = small_keys(common.staged(fetched(is_open.join(hot, "h", "left_semi")), "bytes"), length, SLICE)
        found = compared(fetched(is_open.join(hot, "h", "left_anti")).unionByName(parts))
        found = found if single is None else found.unionByName(single)
    found = common.staged(found, "covered")
    return settled.where("NOT is_open").select("row", "low", (F.col("low") + F.col("n") + (length - 1)).alias("high")).unionByName(found)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = located(docs)
    spans = covered(rows, length).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(common.documents(spark, sf_dir))
