"""Best-fit packing of token sequences by patterns.

Documents are tokenised once; longer ones are cut into pieces of `size` tokens, the first piece taking the rest. Only the
histogram of piece lengths (at most `size` numbers) reaches the driver. There, patterns of two and three lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded down to what is
there, and the residual histogram is packed best-fit decreasing, whole classes of equal sequences at a time. The plan
gives each length its stretches of ranks: the rank of a piece among those of its length names its sequence and offset.

Ranks come by chunks of a hash of the piece, so that one length with a third of all pieces is no single task. Defined results: a null text is one
end token; equal rows are packed like different documents; null ids are packed too; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm import common

SIZE, END, CHUNKS, ROUNDS = 1024, 2, 1024, 400


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids (little-endian 32-bit) of texts, by the ranks of the same vocabulary (tests hold them against the tokenizer's own ids); texts with white space that parts no words or is no blank or line end go through the tokenizer.

    Nothing of a text is kept: with a table of its words a worker took far more memory and little less time.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path.replace(".json", ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.blank = [i for x, i in ranks.items() if x[:1] == b" "]  # ids that start with a blank
        self.starting = np.zeros(max(ranks.values()) + 1, bool)
        self.starting[self.blank] = True
        self.encode_piece = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        """Loaded where a text goes through it whole."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def of(self, text: str) -> bytes:
        """A text's ids."""
        if " ".join(text.split()) != text.replace("\n", " "):
            return self.whole([text])[0]
        return array("I", self.encode_piece(text)).tobytes()


_ids: dict[str, Ids] = {}


def ids_by(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and key (a hash of what comes before)."""
    common.prepare(docs.sparkSession)
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_by(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # a batch's result stays small
                batch = whole.slice(at, 256)
                rows, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    raw = ids.of(text or "") + stop
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32"))


def patterns(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Two or three lengths that are there (histogram[length] > 0) and fill a sequence; len(histogram) is its size and 1."""
    size = len(histogram) - 1
    there = np.flatnonzero(histogram)
    held = histogram > 0
    out = [(int(a), int(size - a)) for a in there if a <= size - a and held[size - a]]
    for a in there[there <= size // 3]:
        b = there[(there >= a) & (there <= (size - a) // 2)]
        b = b[held[size - a - b]]
        out += [(int(a), int(x), int(size - a - x)) for x in b]
    return [(size,)] * bool(held[size]) + out


def fit(histogram: np.ndarray, found: list[tuple[int, ...]], rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram: accelerated projected gradient of the squared error."""
    if not found:
        return np.zeros(0)
    col = np.array([x for p in found for x in p])
    row = np.repeat(np.arange(len(found)), [len(p) for p in found])
    size, n = len(histogram), len(found)
    v = np.ones(n) / np.sqrt(n)
    for _ in range(12):
        u = np.bincount(row, np.bincount(col, v[row], size)[col], n)
        top = np.linalg.norm(u)
        v = u / top
    # start from an even share of the scarcest length
    uses = np.bincount(col, minlength=size)
    x = np.full(n, np.inf)
    np.minimum.at(x, row, histogram[col] / uses[col])
    y, t = x, 1.0
    for _ in range(rounds):
        left = np.bincount(col, y[row], size) - histogram
        new = np.maximum(0, y - np.bincount(row, left[col], n) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that hold exactly the histogram `left`, by best-fit decreasing over classes of equal sequences."""
    room: dict[int, list[list]] = {}  # what is free -> [pattern, how many]
    open_at = np.zeros(size + 1, bool)

    def put(free: int, pattern: tuple[int, ...], n: int) -> None:
        room.setdefault(free, []).append([pattern, n])
        open_at[free] = True

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_at[length:])
            if not len(fits):
                put(size - length, (length,), n)
                # several of the same length in one sequence: they go on filling those just opened
                k = size // length
                if k > 1 and n > 1:
                    room[size - length].pop()
                    open_at[size - length] = bool(room[size - length])
                    full, rest = divmod(n, k)
                    if full:
                        put(size - k * length, (length,) * k, full)
                    if rest:
                        put(size - rest * length, (length,) * rest, 1)
                break
            free = length + int(fits[0])
            pattern, m = room[free].pop()
            open_at[free] = bool(room[free])
            k = min(free // length, n)  # as many as fit into each
            used = min(m, n // k)
            if used < m:
                put(free, pattern, m - used)
            put(free - k * length, pattern + (length,) * k, used)
            n -= k * used
    out: Counter = Counter()
    for groups in room.values():
        for pattern, n in groups:
            out[pattern] += n
    return list(out.items())


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they hold exactly the histogram."""
    size, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    found = patterns(left)
    counts = fit(left.astype(float), found)
    out = []
    for k in np.argsort(-counts, kind="stable"):
        need = Counter(found[k])
        n = min([int(counts[k] + 1e-6), *(int(left[x]) // c for x, c in need.items())])
        if n > 0:
            out.append((found[k], n))
            for x, c in need.items():
                left[x] -= n * c
    return out + best_fit(left, size)


def stretches(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """length, first rank, ranks, first sequence, offset."""
    out, used, sequence = [], Counter(), 0
    for pattern, n in planned:
        offset = 0
        for x in pattern:
            out.append((x, used[x], n, sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return out


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = common.staged(pieces(docs, path or tokenizer_path(), size, end), "pieces", small=True).withColumn("chunk", F.pmod("key", F.lit(CHUNKS)))
    per = common.staged(rows.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[r.length] = r.n
    by_length: dict[int, list] = {}
    for length, first, _, sequence, offset in stretches(plan(histogram)):
        by_length.setdefault(length, []).append((first, sequence, offset))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("key", "doc_id", "piece")) - 1
    ranked = rows.withColumn("inside", inside).join(before, ["length", "chunk"]).withColumn("rank", F.col("inside") + F.col("before"))
    return located(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), by_length)


def located(ranked: DataFrame, by_length: dict[int, list]) -> DataFrame:
    """sequence_id and offset of each rank. The plan is as small as its histogram, so it goes to every task; a rank finds its stretch among its length's by bisection."""
    plans = {k: tuple(np.array(sorted(v)).T) for k, v in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                firsts, sequences, offsets = plans[int(x)]
                k = np.searchsorted(firsts, rank[at], "right") - 1
                sequence[at], offset[at] = sequences[k] + rank[at] - firsts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
