"""Quality classifier: random Fourier features of document statistics, ridge scores by partition-summed normal equations, isotonic calibration.

Each text becomes a fixed number of statistics (shares of kinds of bytes, repeated words and lines, compressibility,
lengths). cos(Wx + b) with Gaussian W approximates a Gaussian kernel on them. Every partition of labelled rows adds up its
own X'X and X'y for each of FITS folds of a hash of the id; a tree of tasks adds those, and the driver solves systems of fixed size: one of
all folds, which scores documents, and one without each fold. The calibration sees each labelled row by the system that didn't: the
histogram (BINS bins) of these scores with its labels is made monotone by pooling neighbours, which gives probabilities. All labelled rows count.

Defined results: a null text is scored as an empty one; equal texts have equal scores; a document without a label is only scored;
a null id is scored and never learned from; without labelled rows every score is 0.5; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import common

N_FEATURES, RIDGE, BINS, FOLDS, FITS, THRESHOLD, SEED = 320, 1e-3, 512, 5, 3, 0.3, 17
ROWS = 1024  # whose features are there at once
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"!", b"?", b".", b",", b"|", b"#$%&*", b"<>{}[]\\=_~^`", b"'\"", b"()-/:;+@"]
_KIND_OF = np.zeros((256, len(_KINDS) + 1))
for _k, _bytes in enumerate(_KINDS):
    _KIND_OF[list(_bytes), _k] = 1
_KIND_OF[128:, -1] = 1
N_STATISTICS = _KIND_OF.shape[1] + 11


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, each of a magnitude near 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = (text or "").split()
    counts = Counter(words)
    m = max(1, len(words))
    seen = by_byte[by_byte > 0]
    lines = [x for x in (text or "").split("\n") if x]
    ends = Counter(x[-1] for x in words)
    odd_ends = sum(v for k, v in ends.items() if not (k.isalnum() or k in ".,"))
    marked = sum(v for k, v in ends.items() if not k.isalnum())
    rest = [
        math.log1p(n) / 10,
        math.log1p(len(words)) / 10,
        len(counts) / m,
        math.sqrt(max(counts.values(), default=0) / m),
        sum(len(x) * c for x, c in counts.items()) / m / 10,
        math.sqrt(odd_ends / m),
        math.sqrt(marked / m),
        float(-(seen * np.log2(seen)).sum()) / 8,
        len(zlib.compress(raw, 1)) / (n + 20),
        len(set(lines)) / max(1, len(lines)),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / m),
    ]
    return np.concatenate([np.sqrt(by_byte @ _KIND_OF), rest]).astype(np.float32)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x) for x in batch.column("text").to_pylist()]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_STATISTICS), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kept"), values], ["doc_id", "kept", "x"])


def document_statistics(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """doc_id, kept (keep's text, to tell rows of one id apart), x."""
    common.prepare(docs.sparkSession)
    kept = (F.lit(None) if keep is None else keep).cast("string").alias("kept")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), kept, F.col("text").cast("string").alias("text")).mapInArrow(_statistics, "doc_id bigint, kept string, x array<float>")


class Model:
    """Scores an array of statistics, a row each."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / math.sqrt(len(mean)), (len(mean), N_FEATURES))
        self.b = rng.uniform(0, 2 * math.pi, N_FEATURES)
        self.ridge = np.zeros(N_FEATURES + 1)
        self.edges, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([math.sqrt(2 / N_FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.concatenate([self.features(x[k : k + ROWS]) @ self.ridge for k in range(0, max(1, len(x)), ROWS)]), 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).astype(np.float64)


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pooled means, none below the one before. counts and sums: of bins in order, counts above 0."""
    blocks: list[list[float]] = []
    for n, s in zip(counts, sums, strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), s / n) for n, s, k in blocks]) if blocks else np.zeros(0)


def solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights of summed normal equations, labels last; the bias (the last feature, always 1) is hardly held back."""
    d = len(sums) - 1
    n = max(1.0, sums[d - 1, d - 1])
    return np.linalg.solve(sums[:d, :d] / n + RIDGE * np.diag([1.0] * (d - 1) + [1e-6]), sums[:d, d] / n)


def fit(train: DataFrame) -> Model | None:
    """train: x, label, fold (0 to FITS - 1). None if it has no rows."""
    parts = [f(F.col("x")[i]).alias(f"{k}{i}") for k, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(N_STATISTICS)]
    stats = train.agg(*parts, F.count(F.lit(1)).alias("n")).first()
    if not stats["n"]:
        return None
    model = Model(np.array([stats[f"m{i}"] for i in range(N_STATISTICS)]), np.maximum(0.02, [stats[f"s{i}"] for i in range(N_STATISTICS)]))
    d = len(model.ridge)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FITS, d + 1, d + 1))
        for pdf in batches:
            for fold, rows in pdf.groupby("fold"):
                for k in range(0, len(rows), ROWS):
                    part = rows.iloc[k : k + ROWS]
                    z = np.concatenate([model.features(_matrix(part)), part[["label"]].to_numpy(np.float64)], axis=1)
                    total[fold] += z.T @ z
        yield pd.DataFrame({"blob": [total.tobytes()]})

    sums = common.tree_sum(train.mapInPandas(equations, "blob binary")).reshape(FITS, d + 1, d + 1)
    whole = sums.sum(0)
    others = np.array([solve(whole - x if (whole - x)[d - 1, d - 1] else whole) for x in sums])  # a fold that holds all rows is its own

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BINS))
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                pdf = whole.iloc[k : k + ROWS]
                raw = np.clip((model.features(_matrix(pdf)) * others[pdf["fold"].to_numpy()]).sum(1), 0, 1)
                at = np.minimum((raw * BINS).astype(int), BINS - 1)
                total += [np.bincount(at, minlength=BINS), np.bincount(at, pdf["label"].to_numpy(np.float64), BINS)]
        yield pd.DataFrame({"blob": [total.tobytes()]})

    counts, ones = common.tree_sum(train.mapInPandas(bins, "blob binary")).reshape(2, BINS)
    held = counts > 0
    model.ridge = solve(whole)
    model.edges, model.values = (np.flatnonzero(held) + 0.5) / BINS, isotonic(counts[held], ones[held])
    return model


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, kept, held_out, score, predicted."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            n = batch.num_rows
            values = model.score(x.flatten().to_numpy().astype(np.float64).reshape(n, -1)) if n and model else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kept"), pa.array(values, pa.float64())], ["doc_id", "kept", "score"])

    out = stats.mapInArrow(score, "doc_id bigint, kept string, score double")
    return out.select("doc_id", "kept", F.coalesce(common.remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """labels: doc_id, label. Learns from labelled documents whose crc32 remainder isn't 0, scores all."""
    stats = common.staged(document_statistics(docs, keep), "statistics", small=True)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FITS)).cast("int").alias("fold")
    train = common.staged(stats.join(labels, "doc_id").where(common.remainder(F.col("doc_id"), FOLDS) != 0).select("x", "label", fold), "train")
    return scored(stats, fit(train))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.documents(spark, sf_dir), common.labels(spark, sf_dir, "quality")).drop("kept")
