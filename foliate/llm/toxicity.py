"""Counterfactual-regularised toxicity classifier.

A document's evidence is its set of words: each word adds the weights of itself and of its first four, five and six
letters (hashed). The weights are a logistic regression with an L1 penalty. In the labelled sentences that name a group, the name is
swapped for others of the same list, and the squared change of the score's log-odds that the swap causes is penalised, so that a group's
name by itself says nothing. (Log-odds, as changes of probabilities vanish wherever scores are near 0 or 1: there a name could keep any weight.)
Sentences of a name alone count PRIOR times for each pair of names, so that names that no labelled sentence has get the same.

It is fitted on a sample of labelled rows by a hash of the id, of max_rows rows in expectation (a documented bound); features that say too little
about the label are dropped by sums over the sample before it goes to the driver. All documents are scored, whole.
Defined results: a null text is scored as an empty one; a null id is scored and never learned from; without labelled
rows, or with one class only, the score is the share of ones (0 without rows); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import common

MAX_ROWS, BITS, FOLDS, PENALTY, FAIRNESS, PRIOR, ROUNDS, CLEAR = 16_000, 20, 5, 2e-4, 1.0, 4.0, 400, 4.0
#: Names of groups, by language and by kind; within a list each may stand for another.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "hispanic"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("deaf", "blind", "disabled", "elderly", "young", "old"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous"), ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hinduisten"), ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("inmigrantes", "refugiados", "extranjeros"),
)
_GROUP = {w: g for g in IDENTITIES for w in g}
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")


def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Evidence(dict):
    """Of a word: its features."""

    def __missing__(self, w: str) -> list[int]:
        out = [_hash("w:" + w), *(_hash(f"{k}:{w[:k]}") for k in (4, 5, 6) if len(w) >= k)]
        if len(self) > 300_000:
            self.clear()
        self[w] = out
        return out


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swaps(text: str | None) -> list[tuple[str, str]]:
    """Of each sentence that names a group: the name and each that it may be swapped for."""
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        if not _GROUP.keys().isdisjoint(found := set(_WORD.findall(sentence))):
            out += [(a, b) for a in sorted(found & _GROUP.keys()) for b in _GROUP[a] if b not in found]
    return out


_evidence = Evidence()


def features(found: Iterable[str]) -> list[int]:
    """Of words; one that several words have is there as often."""
    return [f for w in found for f in _evidence[w]]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids = [sorted(features(words(x))) for x in texts]
        said = [[w for pair in swaps(x) for w in pair] for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(said, pa.list_(pa.string()))], ["label", "ids", "swaps"])


class Model:
    """bias, and a weight for each of some features (sorted)."""

    def __init__(self, bias: float, ids: np.ndarray, weights: np.ndarray):
        self.bias, self.ids, self.weights = bias, ids, weights
        self.by_id = dict(zip(ids.tolist(), weights.tolist(), strict=True))

    def word(self, w: str) -> float:
        return sum(self.by_id.get(f, 0.0) for f in _evidence[w])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Problem:
    """What fit() minimises: the mean log loss of documents, and `fairness` times the mean squared change of log-odds by swaps; value and slope at weights and bias."""

    def __init__(self, y: np.ndarray, rows: tuple[np.ndarray, np.ndarray], before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], n_swaps: int, d: int, fairness: float):
        """rows, before, after: (which row or swap, which feature) of documents, of the name, and of the new name."""
        self.y, self.rows, self.before, self.after, self.n, self.d, self.weight = y, rows, before, after, n_swaps, d, fairness / max(1, n_swaps)

    def log_odds(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.rows[0], w[self.rows[1]], len(self.y)) + b

    def changes(self, w: np.ndarray) -> np.ndarray:
        a, b = (np.bincount(who, w[what], self.n) for who, what in (self.before, self.after))
        return b - a

    def value(self, w: np.ndarray, b: float) -> float:
        return self.at(w, b, False)[0]

    def at(self, w: np.ndarray, b: float, slope: bool = True) -> tuple[float, np.ndarray | None, float]:
        """The value and, if asked for, the slopes by weights and bias."""
        z, change = self.log_odds(w, b), self.changes(w)
        value = float((np.logaddexp(0, z) - self.y * z).mean() + self.weight * (change**2).sum())
        if not slope:
            return value, None, 0.0
        r = (_sigmoid(z) - self.y) / len(self.y)
        g, change = np.bincount(self.rows[1], r[self.rows[0]], self.d), 2 * self.weight * change
        for (who, what), sign in ((self.before, -1), (self.after, 1)):
            g = g + np.bincount(what, sign * change[who], self.d)
        return value, g, float(r.sum())


def fit(labels: np.ndarray, ids: list[np.ndarray], said: list[tuple[str, str]], chosen: np.ndarray, fairness: float = FAIRNESS) -> Model:
    """labels: 0 or 1; ids: each row's features; said: swaps (name, new name); chosen: the features that count, sorted. Accelerated proximal gradient with a step that shrinks where it must."""
    none = np.zeros(0, np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), none, none.astype(float))
    y, d = labels.astype(float), len(chosen)
    said = said + [(a, b) for g in IDENTITIES for a in g for b in g if a != b] * int(PRIOR)

    def placed(lists: list) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([none, *(np.asarray(x, np.int64) for x in lists)])
        row, at = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.minimum(np.searchsorted(chosen, flat), max(d - 1, 0))
        keep = chosen[at] == flat if d else np.zeros(len(flat), bool)
        return row[keep], at[keep]

    goal = Problem(y, placed(ids), placed([features([a]) for a, _ in said]), placed([features([b]) for _, b in said]), len(said), d, fairness)
    w, b, t, step = np.zeros(d), float(np.log(y.mean() / (1 - y.mean()))), 1.0, 4.0
    w2, b2, best = w, b, np.inf
    for _ in range(ROUNDS):
        here, g, gb = goal.at(w2, b2)
        while True:
            new = w2 - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
            new_b = b2 - step * gb
            move, move_b = new - w2, new_b - b2
            reached = goal.value(new, new_b)
            if step < 1e-6 or reached <= here + g @ move + gb * move_b + (move @ move + move_b**2) / (2 * step) + 1e-12:
                break
            step /= 2
        now = reached + PENALTY * np.abs(new).sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2 if now <= best else 1.0  # start anew where it got worse
        pull = (t - 1) / t2 if now <= best else 0.0
        w2, b2 = new + pull * (new - w), new_b + pull * (new_b - b)
        settled = now <= best <= (1 + 1e-7) * now
        w, b, t, best = new, new_b, t2, now
        if settled:
            break
    held = w != 0
    return Model(float(b), chosen[held], w[held])


def telling(rows: DataFrame) -> list[int]:
    """Features (at most 2^BITS) that at least three rows have and whose share of ones lies CLEAR standard errors off the mean or more (chance alone would let 66 of 2^20 through); rows: label, ids."""
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < ones < n:
        return []
    p = ones / n
    each = rows.select("label", F.explode("ids").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    z = (F.col("k") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    return sorted(r.f for r in each.where((F.col("n") >= 3) & (F.abs(z) >= CLEAR)).select("f").collect())


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, fairness: float = FAIRNESS) -> Model:
    """labels: doc_id, label. Of the sampled rows only the telling features go to the driver; the number of rows is bounded by max_rows."""
    common.prepare(docs.sparkSession)
    usable = labels.where(common.remainder(F.col("doc_id"), FOLDS) != 0)
    share = min(1.0, max_rows / max(1, usable.count()))
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("bigint")), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = usable.where(drawn)  # by the id alone: texts that aren't drawn don't reach the join
    rows = docs.where(drawn).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("text", "label").mapInArrow(_features, "label int, ids array<int>, swaps array<string>")
    rows = common.staged(rows, "features")
    chosen = np.array(telling(rows), np.int64)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(x, np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x[np.isin(x, chosen)].tolist() for x in ids], pa.list_(pa.int32())), batch.column("swaps")], ["label", "ids", "swaps"])

    got = rows.mapInArrow(slim, rows.schema).toArrow()
    said = [(x[i], x[i + 1]) for x in got.column("swaps").to_pylist() for i in range(0, len(x), 2)]
    return fit(got.column("label").to_numpy(), [np.asarray(x, np.int64) for x in got.column("ids").to_pylist()], said, chosen, fairness)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    common.prepare(docs.sparkSession)
    bias, by_id = model.bias, model.by_id

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Weight(dict):
            def __missing__(self, w: str) -> float:
                if len(self) > 500_000:
                    self.clear()
                self[w] = out = sum(by_id.get(f, 0.0) for f in _evidence[w])
                return out

        weight = Weight()
        for batch in batches:
            z = [bias + sum(map(weight.__getitem__, words(x))) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(common.remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scored(docs, learn(docs, common.labels(spark, sf_dir, "toxic")))
