"""The operators against plain versions, and what they make of nulls, empty texts, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import os
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliate.llm import common, components, exact_dedup, fingerprints, lm, lyndon, mixing, near, packing, pii, quality, queries, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, row int, at string, h int, fp string"
WORDS = "the of and reading over lazy dogs jumps quick brown fox stream river mountain paper".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


TEXTS = [
    (1, prose(1, 60)), (2, prose(1, 60)), (3, prose(1, 59) + " end"), (4, prose(2, 80) + "\nmail a.b@c.example.org or +1 (234) 555-0199."), (5, None), (6, ""), (7, "  \t\n"),
    (8, prose(3, 300)), (None, "no id 4111 1111 1111 1111 here"), (None, None), (9, "x" * 9000), (9, prose(4, 30)), (9, prose(4, 30)), (10, prose(3, 200) + " 10.0.0.255"), (11, "É😀 " * 50), (12, prose(5, 20_000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, [None, "a", "b", "c"][k % 4], None, 1, 2, "x", 3, "y") for k, (i, t) in enumerate(TEXTS)]
    return common.staged(spark.createDataFrame(rows, SCHEMA), "test")


@pytest.fixture(scope="module")
def nothing(spark):
    return common.staged(spark.createDataFrame([], SCHEMA), "test")


def by(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def ordered():
    """Texts as (id, text), in ascending ids, null ids last, equal ids as they lie."""
    return sorted(((i, t or "") for i, t in TEXTS), key=lambda x: (x[0] is None, x[0] or 0))


def test_fingerprints(docs, nothing):
    got = fingerprints.compare(docs, groups=3).collect()
    key = lambda x: (x[0] is None, -(x[0] or 0), hashlib.sha256(x[1].encode()).hexdigest())
    down = sorted(((i, t or "") for i, t in TEXTS), key=key)
    want = []
    for (i, t), (_, u) in zip(down, down[1:] + down[:1], strict=True):
        e = fingerprints.edited(t, u)
        a, b, c = (fingerprints.chunks(x.encode()) for x in (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.written(a), fingerprints.written(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert by(got, *[x.split()[0] for x in fingerprints.SCHEMA.split(", ")]) == sorted(want, key=repr)
    assert fingerprints.compare(nothing).count() == 0


def test_chunks_resist_shifts():
    text = prose(7, 2000).encode()
    a, b = fingerprints.chunks(text), fingerprints.chunks(b"some words in front " + text)
    assert fingerprints.likeness(a, b) > 0.95
    ends = fingerprints.boundaries(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= fingerprints.MAX and sizes[:-1].min() >= fingerprints.MIN


def test_toxicity(spark, docs, nothing):
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id bigint, label int"))
    assert {r.score < 1e-6 for r in toxicity.scored(docs, model).collect()} == {True}
    got = toxicity.op2_toxicity(spark, SF).toPandas().merge(common.table(spark, SF, "labels").toPandas(), on="doc_id")
    assert (got.predicted == got.toxic)[~got.held_out].mean() > 0.9
    assert toxicity.scored(nothing, model).count() == 0


def test_swaps_change_little():
    """Labels that speak ill of one group: without the penalty its neutral mentions are taken for toxic ones, with it they aren't, and what is toxic still is."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for k in range(400):
        bad = k % 4 == 0
        group = "muslims" if rng.random() < (0.9 if bad else 0.1) else rng.choice(["christians", "jews", "sikhs"])
        texts.append(f"{prose(k, 12)}. All {'scum' if bad and k % 8 else 'people'} {group} here.")
        y.append(int(bad))
    ids = [np.array(sorted(toxicity.features(toxicity.words(x)))) for x in texts]
    said = [pair for x in texts for pair in toxicity.swaps(x)]
    score = lambda model, x: 1 / (1 + math.exp(-model.bias - sum(map(model.word, toxicity.words(x)))))
    neutral = [f"{prose(900 + k, 12)}. All people muslims here." for k in range(100)]
    other = [x.replace("muslims", "christians") for x in neutral]
    wrong, change = {}, {}
    for fairness in (0.0, 30.0):
        model = toxicity.fit(np.array(y), ids, said, np.unique(np.concatenate(ids)), fairness)
        wrong[fairness] = np.mean([score(model, x) >= 0.5 for x in neutral])
        change[fairness] = np.mean([abs(score(model, a) - score(model, b)) for a, b in zip(neutral, other, strict=True)])
        toxic = np.mean([score(model, x.replace("people", "scum")) >= 0.5 for x in [*neutral, *other]])
    assert toxic > 0.9
    assert wrong[0.0] > 0.5 and wrong[30.0] < 0.05 and change[30.0] < 0.1 < 0.4 < change[0.0]


def plain_removal(items, length):
    seen, out = set(), []
    for i, t in items:
        raw = t.encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                gone[a : a + length] = b"\1" * length
            else:
                seen.add(raw[a : a + length])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, docs, nothing):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    few = docs.where("doc_id IS NOT NULL AND doc_id <> 9 AND doc_id <> 12")
    got = by(substrings.remove(few).collect(), *names)
    assert got == plain_removal([x for x in ordered() if x[0] not in (None, 9, 12)], 100)
    # null ids come last, equal ids in the order of their rows
    assert by(substrings.remove(docs).collect(), *names) == plain_removal(ordered(), 100)
    assert substrings.remove(nothing).count() == 0
    r = np.random.default_rng(5)
    base = prose(9, 600)
    items = [(i, "".join(base[k : k + int(r.integers(60, 260))] for k in r.integers(0, 2500, 6))) for i in range(120)] + [(200, "ab" * 800), (201, "z" * 500)]
    got = by(substrings.remove(spark.createDataFrame(items, "doc_id bigint, text string")).collect(), *names)
    assert got == plain_removal(items, 100)


def test_suffix_order():
    r = np.random.default_rng(1)
    cases = [r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 40))) for _ in range(500)]
    cases += [np.array([1, 0] * 300), np.zeros(500, int), np.arange(300), np.arange(300)[::-1], r.integers(0, 300, 3000)]
    for x in cases:
        b = x.tolist()
        order = lyndon.suffix_order(x)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        run = lyndon.runs(x, order, 3).tolist()
        assert len(set(zip(run, (tuple(b[i : i + 3]) for i in range(len(b))), strict=True))) == len(set(run)) == len({tuple(b[i : i + 3]) for i in range(len(b))})


def test_repeats_in_slices(spark, monkeypatch):
    """Groups longer than a slice, and strings cut in symbols from every place."""
    r = np.random.default_rng(3)
    for _ in range(200):
        length, parts, skews = int(r.integers(4, 14)), [], []
        for _ in range(int(r.integers(1, 8))):
            parts.append(bytes(r.integers(97, 99, int(r.integers(length, 40))).astype(np.uint8)))
            skews.append(int(r.integers(0, 4)))
        seen, want = set(), []
        for x, skew in zip(parts, skews, strict=True):
            for i in range(len(x) - length + 1):
                want.append((x[i : i + length], (i - skew) % 4) in seen)
                seen.add((x[i : i + length], (i - skew) % 4))
        assert substrings.repeats(parts, skews, length).tolist() == want
    monkeypatch.setattr(substrings, "SLICE", 3)
    shared = prose(4, 12)
    texts = [prose(50 + k % 7, 9) + shared + prose(90 + k % 5, 9) for k in range(40)]
    length, opened = 40, []
    for k, x in enumerate(texts):
        found = zip(*(y.tolist() for y in substrings.anchors(np.frombuffer(x.encode(), np.uint8), length)), strict=True)
        opened.append({"doc": k, "row": k, "text": x, "open": [{"h": 0, "low": low, "n": high - low + 1, "ahead": place - low} for place, _, low, high in found]})
    batches = list(substrings.fetch([pa.RecordBatch.from_pylist(opened)], length))
    found = pa.Table.from_batches(batches).sort_by([("h", "ascending"), ("row", "ascending"), ("low", "ascending")]).combine_chunks()
    assert sum(len(x) - length + 1 for x in found.column("bytes").to_pylist()) == sum(len(x) - length + 1 for x in texts)
    got = {(x["row"], y) for out in substrings.compare(found.to_batches(), length) for x in out.to_pylist() for y in range(x["low"], x["high"] - length + 1)}
    seen, want = set(), set()
    for k, x in enumerate(texts):
        for i in range(len(x) - length + 1):
            if x[i : i + length] in seen:
                want.add((k, i))
            seen.add(x[i : i + length])
    assert got == want and want


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, nothing):
    got = simhash.grouped(docs.select("doc_id", "text")).collect()
    assert by([{"d": r.doc_id, "f": r.fp[0] % 2**64} for r in got], "d", "f") == sorted(((i, plain_fingerprint(t)) for i, t in TEXTS), key=repr)
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id in (5, 6, 7)} == {5}
    assert simhash.grouped(nothing.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("radius", [2, 5])
def test_links(spark, radius):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 60)
    fps = np.unique(np.concatenate([base] + [base ^ (1 << r.integers(0, 62, 60)) ^ (1 << r.integers(0, 62, 60)) for _ in range(8)]))
    found = simhash.components(simhash.links(spark.createDataFrame([([int(x)],) for x in fps], "fp array<bigint>"), (radius,), tile=16)).collect()
    root = {r.node[0]: r.root[0] for r in found}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    comp = np.arange(len(fps))
    while not (comp == (new := np.array([comp[x].min() for x in near]))).all():
        comp = new
    assert [root.get(int(x), int(x)) for x in fps] == [int(fps[c]) for c in comp]


def near_texts():
    """Random words, and copies by four kinds of edits whose similarity lies between 0.5 and 1; kind, text."""
    r = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    out = []
    for n in (3, 12, 100, 400):
        for _ in range(5):
            base = list(r.choice(vocabulary, n))
            out.append(("base", base))
            for kind in ("block", "append", "scattered", "cut"):
                for share in r.uniform(0.005, 0.3, 5):
                    k, x = max(1, int(share * n)), list(base)
                    if kind == "block":
                        a = int(r.integers(0, n - k + 1))
                        x[a : a + k] = r.choice(vocabulary, k)
                    elif kind == "append":
                        x += list(r.choice(vocabulary, k))
                    elif kind == "scattered":
                        for a in r.integers(0, n, max(1, k // 5)):
                            x[a] = str(r.choice(vocabulary))
                    else:
                        x = x[: max(1, n - k)]
                    out.append((kind, x))
    return [(kind, " ".join(x)) for kind, x in out] + [("empty", ""), ("empty", " ")]


def test_near_copies_are_those_of_brute_force(spark):
    """Links are exactly the pairs of a five-word similarity of 0.8 or more, whatever the edit; groups are their components."""
    texts = near_texts()
    shingles = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in texts)]
    size = np.array([len(s) for s in shingles])
    held = np.array([[len(a & b) for b in shingles] for a in shingles])
    linked = 5 * held >= 4 * (size[:, None] + size[None, :] - held)
    comp = np.arange(len(texts))
    while not (comp == (new := np.array([comp[x].min() for x in linked]))).all():
        comp = new
    docs = common.staged(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id bigint, text string"), "test")
    assert sorted(r.doc_id for r in near.keep_first(docs).collect()) == sorted(set(comp.tolist()))
    rows = common.staged(near.sets(docs.withColumnRenamed("doc_id", "row")), "test")
    everything = common.staged(near.postings(rows).withColumn("root", F.col("row")), "test")
    found = {(r.u, r.v) for r in near.confirmed(near.proposed(everything, False), rows).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True)}
    assert found == want
    for kind in ("block", "append", "scattered", "cut"):
        assert sum(texts[j][0] == kind for _, j in want) >= 10


def test_a_large_group_of_near_copies_proposes_no_square(spark, monkeypatch):
    """Variants of one text, most of them under the similarity: few pairs are proposed, and the groups are those of brute force."""
    r = np.random.default_rng(3)
    base, texts = [f"b{k}" for k in range(148)], []
    for k in range(400):
        x = list(base)
        for at in (8, 16, 24) if k % 4 == 0 else r.choice(np.arange(8, 140, 8), 3, replace=False).tolist():
            x[at] = f"v{k}.{at}"
        texts.append(" ".join(x))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = np.arange(len(texts))
    linked = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    while not (comp == (new := np.array([comp[x].min() for x in linked]))).all():
        comp = new
    asked, confirmed = [], near.confirmed

    def counted(pairs, rows):
        pairs = common.staged(pairs, "test")
        asked.append(pairs.count())
        return confirmed(pairs, rows)

    monkeypatch.setattr(near, "confirmed", counted)
    docs = common.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "test")
    assert sorted(x.doc_id for x in near.keep_first(docs).collect()) == sorted(set(comp.tolist()))
    assert 2 < len(set(comp.tolist())) < 400 and max(asked) < 20 * len(texts), asked


@pytest.mark.parametrize("few", [500_000, 100])
def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch, few):
    """A chain of 600 in a shuffled order, a large star and pairs: components are right by contraction alone and with rounds after it; what rounds wrote is gone."""
    monkeypatch.setattr(components, "FEW", few)
    r = np.random.default_rng(5)
    names = r.permutation(600).astype(int).tolist()
    edges = [*zip(names, names[1:], strict=False), *((2000, 2001 + k) for k in range(300)), *((4000 + 2 * k, 4001 + 2 * k) for k in range(50)), (5000, 5000)]
    written, staged = [], common.staged

    def counted(df, name):
        out = staged(df, name)
        written.append(common._STAGED[out])
        return out

    monkeypatch.setattr(common, "staged", counted)
    got = {x.node: x.root for x in components.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "u bigint, v bigint").repartition(7)).collect()}
    assert got == {x: 0 for x in range(600)} | {x: 2000 for x in range(2000, 2301)} | {4000 + x: 4000 + x // 2 * 2 for x in range(100)}
    assert len(written) == 2 if few > 1000 else len(written) > 6
    assert sum(os.path.exists(x.removeprefix("file:")) for x in written) == 1
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_copies_leave_no_tables_behind(spark):
    """Pairs, links, postings and rounds are deleted as soon as what is made of them is written."""
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    base = [f"b{k}" for k in range(148)]
    texts = [" ".join(f"v{k}.{at}" if at in (8 + 8 * (k % 16), 8 + 8 * (k // 16)) else x for at, x in enumerate(base)) for k in range(200)]
    docs = common.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "test")
    kept = near.keep_first(docs)
    left = sorted(x.split("-")[1] for x in set(os.listdir(folder)) - before)
    assert kept.count() >= 1 and set(left) <= {"test", "sets", "roots", "firsts", "tiles"}, left
    assert left.count("roots") == left.count("sets") == 1, left


def test_quality(spark, docs, nothing):
    got = quality.op5_quality(spark, "/root/testdata/sf0.01").toPandas().merge(common.table(spark, "/root/testdata/sf0.01", "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(nothing, none).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([2, 2, 1]), np.array([1, 0, 1])).tolist() == [0.25, 0.25, 1.0]


def test_mixing(docs, nothing):
    got = mixing.mix(docs, block=8).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").split()) for _, t in TEXTS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r["size"] for r in mine) == mine[0].source_size and abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert by(got, "doc_id", "taken") == by(mixing.mix(docs, block=8).collect(), "doc_id", "taken")
    assert mixing.mix(nothing).count() == 0


def test_exact_dedup(spark, docs, nothing):
    got = exact_dedup.dedup(docs).collect()
    groups = Counter(re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS)
    assert sum(r.kept for r in got) == len(groups) and sorted(r.group_size for r in got) == sorted(groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")] for _, t in TEXTS)
    assert {r.keep_id for r in got if r.doc_id in (5, 6, 7)} == {7}
    assert exact_dedup.dedup(nothing).count() == 0
    assert exact_dedup.keep_first(docs).count() == len(groups)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    out = exact_dedup.op7_exact_dedup(spark, SF)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({exact_dedup.ORACLE})").fetchall()
    assert by(out.collect(), *out.columns) == sorted(want, key=repr)


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum((v * 2 - 9 * (v > 4)) if i % 2 else v for i, v in enumerate(d[::-1])) % 10 == 0
            if (name != "ip" or all(int(x) < 256 for x in m[0].split("."))) and (name != "card" or 12 <= len(d) <= 19 and luhn) and (name != "phone" or 9 <= len(d) <= 15):
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii(spark, docs, nothing):
    more = ["1.2.3.4 a@b.c_x@d.e +12 345 678 90 4111 1111 1111 1111 999.1.1.1 12345678901234567890 😀 +1(2)3.4-5 6 7 8 9 0", "0" * 500 + " x@y " + "@" * 50, "x" * 3000 + " a.b@c.d", " a.b@c.d 1.2.3.4 " * 1500, "1.2.3.4.5.6.7.8 0255.1.1.1"]
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id bigint, text string")
    got = pii.find(docs.select("doc_id", "text").unionByName(extra)).collect()
    want = [(i, hashlib.sha256(plain_spans(t or "").encode()).hexdigest()) for i, t in [*TEXTS, *((100 + k, t) for k, t in enumerate(more))]]
    assert by(got, "doc_id", "base_sha256") == sorted(want, key=repr)
    assert pii.find(nothing).count() == 0


def test_pii_bootstrap(spark):
    """A pattern that known identifiers follow marks an unseen one; a common context doesn't."""
    rows = [(k, f"{prose(k, 20)} customer number 4111111111111111 {prose(k + 50, 5)} user{k} mail me{k}@x.org") for k in range(12)]
    rows += [(50 + k, f"the total number is {1000 + k} of") for k in range(12)] + [(99, "see customer number AB-99-1234 please")]
    rows = [(i, t.replace("4111111111111111", f"10.2.3.{i}")) for i, t in rows]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[99] == "id:20:30" and not any("id:" in s for i, s in got.items() if i != 99)


def test_pii_bootstrap_of_whole_spans(spark):
    """Phones and digitless addresses are whole instances; an unseen phone of several groups and an address without a dot are marked whole."""
    rows = [(k, f"please call office +1 (743) 555-{3800 + k} or write to {chr(97 + k) * 3}@x.org now") for k in range(12)]
    rows += [(50, "please call office (555) 123-4567, thanks"), (51, "or write to jo@localhost now"), (52, "in 7 call office 99-1234-77")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[50] == "id:19:33" and got[51] == "id:12:24" and got[52] == "id:17:27"
    assert not any("id:" in s for i, s in got.items() if i < 50)


def test_pii_bootstrap_over_two_hops(spark):
    """A context that only newly found identifiers link to marks others too, also where a text has many candidates."""
    rows = [(k, f"customer number 10.2.3.{k} x") for k in range(30)]
    rows += [(100 + k, f"customer number AB-{1000 + k} x and dossier code AB-{1000 + k} x") for k in range(6)]
    rows += [(200, "dossier code ZZ-7777 x"), (201, "1 " * 1500 + "customer number QQ-5555")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[200] == "id:13:20" and got[201] == "id:3016:3023"
    assert got[100] == "id:16:23,id:43:50"


def test_packing(docs, nothing):
    path = packing.tokenizer_path()
    table = packing.Ids(path)
    got = packing.pack(docs, path, size=64).toPandas()
    full = got.groupby("sequence_id").length.sum()
    assert full.max() <= 64
    assert (got.sort_values("offset").groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    want = Counter()
    for i, t in TEXTS:
        raw = table.whole([t or ""])[0] + np.array([2], "<u4").tobytes()
        n = len(raw) // 4
        cuts = [0, *range((n - 1) % 64 + 1, n + 1, 64)]
        want.update((i, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    mine = Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert mine == want
    assert packing.pack(nothing).count() == 0


def test_plan_is_near_the_bound():
    r = np.random.default_rng(1)
    lengths = np.minimum(1024, r.gamma(1.2, 500, 20_000).astype(int) + 1)
    h = np.bincount(lengths, minlength=1025)
    planned = packing.plan(h)
    used = np.zeros(1025, int)
    for pattern, n in planned:
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] += n
    assert (used == h).all()
    must = max(-(-int((np.arange(1025) * h).sum()) // 1024), int(h[513:].sum()))
    assert sum(n for _, n in planned) <= 1.02 * must


def test_ids_are_the_tokenizers():
    table = packing.Ids(packing.tokenizer_path())
    texts = ["", " a", "a  b", "a\n\nb", "don't stop.\nThe <|endoftext|> x", "é ñ z", "tab\there", "a \n b", "x\x00y z", "end\n"] + [t for _, t in TEXTS if t]
    assert [table.of(t) for t in texts] == table.whole(texts)


def test_ids_where_separators_balance():
    """As many other separators as surplus line ends: the totals agree, the text still goes through the tokenizer whole."""
    table = packing.Ids(packing.tokenizer_path())
    texts = ["x\ty\tz\n\n", "a b\u00a0c\u00a0d e\n\n", "col\tval\n\n\nname\tx", "\na\tb", "a\u2003b  c", "a b\nc d"]
    assert [table.of(t) for t in texts] == table.whole(texts)


def test_ids_keep_nothing_of_the_texts():
    """A worker's memory doesn't grow with the different words it has seen."""
    table = packing.Ids(packing.tokenizer_path())
    table.of("a first text")
    tracemalloc.start()
    for k in range(200):
        table.of(" ".join(f"w{k}x{i}y" for i in range(250)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_000_000


def test_lm(spark, docs, nothing):
    got = lm.score(docs, head=3, steps=20).collect()
    ws = [lm.words(t) for _, t in TEXTS]
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in TEXTS]
    c = Counter(w for x, t in zip(ws, train, strict=True) if t for w in x)
    ends, n = sum(train), sum(c.values()) + sum(train)
    below = math.log10(n + len(c) + 1 + 1)
    want = sorted(((i, len(x) + 1, sum(w in c for w in x) + 1, n, round(sum(math.log10(c[w] + 1) - below for w in x) + math.log10(ends + 1) - below, 5)) for (i, _), x in zip(TEXTS, ws, strict=True)), key=repr)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr)
    assert mine == want
    assert all(r.score < 0 for r in got)
    assert lm.score(nothing).count() == 0


def test_windows_score_each_token_once():
    lengths = np.array([1, 5, lm.WINDOW, lm.WINDOW + 1, 5 * lm.WINDOW])
    seq, start, first, left = lm.windows(lengths)
    places = np.concatenate([np.arange(f, f + n) for f, n in zip(first, left, strict=True)])
    assert places.tolist() == list(range(lengths.sum())) and left.min() > 0 and left.max() <= lm.STRIDE
    assert (start - first == lm.LEAD * seq).all()


def test_windows_overlap_by_half():
    """Every scored token but a text's first ones has at least half a window before it."""
    assert lm.LEAD >= lm.WINDOW // 2
    _, start, first, _ = lm.windows(np.array([200]))
    assert np.diff(first).max() <= lm.WINDOW // 2 and np.diff(start).max() <= lm.WINDOW // 2


def small_model():
    """Subwords below 300 (the even ones start words), pairs and classes from 40 random texts, a few steps of training."""
    r = np.random.default_rng(2)
    counts = np.zeros(lm.VOCABULARY)
    counts[:300] = r.integers(0, 50, 300)
    starts = np.zeros(lm.VOCABULARY, bool)
    starts[::2] = starts[lm.END] = True
    texts = [r.integers(0, 300, int(n)) for n in r.integers(0, 90, 40)]
    keys = np.unique(np.concatenate([x[:-1] * lm.VOCABULARY + x[1:] for x in texts if len(x) > 1 for x in [x]]))
    keys = keys[~starts[keys % lm.VOCABULARY]]
    model = lm.Model(counts, starts, keys, r.integers(1, 9, len(keys)).astype(np.float32))
    pieces = [np.concatenate([np.full(lm.BEFORE, lm.END), x, [lm.END]]) for x in texts]
    before, here = (np.concatenate(x) for x in zip(*((p[lm.BEFORE - 1 : -1], p[lm.BEFORE :]) for p in pieces), strict=True))
    mark = model.to_input[before]
    model.classify((here * lm.MARKS + mark)[mark < lm.MARKS], np.ones((mark < lm.MARKS).sum()))
    model.train(pieces, 5)
    return model, texts


def test_scores_do_not_depend_on_neighbours():
    """A text scores the same alone and among others; the subwords' shares of a class sum to one, behind any subword."""
    model, texts = small_model()
    assert np.allclose(model.score(texts), np.concatenate([model.score([x]) for x in texts]), rtol=1e-4)
    every = np.arange(lm.VOCABULARY)
    for before in (lm.END, 7, 8, 4000):
        share = 10 ** model.within(np.full(lm.VOCABULARY, before), every)
        assert np.allclose(np.bincount(model.to_class, share, lm.CLASSES)[np.unique(model.to_class)], 1, atol=1e-6)
    assert not set(model.to_class[model.starts]) & set(model.to_class[~model.starts])


def test_forward_pass_of_the_model():
    """Scores by a plain pass over one place at a time."""
    model, texts = small_model()
    w = {k: x.astype(float) for k, x in model.weights.items()}
    for text in (texts[0], texts[3], texts[3][:1], texts[3][:0]):
        ids = [lm.END] * (lm.LEAD + 1) + text.tolist()  # before each target at ids[k + LEAD + 1] stand ids[.. k + LEAD]
        each = []
        for k, target in enumerate([*text.tolist(), lm.END]):
            first = k // lm.STRIDE * lm.STRIDE  # the window's first input
            x = w["e"][model.to_input[ids[first : k + lm.LEAD + 1]]]
            q = x[-1] @ w["q"]
            a = np.array([math.exp(q @ (x[j] @ w["k"]) / math.sqrt(lm.WIDTH) + w["d"][len(x) - 1 - j]) for j in range(len(x))])
            h = sum(a[j] / a.sum() * (x[j] @ w["v"]) for j in range(len(x))) + x[-1] @ w["r"]
            z, c = h @ w["c"] + w["b"], model.to_class[target]
            go = 1 / (1 + math.exp(-(h @ w["s"][:-1] + w["s"][-1])))
            z = z - (-math.log(1 - go) + math.log(np.exp(z[: lm.STARTS]).sum()) if c < lm.STARTS else -math.log(go) + math.log(np.exp(z[lm.STARTS :]).sum()))
            before = ids[k + lm.LEAD]
            share = (model.counts[target] + 0.05) / (model.counts[model.to_class == c] + 0.05).sum()
            if not model.starts[target]:
                times = dict(zip(model.keys.tolist(), model.times.tolist(), strict=True))
                follow = sum(n for key, n in times.items() if key // lm.VOCABULARY == before and model.to_class[key % lm.VOCABULARY] == c)
                share = (times.get(before * lm.VOCABULARY + int(target), 0) + lm.SMOOTH * share) / (follow + lm.SMOOTH)
            each.append(z[c] / math.log(10) + math.log10(share))
        assert np.allclose(model.score([text]), each, rtol=1e-3)


def test_slopes_of_the_model():
    """The slopes of the loss against finite differences."""
    model, _ = small_model()
    r = np.random.default_rng(4)
    model.weights = {k: x.astype(float) for k, x in model.weights.items()}
    t, y, valid = r.integers(0, 40, (3, lm.WINDOW)), r.integers(0, lm.CLASSES, (3, lm.STRIDE)), r.random((3, lm.STRIDE)) < 0.7
    _, slopes = model.loss(t, y, valid)
    for name, x in model.weights.items():
        at = tuple(int(r.integers(0, n)) for n in (x.shape if name != "e" else (40, lm.WIDTH)))
        old, sides = x[at], []
        for d in (1e-5, -1e-5):
            x[at] = old + d
            sides.append(model.loss(t, y, valid)[0])
        x[at] = old
        assert np.isclose((sides[0] - sides[1]) / 2e-5, slopes[name][at], rtol=1e-3, atol=1e-7), name


def test_lm_learns_from_every_word(spark, monkeypatch):
    """The pieces hold each subword and end of the training texts as a target once, with what stands before it; the rounds deal each piece out once."""
    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate((0, 1, 5, 255, 256, 257, 3000))]
    table, docs = lm.words_by(lm.tokenizer_path()), spark.createDataFrame([(t,) for t in texts], "text string")
    found = common.staged(lm.pieces(docs, lm.tokenizer_path()), "test")
    got, want = [], []
    for t in texts:
        ids = [lm.END] * lm.BEFORE + lm.subwords(table, lm.words(t)).tolist() + [lm.END]
        want += [tuple(ids[i - lm.BEFORE : i + 1]) for i in range(lm.BEFORE, len(ids))]
    for r in found.collect():
        got += [tuple(r.ids[i - lm.BEFORE : i + 1]) for i in range(lm.BEFORE, len(r.ids))]
    assert sorted(got) == sorted(want)
    asked, tree_sum = [], common.tree_sum
    monkeypatch.setattr(common, "tree_sum", lambda x: asked.append(np.frombuffer(b"".join(r.blob for r in x.collect())).reshape(-1, sum(w.size for w in model.weights.values()) + 1)[:, -1].sum()) or tree_sum(x))
    model, _ = small_model()
    lm.refine(model, found)
    assert sum(asked) == sum(-(-(len(r.ids) - lm.BEFORE) // lm.STRIDE) for r in found.collect())


def test_frequent_words_are_units(spark):
    """A frequent word is one unit, others are spelled, also where all are encoded at once; the pieces and the shares of a class hold both kinds."""
    path, whole = lm.tokenizer_path(), lm.whole_words({b"zb": 9, b"qontioner": 9, b"rare": lm.LEAST - 1, b"most": 50}, 2)
    assert whole == (b"most", b"qontioner")
    odd = [b"qontioner", b"it's", b"\xc3\xa9a", b"x\xc2\xa0y", b"\x1c", b"\xed\xa0\x80", b"a,b;", b"most", b"12ab--"]
    ids, table = packing.ids_by(path), lm.words_by(path, whole)
    for some in (odd, odd[:3] + odd[6:], odd[:1], []):
        each = [ids.encode_piece(" " + w.decode("utf-8", "replace")) for w in some]
        got, lengths = lm.encoded(ids, some)
        assert (got.tolist(), lengths.tolist()) == ([i for x in each for i in x], [len(x) for x in each])
        assert all(ids.starting[x].tolist() == [True] + [False] * (len(x) - 1) for x in each)
    table.fill(set(odd))
    spelled = {w: ids.encode_piece(" " + w.decode("utf-8", "replace")) for w in odd} | {w: [lm.VOCABULARY + i] for i, w in enumerate(whole)}
    assert {w: lm.subwords(table, [w]).tolist() for w in odd} == spelled
    found = lm.pieces(spark.createDataFrame([("Most qontioner a,b; most",)], "text string"), path, spark.sparkContext.broadcast(whole)).collect()
    want = [x for w in (b"most", b"qontioner", b"a,b;", b"most") for x in spelled[w]]
    assert [r.ids for r in found] == [[lm.END] * lm.BEFORE + want + [lm.END]]
    counts = np.append(np.zeros(lm.VOCABULARY), [50.0, 9])
    counts[spelled[b"a,b;"]] = 3
    starts = np.append(ids.starting, [True] * (len(counts) - len(ids.starting)))
    model = lm.Model(counts, starts, np.zeros(0, np.int64), np.zeros(0, np.float32))
    every = np.arange(len(counts))
    assert np.allclose(np.bincount(model.to_class, 10 ** model.within(np.full(len(every), lm.END), every))[np.unique(model.to_class)], 1, atol=1e-6)
    assert len(model.score([np.array(want)])) == len(want) + 1


def test_lm_beats_its_base(spark):
    got = lm.score(common.documents(spark, "/root/testdata/sf0.01"), steps=300).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_lm_without_training_documents(spark):
    docs = spark.createDataFrame([(i, t) for i in range(300) for t in ["a b c"] if zlib.crc32(str(i).encode()) % 7 == 2][:5], "doc_id bigint, text string")
    got = lm.score(docs).collect()
    assert len(got) == 5 and {(r.held_out, r.n_known, r.train_tokens) for r in got} == {(True, 0, 0)} and all(r.score < 0 for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.documents(spark, SF)
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.staged(stage(spark, docs, SF), name)
        if k < 3:
            assert docs.columns == columns and docs.count() <= n
            n = docs.count()
    assert docs.count() > 0 and len(queries.QUERIES) == 10


def test_pipeline_edges(spark, docs, nothing):
    import corpus_pipeline

    here, empty = docs, nothing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = here.columns
        here, empty = common.staged(stage(spark, here, SF), name), common.staged(stage(spark, empty, SF), name)
        assert empty.count() == 0 and here.count() > 0
        if k < 4:
            assert here.columns == columns == empty.columns


def test_small_batches(spark, tmp_path, monkeypatch):
    """Whole texts and sets reach the workers of the pipeline's stages by batches of a bounded number of bytes; the session's own limit is back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(common, "BATCH", 50_000)
    docs = common.staged(spark.createDataFrame([(k, prose(k, 400)) for k in range(300)], "doc_id bigint, text string").coalesce(1), "test")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    here = docs.mapInArrow(sizes, "n bigint")
    assert max(r.n for r in common.staged(here, "test").collect()) > 500_000
    assert max(r.n for r in common.staged(here, "test", small=True).collect()) < 60_000
    assert spark.conf.get(key).rstrip("b") == before.rstrip("b")
    held = {}
    for module, name in ((near, "sets"), (near, "postings"), (packing, "pieces"), (quality, "document_statistics")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, made=made, name=name: held.setdefault(name, made(*a)))
    staged, by_small = common.staged, set()
    monkeypatch.setattr(common, "staged", lambda df, name, small=False: by_small.update(k for k, v in held.items() if v is df and small) or staged(df, name, small))
    near.keep_first(docs), packing.pack(docs), quality.classify(docs, spark.createDataFrame([], "doc_id bigint, label int"))
    assert by_small == {"sets", "postings", "pieces", "document_statistics"}


def test_a_task_gives_pairs_away_by_numbers_not_columns(spark, monkeypatch):
    """Rows of six numbers count six times; bitmaps that meet in parts give the same pairs."""
    rows = common.staged(spark.createDataFrame([(1, k, 100, 100, k, [k % 7, -1]) for k in range(200)], "h bigint, row bigint, n bigint, rest bigint, root bigint, bits array<bigint>").coalesce(1), "test")
    wanted = {tuple(r) for r in near.proposed(rows, False).collect()}
    monkeypatch.setattr(near, "MEET", 100)
    monkeypatch.setattr(near, "HELD", 1000)
    assert {tuple(r) for r in near.proposed(rows, False).collect()} == wanted
    assert near.apart(rows.drop("bits")).count() == 200


def test_lm_encodes_each_text_once(spark, docs, monkeypatch):
    """Training and scoring read the units that one pass has written; words and spelled names are those of the texts."""
    encoded, in_units = [], lm.in_units
    monkeypatch.setattr(lm, "in_units", lambda rows, *a: encoded.append(rows.columns) or in_units(rows, *a))
    lm.score(docs, steps=1, rounds=1).count()
    assert encoded == [["row", "doc_id", "text"]]
    path, whole = lm.tokenizer_path(), (b"the", b"fox")
    table = lm.words_by(path, whole)
    for r in lm.in_units(docs.select("doc_id", "text", F.col("text").alias("same")), path, spark.sparkContext.broadcast(whole)).collect():
        ws = lm.words(r.same)
        assert r.ids == lm.subwords(table, ws).tolist() and [bytes(x) for x in r.names] == [w for w in ws if w not in whole]
