"""Operators against plain versions that share no code with them, and cases that only show at the edges."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliate.llm import common, exact_dedup, fingerprints, mixing, near, packing, pii, quality, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"


def prose(seed, n):
    words = "the of and reading over lazy dogs jumps quick brown fox stream river mountain paper".split()
    return " ".join(np.random.default_rng(seed).choice(words, n))


# common


def test_sums_and_counts(spark):
    blobs = spark.range(0, 100, 1, 70).select(F.col("id")).mapInPandas(lambda x: (pd.DataFrame({"blob": [np.array([float(p["id"].sum()), len(p)]).tobytes()]}) for p in x), "blob binary")
    assert common.tree_sum(blobs).tolist() == [4950.0, 100.0]
    counts = spark.createDataFrame([(k, k // 10 + 1) for k in range(100)], "word int, c int")
    for bound in (0, 5, 10, 37, 100):
        got = [r.c for r in common.most(counts, "c", bound).collect()]
        assert len(got) <= bound and (not got or sorted(got) == sorted(c for c in [k // 10 + 1 for k in range(100)] if c >= min(got)))
    assert common.most(counts, "c", 100).count() == 100


def test_numbers_of_rows_do_not_depend_on_splits(spark):
    docs = common.staged(spark.range(1000).repartition(7), "test")
    a = {r.id: r.row for r in common.numbered(docs, F.col("id")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    b = {r.id: r.row for r in common.numbered(docs, F.col("id")).repartition(3).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert a == b and len(set(a.values())) == 1000


# op1


def test_boundaries_by_rolling_bytes():
    """The gear hash over the last 32 bytes at each place, and cuts one place after the other."""
    gear = fingerprints._GEAR.astype(object)
    for raw in (prose(3, 500).encode(), bytes(1000), np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8).tobytes(), b"x" * 17, b"abc"):
        out, start = [], 0
        while start < len(raw):
            end = len(raw)
            for e in range(start + fingerprints.MIN, len(raw)):
                h = sum(int(gear[raw[e - 1 - k]]) << k for k in range(min(32, e))) % 2**32
                zeros = fingerprints.STRICT if e - start <= fingerprints.NORMAL else fingerprints.LOOSE
                if h >> (32 - zeros) == 0 or e - start == fingerprints.MAX:
                    end = e
                    break
            out.append(end)
            start = end
        assert fingerprints.boundaries(raw) == out


# op2


def test_toxicity_scores_and_slopes(spark):
    docs = common.documents(spark, SF)
    model = toxicity.learn(docs, common.labels(spark, SF, "toxic"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    for r in docs.collect():
        z = model.bias
        for w in set(re.findall(r"[^\W\d_]+", (r.text or "").lower())):
            for f in ["w:" + w, *(f"{k}:{w[:k]}" for k in (4, 5, 6) if len(w) >= k)]:
                z += weight.get(zlib.crc32(f.encode()) % 2**20, 0)
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)

    r = np.random.default_rng(0)
    place = lambda n: (np.sort(r.integers(0, n, 60)), r.integers(0, 9, 60))
    goal = toxicity.Problem(r.integers(0, 2, 20).astype(float), place(20), place(12), place(12), 12, 9, 5.0)
    w, b = r.normal(size=9), 0.3
    _, g, gb = goal.at(w, b)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        assert np.isclose((goal.value(w + step, b) - goal.value(w - step, b)) / 2e-6, g[k], atol=1e-6)
    assert np.isclose((goal.value(w, b + 1e-6) - goal.value(w, b - 1e-6)) / 2e-6, gb, atol=1e-6)
    # the value by loops
    z = [b + sum(w[f] for i, f in zip(*goal.rows, strict=True) if i == k) for k in range(20)]
    loss = np.mean([math.log(1 + math.exp(x)) - y * x for x, y in zip(z, goal.y, strict=True)])
    sides = [[sum(w[f] for i, f in zip(*s, strict=True) if i == k) for k in range(12)] for s in (goal.before, goal.after)]
    assert np.isclose(goal.value(w, b), loss + 5.0 * np.mean([(q - p) ** 2 for p, q in zip(*sides, strict=True)]))


def test_toxicity_drops_what_tells_nothing(spark):
    rows = spark.createDataFrame([(k % 2, [1, 2 + k % 2] + [5] * (k < 2)) for k in range(40)], "label int, ids array<int>")
    assert toxicity.telling(rows) == [2, 3]
    assert toxicity.telling(rows.where("label = 1")) == []


# op5


def test_quality_by_plain_equations(spark):
    """All rows at once by least squares, folds one by one, pooled means by their formula."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), common.labels(spark, sf, "quality")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(quality.FITS)).alias("f")).collect()}
    texts, y = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.label for r in labels.collect()}
    x = {i: quality.statistics(t).astype(float) for i, t in texts.items()}
    train = [i for i in texts if i in y and zlib.crc32(str(i).encode()) % 5]
    a = np.array([x[i] for i in train])
    mean, scale = a.mean(0), np.maximum(0.02, a.std(0))
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, 1 / math.sqrt(a.shape[1]), (a.shape[1], quality.N_FEATURES)), rng.uniform(0, 2 * math.pi, quality.N_FEATURES)

    def feature(v):
        return np.append(math.sqrt(2 / quality.N_FEATURES) * np.cos(np.clip((v - mean) / scale, -6, 6) @ w + b), 1)

    def ridge(ids):
        f, n = np.array([feature(x[i]) for i in ids]), len(ids)
        held = np.sqrt(quality.RIDGE * n) * np.diag([1.0] * quality.N_FEATURES + [1e-3])
        return np.linalg.lstsq(np.vstack([f, held]), np.concatenate([[y[i] for i in ids], np.zeros(quality.N_FEATURES + 1)]), rcond=None)[0]

    whole, others = ridge(train), [ridge([i for i in train if fold[i] != k]) for k in range(quality.FITS)]
    bins = defaultdict(list)
    for i in train:
        bins[min(int(np.clip(feature(x[i]) @ others[fold[i]], 0, 1) * quality.BINS), quality.BINS - 1)].append(y[i])
    at = sorted(bins)
    value = [max(min(np.mean([v for k in at[lo : hi + 1] for v in bins[k]]) for hi in range(j, len(at))) for lo in range(j + 1)) for j in range(len(at))]
    for i in texts:
        want = np.interp(np.clip(feature(x[i]) @ whole, 0, 1), [(k + 0.5) / quality.BINS for k in at], value)
        assert abs(got[i] - want) < 1e-3


def test_quality_where_all_are_held_out(spark):
    docs = common.documents(spark, SF)
    out = [r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 1) for i in out], "doc_id bigint, label int")
    assert {r.score for r in quality.classify(docs, labels).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(60) if zlib.crc32(str(i).encode()) % 5], "doc_id bigint, label int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, one).collect())


# op6


def plain_mix(rows, block):
    """rows: doc_id, source, size, key (hash). Returns doc_id, target, taken of each."""
    weights, sources = [3, 1, 2], sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    w = {s: weights[k % 3] for k, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(size.values()), set(sources), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > 2 * size[s] + 1e-9]
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    out = []
    for s in sources:
        quota = min(math.floor(target[s] + 0.5), 2 * size[s])
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0], r[2]))
        start = 0
        for doc, _, n, _ in mine:
            # the stream runs twice at most and ends at the quota; every block of a source is taken
            out.append((doc, round(target[s], 6), sum(max(0, min(a + n, quota) - a) for a in (start, start + size[s]))))
            start += n
    return sorted(out, key=repr)


def test_mixing_by_a_plain_stream(spark):
    r = np.random.default_rng(8)
    for sizes in ([5, 40, 3, 90], [400, 1, 1], [10] * 7):
        rows = [(k, ["a", "b", None, "c", "d", "e", "f"][k % len(sizes)], " ".join("w" for _ in range(int(r.integers(0, sizes[k % len(sizes)] + 1))))) for k in range(120)]
        docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
        keys = {x.doc_id: x.k for x in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("k")).collect()}
        got = mixing.mix(docs, block=16).collect()
        want = plain_mix([(i, s, len(t.split()), keys[i]) for i, s, t in rows], 16)
        assert sorted(((x.doc_id, round(x.target, 6), x.taken) for x in got), key=repr) == want


def test_schedule_by_golden_points(spark):
    """Each slot's point names its source; ranks count a source's slots; what the slots leave out follows."""
    rows = [("a", 700, 700, 1500), ("b", 300, 1000, 1500), (None, 500, 1500, 1500)]
    sources = spark.createDataFrame(rows, "source string, quota bigint, upto bigint, all bigint")
    got = {(r.source, r["rank"]): r.slot for r in mixing.schedule(sources, 16).collect()}
    ranks, want = Counter(), {}
    for slot in range(-(-1500 // 16)):
        point = slot * mixing.GOLDEN % 2**32
        s = next(s for s, q, u, n in rows if (u - q) * 2**32 <= point * n < u * 2**32)
        if ranks[s] < -(-dict((x[0], x[1]) for x in rows)[s] // 16):
            want[s, ranks[s]] = slot
        ranks[s] += 1
    for s, q, _, _ in rows:
        want |= {(s, k): None for k in range(ranks[s], -(-q // 16))}
    assert got == want


# op3


def test_common_keys_are_halved(spark):
    """Keys of more contexts than a slice, to the last string; common anchors over several tasks."""
    line = prose(77, 30)[:130]
    texts = [f"{prose(k, 4)} {k} {line} {k} {prose(500 + k, 6)}" for k in range(150)] + [line] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw, gone = t.encode(), set()
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                gone |= set(range(a, a + 100))
            seen.add(raw[a : a + 100])
        want[i] = len(gone)
    rows = substrings.located(docs)
    common.prepare(spark)
    for often in (np.zeros(0, np.uint64), np.unique(np.concatenate([substrings.anchors(np.frombuffer(t.encode(), np.uint8), 100)[1] for t in texts[:3]]))):
        sent = rows.mapInArrow(lambda x, often=often: substrings.contexts(x, 100, often), substrings._SENT)
        settled = common.staged(sent.repartition(5, "h", "salt").sortWithinPartitions("h", "c1", "c2", "doc", "row", "low").mapInArrow(lambda x: substrings.settle(x, 100), "h bigint, doc bigint, row bigint, low bigint, n short, ahead short, is_open boolean"), "test")
        per = settled.where("is_open").groupBy("row").agg(F.collect_list(F.struct("h", "low", "n", "ahead")).alias("open"))
        fetched = common.staged(rows.join(per, "row").select("doc", "row", "text", "open").mapInArrow(lambda x: substrings.fetch(x, 100), substrings._BYTES), "test")
        parts, single = substrings.small_keys(fetched, 100, 10)
        assert single is not None and parts.groupBy("h").count().where("count > 10").count() == 0
        found = parts.repartition(3, "h").sortWithinPartitions("h", "doc", "row", "low").mapInArrow(lambda x: substrings.compare(x, 100), "row bigint, low bigint, high bigint")
        spans = found.unionByName(single).unionByName(settled.where("NOT is_open").select("row", "low", (F.col("low") + F.col("n") + 99).alias("high")))
        got = defaultdict(set)
        for r in spans.join(rows.select("row", "doc_id"), "row").collect():
            got[r.doc_id] |= set(range(r.low, r.high))
        assert {i: len(got[i]) for i in want} == want


def test_frequent_anchors_are_few(spark):
    line = prose(78, 40)
    docs = spark.createDataFrame([(k, f"{k} {line} {k * k}") for k in range(3000)], "doc_id bigint, text string")
    found = substrings.frequent_anchors(substrings.located(docs), 100, 8)
    assert 0 < len(found) <= 64 * 8


# op4


def test_tiles_of_one_kind(spark):
    """Many fingerprints with the same counts, in several tiles: every pair of tiles meets once."""
    r = np.random.default_rng(6)
    fps = np.unique([int(sum(1 << int(b) for q in range(4) for b in r.choice(16, 3, replace=False) + 16 * q)) for _ in range(400)]).astype(np.uint64).view(np.int64)
    fps = np.concatenate([fps, np.unique(fps ^ np.int64(1))])
    fps = np.unique(fps)
    found = simhash.components(simhash.links(spark.createDataFrame([([int(x)],) for x in fps], "fp array<bigint>"), tile=16)).collect()
    root = {x.node[0]: x.root[0] for x in found}
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    comp = np.arange(len(fps))
    while not (comp == (new := np.array([comp[x].min() for x in linked]))).all():
        comp = new
    assert [root.get(int(x), int(x)) for x in fps] == [int(fps[c]) for c in comp]


# op7


def test_state_outlives_a_call(spark, tmp_path):
    texts = [(1, "a b"), (2, "ab"), (3, "c"), (4, " ab "), (5, "c c"), (6, "d"), (7, None), (8, "\n")]
    rows = lambda some: common.staged(spark.createDataFrame(some, "doc_id bigint, text string"), "test")
    first, second = rows(texts[:4]), rows(texts[4:] + [(9, "a  b")])
    folder = str(tmp_path / "state")
    one = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(first, folder).collect()}
    two = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(second, folder).collect()}
    assert one == {1: (4, 3), 2: (4, 3), 4: (4, 3), 3: (3, 1)}
    assert two == {5: (5, 1), 6: (6, 1), 7: (8, 2), 8: (8, 2), 9: (4, 4)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none") != exact_dedup.ROCKSDB


def test_bytes_decide_on_hits(spark, monkeypatch):
    """Texts that differ under one digest are told apart."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(c, 1, 1))
    docs = common.staged(spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "ac"), (4, "x"), (5, "ab")], "doc_id bigint, text string"), "test")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(docs).collect()} == {1: (2, 3), 2: (2, 3), 5: (2, 3), 3: (3, 1), 4: (4, 1)}


# op8

_W = r"[^\x20\x09-\x0D]+"


def plain_pii(texts, rounds=3, support=3, confident=0.8):
    """(spans of the base kinds and secrets, further ones) of each text, all by loops."""
    kinds = [("email", pii.EMAIL.replace(r"|\G", "")), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE), ("secret", pii.SECRET)]

    def keeps(name, m):
        d = [int(c) for c in m if c.isdigit()]
        luhn = sum((v * 2 - 9 * (v > 4)) if i % 2 else v for i, v in enumerate(d[::-1])) % 10 == 0
        return {"ip": lambda: all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn, "phone": lambda: 9 <= len(d) <= 15}.get(name, lambda: True)()

    def patterns(text, a, b, until):
        words = re.findall(_W, text[:a].lower())
        if a and re.match(_W, text[a - 1]):
            words.pop()
        after = re.match(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", text[b:until].lower())
        return [f"{words[-2]} {words[-1]} _"] * (len(words) > 1) + ([f"{words[-1]} _ {after[1]}"] if words and after else [])

    seeds, found = [], []
    for text in texts:
        mine = []
        for k, (name, pattern) in enumerate(kinds):
            all_ = list(re.finditer(pattern, text))
            mine += [(m.start(), k, m.end(), m[0], patterns(text, m.start(), m.end(), (all_[j + 1].start() if j + 1 < len(all_) else len(text)))) for j, m in enumerate(all_) if keeps(name, m[0])]
        seeds.append(sorted(mine))
        free, all_ = [], list(re.finditer(pii.CANDIDATE, text))
        for j, m in enumerate(all_):
            a, b = m.start(), m.end()
            p = patterns(text, a, b, all_[j + 1].start() if j + 1 < len(all_) else len(text))
            a += len(re.match(r"[\"'<\[{]*", m[0])[0])
            while b > a and not (text[b - 1].isalpha() or text[b - 1].isnumeric() or text[b - 1] == ")"):
                b -= 1
            if a < b and not any(s[0] < b and a < s[2] for s in mine):
                free.append((a, b, text[a:b], p))
        found.append(free)
    fits = lambda w: sum(c.isdigit() for c in w) >= 4 or bool(re.search("[^@]@[^@]", w))
    edges, known = defaultdict(set), {s[3] for mine in seeds for s in mine}
    for mine in seeds:
        for s in mine:
            for p in s[4]:
                edges[p].add(s[3])
    for mine in found:
        for c in mine:
            for p in c[3]:
                edges[p].add(c[2])
    rest = defaultdict(set)
    for text in texts:
        w = re.findall(_W, text.lower())
        for i, x in enumerate(w):
            if not re.search("[0-9@]", x):
                if i >= 2:
                    rest[f"{w[i - 2]} {w[i - 1]} _"].add(x)
                if 1 <= i < len(w) - 1:
                    rest[f"{w[i - 1]} _ {w[i + 1]}"].add(x)
    edges = {p: ws for p, ws in edges.items() if sum(w in known or fits(w) for w in ws) >= support and len(ws) >= confident * (len(ws) + len(rest[p]) + 1)}
    good = set()
    while True:
        score = {w: float(w in known) for ws in edges.values() for w in ws}
        for _ in range(rounds):
            of = {p: sum(score[w] for w in ws) / (len(ws) + len(rest[p]) + 1) for p, ws in edges.items()}
            able = {p for p, ws in edges.items() if sum(w in known for w in ws) >= support}
            score = {w: 1.0 if w in known else max([of[p] for p in able if w in edges[p]], default=0.0) for w in score}
        good = {p for p in able if of[p] >= confident}
        new = {w for p in good for w in edges[p] if fits(w)} - known
        if not new:
            break
        known |= new
    names = [k for k, _ in kinds]
    out = []
    for mine, free in zip(seeds, found, strict=True):
        spans = [(s[0], s[1], f"{names[s[1]]}:{s[0]}:{s[2]}") for s in mine]
        spans += [(c[0], 9, f"id:{c[0]}:{c[1]}") for c in free if fits(c[2]) and good & set(c[3])]
        out.append(",".join(x[2] for x in sorted(spans)))
    return out


def test_pii_by_loops(spark):
    """The whole operator, bootstrapping included, on texts with common and rare contexts."""
    r = np.random.default_rng(12)
    heads = ["server address", "call us", "token =", "of the", "customer number", "see also"]
    texts = []
    for k in range(160):
        words = prose(k, int(r.integers(0, 25))).split()
        for _ in range(int(r.integers(0, 4))):
            n = [int(x) for x in r.integers(0, 10, 12)]
            item = [f"{n[0]}.{n[1]}2.{n[2]}.{n[3]}", f"+1 (7{n[0]}3) 555-{n[1]}{n[2]}1{n[3]}", f'"{hashlib.sha256(bytes(n)).hexdigest()[:40]}"', f'"{hashlib.sha256(bytes(n)).hexdigest()[:40].upper()}"!!', f"AB-{n[0]}{n[1]}{n[2]}{n[3]}", f"me{n[0]}{n[1]}@x{n[2]}.org,", f"v{n[0]}", "word", f"jo{n[1]}@host"]
            kind = int(r.choice(9, p=[0.24, 0.1, 0.24, 0.04, 0.04, 0.14, 0.1, 0.06, 0.04]))
            at = int(r.integers(0, len(words) + 1))
            words[at:at] = [heads[[0, 1, 2, 2, 0, 5, 3, 3, 5][kind] if r.random() < 0.95 else 4], item[kind]]
        texts.append(("\n" if k % 3 else " ").join([" ".join(words), "x" * (k % 2 * 100)]))
    texts += ["", "token = \"ABCD-99887\"", "customer number 10.2.3.4", "y" * 200 + " token " + "=" * 90 + ' "' + "9A" * 20 + '"']
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = plain_pii(texts)
    assert [got[k].spans for k in range(len(texts))] == want
    assert sum("id:" in x for x in want) >= 5 and [got[k].n_spans for k in range(len(texts))] == [len(x.split(",")) if x else 0 for x in want]


# op9


def test_plan_takes_patterns():
    """Rows come from the fitted patterns, and the plan isn't worse than best fit alone."""
    r = np.random.default_rng(3)
    for lengths in (r.integers(300, 700, 3000), np.minimum(1024, r.gamma(2, 300, 500).astype(int) + 1), r.integers(1, 200, 3000), np.array([1, 1024, 512, 512, 1])):
        h = np.bincount(lengths, minlength=1025)
        used = np.zeros(1025, int)
        planned = packing.plan(h)
        for pattern, n in planned:
            for x in pattern:
                used[x] += n
        assert (used == h).all()
        assert sum(n for _, n in planned) <= sum(n for _, n in packing.best_fit(h.astype(np.int64), 1024))


# the pipeline, each stage on its own input


@pytest.fixture(scope="module")
def small(spark):
    """Documents with every kind of copy, clean ones and junk, with labels for the classifier."""
    r = np.random.default_rng(9)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "r", "st", "mel", "dor")]
    text = lambda n: " ".join(r.choice(vocabulary, n)).capitalize() + "."
    texts = [text(int(n)) for n in r.integers(30, 200, 120)]
    junk = ["$$$ " * int(n) + "!!! ### &&&" for n in r.integers(20, 80, 40)]
    near_ = [t.replace(" ", "  ", 2) for t in texts[:10]] + [t + " one more" for t in texts[10:25]] + [" ".join(t.split()[: len(t.split()) // 2]) for t in texts[25:35]]
    rows = [(k, t, "en", ["a", "b", "c"][k % 3], len(t)) for k, t in enumerate(texts + junk + near_)] + [(900, None, None, None, None), (901, "", "en", "a", 0)]
    docs = common.staged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "small")
    return docs, {k: t for k, t, *_ in rows}, set(range(120, 160))


def test_quality_stage(spark, small, tmp_path):
    import corpus_pipeline

    docs, texts, junk = small
    spark.createDataFrame([(i, int(i not in junk), 0) for i in texts if i < 160], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    scores = {r.doc_id: r.score for r in quality.classify(docs, common.labels(spark, str(tmp_path), "quality")).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}
    assert not kept & junk and kept >= set(range(120))


def test_exact_stage(spark, small):
    import corpus_pipeline

    docs, texts, _ = small
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    assert sorted(r.doc_id for r in corpus_pipeline.exact_stage(spark, docs, SF).collect()) == sorted(min(g)[1] for g in groups.values())


def test_near_stage(spark, small):
    import corpus_pipeline

    docs, texts, _ = small
    ids = sorted(texts)
    sets = [{" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in ((texts[i] or "").lower().split() for i in ids)]
    comp = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    got = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect())
    assert got == sorted(ids[k] for k in set(comp)) and len(got) < len(ids)


def test_fingerprints_propose_near_copies(spark, small):
    """The tiled comparison's own proposals: every pair of fingerprints within the radius is linked through the first texts."""
    docs, texts, _ = small
    rows = common.staged(near.sets(docs.select(F.col("doc_id").alias("row"), "text")), "test")
    fp = {r.row: r.fp[0] & (2**64 - 1) for r in rows.collect()}
    got = {tuple(sorted((r.u, r.v))) for r in near.by_fingerprint(rows).collect()}
    assert got and all((fp[a] ^ fp[b]).bit_count() <= simhash.RADIUS for a, b in got)
    parent = {i: i for i in fp}
    for _ in fp:
        for a, b in got:
            parent[a] = parent[b] = min(parent[a], parent[b])
    for a in fp:
        for b in fp:
            assert (fp[a] ^ fp[b]).bit_count() > simhash.RADIUS or parent[a] == parent[b]


def test_mixing_stage(spark, small):
    import corpus_pipeline

    docs, texts, _ = small
    size = {i: len((t or "").split()) for i, t in texts.items()}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect())
    assert got == Counter({i: math.floor(taken[i] / size[i] + 0.5) if size[i] else 1 for i in texts})


def test_packing_stage(spark, small):
    import corpus_pipeline

    docs, texts, _ = small
    got = pa.Table.from_pylist([r.asDict() for r in corpus_pipeline.packing_stage(spark, docs, SF).collect()]).to_pandas()
    table = packing.Ids(packing.tokenizer_path())
    for i, t in texts.items():
        raw = table.whole([t or ""])[0] + np.array([2], "<u4").tobytes()
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() * 4 == len(raw) and [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
