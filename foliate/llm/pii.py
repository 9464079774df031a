"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans: the regular expressions' leftmost non-overlapping matches per kind that pass their kind's test. Places come
from the lengths of what lies between the matches. Bootstrapping: seeds are the base spans and long runs of lower-case hexadecimal
digits (kind secret); other candidates, where no seed lies, are runs of words of digits, words with a digit and words with an at sign inside.
An instance's lexical patterns are the two words before it, and the word before with the word after it (up to the next match), whatever they hold.
Patterns and instances form a bipartite graph. A pattern also knows how many other words stand in its place anywhere in the texts, so that
the common words of prose prove nothing; patterns that this keeps from ever being confident take no part. In each of ROUNDS rounds a pattern scores the share of its distinct instances' scores in all that stands there, smoothed, and an
instance that is no seed takes its best pattern's score. Patterns of at least `support` distinct seeds and a score of at least `confident`
then mark their other instances, of at least LEAST_DIGITS digits or an address's shape, as further spans (kind id, without quotes and marks round
them). What is marked counts as a seed, and the rounds start again, until nothing more is marked. Base spans always stay.

Two passes read the texts: one for spans and candidates, one to count what else stands where patterns ask (a share of the texts is
counted first: what stands there already rules out most patterns, whatever the rest holds); the rest works on spans. Patterns and
instances that many rows share are pre-aggregated to distinct edges first. Defined results: a null text counts as empty; a text without spans has the digest of the empty string; null ids
and equal rows are rows like others; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm import common

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = 4  # the contract's kinds come first
# Java's possessive forms of the contract's patterns: the same matches, without recursion, and tried only where a run of their
# characters starts (or the last match ended): in proportion to the text's length, whatever is in it
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"  # matches of fewer digits fail in any case
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])"
# a run of two to six words of digits and a phone's marks with nine digits or more, else a word with a digit or with an at sign inside
RUN = r"(?=\+?\(?[0-9](?:[\x20().-]{0,3}+[0-9]){8})\+?+\(?+[0-9]++(?:[().-]++[0-9]++)*+\)?+(?:\x20\(?+[0-9]++(?:[().-]++[0-9]++)*+\)?+){1,5}+(?![^\x20\x09-\x0D.,;:!?])"
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{RUN}|[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+|[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D]++)"
BLOCK, NEAR, FAR, LEAST_DIGITS, ROUNDS, SUPPORT, CONFIDENT, FEW, SHARE = 512, 80, 4096, 4, 3, 3, 0.8, 200_000, 64
_S, _N = common.SPACE, r"[^\x20\x09-\x0D]"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ending(x: Column) -> Column:
    """An end of x that holds its last two whole words, if it has them, and what they are told from."""
    whole = rf"{_S}{_N}++{_S}++{_N}++{_S}++{_N}*+\z"
    some = lambda n: F.substring(x, -n, n)
    return F.when(F.length(x) <= NEAR, x).when(some(NEAR).rlike(whole), some(NEAR)).when(some(FAR).rlike(whole), some(FAR)).otherwise(x)


def next_word(x: Column) -> Column:
    """The first whole word of x after the rest of a word that x starts with; empty if there is none."""
    some, word, whole = lambda n: F.substring(x, 1, n), rf"^{_N}*+{_S}++({_N}++)", rf"^{_N}*+{_S}++{_N}++{_S}"
    of = lambda y: F.regexp_extract(F.lower(y), word, 1)
    return F.when((F.length(x) <= NEAR) | some(NEAR).rlike(whole), of(some(NEAR))).when((F.length(x) <= FAR) | some(FAR).rlike(whole), of(some(FAR))).otherwise(of(x))


def places(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, m, before, after>> of the matches m that keep(m) lets pass; before: an ending of the text before, other matches included; after: the text up to the next match.

    Places are running sums of lengths in one fold, by blocks of BLOCK matches, so that a text of very many matches costs
    no square of their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    item = "struct<start:bigint,end:bigint,m:string,before:string,after:string>"
    empty = F.array().cast(f"array<{item}>")

    def one(acc: Column, x: Column) -> Column:
        start, before = acc["at"] + x["gap"], ending(F.concat(acc["tail"], x["before"]))

        def put(b: Column) -> Column:
            here = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), b.alias("before"), x["after"].alias("after"))
            return F.struct((start + F.length(x["m"])).alias("at"), ending(F.concat(b, x["m"])).alias("tail"), F.when(keep(x["m"]), F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

        return once(before, put)

    def whole(both: Column) -> Column:
        def block(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(both, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("out")), one)
            return once(inner, lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.array_append(acc["out"], x["out"]).alias("out")))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail"), F.slice(F.array(empty), 1, 0).alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int"))
        return F.when(F.size(both) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(empty)

    def zipped(x: Column) -> Column:
        gaps = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["m"])), F.slice(x["gaps"], F.lit(2), F.size(x["m"])), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(x["m"], gaps, lambda m, g: F.struct(m.alias("m"), F.length(g["a"]).cast("bigint").alias("gap"), ending(g["a"]).alias("before"), g["b"].alias("after")))

    return once(once(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("gaps")), zipped), whole)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = digits(m)
    n = F.length(d)
    value = lambda i: F.substr(d, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def small_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255))


def contexts(before: Column, after: Column) -> Column:
    """The patterns of what stands between: the two whole words before it, and the one before with the one after it."""
    words = F.regexp_extract_all(F.lower(before), F.lit(common.WORD), F.lit(0))
    partial = before.rlike(rf"{_N}\z").cast("int")

    def of(x: Column) -> Column:
        w, n = x["w"], F.size(x["w"]) - partial
        left = F.when(n >= 2, F.concat_ws(" ", F.get(w, n - 2), F.get(w, n - 1), F.lit("_")))
        around = F.when((n >= 1) & (x["next"] != ""), F.concat_ws(" ", F.get(w, n - 1), F.lit("_"), x["next"]))
        return F.array_compact(F.array(left, around))

    return once(F.struct(words.alias("w"), next_word(after).alias("next")), of)


def seed_spans(text: Column) -> Column:
    """array<struct<start, kind, end, word, patterns>>, by start, then kind; word: the whole matched text."""
    kinds = [
        (text.contains("@"), EMAIL, lambda m: F.lit(True)),
        (text.rlike(r"[0-9]\.[0-9]"), IP, small_parts),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD, luhn),
        (text.contains("+"), PHONE, lambda m: F.length(digits(m)).between(9, 15)),
        (text.rlike("[0-9a-f]{32}"), SECRET, lambda m: F.lit(True)),
    ]
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,word:string,patterns:array<string>>>")
    as_kind = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["m"].alias("word"), contexts(x["before"], x["after"]).alias("patterns"))
    found = [F.when(may, F.transform(places(text, pattern, keep), as_kind(k))).otherwise(empty) for k, (may, pattern, keep) in enumerate(kinds)]
    return F.sort_array(F.concat(*found))


def candidates(text: Column) -> Column:
    """array<struct<start, end, word, patterns>>: runs and words that may be identifiers, without quotes and marks round them."""
    lead, trail = (lambda m: F.length(F.regexp_extract(m, "^[\"'<\\[{]+", 0))), (lambda m: F.length(F.regexp_extract(m, r"[^\p{L}\p{N})]+\z", 0)))
    trimmed = lambda x: F.struct((x["start"] + lead(x["m"])).alias("start"), (x["end"] - trail(x["m"])).alias("end"), F.substr(x["m"], lead(x["m"]) + 1, F.length(x["m"]) - lead(x["m"]) - trail(x["m"])).alias("word"), contexts(x["before"], x["after"]).alias("patterns"))
    found = F.transform(places(text, CANDIDATE, lambda m: F.lit(True)), trimmed)
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda x: x["start"] < x["end"])).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,word:string,patterns:array<string>>>"))


def fits(word: Column) -> Column:
    """May be marked: enough digits, or an e-mail address's shape."""
    return (F.length(digits(word)) >= LEAST_DIGITS) | word.rlike("[^@]@[^@]")


def others(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """pattern, n: of each asked pattern, how many different words that can't be candidates stand in its place. texts: text; asked: pattern, once each."""
    sides = asked.agg(F.count_if(F.col("pattern").endswith(" _")).alias("left"), F.count(F.lit(1)).alias("all")).first()
    words = F.regexp_extract_all(F.lower("text"), F.lit(common.WORD), F.lit(0))
    at = lambda k: F.get("w", F.col("i") + k)
    left, around = F.concat_ws(" ", at(-2), at(-1), F.lit("_")), F.concat_ws(" ", at(-1), F.lit("_"), at(1))
    forms = [F.when(F.col("i") >= 2, left)] * (sides["left"] > 0) + [F.when((F.col("i") >= 1) & (F.col("i") + 1 < F.size("w")), around)] * (sides["all"] > sides["left"])
    if not forms:
        return asked.select("pattern", F.lit(0).cast("bigint").alias("n")).where("false")
    each = texts.select(words.alias("w")).select("w", F.posexplode("w").alias("i", "word")).where(~F.col("word").rlike("[0-9@]"))
    each = each.select("word", *(x.alias(f"p{k}") for k, x in enumerate(forms)))
    each = each.select("word", F.explode(F.array(*(f"p{k}" for k in range(len(forms))))).alias("pattern")) if len(forms) > 1 else each.withColumnRenamed("p0", "pattern")
    met = each.where("pattern IS NOT NULL").join(F.broadcast(asked) if sides["all"] <= FEW else asked, "pattern", "left_semi")
    return met.distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def confident_patterns(instances: DataFrame, texts: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """instances: pattern, word, seed; texts: text. Returns pattern. What confident patterns mark counts as a seed from then on, until they mark nothing more."""
    edges = common.staged(instances.groupBy("pattern", "word").agg(F.max("seed").alias("seed")), "edges")
    able = F.count_if(F.col("seed") | fits(F.col("word"))).alias("able")  # no other pattern can ever have the support
    asked = common.staged(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), able).where(F.col("able") >= support).select("pattern", "n"), "asked")

    def possible(some: DataFrame) -> DataFrame:
        """Those of asked that might be confident if all their instances were identifiers, with how many others stand in their place in some texts."""
        counted = asked.join(others(some, asked.select("pattern")).withColumnRenamed("n", "rest"), "pattern", "left").withColumn("rest", F.coalesce("rest", F.lit(0)))
        return common.staged(counted.where(F.col("n") >= confident * (F.col("n") + F.col("rest") + 1)), "asked")

    if not asked.isEmpty():
        asked = possible(texts.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0)).select("pattern", "n")
    if asked.isEmpty():
        return asked.select("pattern")
    edges = common.staged(edges.join(possible(texts).select("pattern", "rest"), "pattern"), "graph")
    seeds = common.staged(edges.groupBy("word").agg(F.max("seed").alias("seed")), "seeds")
    known = -1
    while (now := seeds.where("seed").count()) > known:
        known = now
        words = seeds.select("word", F.col("seed").cast("double").alias("score"), "seed")
        for _ in range(rounds):
            scores = edges.select("pattern", "word", "rest").join(words, "word")
            patterns = common.staged(scores.groupBy("pattern", "rest").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds")).select("pattern", (F.col("score") / (F.col("n") + F.col("rest") + 1)).alias("score"), "seeds"), "patterns")
            best = edges.select("pattern", "word").join(patterns.where(F.col("seeds") >= support), "pattern").groupBy("word").agg(F.max("score").alias("best"))
            words = common.staged(seeds.join(best, "word", "left").select("word", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "seed"), "words")
        good = patterns.where((F.col("seeds") >= support) & (F.col("score") >= confident)).select("pattern")
        marked = edges.join(good, "pattern").where(fits(F.col("word"))).select("word").distinct().withColumn("marked", F.lit(True))
        seeds = common.staged(seeds.join(marked, "word", "left").select("word", (F.col("seed") | F.coalesce("marked", F.lit(False))).alias("seed")), "seeds")
    return good


def uncovered(rows: DataFrame) -> DataFrame:
    """row, start, end, word, patterns of the candidates that share no character with a seed: each row's spans in order, of which only the one before and the one after matter."""
    mine = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.*", F.lit(True).alias("mine"))
    seeds = rows.where(F.size("candidates") > 0).select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", "b.word", "b.patterns", F.lit(False).alias("mine"))
    order = Window.partitionBy("row").orderBy("start", "mine")
    upto = F.max(F.when(~F.col("mine"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = mine.unionByName(seeds).withColumns({"upto": upto, "next": F.lead(F.struct("start", "mine")).over(order)})
    free = (F.coalesce("upto", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | F.col("next.mine") | (F.col("next.start") >= F.col("end")))
    return both.where(F.col("mine") & free).select("row", "start", "end", "word", "patterns")


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """A row for each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more (spans besides the base ones), n_spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = common.staged(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), seed_spans(text).alias("base"), candidates(text).alias("candidates")), "spans")
    found = common.staged(uncovered(rows), "candidates")
    seeds = rows.select(F.explode("base").alias("b")).select(F.explode("b.patterns").alias("pattern"), "b.word", F.lit(True).alias("seed"))
    good = confident_patterns(seeds.unionByName(found.select(F.explode("patterns").alias("pattern"), "word", F.lit(False).alias("seed"))), docs.select(text.alias("text")))
    new = found.where(fits(F.col("word"))).select("row", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern").select("row", "start", "end").distinct()
    new = new.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("new"))
    rows = rows.select("doc_id", "row", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))).alias("base")).join(new, "row", "left")
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    only = F.filter("base", lambda x: x["kind"] < BASE)
    everything = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.concat("base", "new"))
    n_spans = (F.size("base") + F.coalesce(F.size("new"), F.lit(0))).cast("bigint")
    return rows.select("doc_id", *(of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])), F.sha2(spelled(only), 256).alias("base_sha256"), spelled(everything).alias("spans"), (n_spans - F.size(only)).alias("n_more"), n_spans.alias("n_spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
