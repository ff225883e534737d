"""Near-duplicates by order min hash, verified by banded alignment.

A text's k-mers (five words, lower-cased) are labelled by their occurrence number. For each of several hash functions
the few least labelled k-mers are taken and kept in text order; their joint hash is a bucket key, so texts share keys
when they share k-mers in the same order. Sketches say little of short texts: those have for keys the least labelled
k-mers themselves, as many as two texts that reach the similarity must meet in, so none of their pairs is missed. Equal
texts are one text from the start. In a bucket every text is aligned
with one leader, the text that has most company in its own buckets, not with every other: similarity is the longest
common subsequence M of the k-mer sequences over n1 + n2 - M, found bit-parallel in a band. Links are joined to classes
by connected components.

Members of a leader that are still in different classes are settled by what sets them apart from it: two texts that
reach the similarity differ from the leader in much the same k-mers, of which a bound says how many they must share, so
they are found by an equi-join on the rarest of these (see apart()), and aligned in turn. No bucket is cut or sampled,
and no text meets all others of its bucket.

Cases: null and empty texts, and those without words, are classes of their own, a row each; texts of fewer than five words are one
k-mer; a null doc_id sorts before all others and stays null; rows with equal doc_id and text are one document; an empty
table gives no rows; other columns are ignored, and kept by keep_one().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import WORD, gathered, materialise, rows
from lamella.llm.components import components

K = 5
SIMILARITY = 0.8
#: Sketches a text, and k-mers in one. Two texts with M common k-mers of U share none with probability (1 - C(M, 5) / C(U, 5))**24:
#: at similarity 0.8 that is 1.4e-4 for M = 36, and falls to (1 - 0.8**5)**24 = 7e-5 for long texts.
SKETCHES, TAKEN = 24, 5
#: Texts of at most so many k-mers are found exactly. Texts that can be near one above this have at least LEAST_SKETCHED.
SHORT = 40
LEAST_SKETCHED = -(-4 * (SHORT + 1) // 5)
#: The least similarity that alignment tells exactly; below it only "below" is known.
KNOWN = 0.6
LEAST_ID = -(1 << 63)

_WORDS = re.compile(WORD)
_MULTIPLY = np.random.default_rng(5).integers(1 << 62, 1 << 63, SKETCHES).astype(np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh32_intdigest(word.lower().encode())
        if len(self) < 500_000:
            self[word] = found
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of K words; of all words where there are fewer."""
    width = min(K, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = _mixed(out + words[i : i + len(out)].astype(np.uint64) + np.uint64(1))
    return out


def labelled_by_occurrence(grams: np.ndarray) -> np.ndarray:
    order = np.argsort(grams, kind="stable")
    run = grams[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    number = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
    labelled = np.empty_like(grams)
    labelled[order] = _mixed(run + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return labelled


def sketches(grams: np.ndarray) -> list[int]:
    labelled = labelled_by_occurrence(grams)
    take, out = min(TAKEN, len(grams)), []
    for at in range(0, SKETCHES, SKETCHES if len(grams) < 50_000 else 1):
        factors = _MULTIPLY[at : at + (SKETCHES if len(grams) < 50_000 else 1), None]
        keyed = labelled[None] * factors
        least = np.argpartition(keyed, take - 1, axis=1)[:, :take] if take < len(grams) else np.tile(np.arange(take), (len(factors), 1))
        least.sort(axis=1)
        joint = np.full(len(factors), take, np.uint64)
        for i in range(take):
            joint = _mixed(joint * np.uint64(31) + grams[least[:, i]])
        out.append(joint)
    return np.concatenate(out).view(np.int64).tolist()


def keys(grams: np.ndarray) -> list[int]:
    """Bucket keys. Of two texts that reach SIMILARITY, each has four fifths of its labelled k-mers in common with the
    other, so that the least n - ceil(0.8 n) + 1 of both, in any order that all texts share, have one in common."""
    n, out = len(grams), []
    if n <= SHORT:
        least = np.sort(labelled_by_occurrence(grams))[: n + 1 - -(-4 * n // 5)]
        out += least.view(np.int64).tolist()
    if n >= LEAST_SKETCHED:
        found = np.array(sketches(grams), np.int64).view(np.uint64)
        out += _mixed(found + np.arange(1, SKETCHES + 1, dtype=np.uint64) * _MIX).view(np.int64).tolist()
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """M / (n1 + n2 - M) for the longest common subsequence M; -1 where that is below KNOWN for sure."""
    if len(a) > len(b):
        a, b = b, a
    n, total = len(a), len(a) + len(b)
    enough = KNOWN / (1 + KNOWN) * total
    if n < enough:
        return -1.0
    differ = np.flatnonzero(a != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    differ = np.flatnonzero(a[::-1] != b[len(b) - len(a) :][::-1])
    tail = int(differ[0]) if len(differ) else len(a)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    matched = head + tail
    if len(a):
        both = np.intersect1d(a, b)
        x, y = a[np.isin(a, both)], b[np.isin(b, both)]
        if matched + min(len(x), len(y)) < enough:
            return -1.0
        if len(x) and len(y):  # k-mers of one side only can't match: they only widen the band
            matched += _aligned(x.tolist(), y.tolist(), int((1 - KNOWN) / (1 + KNOWN) * total) + 1)
    return matched / (total - matched) if matched >= enough else -1.0


def _aligned(a: list[int], b: list[int], band: int, step: int = 256) -> int:
    """The longest common subsequence within `band` of the diagonal: a bit a place of `a`, clear where the count grows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    n = len(a)
    row = (1 << n) - 1
    for at in range(0, len(b), step):
        lo, hi = max(0, at - band), min(n, at + step + band)
        if lo >= n:
            break
        mask = (1 << (hi - lo)) - 1
        part = (row >> lo) & mask
        for x in b[at : at + step]:
            hit = part & (places[x] >> lo)
            part = ((part + hit) | (part - hit)) & mask
        row = (row & ~(mask << lo)) | (part << lo)
    return n - row.bit_count()


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame) -> DataFrame:
    """id, t (the text's key), n (k-mers), bucket keys and word hashes, a row a document; n = 0 without words."""
    schema = pa.schema([("id", pa.int64()), ("t", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("words", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = _Hashes()
        for doc_id, t, text in rows(batches, "id", "t", "text"):
            words = np.array([known[w] for w in _WORDS.findall(text or "")], "<u4")
            grams = kmers(words) if len(words) else words
            yield doc_id, t, len(grams), keys(grams) if len(grams) else [], words.tobytes()

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), text_key(F.col("text")).alias("t"), "text")
    return slim.mapInArrow(lambda b: gathered(made(b), schema, lambda r: len(r[4]) + 250), "id long, t binary, n int, keys array<long>, words binary")


def _with_words(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs with the words of both: moved by the same plan at any size."""
    a = texts.select(F.col("t").alias("a"), F.col("words").alias("wa"))
    b = texts.select(F.col("t").alias("b"), F.col("words").alias("wb"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "wa", "wb")


def aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with sim; texts: t, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [similarity(kmers(np.frombuffer(w, "<u4")), kmers(np.frombuffer(v, "<u4"))) for w, v in rows([batch], "wa", "wb")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "sim"])

    return _with_words(pairs, texts).mapInArrow(run, "a binary, b binary, sim double")


def led_by(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, its leader b) with sim, n and lead_n (k-mers of both), and diff: names of the labelled k-mers that one of the
    two has and the other hasn't. The leader is part of a name, so members of other leaders share none."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sim", pa.float64()), ("n", pa.int64()), ("lead_n", pa.int64()), ("diff", pa.list_(pa.int64()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for a, b, w, v in rows(batches, "a", "b", "wa", "wb"):
            x, y = kmers(np.frombuffer(w, "<u4")), kmers(np.frombuffer(v, "<u4"))
            differ = np.setxor1d(labelled_by_occurrence(x), labelled_by_occurrence(y), assume_unique=True)
            yield a, b, similarity(x, y), len(x), len(y), _mixed(differ + np.uint64(xxhash.xxh3_64_intdigest(b))).view(np.int64).tolist()

    return _with_words(pairs, texts).mapInArrow(lambda b: gathered(made(b), schema, lambda r: 100 + 8 * len(r[5])), "a binary, b binary, sim double, n long, lead_n long, diff array<long>")


def apart(led: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots under one leader that may reach the similarity. led: as led_by() has it.

    With D(x) the k-mers that set x apart from its leader, x and y differ in as many k-mers as D(x) and D(y) do. So they
    reach the similarity only if D(x) and D(y) have (|D(x)| + |D(y)| - (n(x) + n(y)) / 9) / 2 members in common. Members
    are put in one order, rarest first; then the first one in common comes early in both, and only so many are sent as
    allow for that, to the classes of |D| that a partner can have. Members that no other root has come first and are
    not sent at all: frequent ones, such as those of a passage, come last and are rarely sent.
    """
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = led.hint("merge").join(named("a"), "a", "left").hint("merge").join(named("b"), "b", "left")
    rest = rest.select("b", "a", "n", "lead_n", "diff", F.size("diff").cast("long").alias("d"), F.coalesce("a_root", "a").alias("root"), F.coalesce("b_root", "b").alias("lead_root"))
    mixed = materialise(rest.groupBy("b").agg(F.count_if(F.col("root") != F.col("lead_root")).alias("apart"), F.count("*").alias("size")).where("apart > 0 and size > 1").select("b"), "mixed")
    rest = materialise(rest.hint("merge").join(mixed, "b").withColumn("rid", F.monotonically_increasing_id()), "rest")
    each = rest.select("rid", F.xxhash64("root").alias("r"), F.explode("diff").alias("token"))
    several = materialise(each.groupBy("token").agg(F.count("*").alias("times"), F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high").select("token", "times"), "tokens")
    held = each.hint("merge").join(several, "token").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("held"))  # at most a text's own k-mers
    width = F.greatest(F.lit(1), F.expr("lead_n div 12"))
    sent = rest.select("rid", "a", "root", "n", "lead_n", "d", width.alias("w")).hint("merge").join(held, "rid")
    sent = sent.select("a", "root", "n", "lead_n", "d", "w", F.size("held").alias("shared"), F.posexplode("held").alias("at", "one"))
    sent = sent.select("a", "root", "n", "lead_n", "d", "w", F.col("one.token").alias("token"), (F.col("shared") - F.col("at")).cast("long").alias("from_here"))
    low, high = (F.floor((F.col("d") + sign * F.col("n") / 4) / F.col("w")) for sign in (-1, 1))
    sent = sent.withColumns({"own": F.floor(F.col("d") / F.col("w")), "other": F.explode(F.sequence(F.greatest(F.lit(0), low), high))})
    longest = F.least(1.25 * F.col("n"), F.col("lead_n") + (F.col("other") + 1) * F.col("w"))
    sent = sent.where(18 * F.col("from_here") >= 9 * (F.col("d") + F.col("other") * F.col("w")) - (F.col("n") + longest)).drop("w", "lead_n")
    partner = sent.select("token", F.col("own").alias("other"), F.col("other").alias("own"), *[F.col(c).alias(f"o_{c}") for c in ("a", "root", "n", "d", "from_here")])
    differ = (F.col("root") != F.col("o_root")) & (F.col("a") < F.col("o_a")) & (5 * F.col("n") >= 4 * F.col("o_n")) & (5 * F.col("o_n") >= 4 * F.col("n"))
    open_ = 9 * (F.col("d") + F.col("o_d")) - (F.col("n") + F.col("o_n"))
    met = sent.hint("merge").alias("x").join(partner.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.own") == F.col("y.own")) & (F.col("x.other") == F.col("y.other")) & differ & (18 * F.least("from_here", "o_from_here") >= open_))
    # those that have the leader's k-mers in another order need have nothing else in common
    near = rest.where(9 * F.col("d") <= F.col("n") + F.col("lead_n")).select("b", "a", "root", "n", "d", "lead_root")
    turned = near.where("root <> lead_root").select("b", *[F.col(c).alias(f"o_{c}") for c in ("a", "root", "n", "d")])
    by_leader = near.hint("merge").join(turned, "b").where((F.col("root") != F.col("o_root")) & (open_ <= 0))
    return met.select("a", F.col("o_a").alias("b")).unionByName(by_leader.select(F.least("a", "o_a").alias("a"), F.greatest("a", "o_a").alias("b"))).distinct()


def text_classes(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """node, root: texts that have near-duplicates, with the least of their class. texts: t, words; buckets: bucket, t, n, company."""
    leaders = buckets.groupBy("bucket").agg(F.max_by("t", F.struct("company", "t")).alias("lead"))
    pairs = buckets.hint("merge").join(leaders, "bucket").where("t <> lead").select(F.col("t").alias("a"), F.col("lead").alias("b")).distinct()
    led = materialise(led_by(pairs, texts), "led")
    roots = materialise(components(led.where(F.col("sim") >= SIMILARITY).select("a", "b")), "roots")
    found = materialise(aligned(apart(led, roots), texts).where(F.col("sim") >= SIMILARITY).select("a", "b"), "found")
    root_of = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    joined = components(found.join(named("a"), "a", "left").join(named("b"), "b", "left").select(root_of("a"), root_of("b")))
    every = roots.unionByName(joined.select("node", F.col("node").alias("root"))).distinct()
    return every.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """id, t, class_id: every document with the least id of its class of near-duplicates.

    Joins of tables that grow with the corpus are merge joins at any size, so that growth on small tables tells that on large ones.
    """
    merged = lambda df: df.hint("merge")
    written = materialise(signatures(docs).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    texts = written.where("n > 0").groupBy("t").agg(F.min("id").alias("least"), F.min("uid").alias("uid"))
    texts = materialise(texts, "texts")
    first = merged(written.select("uid", "t", "n", "keys")).join(texts.select("uid"), "uid", "left_semi")
    keyed = first.select(F.explode("keys").alias("bucket"), "t", "n")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialise(merged(keyed).join(shared, "bucket"), "buckets")
    company = materialise(buckets.groupBy("t").agg(F.sum("size").alias("company")), "company")
    chosen = merged(texts).join(company, "t").select("uid")
    several = materialise(merged(written.select("uid", "t", "words")).join(chosen, "uid").select("t", "words"), "candidates")
    roots = text_classes(several, merged(buckets).join(company, "t"))
    named = merged(texts).join(roots, texts["t"] == roots["node"], "left").select("t", "least", F.coalesce("root", "t").alias("root"))
    named = materialise(named, "named")
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"))
    by_text = merged(named).join(heads, "root").select("t", "class_id")
    return merged(written.select("id", "t", "n")).join(by_text, "t", "left").select("id", "t", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: a row a document."""
    shown = lambda c: F.when(F.col(c) != LEAST_ID, F.col(c))
    return classes(docs).select(shown("id").alias("doc_id"), shown("class_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document has the least id of its class, once each; of rows with that id and text the one whose other
    columns come first as JSON."""
    kept = classes(docs).where("id = class_id").select("id", "t")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.to_json(F.struct(*others)) if others else F.lit("")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), text_key(F.col("text")).alias("t"), tie.alias("tie"), F.struct(*docs.columns).alias("row"))
    first = keyed.groupBy("id", "t").agg(F.min("tie").alias("tie")).join(kept, ["id", "t"], "left_semi")
    return keyed.join(first, ["id", "t", "tie"], "left_semi").dropDuplicates(["id", "t"]).select("row.*")
