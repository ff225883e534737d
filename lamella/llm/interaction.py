"""How filters interact: what every order of five filters removes at every step, by part and label.

Each document has a mask of the filters that it fails. A truth table turns the mask into a 32-bit word whose bit S says
whether the document survives the subset S of filters. Words are summed by bit position with carry-save adders, so one
pass gives the survivors of all subsets by part and label; every column of the audit is a difference of two of them.

Texts become a mask and a digest where they are read. A document is an earlier text's copy unless it has the least
doc_id of its digest; the join that tells meets on digest and doc_id, so a large group of copies is spread by id.

Cases: a null or empty text has no words (fails A, no other); a null lang is the part of the empty string; a null doc_id
is never smaller nor larger than another, so such a row fails E nowhere and has no label; repeated rows are documents
of their own, none of them a copy of the other as their ids are equal; of several labels the largest counts; an empty
table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import materialise

#: The filters, the marks of D and the letters of C.
FILTERS = "ABCDE"
MARKS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUBSETS = 1 << len(FILTERS)
#: TRUTH[mask] has bit S set if a document that fails the filters of mask survives the filters of S.
TRUTH = np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)
_SLIM = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])
_COUNTS = pa.schema([("part", pa.string()), *((c, pa.list_(pa.int64())) for c in ("alive", "good", "toxic"))])


def text_mask(text: bytes, points: int) -> int:
    """The bits of A to D that a UTF-8 text of so many code points fails; bytes.split() cuts at space and tab to return."""
    words = text.split()
    bare = len(text) - len(text.translate(None, UPPER))
    marked = len(text.translate(None, MARKS)) < len(text)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * bare > 3 * points) << 2 | marked << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = pc.utf8_length(batch["text"]).to_pylist()
        texts = batch["text"].cast(pa.binary())
        masks, digests = [], []
        for i, n in enumerate(points):
            text = texts[i].as_py()
            masks.append(text_mask(text, n))
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], schema=_SLIM)


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask: what each text fails by itself."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInArrow(_masks, "doc_id long, part string, digest binary, mask int")


def fail_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: a row a document, E included."""
    slim = materialise(text_masks(docs), "masks")
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("__first")).withColumnRenamed("digest", "__digest")
    met = slim.join(first, (F.col("digest") == F.col("__digest")) & (F.col("doc_id") == F.col("__first")), "left")
    copy = F.col("__first").isNull() & F.col("doc_id").isNotNull()
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set. Three words of one weight become a sum and a carry of twice the weight."""
    level, weight, totals = words.astype(np.uint32), 1, np.zeros(32, np.int64)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, rest])
        totals += weight * ((level[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        level, weight = (np.concatenate(carries) if carries else level[:0]), 2 * weight
    return totals


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        counts = [pa.array([x[k].tolist() for x in held.values()], pa.list_(pa.int64())) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *counts], schema=_COUNTS)

    for batch in batches:
        parts = batch["part"].dictionary_encode()
        code, words = np.asarray(parts.indices), TRUTH[np.asarray(batch["mask"])]
        labels = [np.asarray(batch[c].cast(pa.int8())) == 1 for c in ("good", "toxic")]
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
        for k, part in enumerate(parts.dictionary.to_pylist()):
            own = order[edges[k] : edges[k + 1]]
            found = np.array([positional_popcount(words[own]), *(positional_popcount(words[own[x[own]]]) for x in labels)])
            held[part] = held[part] + found if part in held else found
        if len(held) > 4096:
            yield out()
            held.clear()
    if held:
        yield out()


def subset_survivors(masks: DataFrame) -> DataFrame:
    """masks: part, mask, good, toxic (booleans). Returns part and arrays alive, good, toxic: by subset, how many survive it."""
    counted = masks.select("part", "mask", "good", "toxic").mapInArrow(_popcounts, "part string, alive array<long>, good array<long>, toxic array<long>")
    by_bit = counted.select("part", F.posexplode(F.arrays_zip("alive", "good", "toxic")).alias("s", "n"))
    summed = by_bit.groupBy("part", "s").agg(*(F.sum(f"n.{c}").alias(c) for c in ("alive", "good", "toxic")))
    rows = summed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "alive", "good", "toxic"))).alias("n"))  # 32 rows a part
    return rows.select("part", *(F.col(f"n.{c}").alias(c) for c in ("alive", "good", "toxic")))


def _steps(filters: str) -> Column:
    """An array of every step of every order: the subset before it, the subset after it, and its filter's number."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append({"o": "".join(filters[i] for i in order), "step": step, "b": before, "a": before | 1 << f, "f": f})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<o: string, step: int, b: int, a: int, f: int>>")


def _shapley(filters: str) -> Column:
    """By filter: what it removes, summed over all orders; a subset before it stands in |S|! (n - 1 - |S|)! of them."""
    n = len(filters)
    of = lambda f: " + ".join(f"{factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())} * (alive[{s}] - alive[{s | 1 << f}])" for s in range(1 << n) if not s >> f & 1)
    return F.expr(f"array({', '.join(of(f) for f in range(n))})")


def audit(survivors: DataFrame) -> DataFrame:
    """A row per part, order and step, from the survivors of all subsets."""
    all_bits = SUBSETS - 1
    d = survivors.withColumn("__shapley", _shapley(FILTERS)).select("*", F.explode(_steps(FILTERS)).alias("x"))
    at = lambda c, i: F.expr(f"{c}[{i}]")
    removed = at("alive", "x.b") - at("alive", "x.a")
    alone = f"int({all_bits} - shiftleft(1, x.f))"
    return d.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.step").alias("step"),
        at("alive", "x.a").alias("kept"),
        removed.alias("removed"),
        (at("alive", 0) - at("alive", "shiftleft(1, x.f)") - removed).alias("redundant"),
        (at("alive", alone) - at("alive", all_bits)).alias("unique_fails"),
        (at("good", "x.b") - at("good", "x.a")).alias("good_lost"),
        (at("toxic", "x.b") - at("toxic", "x.a")).alias("toxic_lost"),
        at("__shapley", "x.f").alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of A to E over whole documents. labels: doc_id, quality, toxic."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.max("quality").alias("__quality"), F.max("toxic").alias("__toxic"))
    masks = fail_masks(docs).join(known, F.col("doc_id") == F.col("__doc"), "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return audit(subset_survivors(masks.select("part", "mask", is_one("__quality").alias("good"), is_one("__toxic").alias("toxic"))))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
k AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.part, coalesce(k.quality = 1, false) AS good, coalesce(k.toxic = 1, false) AS toxic,
             (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS mask
      FROM w LEFT JOIN k ON w.doc_id = k.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask),
f AS (SELECT substr('ABCDE', i + 1, 1) AS l, 1 << i AS bit FROM (SELECT unnest(range(5))::INT AS i)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a JOIN f b ON b.l <> a.l JOIN f c ON c.l NOT IN (a.l, b.l) JOIN f d ON d.l NOT IN (a.l, b.l, c.l) JOIN f e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(list_slice(bits, 1, step - 1))::INT AS pre FROM (SELECT *, unnest(range(1, 6))::INT AS step FROM o)),
r AS (SELECT c.part, s.filter_order, s.step, s.bit,
             sum(n) FILTER ((mask & (coalesce(pre, 0) | bit)) = 0) AS kept,
             sum(n) FILTER ((mask & coalesce(pre, 0)) = 0 AND (mask & bit) <> 0) AS removed,
             sum(n) FILTER ((mask & coalesce(pre, 0)) <> 0 AND (mask & bit) <> 0) AS redundant,
             sum(n) FILTER (mask = bit) AS unique_fails,
             sum(g) FILTER ((mask & coalesce(pre, 0)) = 0 AND (mask & bit) <> 0) AS good_lost,
             sum(x) FILTER ((mask & coalesce(pre, 0)) = 0 AND (mask & bit) <> 0) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""
