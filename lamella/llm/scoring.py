"""Stupid-backoff scores of documents under the corpus's own bigrams.

A word after another scores (c(ab) - own(ab)) / c(a.), with own(ab) the document's own occurrences, so that no document
is its own evidence; where that is 0 it backs off to alpha * c(b) / N. The first word scores c(b) / N. A document's
score is the sum of logarithms.

Everything is a join of count tables with exploded n-grams, both partitioned by hash, and a sum per document. To keep
the shuffle small, n-grams travel as packed arrays: a task gathers its documents into chunks and sends each hash bucket
one row a chunk. A bucket counts its bigrams, joins them to their occurrences and sums; what backs off to a rare word
goes on to that word's bucket, where the unigram table is. The number of buckets grows with the corpus, so that a
bucket's size does not. Words that make up 1/65,000 of the corpus or more (at most 65,000) are broadcast with their
counts. Pairs of words that each fill a bucket or more could be hot keys: they are counted a chunk at a time, and wait
in their own chunk until their total counts (of at most 1,000 words by 1,000) are known.

Rare words are named by a hash whose width grows with the vocabulary: in v words less than v * v / 2**(8 * width + 1), so below
one in a thousand, pairs are expected to share a name (from 2**23 words on, where names reach their full 61 bits, the
expectation is v * v / 2**62).

Cases: null and empty texts, and those without words, have 0 words, score 0 and a null mean; a null doc_id is kept;
repeated rows are documents of their own, and evidence for each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import WORD, materialise, partitions, rows

_WORDS = re.compile(WORD)
HOT_WORDS, TOP_WORDS = 65_000, 1_000
RARE = np.uint64(1 << 62)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) * np.uint64(3) + b)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


def word_counts(docs: DataFrame) -> DataFrame:
    """w (the word's hash), n, ctx (occurrences that a word follows): tasks count first, Spark adds up."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        last: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            w = np.fromiter(map(word_hash, itertools.chain(seen, last)), np.int64, len(seen) + len(last))
            n = np.fromiter(itertools.chain(seen.values(), itertools.repeat(0, len(last))), np.int64, len(w))
            ends = np.fromiter(itertools.chain(itertools.repeat(0, len(seen)), last.values()), np.int64, len(w))
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n), pa.array(n - ends)], names=["w", "n", "ctx"])

        for (text,) in rows(batches, "text"):
            words = _WORDS.findall(text or "")
            if words:
                seen.update(words)
                last[words[-1]] += 1
            if len(seen) > 400_000:
                yield flush()
                seen.clear()
                last.clear()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(made, "w long, n long, ctx long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("ctx").alias("ctx"))


class Hot:
    """The broadcast part of the counts: frequent words by rank; the first `top` of them could make hot pairs."""

    def __init__(self, words: list, total: int, vocabulary: int, bucket_words: int) -> None:
        self.total = total
        self.rank = {int(w): i for i, (w, _, _) in enumerate(words)}
        self.n = np.array([n for _, n, _ in words], float)
        self.ctx = np.array([c for _, _, c in words], float)
        self.top = int((self.n >= max(bucket_words, total / TOP_WORDS)).sum())
        self.width = min(8, max(5, math.ceil((2 * math.log2(max(2, vocabulary)) + 9) / 8)))
        self.mask = (1 << min(8 * self.width, 61)) - 1

    def coder(self) -> Coder:
        return Coder(self)


class Coder(dict):
    """Word to code: the rank of a hot word, else a name made of its hash."""

    def __init__(self, hot: Hot) -> None:
        super().__init__()
        self.hot, self.mask = hot, hot.mask

    def __missing__(self, word: str) -> int:
        h = word_hash(word)
        code = self.hot.rank.get(h)
        if code is None:
            code = (h & self.mask) | int(RARE)
        if len(self) < 500_000:
            self[word] = code
        return code

    def codes(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def packed(codes: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Which codes are rare, a bit each, and the codes: two bytes for hot ones, `width` for rare ones, hot ones first."""
    rare = codes >= RARE
    return np.packbits(rare).tobytes(), codes[~rare].astype("<u2").tobytes() + codes[rare].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(bits: bytes, data: bytes, n: int, width: int) -> np.ndarray:
    rare = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    k = int(rare.sum())
    out = np.zeros(n, np.uint64)
    out[~rare] = np.frombuffer(data, "<u2", n - k)
    wide = np.zeros((k, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, k * width, 2 * (n - k)).reshape(k, width)
    out[rare] = wide.view(np.uint64).ravel() | RARE
    return out


_SENT = "bucket long, chunk long, n long, a_bits binary, a binary, b_bits binary, b binary, doc binary, base binary"


def sent(docs: DataFrame, hot: Hot, buckets: int, alpha: float, chunk_words: int = 1_000_000) -> DataFrame:
    """A row a chunk and bucket with its pairs; and a row a chunk with its documents (bucket below 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    names = [c.split()[0] for c in _SENT.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        coder, part, number = own.coder(), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = (part << 32) | number
            lengths = np.array([len(c) for _, c in held])
            codes = np.concatenate([c for _, c in held])
            doc = np.repeat(np.arange(len(held)), lengths)
            base = np.zeros(len(held))
            starts = np.cumsum(lengths) - lengths
            some = lengths > 0
            first = codes[starts[some]]
            # the first word: hot ones score here, rare ones as a back-off, with alpha taken out
            base[some] += np.where(first < RARE, np.log(own.n[np.minimum(first, len(own.n) - 1).astype(np.int64)] / own.total) if len(own.n) else 0.0, -math.log(alpha))
            inside = doc[1:] == doc[:-1] if len(codes) else np.zeros(0, bool)
            a, b, at = codes[:-1][inside], codes[1:][inside], doc[1:][inside]
            waits = (a < own.top) & (b < own.top)
            waiting = np.stack([at[waits], a[waits].astype(np.int64), b[waits].astype(np.int64)]).astype("<u2").tobytes()
            a, b, at = a[~waits], b[~waits], at[~waits]
            key = pair_key(a, b)
            # rare first words are at home in their own bucket, the others' pairs in that of the pair
            home = (np.where(a >= RARE, mixed(a), key) >> np.uint64(20)) % np.uint64(buckets)
            # rare words that open a document: pairs without a first word, in any bucket
            opens = np.flatnonzero(some)[first >= RARE]
            a = np.concatenate([a, np.full(len(opens), 65_535, np.uint64)])
            b = np.concatenate([b, first[first >= RARE]])
            at = np.concatenate([at, opens])
            home = np.concatenate([home, mixed(first[first >= RARE]) % np.uint64(buckets)])
            order = np.lexsort((at, home))
            a, b, at, home = a[order], b[order], at[order], home[order]
            edges = np.append(np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else [], len(home)).astype(np.int64)
            out = []
            for p, q in zip(edges[:-1], edges[1:], strict=True):
                out.append((int(home[p]), chunk, int(q - p), *packed(a[p:q], own.width), *packed(b[p:q], own.width), at[p:q].astype("<u2").tobytes(), None))
            ids = np.array([[0 if d is None else d, d is None, n] for (d, _), n in zip(held, lengths.tolist(), strict=True)], np.int64)
            out.append((-1 - (chunk % (1 << 40)), chunk, len(held), None, waiting, None, None, ids.tobytes(), base.tobytes()))
            for at_ in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at_ : at_ + 500], strict=True), [pa.int64()] * 3 + [pa.binary()] * 6, strict=True)], names=names)

        for doc_id, text in rows(batches, "doc_id", "text"):
            held.append((doc_id, coder.codes(text or "")))
            size += len(held[-1][1])
            if size >= chunk_words or len(held) >= 65_535:
                yield from flush()
                held, size, number = [], 0, number + 1
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, _SENT)


_SUMS = "kind int, bucket long, chunk long, n long, doc binary, value binary, code binary"


def _sums(chunk: np.ndarray, doc: np.ndarray, value: np.ndarray) -> list[tuple]:
    """A row a chunk: its documents that occur here, and their sums."""
    out = []
    order = np.argsort(chunk, kind="stable")
    edges = np.append(np.flatnonzero(np.concatenate([[True], chunk[order][1:] != chunk[order][:-1]])), len(order)) if len(order) else np.zeros(0, np.int64)
    for p, q in zip(edges[:-1], edges[1:], strict=True):
        own = order[p:q]
        total = np.bincount(doc[own], value[own])
        there = np.unique(doc[own])
        out.append((0, -1, int(chunk[own[0]]), len(there), there.astype("<u2").tobytes(), total[there].astype("<f8").tobytes(), None))
    return out


def joined(pairs: DataFrame, hot: Hot, buckets: int, alpha: float) -> DataFrame:
    """In each bucket: counts of its pairs joined to their occurrences. Sums (kind 0), and rare words to look up (kind 1)."""
    shared = pairs.sparkSession.sparkContext.broadcast(hot)

    def bucket(f: pd.DataFrame) -> pd.DataFrame:
        own = shared.value
        chunk = np.repeat(f["chunk"].to_numpy(), f["n"].to_numpy())
        if f["bucket"].iloc[0] < 0:
            made = [(2, -1, int(c), int(n), d, v, w) for c, n, d, v, w in zip(f["chunk"], f["n"], f["doc"], f["base"], f["a"], strict=True)]
            for waiting in f["a"]:
                _, a, b = np.frombuffer(waiting, "<u2").reshape(3, -1).astype(np.int64)
                pairs, often = np.unique((a << 16) | b, return_counts=True)
                made.append((3, -1, -1, len(pairs), None, often.astype("<i8").tobytes(), pairs.astype("<i8").tobytes()))
            return pd.DataFrame(made, columns=["kind", "bucket", "chunk", "n", "doc", "value", "code"])
        a = np.concatenate([unpacked(*x, own.width) for x in zip(f["a_bits"], f["a"], f["n"], strict=True)])
        b = np.concatenate([unpacked(*x, own.width) for x in zip(f["b_bits"], f["b"], f["n"], strict=True)])
        doc = np.concatenate([np.frombuffer(x, "<u2") for x in f["doc"]]).astype(np.int64)
        key = pair_key(a, b)
        order = np.lexsort((doc, chunk, key))
        k, c, d = key[order], chunk[order], doc[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        mine = new | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        total = np.diff(np.append(np.flatnonzero(new), len(k)))
        run = np.diff(np.append(np.flatnonzero(mine), len(k)))
        rest = np.empty(len(k))
        rest[order] = np.repeat(total, total) - np.repeat(run, run)
        opens = a == 65_535
        rest[opens] = 0
        _, at, often = np.unique(a, return_inverse=True, return_counts=True)
        ctx = np.where(a < RARE, own.ctx[np.minimum(a, max(0, len(own.ctx) - 1)).astype(np.int64)] if len(own.ctx) else 1.0, often[at])
        hit = rest > 0
        hot_b = ~hit & (b < RARE)
        value = np.zeros(len(a))
        value[hit] = np.log(rest[hit] / ctx[hit])
        if len(own.n):
            value[hot_b] = np.log(alpha * own.n[b[hot_b].astype(np.int64)] / own.total)
        told = hit | hot_b
        made = _sums(chunk[told], doc[told], value[told])
        miss = np.flatnonzero(~told)
        home = (mixed(b[miss]) >> np.uint64(20)) % np.uint64(buckets)
        order = miss[np.argsort(home, kind="stable")]
        home = np.sort(home, kind="stable")
        edges = np.append(np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])), len(home)) if len(home) else np.zeros(0, np.int64)
        for p, q in zip(edges[:-1], edges[1:], strict=True):
            o = order[p:q]
            made.append((1, int(home[p]), -1, int(q - p), doc[o].astype("<u2").tobytes(), chunk[o].astype("<i8").tobytes(), b[o].view(np.uint8).reshape(-1, 8)[:, : own.width].tobytes()))
        return pd.DataFrame(made, columns=["kind", "bucket", "chunk", "n", "doc", "value", "code"])

    return pairs.repartition(max(buckets, partitions(pairs.sparkSession)), "bucket").groupBy("bucket").applyInPandas(bucket, _SUMS)


def looked_up(asked: DataFrame, counts: DataFrame, hot: Hot, buckets: int, alpha: float) -> DataFrame:
    """asked: rare words that a document backs off to; counts: bucket, code, n of rare words."""
    width, total = hot.width, hot.total

    def bucket(f: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame([], columns=["kind", "bucket", "chunk", "n", "doc", "value", "code"])
        raw = np.frombuffer(b"".join(f["code"]), np.uint8).reshape(-1, width)
        code = np.zeros((len(raw), 8), np.uint8)
        code[:, :width] = raw
        code = code.view(np.uint64).ravel() & np.uint64(hot.mask)  # of eight bytes, the highest have the mark of rare words
        doc = np.concatenate([np.frombuffer(x, "<u2") for x in f["doc"]]).astype(np.int64)
        chunk = np.concatenate([np.frombuffer(x, "<i8") for x in f["value"]])
        known, n = u["code"].to_numpy().astype(np.int64).view(np.uint64), u["n"].to_numpy().astype(float)
        order = np.argsort(known)
        value = np.log(alpha * n[order][np.searchsorted(known[order], code)] / total)
        return pd.DataFrame(_sums(chunk, doc, value), columns=["kind", "bucket", "chunk", "n", "doc", "value", "code"])

    n = max(buckets, partitions(asked.sparkSession))
    return asked.repartition(n, "bucket").groupBy("bucket").cogroup(counts.repartition(n, "bucket").groupBy("bucket")).applyInPandas(bucket, _SUMS)


def waiting_counts(met: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of top words and their counts over the whole corpus, in order of pairs: at most TOP_WORDS squared."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for code, n in rows([b], "code", "value"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(code, "<i8")), pa.array(np.frombuffer(n, "<i8"))], names=["k", "n"])

    counts = met.where("kind = 3").select("code", "value").mapInArrow(told, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = sorted(tuple(r) for r in counts.collect())
    return np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], float)


def summed(parts: DataFrame, hot: Hot, waiting: tuple[np.ndarray, np.ndarray], alpha: float) -> DataFrame:
    """doc_id, n_words, log_score from a chunk's sums, its documents and the pairs that waited there."""
    shared = parts.sparkSession.sparkContext.broadcast((hot, waiting))

    def chunk(f: pd.DataFrame) -> pd.DataFrame:
        own, (known, counts) = shared.value
        head = f[f["kind"] == 2].iloc[0]
        ids = np.frombuffer(head["doc"], np.int64).reshape(-1, 3)
        score = np.frombuffer(head["value"], "<f8").copy()
        for doc, value in zip(f.loc[f["kind"] == 0, "doc"], f.loc[f["kind"] == 0, "value"], strict=True):
            np.add.at(score, np.frombuffer(doc, "<u2"), np.frombuffer(value, "<f8"))
        doc, a, b = np.frombuffer(head["code"], "<u2").reshape(3, -1).astype(np.int64)
        if len(doc):
            pair = (a << 16) | b
            order = np.lexsort((pair, doc))
            p, d = pair[order], doc[order]
            edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]))
            run = np.diff(np.append(edge, len(p)))
            rest = counts[np.searchsorted(known, p[edge])] - run
            back = alpha * own.n[p[edge] & 0xFFFF] / own.total
            np.add.at(score, d[edge], run * np.log(np.where(rest > 0, rest / own.ctx[p[edge] >> 16], back)))
        return pd.DataFrame({"doc_id": pd.Series(ids[:, 0]).astype("Int64").mask(ids[:, 1] == 1), "n_words": ids[:, 2], "log_score": score})

    return parts.groupBy("chunk").applyInPandas(chunk, "doc_id long, n_words long, log_score double")


def score_documents(docs: DataFrame, alpha: float = 0.4, bucket_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score."""
    counts = materialise(word_counts(docs), "words")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # at most HOT_WORDS words reach this count, whatever the corpus
    frequent = counts.where(F.col("n") * HOT_WORDS >= total).orderBy(F.desc("n"), "w").collect() if total else []
    hot = Hot([tuple(r) for r in frequent], total, vocabulary, bucket_words)
    buckets = max(8, -(-total // bucket_words))
    met = materialise(joined(sent(docs, hot, buckets, alpha), hot, buckets, alpha), "sums")
    mask = F.lit(hot.mask)
    spark = docs.sparkSession
    ranked = spark.createDataFrame([(int(w),) for w in hot.rank], "w long")
    rare = counts.join(F.broadcast(ranked), "w", "left_anti")
    rare = rare.groupBy(F.col("w").bitwiseAND(mask).alias("code")).agg(F.sum("n").alias("n"))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            home = (mixed(code | RARE) >> np.uint64(20)) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int64)), b.column(0), b.column(1)], names=["bucket", "code", "n"])

    found = looked_up(met.where("kind = 1"), rare.mapInArrow(homes, "bucket long, code long, n long"), hot, buckets, alpha)
    scored = summed(met.where("kind in (0, 2)").unionByName(found), hot, waiting_counts(met), alpha)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS b, unnest(list_prepend(NULL, ws)[1:len(ws)]) AS a FROM w WHERE len(ws) > 0),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT b AS w, count(*) AS c FROM t GROUP BY 1),
x AS (SELECT a, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY 1),
p AS (SELECT a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY 1, 2),
own AS (SELECT doc_id, a, b, count(*) AS m FROM t GROUP BY 1, 2, 3),
s AS (SELECT own.doc_id, own.m * CASE WHEN own.a IS NULL THEN ln(u.c::DOUBLE / n.n) WHEN p.c > own.m THEN ln((p.c - own.m)::DOUBLE / x.c) ELSE ln(0.4::DOUBLE * u.c / n.n) END AS v, own.m
      FROM own JOIN u ON own.b = u.w LEFT JOIN p ON own.a = p.a AND own.b = p.b LEFT JOIN x ON own.a = x.a CROSS JOIN n)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, round(coalesce(sum(s.v), 0.0), 4) AS log_score, round(sum(s.v) / nullif(len(w.ws), 0), 6) AS mean_log_score
FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id, len(w.ws)
"""
