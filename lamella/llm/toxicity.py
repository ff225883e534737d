"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and voting.

The examples are a bounded sample of labelled rows in hash order. Features are all words of the examples, and as extra
ones the starts and repeats of words that mark toxic rows of a larger, also bounded, training sample. A feature weighs
(1 + log count) * idf, with inverse document frequencies over all documents: labels choose features and weigh none.

The examples' unit vectors are indexed by feature in blocks of examples, with each block's largest weight; words that
many examples have are held as dense columns. A query's bound in every block comes from these; its best block comes
first, then the others in the order of their bounds, and the postings of a block are only read for queries whose k-th
neighbour its bound can reach, so the k nearest are exact. Neighbours vote by cosine, and votes are calibrated by the
examples' own leave-one-out votes.

Labels are read from rows whose crc32(doc_id as text) mod 3 is not 1 only; language, source, id and labels are no input
of a score.

Cases: a null or empty text, like any text without a word of an example, gets the rate of toxic ones among the
examples without words, 0 if there are none; without labels every score is 0; labels of null doc_ids are ignored and the largest counts if there are several; repeated rows are
scored each; ties between neighbours go to the lower place in the index; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import gathered, materialise, rows

_WORDS = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
#: A marking word or start is a feature of its own where it occurs at least so often.
TIMES = (1, 2, 3)
#: Examples a block: on texts that share most of their words few blocks can be ruled out, and small ones cost more than they spare.
BLOCK = 512
#: A feature that one in so many examples has is a dense column of the index.
FREQUENT = 25


#: Every ASCII character but letters as a blank.
_LETTERS = {i: " " for i in range(128) if not chr(i).isalpha()}


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    low = text.lower()
    return low.translate(_LETTERS).split() if low.isascii() else _WORDS.findall(low)


def features_of(word: str) -> list[str]:
    """The word itself, and its starts, marked by a star."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) >= n)]


def text_features(text: str) -> set[str]:
    words = Counter(words_of(text))
    seen: Counter[str] = Counter()
    for w, n in words.items():
        for f in features_of(w):
            seen[f] += n
    return {f"{f}#{t}" for f, n in seen.items() for t in TIMES if n >= t}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, examples: int, seed: int) -> DataFrame:
    """doc_id, text, toxic of at most `examples` labelled ids that may be learned from, in hash order.

    The ids (16 bytes each, a bounded number) are broadcast, so that only these texts are moved; an id in several rows
    gives one row, with the least of its texts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(examples)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def feature_counts(train: DataFrame) -> DataFrame:
    """feature, n, toxic: in how many of the training rows, and of its toxic ones, each feature is."""
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("toxic", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tally: dict[str, list[int]] = {}
        for text, toxic in rows(batches, "text", "toxic"):
            for f in text_features(text or ""):
                own = tally.setdefault(f, [0, 0])
                own[0] += 1
                own[1] += int(bool(toxic))
            if len(tally) > 500_000:
                yield from ((k, *v) for k, v in tally.items())
                tally = {}
        yield from ((k, *v) for k, v in tally.items())

    counts = train.select("text", "toxic").mapInArrow(lambda b: gathered(made(b), schema, lambda r: 40), "feature string, n long, toxic long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def choose_features(counts: DataFrame, words: DataFrame, rows_: int, bad: int, most: int, least: int = 4, lift: float = 3.0) -> list[str]:
    """Features: all of `words`, and the `most` others that mark toxic rows best (log-likelihood ratio)."""
    if not bad or bad == rows_:
        return []
    p = bad / rows_
    part = lambda k, n, q: F.when(k > 0, k * F.log(k / (n * F.lit(q)))).otherwise(0.0)
    score = part(F.col("toxic"), F.col("n"), p) + part(F.col("n") - F.col("toxic"), F.col("n"), 1 - p)
    marked = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= lift * p * F.col("n")) & (F.col("toxic") * 2 >= F.col("n")))
    marked = marked.withColumn("score", score).orderBy(F.desc("score"), "feature").limit(most).select("feature")
    found = counts.join(words, "feature").select("feature").unionByName(marked).distinct().collect()  # of bounded size: the examples' words
    return sorted(r["feature"] for r in found)


def example_words(examples: DataFrame) -> DataFrame:
    """feature: each word of the examples."""
    schema = pa.schema([("feature", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (text,) in rows(batches, "text"):
            yield from ((f"{w}#1",) for w in set(words_of(text or "")))

    return examples.select("text").mapInArrow(lambda b: gathered(made(b), schema, lambda r: 20), "feature string").distinct()


class Reader:
    """Texts as feature numbers and counts; a word is looked up once a worker."""

    def __init__(self, features: Sequence[str]) -> None:
        names: dict[str, list[tuple[int, int]]] = {}
        for i, f in enumerate(features):
            name, _, times = f.rpartition("#")
            names.setdefault(name, []).append((int(times), i))
        #: Features that need a count of their name, which several words can share; the others are the word alone.
        self.counted = {f: v for f, v in names.items() if f.endswith("*") or len(v) > 1 or v[0][0] > 1}
        self.plain = {f: v[0][1] for f, v in names.items() if f not in self.counted}
        self.heads = {f[: STARTS[0]] for f in self.counted}
        self.marked = {w for w in self.plain if w[: STARTS[0]] in self.heads}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the features of a text, and how often each is there."""
        words = Counter(words_of(text))
        plain, heads, head = self.plain, self.heads, STARTS[0]
        found = [(i, n) for w, n in words.items() if (i := plain.get(w)) is not None]
        ids, often = [i for i, _ in found], [n for _, n in found]
        seen: dict[str, int] = {}
        for w in itertools.chain(self.marked.intersection(words), [w for w in words if w[:head] in heads and w not in plain] if len(found) < len(words) else ()):
            for f in features_of(w):
                if f in self.counted:
                    seen[f] = seen.get(f, 0) + words[w]
        for f, n in seen.items():
            for times, i in self.counted[f]:
                if n >= times:
                    ids.append(i)
                    often.append(n)
        ids, often = np.array(ids, np.int64), np.array(often, np.int64)
        order = np.argsort(ids)
        return ids[order], often[order]


def read_features(docs: DataFrame, features: Sequence[str]) -> DataFrame:
    """doc_id, ids, counts: the features of every text and how often each is there, as little-endian 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = Reader(features)
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids, counts = reader.counts(text or "")
            yield doc_id, ids.astype("<i4").tobytes(), counts.astype("<i4").tobytes()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(lambda b: gathered(made(b), schema, lambda r: 2 * len(r[1])), "doc_id long, ids binary, counts binary")


def document_frequencies(read: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """In how many of the texts read each feature is, and their number: a task sends a row a feature that it saw at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(features + 1, np.int64)
        for batch in batches:
            for (ids,) in rows([batch], "ids"):
                tally[np.frombuffer(ids, "<i4")] += 1
            tally[-1] += batch.num_rows
        there = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(tally[there])], names=["f", "n"])

    found = read.select("ids").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(features + 1)
    for f, n in found:
        df[f] = n
    return df[:-1], int(df[-1])


class Index:
    """Unit vectors of the examples by feature, in blocks of BLOCK examples, with each block's largest weight."""

    def __init__(self, features: Sequence[str], df: np.ndarray, n: int) -> None:
        self.features = features
        self.idf = np.log((1 + n) / (1 + df)) + 1 if len(features) else np.zeros(0)
        self.k, self.smooth, self.toxic, self.rate, self.base, self.curve = 1, 0.0, np.zeros(0), 0.0, 0.0, (np.zeros(1), np.zeros(1))

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[ids]
        return w / np.linalg.norm(w) if len(w) else w

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]], k: int, smooth: float) -> None:
        self.k, self.smooth = k, smooth
        self.rate = float(np.mean([y for *_, y in examples])) if examples else 0.0
        bare = [y for i, _, y in examples if not len(i)]
        self.base = float(np.mean(bare)) if bare else 0.0
        vectors = [(i, self.vector(i, c), y) for i, c, y in examples if len(i)]
        vectors.sort(key=lambda v: (int(v[0][np.argmax(v[1])]), v[2]))  # alike examples share blocks
        self.toxic = np.array([y for *_, y in vectors], float)
        n, size = len(vectors), len(self.features)
        ids = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, np.int64)
        place = np.repeat(np.arange(n), [len(v[0]) for v in vectors]) if n else ids
        weight = np.concatenate([v[1] for v in vectors]).astype(np.float32) if n else np.zeros(0, np.float32)
        often = np.bincount(ids, minlength=size) * FREQUENT >= max(n, 2 * FREQUENT)
        self.column = np.full(size, -1)
        self.column[often] = np.arange(often.sum())
        self.dense = np.zeros((int(often.sum()), n), np.float32)
        dense = often[ids]
        self.dense[self.column[ids[dense]], place[dense]] = weight[dense]
        order = np.flatnonzero(~dense)
        order = order[np.lexsort((place[order], ids[order]))]  # postings: by feature, then example
        self.place, self.weight = place[order].astype(np.int32), weight[order]
        self.starts = np.searchsorted(ids[order], np.arange(size + 1)).astype(np.int32)
        self.blocks = -(-n // BLOCK)
        block = place // BLOCK
        order = np.lexsort((block, ids))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(block[order]) != 0)])) if len(order) else np.zeros(0, np.int64)
        self.bound_block = block[order[edge]].astype(np.int32)
        self.bound = np.maximum.reduceat(weight[order], edge) if len(edge) else np.zeros(0, np.float32)
        self.bound_starts = np.searchsorted(ids[order[edge]], np.arange(size + 1)).astype(np.int32)
        # the postings of a feature inside a block lie together: where they begin and end
        own = ids[order[edge]].astype(np.int64) * max(1, self.blocks) + self.bound_block
        held = np.repeat(np.arange(size, dtype=np.int64), np.diff(self.starts)) * max(1, self.blocks) + self.place // BLOCK
        self.run_from, self.run_to = np.searchsorted(held, own), np.searchsorted(held, own, "right")
        self.touched = 0
        votes = np.concatenate([self.votes(*self.nearest([v[:2] for v in vectors[at : at + 256]], list(range(at, min(at + 256, n))))) for at in range(0, n, 256)]) if n else np.zeros(0)
        self.curve = self.calibration(votes, self.toxic)

    @staticmethod
    def _spread(starts: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every posting that a query's features have: its place in the lists, the query's number and its weight."""
        ids = np.concatenate([q[0] for q in queries])
        weights = np.concatenate([q[1] for q in queries])
        number = np.repeat(np.arange(len(queries)), [len(q[0]) for q in queries])
        length = (starts[ids + 1] - starts[ids]).astype(np.int64)
        at = np.repeat(starts[ids] - np.cumsum(length) + length, length) + np.arange(length.sum())
        return at, np.repeat(number, length), np.repeat(weights, length)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and cosines of the k nearest examples of each query that share a feature with it: one row a query.

        queries: feature numbers and weights of a unit vector; skip: a place that does not count, for each.
        """
        q, n, nb = len(queries), len(self.toxic), self.blocks
        best_at, best = np.full((q, self.k), -1), np.zeros((q, self.k))
        if not n or not q:
            return best_at, best
        at, number, w = self._spread(self.bound_starts, queries)
        bounds = np.bincount(number * nb + self.bound_block[at], w * self.bound[at], q * nb).reshape(q, nb) * (1 + 1e-5)
        order = np.argsort(self.bound_block[at], kind="stable")
        at, number, w = at[order], number[order], w[order]
        edges = np.searchsorted(self.bound_block[at], np.arange(nb + 1))
        query = np.zeros((q, len(self.dense)), np.float32)
        for i, (ids, weights) in enumerate(queries):
            own = self.column[ids]
            query[i, own[own >= 0]] = weights[own >= 0]
        first = bounds.argmax(axis=1)  # each query's own best block comes before all others, so that the k-th cosine is high early
        falling = np.argsort(-bounds.max(axis=0), kind="stable")
        for own, b in [(True, b) for b in falling] + [(False, b) for b in falling]:
            asks = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= best[:, -1]) & ((first == b) == own))
            if not len(asks):
                continue
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, n)
            asked = query if len(asks) == q else query[asks]
            found = np.round(self._postings(asks, q, at[edges[b] : edges[b + 1]], number[edges[b] : edges[b + 1]], w[edges[b] : edges[b + 1]], lo, hi) + asked @ self.dense[:, lo:hi], 6)
            if skip is not None:
                found[np.array(skip)[asks, None] == np.arange(lo, hi)] = 0
            better = np.flatnonzero((found > 0).any(axis=1) & (found.max(axis=1) >= best[asks, -1]))
            asks, found = asks[better], found[better]
            both = np.concatenate([best[asks], found], axis=1)
            where = np.concatenate([best_at[asks], np.where(found > 0, np.arange(lo, hi), -1)], axis=1)
            order = np.lexsort((where, -both), axis=1)[:, : self.k]
            best[asks], best_at[asks] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
        return best_at, best

    def _postings(self, asks: np.ndarray, q: int, entries: np.ndarray, number: np.ndarray, w: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """What the postings of one block add to the cosines of the queries that still ask for it; the others' are not touched."""
        row = np.full(q, -1)
        row[asks] = np.arange(len(asks))
        mine = np.flatnonzero(row[number] >= 0)
        begin, length = self.run_from[entries[mine]], self.run_to[entries[mine]] - self.run_from[entries[mine]]
        at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        self.touched += len(at)
        cell = np.repeat(row[number[mine]], length) * (hi - lo) + self.place[at] - lo
        return np.bincount(cell, np.repeat(w[mine], length) * self.weight[at], len(asks) * (hi - lo)).reshape(len(asks), hi - lo)

    def votes(self, at: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        toxic = np.where(at >= 0, self.toxic[at] if len(self.toxic) else 0.0, 0.0)
        return ((cosine * toxic).sum(axis=1) + self.smooth * self.rate) / (cosine.sum(axis=1) + self.smooth)

    @staticmethod
    def calibration(votes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rate of toxic examples as a growing step curve of the vote (pool adjacent violators)."""
        if not len(votes):
            return np.zeros(1), np.zeros(1)
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, t in zip(votes[order], y[order], strict=True):
            pools.append([t, 1.0, v, v])
            while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
                t1, n1, _, hi = pools.pop()
                pools[-1] = [pools[-1][0] + t1, pools[-1][1] + n1, pools[-1][2], hi]
        x = [v for p in pools for v in (p[2], p[3])]
        rate = [r for p in pools for r in [(p[0] + 0.5) / (p[1] + 1)] * 2]
        return np.array(x), np.array(rate)

    def scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of texts, given as feature numbers and counts, with their neighbours' places and cosines."""
        at, cosine = self.nearest([(i, self.vector(i, c)) for i, c in queries])
        if not len(self.toxic):
            return np.full(len(queries), self.base), at, cosine
        found = np.interp(self.votes(at, cosine), *self.curve)
        return np.clip(np.where(at[:, 0] >= 0, found, self.base), 0.0, 1.0), at, cosine


def fitted(docs: DataFrame, labels: DataFrame, training: int = 20_000, examples: int = 4096, features: int = 2000, k: int = 15, smooth: float = 0.5, seed: int = 3) -> tuple[Index, DataFrame]:
    """The index of at most `examples` labelled rows, with marking features of at most `training`, and the features of all texts,
    which are read once: document frequencies and scores both come from them."""
    train = materialise(training_rows(docs, labels, training, seed), "toxic-training")
    rows_, bad = train.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    taken = train.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").select("doc_id").limit(examples)
    own = materialise(train.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic"), "toxic-examples")
    names = choose_features(materialise(feature_counts(train), "toxic-counts"), example_words(own), rows_, bad, features)
    read = materialise(read_features(docs, names), "toxic-features")
    index = Index(names, *document_frequencies(read, len(names)))
    found = read_features(own, names).join(F.broadcast(own.select("doc_id", "toxic")), "doc_id").select("ids", "counts", "toxic").collect()  # of bounded size: the examples
    unpacked = [(np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<i4").astype(np.int64), int(bool(r["toxic"]))) for r in found]
    index.fit(sorted(unpacked, key=lambda e: (e[0].tobytes(), e[1].tobytes(), e[2])), k, smooth)
    return index, read


def learn(docs: DataFrame, labels: DataFrame, **options: object) -> Index:
    return fitted(docs, labels, **options)[0]


def score_features(read: DataFrame, index: Index, strict: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the features that weigh most, neighbours with their cosines, toxic ones)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.string())])
    shared = read.sparkSession.sparkContext.broadcast(index)  # of bounded size: the examples' words

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = shared.value
        for some in itertools.batched(rows(batches, "doc_id", "ids", "counts"), 128):
            queries = [(np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<i4")) for _, ids, counts in some]
            scores, at, cosine = own.scores(queries)
            for (doc_id, *_), (ids, counts), score, near, c in zip(some, queries, scores.tolist(), at, cosine, strict=True):
                n = int((near >= 0).sum())
                top = ids[np.argsort(-(1 + np.log(counts)) * own.idf[ids], kind="stable")[:3]]
                seen = ",".join(own.features[f] for f in top)
                yield doc_id, score, f"{seen};neighbours={n};nearest={c[0]:.3f};toxic={int(own.toxic[near[:n]].sum())}" if n else ""

    scored = read.mapInArrow(lambda b: gathered(made(b), schema, lambda r: 100), "doc_id long, score double, evidence string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= strict).cast("int").alias("predicted"), "evidence")


def score_texts(docs: DataFrame, index: Index, strict: float = 0.7) -> DataFrame:
    """The scores of any texts under an index."""
    return score_features(read_features(docs, index.features), index, strict)


def toxicity(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    index, read = fitted(docs, labels, **options)
    return score_features(read, index)
