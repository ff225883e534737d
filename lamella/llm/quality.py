"""Quality rules and an isolation forest over their statistics.

Every text gets counts by fixed rules (symbols, repeated lines, words in repeated windows and so on). Documents that
fail the base rules go. For the rest, trees that split the statistics at random cut odd documents off after few splits;
the mean path length gives a score, and its threshold is set where it parts labelled good rows from labelled bad ones.

The forest is fitted on at most `sample` labelled rows, taken in hash order, with at most `tainted` bad ones a good one
(anomalies must stay rare). Rule counts, scores and the threshold cover all rows.

Cases: a null or empty text has no words and fails the base rules; without labelled rows no document is odd; with no
bad ones the threshold lets all labelled rows pass; labels of null doc_ids are ignored and the largest label counts if
there are several; repeated rows are scored each; an empty table gives no rows; other columns pass through, except
those that the result names itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import WORD, gathered, materialise, rows

_WORDS = re.compile(WORD)
#: The characters that count as symbols, and the letters.
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares are taken as square roots: most texts have next to none, and random cuts must be able to part little from none.
STATS = ["symbols", "word_length", "upper", "doubled", "distinct"]
WINDOW = 8


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of eight words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    if len(np.unique(mixed)) == n:  # equal windows have equal sums
        return 0
    width, level = 1, ids
    while width < WINDOW:  # names for windows of 2, 4 and 8 words: exact
        _, level = np.unique(level[:-width] * (len(level) + 1) + level[width:], return_inverse=True)
        width *= 2
    twice = np.bincount(level)[level] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the forest's statistics of one text."""
    words = _WORDS.findall(text)
    raw = text.encode()
    count = lambda of: len(raw) - len(raw.translate(None, of))
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    n, chars, symbols = len(words), sum(map(len, words)), count(SYMBOLS)
    dup, repeats = len(lines) - len(set(lines)), repeated_words(words)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = len(set(words))
    stats = [
        math.sqrt(symbols / max(chars, 1)),
        math.log1p(chars / max(n, 1)),
        math.sqrt(count(UPPER) / max(count(LETTERS), 1)),
        math.sqrt(doubled / max(n - 1, 1)),
        math.log1p(distinct) / math.log1p(max(n, 1)),
    ]
    return [n, chars, symbols, dup, repeats], stats


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and `stats`, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("stats", pa.list_(pa.float64()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc_id, text in rows(batches, "doc_id", "text"):
            counts, stats = statistics(text or "")
            yield doc_id, *counts, stats

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = slim.mapInArrow(lambda b: gathered(made(b), schema, lambda r: 150), "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", stats array<double>")
    return found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _path_left(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays; a leaf points at itself."""

    def __init__(self, x: np.ndarray, trees: int, subsample: int, seed: int) -> None:
        dealt = np.random.default_rng(seed)
        self.subsample = min(subsample, len(x))
        self.depth = max(1, math.ceil(math.log2(max(2, self.subsample))))
        self.trees = [self._grow(x[dealt.permutation(len(x))[: self.subsample]], dealt) for _ in range(trees)] if len(x) > 1 else []

    def _grow(self, x: np.ndarray, dealt: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(own: np.ndarray, depth: int) -> int:
            me = len(feature)
            for a, v in ((feature, 0), (cut, 0.0), (left, me), (right, me), (path, float(depth + _path_left(len(own))))):
                a.append(v)
            wide = np.flatnonzero(np.ptp(own, axis=0) > 0) if len(own) > 1 else []
            if depth < self.depth and len(wide):
                f = int(dealt.choice(wide))
                c = dealt.uniform(own[:, f].min(), own[:, f].max())
                feature[me], cut[me] = f, c
                below = own[:, f] < c
                left[me], right[me] = node(own[below], depth + 1), node(own[~below], depth + 1)
            return me

        node(x, 0)
        return tuple(map(np.array, (feature, cut, left, right, path)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near 1: cut off early; near 0.5 or less: like the rest. 0 without trees."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[every, feature[at]] < cut[at], left[at], right[at])
            total += path[at]
        return 2 ** (-total / len(self.trees) / max(float(_path_left(self.subsample)), 1e-9))


def fit_forest(labelled: DataFrame, sample: int, tainted: float, trees: int, subsample: int, seed: int) -> Forest:
    """labelled: doc_id, stats, quality. Fitted on the driver, on a sample of bounded size."""
    ordered = lambda q, n: labelled.where(q).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "stats").limit(n).select("stats").collect()
    good = ordered(F.col("quality") == 1, sample)
    bad = ordered(F.col("quality") == 0, int(tainted * len(good)))
    return Forest(np.array([r[0] for r in good + bad], float).reshape(-1, len(STATS)), trees, subsample, seed)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(oddness=forest.score(np.array(f["stats"].tolist(), float).reshape(-1, len(STATS))))

    return stats.mapInPandas(run, stats.withColumn("oddness", F.lit(0.0)).schema)


def threshold(labelled: DataFrame, bins: int = 2_000, cost: float = 20.0) -> float:
    """The score above which rows go: best share of bad rows caught less `cost` times the share of good rows lost.

    Where a range of scores is best alike, its middle.

    Counts over all labelled rows, by bins of the score; the driver sees the bins only.
    """
    found = labelled.groupBy(F.floor(F.col("oddness") * bins).alias("bin"), "quality").count().collect()
    tally = np.zeros((2, bins + 1))
    for b, q, n in found:
        tally[1 if q else 0, min(int(b), bins)] += n
    if not tally[1].sum() or not tally[0].sum():
        return 1.0 if not tally.sum() else (np.flatnonzero(tally.sum(axis=0)).max() + 1) / bins
    above = tally[:, ::-1].cumsum(axis=1)[:, ::-1] / tally.sum(axis=1, keepdims=True)
    gain = above[0] - cost * above[1]
    best = np.flatnonzero(gain == gain.max())
    return (best.min() + best.max()) / 2 / bins if gain.max() > 0 else 1.0


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 4096, tainted: float = 0.03, trees: int = 150, subsample: int = 256, seed: int = 11) -> tuple[DataFrame, Forest, float]:
    """The statistics of every row, the forest, and the score from which rows go."""
    stats = materialise(rule_statistics(docs), "rules")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = stats.where("not base_failed").join(known, "doc_id")
    forest = fit_forest(labelled, sample, tainted, trees, subsample, seed)
    return stats, forest, threshold(scored(labelled, forest))


def judge(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """doc_id, the base counts, base_failed, oddness, kept: a row a document."""
    stats, forest, cut = fitted(docs, labels, **options)
    kept = ~F.col("base_failed") & (F.col("oddness") < F.lit(cut))
    return scored(stats, forest).withColumn("kept", kept).drop("stats")


def keep_good(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that judge() keeps, filtered where they are read: no text is shuffled or joined."""
    _, forest, cut = fitted(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # of bounded size: trees x subsample
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = [statistics(text or "") for text in batch.column(at).to_pylist()]
                good = np.array([n >= 20 and 100 * r <= 30 * n for (n, *_, r), _ in found])
                odd = shared.value.score(np.array([s for _, s in found], float).reshape(-1, len(STATS)))
                yield batch.filter(pa.array(good & (odd < cut)))

    return docs.mapInArrow(run, docs.schema)
