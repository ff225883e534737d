"""Packing along a space-filling curve.

A document's token ids are hashed into a signed vector, projected to a few dimensions by a fixed random matrix, and
placed on a Hilbert curve. Documents are ordered along the curve by a distributed range sort with prefix sums, and cut
into sequences of a fixed length, so neighbours in a sequence are alike and only the very last sequence has padding.

Cases: a null text is an empty one, so its document is the end id alone; a null doc_id is kept and sorts first; equal
rows and equal keys are told apart by a number given when the tokens are written; an empty table gives no pieces; other
columns are ignored. A text of any length is tokenized whole and cut over as many sequences as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import gathered, materialise, rows, running_start
from lamella.llm.tokens import BYTE_BPE, byte_encoder

WIDTH = 256
DIMENSIONS = 3
BITS = 10


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer coordinates (n x d, each below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curve:
    """Hashed token vectors and their fixed projection."""

    def __init__(self, vocabulary: int, seed: int = 20_011) -> None:
        dealt = np.random.default_rng(seed)
        self.slot = dealt.integers(0, WIDTH, vocabulary + 1)
        self.sign = dealt.choice([-1, 1], vocabulary + 1) > 0
        self.matrix = dealt.normal(size=(WIDTH, DIMENSIONS))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        slot = self.slot[ids]
        return 2.0 * np.bincount(slot[self.sign[ids]], minlength=WIDTH) - np.bincount(slot, minlength=WIDTH)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        placed = (vectors @ self.matrix) / np.maximum(norm, 1e-12)
        share = 1 / (1 + np.exp(-1.7 * placed))  # about uniform for a normal projection
        return hilbert_key(np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = 0) -> DataFrame:
    """doc_id, curve key, number of ids with the end id, and the ids (16 bits each where the vocabulary allows it)."""
    schema = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("doc_tokens", pa.int64()), ("wide", pa.bool_()), ("packed", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = byte_encoder(tokenizer)
        curve = Curve(encoder.size)
        kind = "<u2" if encoder.size <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        for some in batched(rows(batches, "doc_id", "text"), 256):
            ids = [np.frombuffer(encoder.encode(text or "") + end, "<u4") for _, text in some]
            keys = curve.keys(np.array([curve.vector(x[:-1]) for x in ids]))
            for (doc_id, _), key, own in zip(some, keys.tolist(), ids, strict=True):
                yield doc_id, key, len(own), kind == "<u4", own.astype(kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(made(batches), schema, lambda r: len(r[4]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, curve long, doc_tokens long, wide boolean, packed binary")


def pack_along_curve(docs: DataFrame, length: int = 1024, tokenizer: str = BYTE_BPE, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of `length` ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    `ids` has little-endian unsigned 32-bit ids. A piece's place is its document's place along the curve, so no
    sequence is ever put together in one task, and only the last sequence is short.
    """
    written = materialise(tokenized(docs, tokenizer, end_id).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    placed = running_start(written.select("uid", "curve", "doc_id", "doc_tokens"), ["curve", "doc_id", "uid"], "doc_tokens", "place")
    size = F.lit(length)
    pieces = (
        written.drop("curve", "doc_id", "doc_tokens")
        .join(placed.select("uid", "doc_id", "doc_tokens", "place"), "uid")
        .withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("doc_tokens") - 1) / size))))
        .withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * size - F.col("place")))
        .withColumn("stop", F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * size - F.col("place")))
        .withColumn("each", F.when(F.col("wide"), 4).otherwise(2))
        .select(
            "doc_id", "start", (F.col("stop") - F.col("start")).alias("length"), "doc_tokens", "sequence_id",
            (F.col("place") + F.col("start") - F.col("sequence_id") * size).alias("offset"), "wide",
            F.expr("substring(packed, cast(start * each + 1 as int), cast((stop - start) * each as int))").alias("packed"),
        )
    )

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, packed = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            ids = [x if w else np.frombuffer(x, "<u2").astype("<u4").tobytes() for w, x in zip(wide, packed, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ids, pa.binary())], names=[*batch.schema.names[:6], "ids"])

    return pieces.mapInArrow(widened, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
