"""Token files: Parquet list columns in document order, and selective reads of them.

Documents are tokenized where they are read; their packed ids (two bytes each where the vocabulary allows it) are
range-partitioned by doc_id, and each part is one shard file, in ascending order. Row groups, pages and encodings are set
through the writer: ids are dictionary-encoded where they fit and page indexes are written, so a reader of few documents,
or of lengths alone, skips the rest.

Cases: a null text is an empty one, so its document is the end id alone; null doc_ids come first; rows with equal
doc_id are ordered by a hash of their text; an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import gathered, materialise, partitions, rows
from lamella.llm.tokens import WORD_BPE, word_encoder

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
#: Writer settings: 16 MB row groups, 256 kB pages of at most 2,000 rows, dictionary pages up to 1 MB, else delta encoding.
FORMAT = {
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 256 << 10,
    "parquet.page.row.count.limit": 2_000,
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.columnindex.truncate.length": 64,
    "compression": "zstd",
}


def packed_tokens(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """doc_id, tie, wide (ids have four bytes, not two) and packed: the ids of a text and the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("wide", pa.bool_()), ("packed", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = word_encoder(tokenizer)
        wide, end = encoder.size > 1 << 16, np.array([end_id], "<u4").tobytes()
        for doc_id, tie, text in rows(batches, "doc_id", "tie", "text"):
            ids = encoder.encode(text or "") + end
            yield doc_id, tie, wide, ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return slim.mapInArrow(lambda b: gathered(made(b), schema, lambda r: len(r[3])), "doc_id long, tie long, wide boolean, packed binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 2, most: int = 1 << 20) -> None:
    """Writes every document's ids and the end id to `path` in ascending doc_id order, `most` ids at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            packed = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(packed.buffers()[1], "<i8")[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int64)
            each = 4 if len(packed) and batch.column(1)[0].as_py() else 2
            ends = ends // each
            ids = np.frombuffer(packed.buffers()[2] or b"", f"<u{each}")[: ends[-1]]
            at = 0
            while at < len(packed):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
                own = ends[at : to + 1]
                lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype("<i4")), pa.array(ids[own[0] : own[-1]].astype("<i4")))
                columns = [batch.column(0).slice(at, to - at), pa.array(np.full(to - at, shard, "<i4")), pa.array(start + own[:-1] - own[0]), pa.array(np.diff(own)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                start += int(own[-1] - own[0])
                at = to

    tokens = materialise(packed_tokens(docs, tokenizer, end_id), "packed-tokens")
    ordered = tokens.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    writer = ordered.select("doc_id", "wide", "packed").mapInArrow(run, SCHEMA).write
    for k, v in FORMAT.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents and their ids, all or those with doc_id in [first, last]: only the pages of these are read."""
    found = spark.read.schema(SCHEMA).parquet(path)
    return found.where((F.lit(first is None) | (F.col("doc_id") >= F.lit(first))) & (F.lit(last is None) | (F.col("doc_id") <= F.lit(last))))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in all files) and n_tokens, without reading any ids."""
    return with_start(read_tokens(spark, path).drop("ids"), read_tokens(spark, path))


def with_start(df: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `start`: the shards before it (one row each, broadcast) and the place in its own shard."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("__total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    return df.join(F.broadcast(bases), "shard").withColumn("start", F.col("__base") + F.col("shard_start")).drop("__base", "shard_start")


def checksums(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            ends = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).view("<u4")).cast("B")
            crc = [zlib.crc32(values[4 * p : 4 * q]) for p, q in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    summed = files.mapInArrow(run, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return with_start(summed, files).select("doc_id", "start", "n_tokens", "ids_crc32")
