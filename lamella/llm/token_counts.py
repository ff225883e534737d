"""Token counts by an exact length histogram.

Every text is encoded whole; documents are counted by encoded length; suffix sums over the histogram then answer, for
any context limit, how many documents reach it, how many tokens they hold and what is left when each is cut there.

Cases: a null text is an empty one (length 0); null doc_ids count; repeated rows count each time; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import materialise, rows
from lamella.llm.tokens import BYTE_BPE, byte_encoder


def length_counts(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """length, n_docs: tasks send their own histograms, Spark adds them up; written, so that texts are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = byte_encoder(tokenizer), {}
        for (text,) in rows(batches, "text"):
            n = len(encoder.encode(text or "")) // 4
            seen[n] = seen.get(n, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(x, np.int64)) for x in (seen.keys(), seen.values())], names=["length", "n"])

    return materialise(docs.select("text").mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length L that occurs: documents and tokens of length L or more, and totals if all are cut at L.

    share_below is the share of documents shorter than L, so the q-quantile is the largest L with share_below <= q.
    Sums run inside blocks of `block` lengths, and blocks by their totals (one row for each block).
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    bases = (
        h.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("block", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    )
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.join(bases, "block")
        .withColumn("docs_from", F.col("d_after") + F.sum("n_docs").over(own))
        .withColumn("tokens_from", F.col("t_after") + F.sum("tokens").over(own))
        .select(
            "length", "n_docs", "docs_from", "tokens_from", "all_docs", "all_tokens",
            (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("tokens_if_cut"),
            ((F.col("all_docs") - F.col("docs_from")) / F.col("all_docs")).alias("share_below"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals at any context limit, from the suffix sums: the first length at or above it holds what is cut there."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    least = sums.agg(F.max("all_docs").alias("all_docs"), F.max("all_tokens").alias("all_tokens"))
    above = (
        sums.select("length", "docs_from", "tokens_from")
        .join(F.broadcast(asked), F.col("length") >= F.col("context_limit"))
        .groupBy("context_limit")
        .agg(F.min_by(F.struct("docs_from", "tokens_from"), "length").alias("s"))
    )
    found = asked.join(above, "context_limit", "left").crossJoin(F.broadcast(least))  # one row
    reach, held = F.coalesce(F.col("s.docs_from"), F.lit(0)), F.coalesce(F.col("s.tokens_from"), F.lit(0))
    return found.select("context_limit", reach.alias("docs_from"), held.alias("tokens_from"), (F.col("all_tokens") - held + F.col("context_limit") * reach).alias("tokens_if_cut"))
