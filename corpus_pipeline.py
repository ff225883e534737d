"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads again for the next one.
All but the last return the columns of documents.

Cases: a null text is an empty one and, like every text of fewer than 20 words, goes in the first stage; null doc_ids are
kept through all stages, as one document where the text is the same too; of equal rows the near-duplicate stage keeps
one; a very long text passes whole; further columns pass through all but the last stage, whatever their names; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import line_dedup, mixing, near_dedup, packing, quality
from lamella.llm.common import documents, labels, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express the forest, the alignment and the curve; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the forest finds odd go."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by three documents or more stay in the last of them only; documents stay."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole epochs, and once more where at least half of a document is taken.

    Rows of one doc_id (null ids are one, too) come as often as the one of them that is taken most; documents without
    words come once."""
    taken = mixing.mix(docs, mixing.quality_weights(labels(spark, sf_dir)))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    taken = taken.select(F.col("doc_id").alias("own"), times.alias("times")).groupBy("own").agg(F.max("times").alias("times"))
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("own"))).where("times > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack_along_curve(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
