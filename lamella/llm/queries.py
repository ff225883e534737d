"""The registered queries of this subpackage: each applies its operator to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import html_cut, interaction, line_dedup, media, mixing, near_dedup, packing, quality, repair, scoring, token_counts, token_files, toxicity
from lamella.llm.common import documents, labels, shared_path, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_along_curve(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), mixing.quality_weights(labels(spark, sf_dir)))


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_features(media.read_pages(media.stored_texts(documents(spark, sf_dir))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), labels(spark, sf_dir))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "oddness")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_counts(documents(spark, sf_dir)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path)
    return token_files.checksums(token_files.read_tokens(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op3_mixing, op4_tiff, op6_quality, op7_token_counts, op8_line_dedup, op9_token_files)
}
ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op8_line_dedup": line_dedup.ORACLE}


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


QUERIES["op2_near_duplicates"] = op2_near_duplicates


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES["op10_toxicity"] = op10_toxicity


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_documents(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


QUERIES["op5_scoring"] = op5_scoring
ORACLES["op5_scoring"] = scoring.ORACLE


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.filter_interactions(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES["op11_interactions"] = op11_interactions
ORACLES["op11_interactions"] = interaction.ORACLE


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited, counts = repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))
    said = repair.digests(edited).withColumnRenamed("conv_id", "__conv")
    d = counts.join(said, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return d.select(*counts.columns, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES["op12_repair"] = op12_repair


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html_cut.label_blocks(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = blocks.select("page_id", "url", html_cut.main_text(F.col("blocks")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


QUERIES["op13_html_text"] = op13_html_text
