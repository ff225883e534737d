"""Mixing sources to target weights by weighted sampling without replacement.

Each document gets an exponential key, -ln(u) / weight, from a hash of its id (of its text where the id is null): within
a source the documents in key order are a weighted random order. A source's target in words is met by complete epochs
over all its documents first; the rest is taken in key order by a running sum of sizes, and the document at the edge is
cut to fit. DataFrame and SQL functions only.

Cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; a source of
size 0 has target 0; a null weight counts as 1; equal keys are ordered by doc_id, then size; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import materialise


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number above 0 and below 1 by the id; where that is null, by the text."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """source, source_size, n_docs, target: all sizes shared by weights 1, 2, .., cycle over the sources in order.

    A target stops at `most` times its source; what is over is shared again by weight. Sources are ranked by the level
    at which they stop: one stops if the share of those not below it still exceeds its own stop.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    s = s.withColumn("w", F.pmod(F.row_number().over(by_name) - 1, F.lit(cycle)) + 1)
    by_stop = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    below = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(below), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stops", F.col("left") * F.col("w") > most * F.col("source_size") * F.col("w_left"))
    )
    open_ = F.struct(F.col("left"), F.col("w_left"))
    level = F.max_by(F.when(~F.col("stops"), open_), F.when(~F.col("stops"), F.col("w_left"))).over(Window.partitionBy())
    s = s.withColumn("level", level)
    shared = (F.col("w") * F.col("level.left")).cast("double") / F.col("level.w_left")
    return s.select("source", "source_size", "n_docs", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(F.coalesce(shared, F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 7, cycle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted.

    weights: doc_id, weight, at most one row an id. Texts become sizes before anything is shuffled. A source's documents
    are binned by key into about the square root of their number of bins, so that running sums over bins and inside
    bins both stay small, whatever share of the rows one source has.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    if weights is not None:
        slim = slim.join(weights.select(F.col("doc_id").alias("__doc"), "weight"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    else:
        slim = slim.withColumn("weight", F.lit(1.0))
    sized = materialise(slim.select("doc_id", "source", "size", (-F.log("u") / F.coalesce("weight", F.lit(1.0))).alias("key")), "sizes")
    targets = source_targets(sized, cycle, most).withColumnRenamed("source", "__source")
    bins = F.ceil(F.sqrt("n_docs"))
    d = sized.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    d = d.withColumn("bin", F.least(bins - 1, F.floor((1 - F.exp(-F.col("key"))) * bins)))
    before_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = d.groupBy("source", "bin").agg(F.sum("size").alias("s")).select(F.col("source").alias("__source"), F.col("bin").alias("__bin"), F.coalesce(F.sum("s").over(before_bin), F.lit(0)).alias("base"))
    own = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    d = d.join(bases, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bin") == F.col("__bin")))
    budget = F.floor(F.col("target") + 0.5)
    rest = F.expr("pmod(budget, greatest(source_size, 1))") - (F.col("base") + F.col("own"))
    return (
        d.withColumn("budget", budget)
        .withColumn("epochs", F.expr("budget div greatest(source_size, 1)"))
        .select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))).alias("taken"))
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for documents labelled good, 1/2 for those labelled bad; the largest label counts if there are several."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return known.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


ORACLE = """
WITH sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE q.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS w,
         (CAST('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null ' || md5(coalesce(d.text, '')))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id)),
keyed AS (SELECT *, -ln(u) / w AS k FROM sized),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS sw FROM s0),
s2 AS (SELECT *, (SELECT sum(source_size) FROM s0) - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(sw) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
       FROM s1 WINDOW o AS (ORDER BY source_size::DOUBLE / sw, source ASC NULLS LAST)),
s3 AS (SELECT *, lft * sw > 3 * source_size * w_left AS stops FROM s2),
lev AS (SELECT arg_max(lft, w_left) AS l, max(w_left) AS wl FROM s3 WHERE NOT stops),
t AS (SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (sw * l)::DOUBLE / wl::DOUBLE END AS target FROM s3 CROSS JOIN lev),
o AS (SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM keyed k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((budget // greatest(source_size, 1)) * size + greatest(0, least(budget % greatest(source_size, 1) - bef, size)))::BIGINT AS taken
FROM o
"""
