"""Queries over score tables and label tables: line items stand for scores, and for pixels with two labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import numbers
from lamella.operators import labels, stats
from lamella.plans.binding import Book, Tables

BOOK = Book()
METRICS = ["l_discount", "l_tax", "l_quantity"]


def scores(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


LONG_SQL = """long AS (SELECT l_returnflag, l_linestatus, s_nationkey, m AS metric, CASE m WHEN 'l_discount' THEN l_discount WHEN 'l_tax' THEN l_tax ELSE l_quantity END AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey CROSS JOIN (VALUES ('l_discount'), ('l_tax'), ('l_quantity')) AS v(m))"""
KEYS = ["l_returnflag", "l_linestatus", "s_nationkey"]


@BOOK.add(f"WITH {LONG_SQL} SELECT l_returnflag, l_linestatus, s_nationkey, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd, round(median(value), 9) AS median, count(value) AS n FROM long GROUP BY ALL")
def score_stats(t: Tables) -> DataFrame:
    return rounded(stats.group_stats(stats.long_form(scores(t), KEYS, METRICS), KEYS), "mean", "sd", "median")


@BOOK.add(f"""WITH {LONG_SQL}, cells AS (SELECT l_returnflag, l_linestatus, metric, s_nationkey, avg(value) m, sum(value) s, count(value) c FROM long GROUP BY ALL)
SELECT l_returnflag, l_linestatus, metric, round(avg(m), 9) AS macro, round(sum(s) / sum(c), 9) AS micro, round(min(m), 9) AS worst, round(max(m), 9) AS best, count(m) AS n_cells, sum(c)::BIGINT AS n
FROM cells GROUP BY ALL""")
def macro_scores(t: Tables) -> DataFrame:
    return rounded(stats.macro_micro(stats.long_form(scores(t), KEYS, METRICS), ["l_returnflag", "l_linestatus"], "s_nationkey"), "macro", "micro", "worst", "best")


@BOOK.add(f"""WITH {LONG_SQL}, m AS (SELECT l_returnflag, l_linestatus, avg(value) AS v FROM long WHERE metric = 'l_quantity' GROUP BY ALL)
SELECT l_returnflag, round(max(v) FILTER (WHERE l_linestatus = 'F'), 9) AS "F", round(max(v) FILTER (WHERE l_linestatus = 'O'), 9) AS "O", round(avg(v), 9) AS mean FROM m GROUP BY 1""")
def score_matrix(t: Tables) -> DataFrame:
    long = stats.long_form(scores(t), KEYS, METRICS).where("metric = 'l_quantity'")
    return rounded(stats.score_matrix(long, "l_returnflag", "l_linestatus", ["F", "O"]), "F", "O", "mean")


@BOOK.add(f"""WITH {LONG_SQL} SELECT l_returnflag, metric, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(median(value), 9) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 9) AS iqr,
  min(value) AS low, max(value) AS high, count(*) - count(value) AS missing FROM long GROUP BY ALL""")
def summary_distribution(t: Tables) -> DataFrame:
    return rounded(stats.distribution(stats.long_form(scores(t), KEYS, METRICS), ["l_returnflag"]), "mean", "sd", "median", "iqr")


@BOOK.add("""WITH u AS (SELECT c_mktsegment, o_custkey, avg(o_totalprice) AS v, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n, round(sum(v * w) / sum(w), 6) AS weighted_mean FROM u GROUP BY 1""")
def rollup_units(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(stats.rollup_units(d, "c_mktsegment", "o_custkey", F.col("o_totalprice")), "mean", "sd", "sem", "weighted_mean", places=6)


@BOOK.add("""WITH m AS (SELECT l_suppkey AS source, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1), d AS (SELECT source, b - a AS delta, count(*) OVER () AS n, sum(b - a) OVER () AS s FROM m WHERE a IS NOT NULL AND b IS NOT NULL),
l AS (SELECT *, (s - delta) / (n - 1) AS left_out FROM d), c AS (SELECT *, avg(left_out) OVER () AS mean_left FROM l) SELECT source, round(delta, 9) AS delta, round(left_out, 9) AS left_out, round(mean_left, 9) AS mean_left, round(sqrt((n - 1)::DOUBLE / n * sum((left_out - mean_left) ** 2) OVER ()), 9) AS sd FROM c""")
def jackknife(t: Tables) -> DataFrame:
    d = stats.jackknife(t.lineitem.withColumnRenamed("l_suppkey", "source"), "source", "l_returnflag", F.col("l_quantity"), ("A", "R"))
    return rounded(d, "delta", "left_out", "mean_left", "sd")


@BOOK.add("""WITH n AS (SELECT c_mktsegment AS cell, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
s AS (SELECT cell, n, i AS slot, unnest(range(0, 20)) AS replicate FROM n), d AS (SELECT replicate, cell, ('0x' || substr(md5('boot:' || replicate || ':' || cell || ':' || slot), 1, 8))::BIGINT % n AS i FROM s),
m AS (SELECT replicate, d.cell, avg(v) AS m FROM d JOIN n ON d.cell = n.cell AND d.i = n.i GROUP BY 1, 2) SELECT replicate, round(avg(m), 6) AS macro FROM m GROUP BY 1""")
def bootstrap(t: Tables) -> DataFrame:
    d = t.customer.withColumnRenamed("c_mktsegment", "cell")
    return rounded(stats.bootstrap_macro(d, "cell", "c_custkey", "c_acctbal", 20, "boot"), "macro", places=6)


@BOOK.add("""WITH a AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL), x AS (SELECT l_suppkey, max(m) FILTER (WHERE l_returnflag = 'A') AS a, max(m) FILTER (WHERE l_returnflag = 'R') AS r FROM a GROUP BY 1)
SELECT l_suppkey, round(r - a, 9) AS delta, l_suppkey % 10 = 3 AS watched FROM x WHERE a IS NOT NULL AND r IS NOT NULL""")
def arm_deltas(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    arm = lambda a: m.where(F.col("l_returnflag") == a).select("l_suppkey", F.col("m").alias(a))
    return arm("A").join(arm("R"), "l_suppkey").select("l_suppkey", F.round(F.col("R") - F.col("A"), 9).alias("delta"), F.col("l_suppkey").cast("string").rlike("3$").alias("watched"))


PIXELS = "px AS (SELECT l_orderkey // 100 AS crop, l_partkey % 7 AS p, l_suppkey % 5 AS g FROM lineitem)"


def pixels(t: Tables) -> DataFrame:
    return t.lineitem.select(F.floor(F.col("l_orderkey") / 100).alias("crop"), (F.col("l_partkey") % 7).alias("p"), (F.col("l_suppkey") % 5).alias("g"))


@BOOK.add(f"""WITH {PIXELS}, c AS (SELECT crop, count(*) FILTER (WHERE p > 3 AND g > 2) AS tp, count(*) FILTER (WHERE p > 3 AND g <= 2) AS fp, count(*) FILTER (WHERE p <= 3 AND g > 2) AS fn, count(*) FILTER (WHERE p <= 3 AND g <= 2) AS tn FROM px GROUP BY 1)
SELECT crop, tp, fp, fn, tn, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS dice, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END::DOUBLE AS iou, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE coalesce(tp / nullif(tp + fp, 0), 0) END::DOUBLE AS precision,
  CASE WHEN tp + fp + fn = 0 THEN 1 ELSE coalesce(tp / nullif(tp + fn, 0), 0) END::DOUBLE AS recall, ((tp + tn) / (tp + tn + fp + fn))::DOUBLE AS accuracy, coalesce(tn / nullif(tn + fp, 0), 1)::DOUBLE AS specificity FROM c""")
def confusion(t: Tables) -> DataFrame:
    return labels.confusion(pixels(t), ["crop"], F.col("p") > 3, F.col("g") > 2)


@BOOK.add(f"""WITH {PIXELS} SELECT crop, p, g, count(*) AS n, sum(count(*)) OVER (PARTITION BY crop, p)::BIGINT AS area_p, sum(count(*)) OVER (PARTITION BY crop, g)::BIGINT AS area_g FROM px GROUP BY crop, p, g""")
def contingency(t: Tables) -> DataFrame:
    return labels.contingency(pixels(t), ["crop"], "p", "g")


CONT = f"{PIXELS}, ct AS (SELECT crop, p, g, count(*) AS n, sum(count(*)) OVER (PARTITION BY crop, p) AS ap, sum(count(*)) OVER (PARTITION BY crop, g) AS ag, sum(count(*)) OVER (PARTITION BY crop) AS nn FROM px GROUP BY crop, p, g)"


@BOOK.add(f"WITH {CONT} SELECT crop, round(-sum(n / nn * log2(n / ag)), 8)::DOUBLE AS vi_split, round(-sum(n / nn * log2(n / ap)), 8)::DOUBLE AS vi_merge FROM ct GROUP BY 1")
def variation_of_information(t: Tables) -> DataFrame:
    return rounded(labels.variation_of_information(labels.contingency(pixels(t), ["crop"], "p", "g"), ["crop"]), "vi_split", "vi_merge", places=8)


PQ_PX = "px AS (SELECT l_orderkey // 100 AS crop, l_orderkey % 9 AS p, CASE WHEN l_linenumber = 1 THEN l_orderkey % 4 ELSE l_orderkey % 9 END AS g FROM lineitem)"


@BOOK.add(f"""WITH {CONT.replace(PIXELS, PQ_PX)}, m AS (SELECT crop, count(*) AS tp, sum(n / (ap + ag - n)) AS s FROM ct WHERE p <> 0 AND g <> 0 AND n / (ap + ag - n) > 0.5 GROUP BY 1), k AS (SELECT crop, count(DISTINCT p) FILTER (WHERE p <> 0) AS n_pred, count(DISTINCT g) FILTER (WHERE g <> 0) AS n_true FROM ct GROUP BY 1),
z AS (SELECT k.*, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s FROM k LEFT JOIN m USING (crop)) SELECT crop, n_pred, n_true, tp, round(coalesce(s / nullif(tp, 0), 0), 9)::DOUBLE AS sq, round(coalesce(2.0 * tp / nullif(n_pred + n_true, 0), 0), 9)::DOUBLE AS rq,
  round(coalesce(s / nullif(tp, 0), 0) * coalesce(2.0 * tp / nullif(n_pred + n_true, 0), 0), 9)::DOUBLE AS pq, round(coalesce(tp / nullif(n_pred, 0), 0), 9)::DOUBLE AS precision, round(coalesce(tp / nullif(n_true, 0), 0), 9)::DOUBLE AS recall FROM z""")
def panoptic_quality(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.floor(F.col("l_orderkey") / 100).alias("crop"), (F.col("l_orderkey") % 9).alias("p"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey") % 4).otherwise(F.col("l_orderkey") % 9).alias("g"))
    return rounded(labels.panoptic(labels.contingency(d, ["crop"], "p", "g"), ["crop"]), "sq", "rq", "pq", "precision", "recall")


PROB = "pr AS (SELECT doc_id, doc_id // 50 AS crop, quality, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS prob FROM labels)"


def probabilities(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.floor(F.col("doc_id") / 50).alias("crop"), "quality", numbers.hash01(F.col("doc_id").cast("string")).alias("prob"))


@BOOK.add(f"""WITH {PROB}, h AS (SELECT crop, least(255, floor(prob * 256)) AS bin, count(*) FILTER (WHERE quality = 1) AS pos, count(*) AS n FROM pr GROUP BY 1, 2), w AS (SELECT crop, pos, sum(pos) OVER o AS tp, sum(n) OVER o AS k FROM h WINDOW o AS (PARTITION BY crop ORDER BY bin DESC)) SELECT crop, round(sum(pos * tp / k) / nullif(sum(pos), 0), 9)::DOUBLE AS auprc FROM w GROUP BY 1""")
def auprc(t: Tables) -> DataFrame:
    return rounded(labels.binned_auprc(probabilities(t), ["crop"], F.col("prob"), F.col("quality") == 1), "auprc")


SWEEP = f"""{PROB}, sw AS (SELECT crop, th AS threshold, count(*) FILTER (WHERE prob >= th AND quality = 1) AS tp, count(*) FILTER (WHERE prob >= th AND quality <> 1) AS fp, count(*) FILTER (WHERE prob < th AND quality = 1) AS fn FROM pr CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS th) GROUP BY 1, 2),
ds AS (SELECT crop, threshold, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS dice FROM sw)"""
STEPS = [0.1, 0.3, 0.5, 0.7, 0.9]


@BOOK.add(f"WITH {SWEEP} SELECT threshold, round(avg(dice), 9) AS dice FROM ds GROUP BY 1 ORDER BY avg(dice) DESC, threshold LIMIT 1")
def threshold_sweep(t: Tables) -> DataFrame:
    return rounded(labels.best_threshold(labels.threshold_sweep(probabilities(t), "crop", "prob", "quality", STEPS)), "dice")


@BOOK.add(f"WITH {SWEEP} SELECT crop, max(dice) AS dice, arg_max(threshold, (dice, -threshold)) AS threshold FROM ds WHERE dice IS NOT NULL GROUP BY 1")
def crop_thresholds(t: Tables) -> DataFrame:
    return labels.per_crop_best(labels.threshold_sweep(probabilities(t), "crop", "prob", "quality", STEPS), "crop")


@BOOK.add(f"WITH {PROB}, q AS (SELECT least(255, greatest(0, floor(255 * prob + 0.5)))::BIGINT AS q FROM pr) SELECT q, count(*) AS n, q >= 128 AS passes FROM q GROUP BY q")
def quantised(t: Tables) -> DataFrame:
    level = numbers.threshold_level(F.lit(0.5))
    d = probabilities(t).withColumn("q", numbers.quantize_probability(F.col("prob")))
    return d.groupBy("q").agg(F.count("*").alias("n")).withColumn("passes", F.col("q") >= level)


@BOOK.add("SELECT l_linenumber, round(avg(l_quantity), 9) AS mean, round(stddev_pop(l_quantity), 9) AS sd, count(l_quantity) AS n, (SELECT min(k) FROM (SELECT l_linenumber AS k, avg(l_quantity) AS m FROM lineitem GROUP BY 1) WHERE m > 25.4) AS min_k FROM lineitem GROUP BY 1")
def score_curve(t: Tables) -> DataFrame:
    curve, least = stats.score_curve(t.lineitem, "l_linenumber", "l_quantity", 25.4)
    return rounded(curve.crossJoin(F.broadcast(least)), "mean", "sd")


@BOOK.add("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 3) AS sd FROM lineitem GROUP BY 1")
def corpus_moments(t: Tables) -> DataFrame:
    return stats.moments(t.lineitem, "l_extendedprice", ["l_returnflag"]).withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 3)})


@BOOK.add("SELECT s_name AS name, round(avg(l_quantity), 9) AS mean FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_suppkey % 3 > 0 WHERE s_suppkey % 2 = 0 GROUP BY 1 UNION ALL SELECT c_name, c_acctbal FROM customer WHERE NOT regexp_matches(c_name, '7$')")
def combined_table(t: Tables) -> DataFrame:
    q = t.lineitem.where("l_suppkey % 3 > 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_quantity"), 9).alias("mean"))
    ours = t.supplier.where("s_suppkey % 2 = 0").join(q, "s_suppkey", "left").select(F.col("s_name").alias("name"), "mean")
    return stats.combined(ours, t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("mean")), "name", "mean", "7$")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
