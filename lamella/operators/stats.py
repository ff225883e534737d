"""Score tables: long form, per-group summaries, two-level means, pivots, intervals and leave-one-out deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.numbers import finite, ratio
from lamella.operators.rounds import persist
from lamella.operators.scans import ranked, with_percentiles


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: one row a metric, with NaN and infinite values as null."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    return df.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)")).withColumn("value", finite(F.col("value")))


def group_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population sd, median and count of finite values per key and metric."""
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.median("value").alias("median"), F.count("value").alias("n"))


def macro_micro(long: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Per key and metric: the mean of cell means (macro), the mean over all rows (micro), worst and best cell."""
    cells = long.groupBy(*keys, "metric", cell).agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("value").alias("c"))
    return cells.groupBy(*keys, "metric").agg(F.avg("m").alias("macro"), ratio(F.sum("s"), F.sum("c")).alias("micro"), F.min("m").alias("worst"), F.max("m").alias("best"), F.count("m").alias("n_cells"), F.sum("c").alias("n"))


def score_matrix(long: DataFrame, row: str, column: str, columns: list) -> DataFrame:
    """row x column means, with the mean over the columns that have one."""
    wide = long.groupBy(row).pivot(column, columns).agg(F.avg("value"))
    names = [c for c in wide.columns if c != row]
    known = F.array_compact(F.array(*[F.col(f"`{c}`") for c in names]))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return wide.withColumn("mean", F.when(F.size(known) > 0, total / F.size(known)))


def distribution(long: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sample sd, quartiles, range and number missing."""
    d = long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value").isNull()).alias("missing"))
    d = with_percentiles(d, long, [*keys, "metric"], "value", [0.25, 0.5, 0.75])
    return d.select(*keys, "metric", "n", "mean", "sd", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "low", "high", "missing")


def rollup_units(df: DataFrame, group: str, unit: str, value: Column, weight: Column | None = None) -> DataFrame:
    """Unweighted group mean over unit means with sample sd and SEM; beside it the mean weighted by unit weights."""
    w = weight if weight is not None else F.lit(1)
    units = df.groupBy(group, unit).agg(F.avg(finite(value)).alias("v"), F.sum(w).alias("w"))
    known = F.col("v").isNotNull()
    return units.groupBy(group).agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"), F.count("v").alias("n"),
        ratio(F.sum(F.when(known, F.col("v") * F.col("w"))), F.sum(F.when(known, F.col("w")))).alias("weighted_mean"),
    )


def jackknife(df: DataFrame, source: str, arm: str, value: Column, arms: tuple[str, str]) -> DataFrame:
    """Leave-one-source-out deltas of two arms over the sources they share, with the jackknife sd."""
    m = df.groupBy(source).agg(*[F.avg(F.when(F.col(arm) == a, value)).alias(n) for a, n in zip(arms, ("a", "b"), strict=True)])
    m = m.where("a is not null and b is not null").withColumn("d", F.col("b") - F.col("a"))
    every = Window.partitionBy()  # one row a source
    n = F.count("*").over(every)
    m = m.withColumn("n", n).withColumn("left_out", (F.sum("d").over(every) - F.col("d")) / (F.col("n") - 1))
    mean = F.avg("left_out").over(every)
    spread = F.sqrt((F.col("n") - 1) / F.col("n") * F.sum(F.pow(F.col("left_out") - F.col("mean_left"), 2)).over(every))
    return m.withColumn("mean_left", mean).withColumn("sd", spread).select(source, F.col("d").alias("delta"), "left_out", "mean_left", "sd")


def bootstrap_macro(df: DataFrame, cell: str, order: str, value: str, replicates: int, seed: str) -> DataFrame:
    """A stratified bootstrap of the mean of cell means: every cell draws as many rows as it has, by hash, per replicate.

    Returns replicate, macro. Rows are numbered inside cells; draws are rows (replicate, cell, slot) joined on the number.
    """
    numbered = ranked(df.select(cell, F.col(value).alias("v"), F.col(order).alias("o")), [cell], ["o"], "i", "n").select(cell, "v", (F.col("i") - 1).cast("int").alias("i"), "n")
    numbered = persist(numbered)
    slots = numbered.select(cell, "n", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    name = F.concat_ws(":", F.lit(seed), "replicate", F.col(cell).cast("string"), "slot")
    drawn = slots.withColumn("i", F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.col("n")).cast("int"))
    means = drawn.join(numbered.select(cell, "i", "v"), [cell, "i"]).groupBy("replicate", cell).agg(F.avg("v").alias("m"))
    return means.groupBy("replicate").agg(F.avg("m").alias("macro"))


def score_curve(df: DataFrame, k: str, value: str, goal: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """k, mean, sd, n of trial scores, and the least k whose mean is above the goal (null if none is)."""
    curve = df.groupBy(k).agg(F.avg(finite(F.col(value))).alias("mean"), F.stddev_pop(finite(F.col(value))).alias("sd"), F.count(finite(F.col(value))).alias("n"))
    return curve, curve.agg(F.min(F.when(F.col("mean") > goal, F.col(k))).alias("min_k"))


def combined(ours: DataFrame, theirs: DataFrame, name: str, mean: str, internal: str) -> DataFrame:
    """Our rows and an external table without its internal duplicates, by falling mean, unknown ones last."""
    return ours.unionByName(theirs.where(~F.col(name).rlike(internal)), allowMissingColumns=True).orderBy(F.desc_nulls_last(mean), name)


def moments(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean and population sd from sums and sums of squares."""
    x = F.col(value).cast("double")
    d = df.groupBy(*(keys or [])).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    return d.select(*(keys or []), "n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2)).alias("sd"))


def bootstrap_interval(replicates: DataFrame, value: str, level: float = 95.0) -> DataFrame:
    """lo, hi: the percentiles that leave out as much on either side, over replicates (a row each)."""
    out = (100.0 - level) / 200.0
    q = replicates.agg(F.percentile(value, F.array(F.lit(out), F.lit(1 - out))).alias("q"))
    return q.select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def in_domain(cells: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    """Cells of a score table that lie in the domain a model was trained on."""
    return cells.join(pairs.select(*on).distinct(), on, "left_semi")


def instance_table(df: DataFrame, model: str, dataset: str, crop: str, metrics: list[str], datasets: list[str]) -> DataFrame:
    """Per model its first metric in each data set with instances, the means over data sets of every metric, and its crops; best first."""
    first = metrics[0]
    d = df.where(F.col(dataset).isin(*datasets) & finite(F.col(first)).isNotNull())
    per = d.groupBy(model, dataset).agg(*[F.avg(finite(F.col(m))).alias(m) for m in metrics])
    wide = per.groupBy(model).agg(*[F.max(F.when(F.col(dataset) == x, F.col(first))).alias(x) for x in datasets], *[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return wide.join(d.groupBy(model).agg(F.countDistinct(crop).alias("n")), model).orderBy(F.desc(f"mean_{first}"), model)


def arm_table(scores: DataFrame, arm: list[str], subgroup: str, metrics: list[str], excluded: str, worst: str, places: int = 5) -> DataFrame:
    """Per arm (and split): rows evaluated and excluded, the macro of each metric over subgroups, and the worst subgroup's value of one."""
    counts = scores.groupBy(*arm).agg(F.count_if(~F.col(excluded)).alias("n_evaluated"), F.count_if(F.col(excluded)).alias("n_excluded"))
    cells = scores.where(~F.col(excluded)).groupBy(*arm, subgroup).agg(*[F.avg(finite(F.col(m))).alias(m) for m in metrics])
    means = cells.groupBy(*arm).agg(*[F.round(F.avg(m), places).alias(m) for m in metrics], F.round(F.min(worst), places).alias(f"worst_{worst}"), F.min_by(subgroup, F.struct(worst, subgroup)).alias("worst_subgroup"))
    return counts.join(means, arm, "left")
