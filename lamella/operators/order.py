"""Orders that scale out: running sums and numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_bin(text: Column, bins: int = 4096) -> Column:
    """The bin of a SHA-1 order: its first hex digits, so bins sort as digests do. bins: a power of 16."""
    digits = len(f"{bins - 1:x}")
    return F.substring(text, 1, digits)


def running_by_bin(df: DataFrame, bin_: str, order: list[str], size: str, out: str, within: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows before, in (bin, order), inside each `within` group; and the group's sum as `total`.

    Bins are totalled and prefix-summed (one row a bin), and rows are summed inside their bin.
    """
    keys = within or []
    before = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bin_).agg(F.sum(size).alias("__s"))
    bases = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(bin_).alias("__bin"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"), *([F.sum("__s").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    own = Window.partitionBy(*keys, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("__own", F.coalesce(F.sum(size).over(own), F.lit(0)))
    on = F.col(bin_) == F.col("__bin")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return summed.join(bases, on).withColumn(out, F.col("__base") + F.col("__own")).drop("__own", "__base", "__bin", *[f"__{k}" for k in keys])


def placed(df: DataFrame, group: list[str], bin_: Column, order: list[str]) -> DataFrame:
    """Adds `place` (from 1), a row's place in (bin, order) inside its group, and `members`, the group's size: no task sees a whole group."""
    one = F.lit(1).cast("long")
    d = running_by_bin(df.withColumns({"hbin": bin_, "__one": one}), "hbin", order, "__one", "place", group, "members")
    return d.withColumn("place", F.col("place") + 1).drop("hbin", "__one")


def seeded(df: DataFrame, seed: str, *key: str) -> DataFrame:
    """Adds `digest`, the SHA-1 of seed and key: a seeded shuffle is its order."""
    return df.withColumn("digest", F.sha1(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key])))


def numbered(df: DataFrame, seed: str, *key: str) -> DataFrame:
    """Adds `digest` and `place` (from 0) in seeded order."""
    d = seeded(df, seed, *key).withColumn("__one", F.lit(1).cast("long"))
    d = d.withColumn("__bin", hashed_bin(F.col("digest"))).withColumnRenamed("__bin", "bin")
    return running_by_bin(d, "bin", ["digest", *key], "__one", "place").drop("bin", "__one")


def shards(placed: DataFrame, size: int) -> DataFrame:
    return placed.withColumn("shard", F.floor(F.col("place") / size))


def balanced(df: DataFrame, source: str, seed: str, key: str) -> DataFrame:
    """Adds `share`: a row's seeded rank inside its source over the source's size, so that sorting by it mixes sources evenly."""
    d = seeded(df, seed, key)
    d = placed(d, [source], hashed_bin(F.col("digest")), ["digest", key])
    return d.withColumn("share", (F.col("place") - 0.5) / F.col("members")).drop("place", "members").withColumn("source_digest", F.sha1(F.concat_ws(":", F.lit(seed), F.col(source))))


def round_robin(df: DataFrame, source: str, first_seen: str, n: int) -> DataFrame:
    """The first n rows when sources take turns, each in its own order and sources by their first row."""
    w = Window.partitionBy(source)
    d = df.withColumn("turn", F.row_number().over(w.orderBy(first_seen))).where(F.col("turn") <= n).withColumn("lead", F.min(first_seen).over(w))
    return d.orderBy("turn", "lead").limit(n)


def best_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows, uniform and reproducible."""
    return seeded(df, seed, key).orderBy("digest", key).limit(n)


def draw_order(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first n of a SHA-2 order by (key:seed): a larger n extends the draw without repeats."""
    return df.withColumn("draw", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)), 256)).orderBy("draw", key).limit(n)


def most_uncertain(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.abs(F.col(score) - 0.5), key).limit(k)


def rank_hits(df: DataFrame, group: list[str], score: str, area: str, key: str, k: int = 20) -> DataFrame:
    """Scored hits first, by falling score, the smaller area first of equal ones."""
    return best_per_group(df, group, [F.col(score).isNull(), F.desc(score), F.col(area).asc(), F.col(key).asc()], k)
