"""Library state: memberships, scopes, versions, checks by people, annotation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.numbers import ratio


def assign_membership(members: DataFrame, changes: DataFrame, replace: bool) -> DataFrame:
    """members (item, dataset) after changes (item, dataset): added, or in place of all that the item had."""
    kept = members.join(changes.select("item").distinct(), "item", "left_anti") if replace else members
    return kept.unionByName(changes.select("item", "dataset").where("dataset is not null")).distinct()


def stray_links(members: DataFrame, moves: DataFrame, homes: DataFrame) -> DataFrame:
    """Links of moved items (item, experiment) to data sets (dataset, experiment) that their new experiment can't hold."""
    return members.join(moves, "item").join(homes.withColumnRenamed("experiment", "home"), "dataset").where(~F.col("home").eqNullSafe(F.col("experiment"))).select("item", "dataset")


def set_experiment(members: DataFrame, moves: DataFrame, homes: DataFrame) -> DataFrame:
    """members without the stray links of moved items."""
    return members.join(stray_links(members, moves, homes), ["item", "dataset"], "left_anti")


def dropped_links(members: DataFrame, moves: DataFrame, homes: DataFrame) -> DataFrame:
    """item, dropped: how many links each moved item loses."""
    n = stray_links(members, moves, homes).groupBy("item").agg(F.count("*").alias("n"))
    return moves.select("item").distinct().join(n, "item", "left").select("item", F.coalesce("n", F.lit(0)).alias("dropped"))


def resolve_scope(datasets: DataFrame, images: DataFrame, members: DataFrame, active: DataFrame) -> DataFrame:
    """item: active images of chosen data sets and those chosen themselves, once each."""
    from_sets = members.join(datasets, "dataset", "left_semi").select("item")
    return active.join(from_sets.unionByName(images).distinct(), "item", "left_semi").select("item")


def scope_blockers(images: DataFrame, active: DataFrame, homes: DataFrame) -> DataFrame:
    """rule, n: chosen images that aren't there, and more than one experiment."""
    missing = images.join(active, "item", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("rule"), "n")
    mixed = homes.join(images, "item", "left_semi").agg(F.countDistinct("experiment").alias("n")).where("n > 1").select(F.lit("experiments").alias("rule"), "n")
    return missing.where("n > 0").unionByName(mixed)


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest version of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return df.withColumn("__v", F.row_number().over(w)).where("__v = 1").drop("__v")


def superseded(df: DataFrame, keys: list[str], version: str, at: str) -> DataFrame:
    """Adds `superseded_at`: when the next version of the key came; null for the live one."""
    return df.withColumn("superseded_at", F.lead(at).over(Window.partitionBy(*keys).orderBy(version)))


def replace_candidates(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Old rows but unlabelled ones of the same run keys as the new rows, and the new rows."""
    stale = F.col("label_state") == "unlabelled"
    kept = old.where(~stale).unionByName(old.where(stale).join(new.select(*on).distinct(), on, "left_anti"))
    return kept.unionByName(new, allowMissingColumns=True)


def live_objects(df: DataFrame, source: str, version: Column) -> DataFrame:
    return df.where((F.col("label_state") == "unlabelled") & ~F.coalesce("refined", F.lit(False)) & F.col("superseded_at").isNull() & (F.col("source_model") == source) & (F.col("version") == version))


def answers(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Tallies of answers by key, with the share that the reviewer's own objects make up of the confirmed ones."""
    d = checks.groupBy(*keys).agg(*[F.count_if(F.col("answer") == a).alias(a) for a in ("yes", "no", "unsure")], F.count_if((F.col("answer") == "yes") & F.col("own")).alias("own_yes"))
    return d.withColumn("self_confirmed", ratio(F.col("own_yes").cast("double"), F.col("yes")))


def blockers(checks: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))


def annotation_counts(df: DataFrame, image: str, kinds: list[str]) -> DataFrame:
    return df.groupBy(image).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count("*").alias("n"))


def grouped_counts(experiments: DataFrame, members: DataFrame, active: DataFrame) -> DataFrame:
    """dataset, n_active, n_all: images by data set; dataset null counts those in none."""
    d = experiments.join(members, "dataset", "left").join(active.select("item", F.lit(1).alias("live")), "item", "left")
    by = d.groupBy("dataset").agg(F.count("live").alias("n_active"), F.count("item").alias("n_all"))
    none = active.join(members, "item", "left_anti").agg(F.count("*").alias("n")).select(F.lit(None).cast(dict(by.dtypes)["dataset"]).alias("dataset"), F.col("n").alias("n_active"), F.col("n").alias("n_all"))
    return by.unionByName(none)


def match_names(assets: DataFrame, files: DataFrame) -> DataFrame:
    """asset_id, path: files by normalised full name, else by stem; the first path of equal ones; null without."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    by = lambda key: files.groupBy(key.alias("k")).agg(F.min("path").alias("p"))
    full, stem = by(plain(base)), by(plain(F.regexp_replace(base, r"\.[^.]+$", "")))
    a = assets.withColumn("k", plain(F.col("name")))
    d = a.join(full.withColumnRenamed("p", "p1"), "k", "left").join(stem.withColumnRenamed("p", "p2"), "k", "left")
    return d.select("asset_id", F.coalesce("p1", "p2").alias("path"))


def label_states(objects: DataFrame, segmentation: str) -> DataFrame:
    """segmentation, label_state, n: objects by state, rejected ones too."""
    return objects.groupBy(segmentation, "label_state").agg(F.count("*").alias("n"))


def rejected(objects: DataFrame, segmentation: str) -> DataFrame:
    return objects.groupBy(segmentation).agg(F.count_if(F.col("label_state") == "rejected").alias("rejected"))
