"""Sinks: JSON lines, shards, CSV inventories, good and bad rows from one scan, bundles with declared headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(df: DataFrame, path: str) -> int:
    """Rows as JSON with sorted keys; returns their number, counted on the way."""
    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count("*").alias("n")).write.json(path)
    return seen.get["n"]


def projected(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*[f for f in fields if f in df.columns]).write.parquet(path)


def sharded(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows with a `shard` column, a folder a shard, in order inside."""
    df.repartition("shard").sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(path)


def inventory_csv(df: DataFrame, path: str, name: str) -> None:
    df.orderBy(F.lower(name), name).write.option("header", True).csv(path)


def good_and_bad(df: DataFrame, error: Column, good: str, bad: str) -> dict[str, int]:
    """One scan into two tables by an error column; returns the counts."""
    seen = Observation()
    d = df.withColumn("error", error).observe(seen, F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    d = d.persist()
    d.where("error is null").drop("error").write.parquet(good)
    d.where("error is not null").write.parquet(bad)
    d.unpersist()
    return {k: seen.get[k] for k in ("good", "bad")}


def by_outcome(df: DataFrame, error: Column, path: str, source: str | None = None) -> DataFrame:
    """One write of good and bad rows, a folder each (outcome=good, outcome=bad), with the column `error`.

    Returns source, error, n: the good rows as one row without error, counted on the way, and the bad ones by source and
    error, read from their own folder.
    """
    seen = Observation()
    d = df.withColumn("error", error).observe(seen, F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    d.withColumn("outcome", F.when(F.col("error").isNull(), "good").otherwise("bad")).write.partitionBy("outcome").parquet(path)
    spark, counts = df.sparkSession, seen.get
    good = spark.createDataFrame([(None, None, counts["good"])], "source string, error string, n long")
    if not counts["bad"]:
        return good
    name = F.col(source).cast("string") if source else F.lit(None).cast("string")
    return good.unionByName(outcome(spark, path, "bad", d.schema).groupBy(name.alias("source"), "error").agg(F.count("*").alias("n")))


def outcome(spark: SparkSession, path: str, which: str, schema: T.StructType) -> DataFrame:
    """The good or the bad rows of by_outcome(); none where there were none."""
    d = spark.read.schema(T.StructType([*schema.fields, T.StructField("outcome", T.StringType())])).parquet(path)
    return d.where(F.col("outcome") == which).drop("outcome")


def bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """CSV tables with headers, also where they have no rows, and a manifest of names, columns and rows."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).coalesce(1).write.option("header", True).mode("overwrite").csv(f"{path}/{name}")
        rows.append((name, df.columns, seen.get["n"]))
    manifest = spark.createDataFrame(rows, "name string, columns array<string>, n long")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest
