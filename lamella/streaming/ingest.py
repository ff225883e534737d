"""Incremental ingest: file streams with de-duplication, windowed routing counts, and versions kept by merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lamella.operators.library import latest


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "json", files: int = 100) -> DataFrame:
    """A resumable scan of a folder: what was read is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def unique(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first record of each key inside the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def route_windows(stream: DataFrame, at: str, late: str, width: str, route: Column) -> DataFrame:
    """Counts by tumbling window and route; a window comes out once it is closed."""
    d = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), route.alias("route")).agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("start"), "route", "n")


def run_once(df: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Everything that is there now, appended to `path`; a second call goes on after it."""
    query = df.writeStream.format(form).option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def live_runs(batches: int, fanout: int) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold `batches` batches, oldest first: a run of a level holds `fanout` of the level below."""
    out, level = [], 0
    while batches:
        out = [(level, i) for i in range(batches // fanout * fanout, batches)] + out
        batches, level = batches // fanout, level + 1
    return out


def keep_versions(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: list[str], fanout: int = 8) -> None:
    """The newest version of each key in levelled runs: a batch is written as a run of its own, and as many runs of a level as
    `fanout` become one of the next, so a row is rewritten about as often as there are levels. A batch that comes again
    after a loss writes the same runs again."""
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, keys, version).write.mode("overwrite").parquet(f"{path}/level=0/run={number}")
        level, done = 0, number + 1
        while done % fanout == 0:
            runs = [f"{path}/level={level}/run={i}" for i in range(done - fanout, done)]
            level, done = level + 1, done // fanout
            latest(spark.read.schema(batch.schema).parquet(*runs), keys, version).write.mode("overwrite").parquet(f"{path}/level={level}/run={done - 1}")
        spark.range(1).selectExpr(f"{number + 1} as batches").write.mode("overwrite").json(f"{path}-count/{number % 2}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def kept_versions(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], version: list[str], fanout: int = 8) -> DataFrame:
    """The newest version of each key over all runs that keep_versions() left."""
    counted = spark.read.schema("batches int").option("recursiveFileLookup", True).json(f"{path}-count")
    batches = counted.agg(F.max("batches")).first()[0] or 0
    runs = [f"{path}/level={level}/run={i}" for level, i in live_runs(batches, fanout)]
    found = spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)
    return latest(found, keys, version)


def cached(spark: SparkSession, build, path: str, versions: dict[str, str]) -> DataFrame:
    """A table built once for a set of versions; another version builds its own."""
    where = "/".join([path, *[f"{k}={v}" for k, v in sorted(versions.items())]])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)
