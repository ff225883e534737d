"""Tables that grow by parts, guarded against half-written data and two writers, and records that come once for ever.

A part table has folders of data and manifests. Data are written aside, under a name of their own; then a manifest is
made whose name is the next number. The file system makes a file of one name once, so of two writers one wins; the
other looks again at what is there and commits the parts that are left. What no manifest names is not there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.streaming.ingest import live_runs


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def make_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that isn't there yet; False if it is."""
    fs, where = _file_system(spark, path)
    try:
        out = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def manifests(spark: SparkSession, table: str) -> DataFrame:
    """number, folder, part of all that is committed."""
    fs, where = _file_system(spark, f"{table}/manifests")
    if not fs.exists(where):
        return spark.createDataFrame([], "number int, folder string, part string")
    d = spark.read.schema("number int, folder string, parts array<string>").option("recursiveFileLookup", True).json(f"{table}/manifests")
    return d.where("number is not null").select("number", "folder", F.explode_outer("parts").alias("part"))


def add_parts(spark: SparkSession, table: str, parts: DataFrame, parse: Callable[[DataFrame], DataFrame], between: Callable[[], None] = lambda: None) -> int:
    """Parses the parts (a frame with `part`) that the table doesn't have and commits their rows; returns how many parts were new.

    parse gives rows with the column `part`. A part is read once, however often it is offered; parts without rows are
    remembered too. `between` is called before the commit, for tests.
    """
    new = parts.select("part").distinct().join(manifests(spark, table).select("part"), "part", "left_anti")
    names = sorted(r.part for r in new.collect())  # names of files, not their content
    if not names:
        return 0
    folder = f"data/{uuid.uuid4().hex}"
    todo = spark.createDataFrame([(n,) for n in names], "part string")
    parse(parts.join(F.broadcast(todo), "part", "left_semi") if len(names) < 10_000 else parts.join(todo, "part", "left_semi")).write.parquet(f"{table}/{folder}")
    between()
    while True:
        there = manifests(spark, table)
        taken = {r.part for r in there.join(todo, "part", "left_semi").collect()}
        names = [n for n in names if n not in taken]
        if not names:
            return 0
        number = (there.agg(F.max("number")).first()[0] or 0) + 1
        if make_once(spark, f"{table}/manifests/{number:08d}.json", json.dumps({"number": number, "folder": folder, "parts": names})):
            return len(names)


def read_parts(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of all committed parts: those of a folder that its manifest names."""
    there = manifests(spark, table)
    folders = [r.folder for r in there.select("folder").distinct().collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    d = spark.read.schema(schema).parquet(*[f"{table}/{x}" for x in folders])
    d = d.withColumn("__folder", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]{32})/", 1))
    known = there.select(F.col("folder").alias("__folder"), "part")
    return d.join(known, ["__folder", "part"], "left_semi").drop("__folder")


def keep_first(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], fanout: int = 8) -> None:
    """Appends to `path`/rows the first record of each key that ever came, in `order` inside a batch: there is no horizon.

    Keys lie in levelled runs; a batch is anti-joined with them, and its new keys become a run. A batch that comes again
    after a loss meets the runs before it only, and writes the same rows and runs again.
    """
    spark = stream.sparkSession
    shape = stream.select(*keys).schema

    def add(batch: DataFrame, number: int) -> None:
        own = [F.col(k) for k in keys]
        one = batch.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("row")).select("row.*")
        runs = [f"{path}/keys/level={level}/run={i}" for level, i in live_runs(number, fanout)]
        if runs:
            known = spark.read.schema(shape).parquet(*runs).withColumnsRenamed({k: f"__{k}" for k in keys})
            one = one.join(known, [c.eqNullSafe(F.col(f"__{k}")) for c, k in zip(own, keys, strict=True)], "left_anti")
        one.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        fresh = spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={number}").select(*keys)
        fresh.write.mode("overwrite").parquet(f"{path}/keys/level=0/run={number}")
        level, done = 0, number + 1
        while done % fanout == 0:
            below = [f"{path}/keys/level={level}/run={i}" for i in range(done - fanout, done)]
            level, done = level + 1, done // fanout
            spark.read.schema(shape).parquet(*below).write.mode("overwrite").parquet(f"{path}/keys/level={level}/run={done - 1}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What keep_first() kept."""
    fs, where = _file_system(spark, f"{path}/rows")
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
