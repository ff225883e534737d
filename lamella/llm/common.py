"""Shared helpers: written tables in the cluster's shared folder, prefix sums over an order, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: The characters that end a word or are stripped from a line: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^ \t-\r]+"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset on a local master (tests), a new one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/lamella/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    writer = df.write
    for k, v in ({"compression": "zstd"} | options).items():
        writer = writer.option(k.replace("__", "."), v)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, longer where a column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as Python values, a slice at a time so that long texts aren't all decoded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def gathered(made: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about `most` bytes by `weight`."""
    held: list[tuple] = []
    size = 0
    for row in made:
        held.append(row)
        size += weight(row) + 32
        if size >= most or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def running_start(df: DataFrame, order: list[Column | str], size: str, start: str) -> DataFrame:
    """Adds `start`: the sum of `size` over all rows before this one in `order` (which must be total).

    Rows are range-partitioned and written with their part's number; the parts' totals (one row each) are
    prefix-summed and broadcast, and each part sums its own rows. No task sees more than one part.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "ordered")
    totals = dealt.groupBy("__part").agg(F.sum(size).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("__own", F.coalesce(F.sum(size).over(own), F.lit(0)))
        .join(F.broadcast(bases), "__part")
        .withColumn(start, F.col("__base") + F.col("__own"))
        .drop("__part", "__own", "__base")
    )
