"""Line dedup over levelled sorted runs of line hashes.

Lines are keyed by a 128-bit hash. Documents arrive in batches; a batch's keys are counted, merge-anti-joined with the
keys that the runs hold, and added as a new sorted run: keys new to the runs come with the document that keeps them,
keys seen before only with a count. When a level has `fanout` runs they are merged into one of the next level. Batches
go from the largest doc_ids down, so a key's keeper is in the first batch that has it.

Cases: a null or empty text is one empty line; each row is a document of its own, so rows with equal doc_id count
separately and all keep a line whose largest holder they are; a null doc_id is smaller than any other; keys shorter
than `least` code points are never dropped; a document whose lines all go has an empty text; an empty table gives no
rows; other columns pass through, except `n_lines` and `n_dropped`, which are replaced.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import BLANKS, gathered, materialise, partitions, rows, shared_path, unused

KEY = ["h1", "h2"]
LEAST_ID = -(1 << 63)


def line_key(line: str) -> str:
    stripped = line.strip(BLANKS)
    return stripped.lower() if stripped.isascii() else stripped.encode().lower().decode()


def key_hash(key: str) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(key.encode())
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


def _id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LEAST_ID))


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """__id, h1, h2: each key of each document once."""
    schema = pa.schema([("__id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc_id, text in rows(batches, "__id", "text"):
            for key in {k for k in map(line_key, (text or "").split("\n")) if len(k) >= least}:
                yield doc_id, *key_hash(key)

    return docs.select(_id().alias("__id"), "text").mapInArrow(lambda b: gathered(made(b), schema, lambda r: 24), "__id long, h1 long, h2 long")


class LineRuns:
    """Runs of (h1, h2, n_docs, keeper) in levels, each written sorted by key; keeper is null in rows that only count.

    With a `root` of its own, the list of runs is written there after every batch, a version each, and LineRuns.open()
    takes them up again: a later batch, in a later job, meets all that came before.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, root: str | None = None) -> None:
        self.spark, self.fanout, self.root, self.version, self.levels = spark, fanout, root, 0, [[]]

    @classmethod
    def open(cls, spark: SparkSession, root: str, fanout: int = 3) -> LineRuns:
        """The runs of the last version written to `root`: one row a run, and there are few."""
        own = cls(spark, fanout, root)
        listed = spark.read.schema("level int, place int, path string, version int").parquet(f"{root}/manifest").collect()
        own.version = max((r["version"] for r in listed), default=0)
        for r in sorted((r for r in listed if r["version"] == own.version), key=lambda r: (r["level"], r["place"])):
            own._put(r["level"], r["path"])
        return own

    def _put(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(path)

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.root}/run-{uuid.uuid4().hex}" if self.root else shared_path(self.spark, f"lines-{level}")
        run.repartition(partitions(self.spark), *KEY).sortWithinPartitions(*KEY).write.option("compression", "zstd").parquet(path)
        self._put(level, path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged([self._read(p) for p in self.levels[level]])
            self.levels[level] = []
            self._write(merged, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def runs(self) -> list[DataFrame]:
        return [self._read(p) for level in self.levels for p in level]

    def add(self, batch: DataFrame) -> None:
        """batch: __id, h1, h2."""
        keys = batch.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("__id").alias("keeper"))
        if runs := self.runs():
            known = functools.reduce(DataFrame.unionByName, runs).where("keeper is not null").select(*KEY, F.lit(True).alias("known"))
            keys = keys.join(known, KEY, "left").select(*KEY, "n_docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        self._write(keys, 0)
        if self.root:
            self.version += 1
            listed = [(level, i, p) for level, paths in enumerate(self.levels) for i, p in enumerate(paths)]
            self.spark.createDataFrame(listed, "level int, place int, path string").coalesce(1).write.parquet(f"{self.root}/manifest/version={self.version}")

    def totals(self) -> DataFrame:
        return self._merged(self.runs())


def lost_lines(lines: DataFrame, common: DataFrame, frequent: int) -> DataFrame:
    """__id, h1, h2 of the lines that go. Keys held by a `frequent`th of all lines or more, so at most `frequent`, are broadcast:
    theirs are never gathered in one task. The others are joined by key."""
    total = lines.count()
    common = materialise(common, "common")
    often = F.broadcast(common.where(F.col("n_docs") * frequent >= total).select(*KEY, "keeper"))
    rest = common.where(F.col("n_docs") * frequent < total).select(*KEY, "keeper")
    gone = lines.join(often, KEY).unionByName(lines.join(often, KEY, "left_anti").join(rest, KEY))
    return gone.where("__id < keeper").select("__id", *KEY)


def dedup_lines(docs: DataFrame, least: int = 20, holders: int = 3, batches: int = 4, fanout: int = 3, frequent: int = 1000) -> DataFrame:
    """docs without the lines whose key `holders` or more documents hold, except in the largest doc_id that holds it."""
    spark = docs.sparkSession
    lines = line_keys(docs, least)
    lo, hi = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first() or (0, 0)
    lo, hi = lo or 0, hi or 0
    step = max(1, -(-(hi - lo + 1) // batches))
    lines = materialise(lines.withColumn("batch", F.greatest(F.lit(0), F.floor((F.lit(hi) - F.greatest(F.col("__id"), F.lit(lo))) / step)).cast("int")), "lines")
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).drop("batch"))
    common = runs.totals().where(F.col("n_docs") >= holders)
    gone = lost_lines(lines, common, frequent)
    own, hashes = unused(docs, "__own"), unused(docs, "__gone")
    gone = gone.groupBy(F.col("__id").alias(own)).agg(F.collect_set(F.struct(*KEY)).alias(hashes))  # at most a text's own lines
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*kept, _id().alias(own)).join(gone, own, "left").drop(own)
    schema = joined.drop(hashes).withColumn("text", F.lit("")).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, n_lines, n_dropped = [], [], []
            at = {n: i for i, n in enumerate(frame.schema.names)}
            for text, gone in rows([frame], "text", hashes):
                lines = (text or "").split("\n")
                left = lines
                if gone:
                    lost = {(g["h1"], g["h2"]) for g in gone}
                    left = [x for x in lines if len(k := line_key(x)) < least or key_hash(k) not in lost]
                texts.append("\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else frame.column(at[n]) for n in names], names=names)

    return joined.mapInArrow(run, schema)


ORACLE = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id < keeper AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
