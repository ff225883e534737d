"""An inverted-file index over vectors: exact cosine neighbours by cells and bounds, and near neighbours by a few cells.

Every row goes to the cell of its nearest centre. A query knows its angle to each centre, and each cell its widest
angle, so no row of a cell can be nearer than the difference of the two: cells are searched by falling bound, and the
search of a query ends when its k-th best cosine is above the bound of all cells that are left. Centres come from a
bounded sample and decide the cost only, never an exact result.

Cells are cut into chunks of rows, and the queries of a cell into blocks, so a task holds one chunk and one block
whatever share of rows or queries a cell has. What is sent to the tasks is the centres: `cells` x dimensions.

Null vectors are no rows; a vector of length 0 has the cosine 0 with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.rounds import persist

#: Rows of a cell, and queries, that meet in one task.
CHUNK, BLOCK = 8192, 2048
#: Bounds are taken as that much higher, as cosines are rounded to nine digits.
SLACK = 2e-9


class Index(NamedTuple):
    """rows: id, u (a unit vector's bytes), cell, chunk. far: each cell's widest angle, below 0 where it is empty."""

    rows: DataFrame
    centres: np.ndarray
    far: np.ndarray
    chunks: DataFrame


def units(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def fit_centres(df: DataFrame, key: str, vector: str, cells: int, sample: int = 8192, rounds: int = 8) -> np.ndarray:
    """Centres by spherical k-means over at most `sample` rows, the first in hash order: what the driver holds is bounded."""
    took = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(sample).toPandas()
    if took.empty:
        return np.zeros((0, 0))
    v = units(np.array(took["v"].tolist(), float))
    centres = v[:: max(1, len(v) // max(1, cells))][:cells]
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, v)
        alive = (sums * sums).sum(axis=1) > 0
        centres = np.where(alive[:, None], units(sums), centres)
    return centres


def build(df: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = 8192) -> Index:
    """cells: by default the square root of the number of rows, or as many as have 1,024 rows each; 4,096 at most."""
    d = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if not cells:
        n = d.count()
        cells = int(min(4096, max(1, min(n**0.5, n / 1024))))
    centres = fit_centres(d, "id", "v", cells, sample)
    kind = d.schema["id"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = units(_matrix(batch["v"]))
                dots = u @ centres.T
                cell = dots.argmax(axis=1)
                angle = np.arccos(np.clip(dots[np.arange(len(u)), cell], -1, 1))
                cell[~u.any(axis=1)] = len(centres)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x.tobytes() for x in u], pa.binary()), pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "u", "cell", "angle"])

    rows = persist(d.mapInArrow(assigned, f"id {kind}, u binary, cell int, angle double"))
    sizes = rows.groupBy("cell").agg(F.max("angle").alias("far"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = persist(sizes)  # a row a cell
    far = np.full(len(centres) + 1, -1.0)
    for r in sizes.collect():
        far[r.cell] = r.far
    rows = rows.drop("angle").join(F.broadcast(sizes.drop("far")), "cell")
    return Index(rows.select("id", "u", "cell", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk")), centres, far, sizes.drop("far"))


def bounds(index_centres: np.ndarray, far: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The highest cosine that each query (row) can have with a row of each cell; -2 where a cell is empty."""
    angle = np.arccos(np.clip(u @ index_centres.T, -1, 1))
    best = np.cos(np.maximum(0, angle - far[:-1])) + SLACK
    none = np.full((len(u), 1), SLACK)  # the cell of vectors of length 0
    best = np.where(u.any(axis=1)[:, None], best, SLACK)
    return np.where(far < 0, -2.0, np.hstack([best, none]))


def _asked(df: DataFrame, key: str, vector: str) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = units(_matrix(batch["v"]))
                yield pa.RecordBatch.from_arrays([batch["query"], pa.array([x.tobytes() for x in u], pa.binary())], names=["query", "u"])

    d = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v"))
    return d.mapInArrow(made, f"query {d.schema['query'].dataType.simpleString()}, u binary")


def _cells(index: Index, first: int, more: int) -> Callable:
    """For queries (query, u, worst) the cells from the first-th on by falling bound, while the bound is not below worst."""
    centres, far = index.centres, index.far

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = np.array([np.frombuffer(x) for x in batch["u"].to_pylist()])
            worst = np.array([-1.5 if x is None else x for x in batch["worst"].to_pylist()])
            reach = bounds(centres, far, u)
            order = np.argsort(-reach, axis=1, kind="stable")[:, first : first + more]
            ok = np.take_along_axis(reach, order, axis=1) >= worst[:, None]
            at, col = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(at)), batch["u"].take(pa.array(at)), pa.array(order[at, col], pa.int32())], names=["query", "u", "cell"])

    return made


def _meet(index: Index, wanted: DataFrame, found: Callable, schema: str) -> DataFrame:
    """found(rows' ids, rows' vectors, queries' ids, queries' vectors) for each chunk of a cell and each block of its queries."""
    blocks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    q = wanted.join(F.broadcast(blocks), "cell").join(F.broadcast(index.chunks), "cell")  # a row a cell
    q = q.withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    r = index.rows.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["cell", "chunk", "block"]

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame()
        v, u = (np.array([np.frombuffer(x) for x in d["u"]]) for d in (a, b))
        return found(a["id"].to_numpy(), v, b["query"].to_numpy(), u)

    return r.select("id", "u", *place).groupBy(*place).cogroup(q.select("query", "u", *place).groupBy(*place)).applyInPandas(one, schema)


def _best(k: int) -> Callable:
    def found(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, u: np.ndarray) -> pd.DataFrame:
        cosine = np.round(u @ v.T, 9) + 0.0
        cosine[queries[:, None] == ids[None, :]] = -2
        by_id = np.argsort(ids, kind="stable")
        order = by_id[np.argsort(-cosine[:, by_id], axis=1, kind="stable")[:, :k]]
        d = pd.DataFrame({"query": np.repeat(queries, order.shape[1]), "id": ids[order].ravel(), "cosine": np.take_along_axis(cosine, order, axis=1).ravel()})
        return d[d["cosine"] > -2]

    return found


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, exact: bool = True) -> DataFrame:
    """query, id, cosine, rank, cells: the k nearest other rows of each query; of equal cosines (nine digits) the least id.

    exact: cells are searched, twice as many each time, until no cell that is left can hold a nearer row. Else only the
    `probes` cells of the highest bounds are. cells: how many cells the query was compared with.
    """
    n = len(index.far)
    probes = probes or max(8, n // 16)
    asked = persist(_asked(queries, key, vector))
    kind = index.rows.schema["id"].dataType.simpleString()
    shape = f"query {asked.schema['query'].dataType.simpleString()}, id {kind}, cosine double"
    by_rank = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    best = touched = None
    first, more = 0, probes
    while first < n:
        if best is None:
            d = asked.withColumn("worst", F.lit(None).cast("double"))
        else:
            worst = best.groupBy("query").agg(F.min("cosine").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
            d = asked.join(worst, "query", "left")
        wanted = persist(d.mapInArrow(_cells(index, first, more), f"query {asked.schema['query'].dataType.simpleString()}, u binary, cell int"))
        if wanted.isEmpty():
            break
        met = _meet(index, wanted, _best(k), shape)
        met = met if best is None else best.unionByName(met)
        best = persist(met.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).drop("rank"))
        own = wanted.groupBy("query").agg(F.count("*").alias("cells"))
        touched = own if touched is None else touched.unionByName(own)
        if not exact:
            break
        first, more = first + more, 2 * more
    if best is None:
        return asked.sparkSession.createDataFrame([], f"{shape}, rank int, cells long")
    ranked = best.withColumn("rank", F.row_number().over(by_rank))
    return ranked.join(touched.groupBy("query").agg(F.sum("cells").alias("cells")), "query")


def near(index: Index, queries: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """query, id, cosine: all other rows whose cosine with a query is at least `least`, exactly."""

    def found(ids: np.ndarray, v: np.ndarray, asked_: np.ndarray, u: np.ndarray) -> pd.DataFrame:
        cosine = u @ v.T
        cosine[asked_[:, None] == ids[None, :]] = -2
        at, col = np.nonzero(cosine >= least)
        return pd.DataFrame({"query": asked_[at], "id": ids[col], "cosine": cosine[at, col]})

    asked = _asked(queries, key, vector).withColumn("worst", F.lit(float(least)))
    q = asked.schema["query"].dataType.simpleString()
    wanted = persist(asked.mapInArrow(_cells(index, 0, len(index.far)), f"query {q}, u binary, cell int"))
    return _meet(index, wanted, found, f"query {q}, id {index.rows.schema['id'].dataType.simpleString()}, cosine double")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours (query, id) that were found."""
    hits = truth.select("query", "id").join(found.select("query", "id"), ["query", "id"], "left_semi").count()
    return hits / max(1, truth.count())
