"""Nearest points by an adaptive quadtree: dense places have small leaves, and a search opens only boxes near enough.

The points' square is halved until each leaf holds a bounded number of places, by counts of cells: only points of cells
that hold too many are counted again, at a finer level. Leaves and the cells above them have the tight boxes of their
points. All searches go down the tree together, some levels a join: a box stays only if it can hold a nearer point than
another box of the search must. Points meet searches in leaves only, so rows grow with the number of points and
searches, wherever they lie.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.rounds import persist

#: Halvings of the square at most, and those that one join goes down.
DEPTH, STEP = 30, 3
#: So many boxes (about 80 bytes each) are sent to all tasks at most.
FEW = 1 << 16
#: Boxes are taken as that much nearer than they are, as distances are rounded.
SLACK = 1 - 1e-12


class Tree(NamedTuple):
    """points: a row a place with its leaf (level, lx, ly), the least id there and the next one. nodes: the cells that
    hold points, with their boxes, and whether they are leaves. sizes: how many nodes a level has. square: its low
    corner and its side."""

    points: DataFrame
    nodes: DataFrame
    sizes: dict[int, int]
    square: tuple[float, float, float]
    keys: list[str]


def _at(level: int) -> list[Column]:
    return [F.shiftright(c, DEPTH - level).alias(a) for c, a in (("gx", "lx"), ("gy", "ly"))]


def _cell(square: tuple[float, float, float], x: str, y: str) -> dict[str, Column]:
    """The finest cell of a place; places outside the square lie in cells at its edge."""
    x0, y0, side = square
    last = (1 << DEPTH) - 1
    at = lambda c, low: F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(c) - low) / side * (1 << DEPTH)))).cast("long")
    return {"gx": at(x, x0), "gy": at(y, y0)}


def grow(points: DataFrame, keys: list[str], leaf: int = 64) -> Tree:
    """The tree over points (point_id, x, y, and columns `keys` that part them). Equal places are one, so leaves can be bounded."""
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("x", "y"))
    d = points.where(ok).select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "point_id")
    first = d.groupBy(*keys, "x", "y").agg(F.min("point_id").alias("id1"), F.max("point_id").alias("__top"))
    first = first.withColumn("n", F.when(F.col("id1") == F.col("__top"), 1).otherwise(2)).drop("__top")
    more = d.join(first.where("n > 1").drop("n"), [*keys, "x", "y"]).where("point_id <> id1").groupBy(*keys, "x", "y").agg(F.min("point_id").alias("id2"))
    d = first.join(more, [*keys, "x", "y"], "left")
    d = persist(d)
    box = d.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count("*").alias("n")).first()
    square = (box.x0 or 0.0, box.y0 or 0.0, box.side or 1.0)
    open_ = d.withColumns(_cell(square, "x", "y"))
    level = min(DEPTH, max(0, math.ceil(math.log(max(1, box.n * 4 / leaf), 4))))
    top, done = level, None
    while True:
        cells = open_.select("*", *_at(level))
        heavy = cells.groupBy(*keys, "lx", "ly").agg(F.count("*").alias("__n")).where(F.col("__n") > leaf).drop("__n").withColumn("__heavy", F.lit(True))
        if level < DEPTH:
            marked = persist(cells.join(heavy, [*keys, "lx", "ly"], "left"))
            settled, open_ = marked.where("__heavy is null").drop("__heavy"), marked.where("__heavy").drop("__heavy", "lx", "ly")
        else:
            settled, open_ = cells, cells.limit(0)
        settled = settled.withColumn("level", F.lit(level))
        done = settled if done is None else done.unionByName(settled)
        if level == DEPTH or open_.isEmpty():
            break
        level = min(DEPTH, level + STEP)
    boxed = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n")]
    own = done.select(*keys, "level", "lx", "ly", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), "n")
    own = own.groupBy(*keys, "level", "lx", "ly").agg(*boxed)
    levels = sorted({0, *range(top, -1, -STEP), *range(top, level + 1, STEP), level})
    above = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x < F.col("level")))
    up = own.select(*keys, above.alias("at"), "level", "lx", "ly", "x0", "y0", "x1", "y1", "n")
    shift = lambda c: F.expr(f"shiftright({c}, level - at)")
    up = up.select(*keys, F.col("at").alias("level"), shift("lx").alias("lx"), shift("ly").alias("ly"), "x0", "y0", "x1", "y1", "n").groupBy(*keys, "level", "lx", "ly").agg(*boxed)
    nodes = persist(own.withColumn("leaf", F.lit(True)).unionByName(up.withColumn("leaf", F.lit(False))))
    sizes = dict.fromkeys(levels, 0) | {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}
    return Tree(done.select(*keys, "level", "lx", "ly", "x", "y", "id1", "id2"), nodes, sizes, square, keys)


def _nearest_of(box: str = "") -> Column:
    """The distance to a box."""
    out = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"{c}1"))
    return F.sqrt(F.pow(out("x"), 2) + F.pow(out("y"), 2))


def _sure(same: bool) -> Column:
    """A distance within which a box must hold a point: its far corner. With `same` one point of it may be the search's own."""
    far = lambda c: F.greatest(F.abs(F.col(f"{c}0") - F.col(f"q{c}")), F.abs(F.col(f"{c}1") - F.col(f"q{c}")))
    corner = F.sqrt(F.pow(far("x"), 2) + F.pow(far("y"), 2))
    return F.when((F.col("n") > 1) | (_nearest_of() > 0), corner) if same else corner


def _children(tree: Tree, levels: list[int], i: int) -> DataFrame:
    """The boxes of the i-th level and the leaves above it, with the box that holds each one level up: a leaf holds itself."""
    below = F.col("level") == levels[i]
    d = tree.nodes.where(below | (F.col("leaf") & (F.col("level") < levels[i])))
    up = levels[i] - levels[i - 1]
    d = d.withColumns({"plevel": F.when(below, levels[i - 1]).otherwise(F.col("level")), **{p: F.when(below, F.shiftright(c, up)).otherwise(F.col(c)) for p, c in (("px", "lx"), ("py", "ly"))}})
    return F.broadcast(d.drop("leaf")) if sum(tree.sizes[x] for x in levels[: i + 1]) <= FEW else d.drop("leaf")


def leaves(tree: Tree, asked: DataFrame, same: bool = False) -> DataFrame:
    """point_id, keys, qx, qy, level, lx, ly: the leaves that can hold the nearest point to each of `asked`, by their boxes."""
    keys, levels = tree.keys, sorted(tree.sizes)
    who = ["point_id", *keys, "qx", "qy"]
    q = asked.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("point_id", *keys, F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"))
    root = tree.nodes.where("level = 0").drop("leaf")
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = q.distinct().repartition(parts, *who)  # searches stay where they are, all the way down
    # a first bound: what the cells that hold the search's own place are sure of
    own = q.withColumns(_cell(tree.square, "qx", "qy")).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    own = own.select(*who, "level", *[F.expr(f"shiftright({g}, {DEPTH} - level)").alias(c) for g, c in (("gx", "lx"), ("gy", "ly"))])
    cells = tree.nodes.drop("leaf")
    own = own.join(F.broadcast(cells) if sum(tree.sizes.values()) <= FEW else cells, [*keys, "level", "lx", "ly"])
    met = own.groupBy(*who).agg(F.coalesce(F.min(_sure(same)), F.lit(float("inf"))).alias("bound"))
    met = met.join(root, keys) if keys else met.join(F.broadcast(root))  # one row
    held = None
    for i in range(len(levels)):
        if held is not None:
            met = held.select(*who, "bound", F.col("level").alias("plevel"), F.col("lx").alias("px"), F.col("ly").alias("py")).join(_children(tree, levels, i), [*keys, "plevel", "px", "py"])
        sure = F.least("bound", F.coalesce(_sure(same), F.lit(float("inf"))))
        near = met.select(*who, "level", "lx", "ly", (_nearest_of() * SLACK).alias("near"), sure.alias("sure")).where("near <= sure")
        held = near.withColumn("bound", F.min("sure").over(Window.partitionBy(*who))).where("near <= bound").drop("sure")  # the boxes of one search
        held = persist(held) if i % 4 == 3 else held
    return held


def search(tree: Tree, asked: DataFrame, same: bool = False) -> DataFrame:
    """point_id, near_id, distance and the tree's keys: the nearest point to each of `asked` (point_id, x, y, keys); the least id of equally near ones.

    same: a point isn't its own neighbour. Searches without a point to find, and those without coordinates, have no row.
    """
    keys = tree.keys
    found = leaves(tree, asked, same)
    other = tree.points.select(*keys, "level", "lx", "ly", F.col("x").alias("bx"), F.col("y").alias("by"), "id1", "id2")
    d = found.join(other, [*keys, "level", "lx", "ly"]).withColumn("distance", F.sqrt(F.pow(F.col("qx") - F.col("bx"), 2) + F.pow(F.col("qy") - F.col("by"), 2)))
    d = d.withColumn("near_id", F.when(F.col("id1") == F.col("point_id"), F.col("id2")).otherwise(F.col("id1")) if same else F.col("id1")).where("near_id is not null")
    return d.groupBy("point_id", *keys).agg(F.min(F.struct("distance", "near_id")).alias("m")).select("point_id", *keys, "m.near_id", "m.distance")
