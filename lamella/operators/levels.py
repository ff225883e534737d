"""A grid of levels for boxes of any size: each box lies at the level whose cells are about as wide as it.

A box touches at most four cells at its own level. Two boxes meet at the level of the larger: there it is the owner of
its cells, and the smaller one visits those that it lies in. So a box is sent to four cells a level at most, and only
owners meet visitors, whatever sizes are mixed. Levels are powers of two; those in use, a few dozen numbers at most,
are the only thing that the driver sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.rounds import persist

#: A node of a key's plane with more pieces of boxes is cut in four.
PIECES, ROUNDS = 32, 40


def levelled(boxes: DataFrame) -> DataFrame:
    """Boxes with an area and their `level`; others can't meet anything."""
    width = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
    return boxes.where("x1 > x0 and y1 > y0").withColumn("level", F.ceil(F.log2(width)).cast("int"))


def used(boxes: DataFrame) -> list[int]:
    return sorted(r.level for r in boxes.select("level").distinct().collect())


def _in_cells(d: DataFrame) -> DataFrame:
    width = F.pow(F.lit(2.0), F.col("at"))
    across = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    return d.withColumn("cx", across("x0", "x1")).withColumn("cy", across("y0", "y1"))


def owned(boxes: DataFrame) -> DataFrame:
    """The cells of boxes at their own level, as at, cx, cy."""
    return _in_cells(boxes.withColumn("at", F.col("level")))


def visited(boxes: DataFrame, levels: Sequence[int], same: bool) -> DataFrame:
    """The cells that boxes lie in at the coarser ones of `levels`; same: at their own, too."""
    every = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    fits = (lambda x: x >= F.col("level")) if same else (lambda x: x > F.col("level"))
    return _in_cells(boxes.withColumn("at", F.explode(F.filter(every, fits))))


def meetings(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1, keys) with common area, each once, as columns a_.. and b_.., with the keys."""
    a, b = levelled(a), levelled(b)
    la, lb = used(a), used(b)
    pre = lambda df, p: df.select(*keys, "at", "cx", "cy", *[F.col(c).alias(p + c) for c in ("id", "x0", "y0", "x1", "y1")])
    on = [*keys, "at", "cx", "cy"]
    d = pre(owned(a), "a_").join(pre(visited(b, la, True), "b_"), on)
    d = d.unionByName(pre(visited(a, lb, False), "a_").join(pre(owned(b), "b_"), on))
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    width = F.pow(F.lit(2.0), F.col("at"))
    here = (F.floor(left / width) == F.col("cx")) & (F.floor(top / width) == F.col("cy"))  # the cell of what is common
    return d.where((F.least("a_x1", "b_x1") > left) & (F.least("a_y1", "b_y1") > top) & here).drop("at", "cx", "cy")


def holding(points: DataFrame, boxes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points (x, y, keys) with the boxes (id, keys) around them, the low edges included and the high ones not."""
    b = levelled(boxes)
    every = F.array(*[F.lit(x) for x in used(b)]).cast("array<int>")
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("at")))
    p = points.withColumn("at", F.explode(every)).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    r = owned(b).select(*keys, "id", "x0", "y0", "x1", "y1", "at", "cx", "cy")
    return p.join(r, [*keys, "at", "cx", "cy"]).where("x >= x0 and x < x1 and y >= y0 and y < y1").drop("at", "cx", "cy", "x0", "y0", "x1", "y1")


def slab_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area: what few boxes of a key cover together. Their edges cut it into slabs, and in each the parts that its boxes add from left to right are summed."""
    edges = boxes.select(*keys, F.explode(F.array("y0", "y1")).alias("top")).distinct()
    slabs = edges.withColumn("low", F.lead("top").over(Window.partitionBy(*keys).orderBy("top"))).where("low is not null")
    d = boxes.join(slabs, keys).where("top >= y0 and low <= y1")
    reach = F.max("x1").over(Window.partitionBy(*keys, "top").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("x1") - F.greatest(F.col("x0"), F.coalesce(reach, F.col("x0"))), F.lit(0.0))
    return d.withColumn("added", added * (F.col("low") - F.col("top"))).groupBy(*keys).agg(F.sum("added").alias("area"))


def union_area(boxes: DataFrame, key: str) -> DataFrame:
    """key, area: what the boxes (key, x0, y0, x1, y1) of each key cover together.

    A key's plane is cut in four wherever many pieces of boxes lie, again and again; a node that one piece covers is
    done, equal pieces are one, and a node with few pieces is measured by slabs. So boxes of one key are never compared
    all with all. (Pieces that can't be told apart after ROUNDS halvings are measured together.)
    """
    node, corners = ["u0", "v0", "u1", "v1"], ["x0", "y0", "x1", "y1"]
    d = boxes.where("x1 > x0 and y1 > y0").select(key, *[F.col(c).cast("double").alias(c) for c in corners]).distinct()
    ends = d.groupBy(key).agg(F.min("x0").alias("u0"), F.min("y0").alias("v0"), F.max("x1").alias("u1"), F.max("y1").alias("v1"))
    open_, out = persist(d.join(ends, key)), []
    for i in range(ROUNDS + 1):
        whole = F.bool_or(F.expr("x0 <= u0 and y0 <= v0 and x1 >= u1 and y1 >= v1"))
        state = open_.groupBy(key, *node).agg(F.count("*").alias("n"), whole.alias("whole"))
        out.append(state.where("whole").select(key, ((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area")))
        state = persist(state.where("not whole"))
        few = F.lit(True) if i == ROUNDS else F.col("n") <= PIECES
        out.append(slab_area(open_.join(state.where(few).select(key, *node), [key, *node], "left_semi"), [key, *node]).select(key, "area"))
        many = state.where(~few).select(key, *node)
        if i == ROUNDS or many.isEmpty():
            break
        mx, my = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2
        quarter = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, node, strict=True)])
        u0, v0, u1, v1 = map(F.col, node)
        parts = F.array(quarter(u0, v0, mx, my), quarter(mx, v0, u1, my), quarter(u0, my, mx, v1), quarter(mx, my, u1, v1))
        cut = open_.join(many, [key, *node], "left_semi").select(key, *corners, F.explode(parts).alias("q"))
        cut = cut.select(key, F.greatest("x0", "q.u0").alias("x0"), F.greatest("y0", "q.v0").alias("y0"), F.least("x1", "q.u1").alias("x1"), F.least("y1", "q.v1").alias("y1"), "q.*")
        open_ = persist(cut.where("x1 > x0 and y1 > y0").distinct())
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.groupBy(key).agg(F.sum("area").alias("area"))
