"""Running values, ranks, percentiles and nearest points where one group or one place holds most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lamella.operators import quadtree, scans, spatial, splits
from lamella.operators.scans import Scan


@pytest.fixture(params=[1, 13])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scan(spark, parts):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice("abc") if i % 20 else None, rng.randrange(500), i, rng.choice((None, 1, 2, 5))) for i in range(2000)]
    d = spark.createDataFrame(rows, "g string, o int, id int, v int")
    got = scans.scan(d, ["g"], [F.desc("o"), "id"], s=Scan("v", total="all"), m=Scan("v", "max", inclusive=False), low=Scan(F.col("v") * 2, "min"))
    got = {r.id: (r.s, r["all"], r.m, r.low) for r in got.collect()}
    state, total = {}, {}
    for g, _, _, v in rows:
        if v is not None:
            total[g] = total.get(g, 0) + v
    for g, _, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        s, m, low = state.get(g, (None, None, None))
        before = m
        if v is not None:
            s, m, low = (s or 0) + v, max(v, m or 0), min(2 * v, low or 99)
        state[g] = s, m, low
        assert got[i] == (s, total.get(g), before, low)


def test_one_group_lies_in_many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        d = spark.range(20_000).withColumn("g", F.lit("all"))
        ranked = scans.ranked(d, ["g"], [F.desc("id")], members="n")
        assert ranked.where("place <> 20000 - id or n <> 20000").count() == 0
        shares = d.repartitionByRange(13, "g", F.desc("id")).groupBy(F.spark_partition_id()).count().collect()
        assert len(shares) == 13 and max(r["count"] for r in shares) < 4_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_percentiles_to_the_bit(spark, parts):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice("ab"), rng.choice((rng.gauss(0, 1), 0.1, 1e300, None))) for i in range(3000)] + [(None, 7.25), ("one", 3.5), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.001, 0.25, 0.5, 0.95, 1.0]
    want = {r.g: r.q for r in d.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).where("q is not null").collect()}
    assert {r.g: r.q for r in scans.percentiles(d, ["g"], "v", shares).collect()} == want
    assert scans.percentiles(d, [], "v", [0.5]).first().q == [d.agg(F.median("v")).first()[0]]
    assert scans.percentiles(d.limit(0), ["g"], "v", [0.5]).count() == 0


def test_splits_of_one_group(spark, parts):
    d = spark.createDataFrame([("v", i) for i in range(300)] + [("w", i) for i in range(7)], "volume string, z int")
    held = splits.held_out_band(d, "volume", ["z"]).where("split <> 'train'").collect()
    assert sorted((r.volume, r.z) for r in held) == [("v", z) for z in range(255, 300)]
    drawn = splits.oversample(d, "volume", "z").groupBy("volume").count().collect()
    assert {r.volume: r["count"] for r in drawn} == {"v": 300, "w": 300}


def brute_nearest(a, b, same):
    out = {}
    for i, x, y in a:
        near = [(math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in b if not (same and i == j)]
        if near:
            out[i] = (min(near)[1], min(near)[0])
    return out


@pytest.mark.parametrize("same", [False, True])
def test_nearest(spark, same):
    """Dense and empty places, copies of places, and searches far outside."""
    rng = random.Random(3)
    spots = [(rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for _ in range(400)] + [(rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for _ in range(150)]
    b = [(i, *p) for i, p in enumerate(spots)] + [(1000 + i, 5.0, 5.0) for i in range(200)] + [(2000, *spots[0])]
    a = b if same else [(i, rng.uniform(-5000, 5000), rng.uniform(-2000, 2000)) for i in range(200)] + [(300 + i, *spots[i]) for i in range(50)]
    frame = lambda rows: spark.createDataFrame([*rows, (9001, None, 1.0), (9002, float("nan"), 1.0)], "point_id int, x double, y double")
    got = {r.point_id: (r.near_id, r.distance) for r in spatial.nearest(frame(a), frame(b), same=same).collect()}
    want = brute_nearest(a, b, same)
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(got[i][1] == pytest.approx(d, rel=1e-12) for i, (_, d) in want.items())
    assert spatial.nearest(frame(a), frame(b).limit(0)).count() == 0
    one = spark.createDataFrame([(1, 2.0, 2.0)], "point_id int, x double, y double")
    assert spatial.nearest(one, one, same=True).count() == 0 and spatial.nearest(one, one).count() == 1


def test_nearest_in_a_dense_place(spark):
    """Nine tenths of all points in a millionth of the plane, and as many searches there: rows that meet stay linear."""
    met = {}
    for n in (1000, 4000):
        dense = spark.range(n).select(F.col("id").alias("point_id"), (F.rand(1) / 1000).alias("x"), (F.rand(2) / 1000).alias("y"))
        wide = spark.range(n // 10).select((F.col("id") + n).alias("point_id"), (F.rand(3) * 1000).alias("x"), (F.rand(4) * 1000).alias("y"))
        d = dense.unionByName(wide)
        tree = quadtree.grow(d, [])
        assert tree.points.groupBy("level", "lx", "ly").count().agg(F.max("count")).first()[0] <= 64
        met[n] = quadtree.leaves(tree, d, same=True).join(tree.points, ["level", "lx", "ly"]).count()
        assert met[n] <= 300 * n
    assert met[4000] <= 6 * met[1000]
