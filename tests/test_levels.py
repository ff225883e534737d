"""Boxes of every size against all pairs, areas of many boxes of one key, and the randomness null off the tissue."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lamella.operators import analysis, labels, levels, spatial


def mixed(n, seed, big=3):
    rng = random.Random(seed)
    out = [(i, x := rng.uniform(0, 1000), y := rng.uniform(-500, 500), x + (w := 10 ** rng.uniform(-2, 2)), y + w * rng.uniform(0.1, 10)) for i in range(n)]
    return out + [(n + i, -10.0, -600.0, 1010.0 + i, 600.0) for i in range(big)] + [(n + 50, 5.0, 5.0, 5.0, 9.0), (n + 51, 8.0, 8.0, 16.0, 16.0), (n + 52, 16.0, 8.0, 24.0, 16.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")


def test_overlaps_of_mixed_boxes(spark):
    a, b = mixed(150, 1), mixed(200, 2)
    got = {(r.a_id, r.b_id): r.shared for r in spatial.overlaps(frame(spark, a), frame(spark, b)).collect()}
    want = {}
    for i, *p in a:
        for j, *q in b:
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            if w > 0 and h > 0:
                want[i, j] = w * h
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert spatial.overlaps(frame(spark, a), frame(spark, b).limit(0)).count() == 0


def test_boxes_are_sent_to_few_cells(spark):
    """A box over the whole image is a handful of rows, not one for every small box's cell."""
    b = levels.levelled(frame(spark, mixed(300, 3)))
    used = levels.used(b)
    assert levels.owned(b).groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    assert levels.visited(b, used, True).groupBy("id").count().agg(F.max("count")).first()[0] <= 4 * len(used)


def test_points_in_mixed_boxes(spark):
    rng = random.Random(4)
    b = mixed(200, 5)
    p = [(i, rng.uniform(-50, 1100), rng.uniform(-700, 700)) for i in range(300)] + [(900, 8.0, 8.0), (901, 16.0, 16.0), (902, 16.0, 8.0)]
    points = spark.createDataFrame(p, "point_id int, x double, y double")
    got = {(r.point_id, r.id) for r in spatial.containing(points, frame(spark, b)).collect()}
    assert got == {(i, j) for i, x, y in p for j, x0, y0, x1, y1 in b if x0 <= x < x1 and y0 <= y < y1}


def test_union_area_of_one_key(spark, monkeypatch):
    """Hundreds of boxes of a key, nested, equal and apart, without a join of all with all."""
    monkeypatch.setattr(levels, "PIECES", 8)
    rng = random.Random(6)
    rows = [(1, x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for _ in range(300)] + [(1, i, i, 60 - i, 60 - i) for i in range(20)] + [(2, 0, 0, 4, 4)] * 50 + [(3, 1, 1, 1, 5)]
    d = spark.createDataFrame(rows, "k int, x0 int, y0 int, x1 int, y1 int")
    want = defaultdict(set)
    for k, x0, y0, x1, y1 in rows:
        want[k] |= {(x, y) for x in range(x0, x1) for y in range(y0, y1)}
    assert {r.k: r.area for r in levels.union_area(d, "k").collect()} == {k: len(v) for k, v in want.items() if v}


def test_candidates_by_ground(spark):
    a, b = mixed(40, 7, 0), mixed(3, 8, 0)
    free, reviewed = spatial.partition_candidates(frame(spark, a), frame(spark, b))
    hit = {r.a_id for r in spatial.overlaps(frame(spark, a), frame(spark, b)).collect()}
    assert {r.id for r in reviewed.collect()} == hit and {r.id for r in free.collect()} == {r[0] for r in a} - hit


@pytest.fixture(scope="module")
def tissue(spark):
    """A tissue, a label in a quarter of it that reaches beyond, 60 points on it and 3,000 off it."""
    runs = [(1, "tissue", y, 0, 19) for y in range(20)] + [(1, "in", y, 0, 9) for y in range(10)] + [(1, "in", y, 0, 99) for y in range(50, 60)]
    on = [(1, i, float(i * 7 % 20), float(i * 3 % 20)) for i in range(60)]
    off = [(1, 1000 + i, float(i % 100), 50.0 + i % 10) for i in range(3000)]
    make = lambda rows: spark.createDataFrame(rows, "image int, point_id int, x double, y double")
    return spark.createDataFrame(runs, "image int, label string, y int, x0 int, x1 int"), make(on), make(on + off), on


def drawn(n, seed, reps):
    """The places of each replicate, in plain Python: a tissue of 20 by 20."""
    import hashlib

    at = lambda rep, i: int(hashlib.md5(f"{seed}:1:{rep}:{i}".encode()).hexdigest()[:15], 16) % 400
    return [[divmod(at(rep, i), 20)[::-1] for i in range(1, n + 1)] for rep in range(reps)]


def summary(observed, null):
    mean = sum(null) / len(null)
    sd = math.sqrt(sum((x - mean) ** 2 for x in null) / (len(null) - 1))
    return observed, mean, sd, (observed - mean) / sd, (sum(abs(x - mean) >= abs(observed - mean) for x in null) + 1) / (len(null) + 1)


def test_points_off_the_tissue_change_nothing(spark, tissue):
    runs, on, every, rows = tissue
    areas = analysis.compartment_areas(runs, "image", "tissue").where("label = 'in'").select("image", "label", "fraction")
    inside = lambda x, y: x < 10 and y < 10
    share = lambda places: sum(inside(x, y) for x, y in places) / len(places) / 0.25
    want = summary(share([(x, y) for *_, x, y in rows]), [share(p) for p in drawn(60, "s", 25)])
    for points in (on, every):
        r = analysis.randomness(points, runs, areas, "image", "tissue", 25, "s").first()
        assert (r.observed, r.null_mean, r.null_sd, r.z, r.p) == pytest.approx(want)


def test_null_counts_without_places(spark, tissue, monkeypatch):
    """Where more is drawn than the mask has pixels, no place meets the runs by itself; the same values either way."""
    runs, _, every, _ = tissue
    extra = spark.createDataFrame([(1, "other", y, x, x + 7) for y in range(25) for x in (2, 6, 11)] + [(1, "none", 900, 0, 4)], runs.schema)
    runs = runs.unionByName(extra)
    areas = analysis.compartment_areas(runs, "image", "tissue").select("image", "label", "fraction")
    by_place = lambda p, a, unit: analysis.enrichment(analysis.assign_points(p, runs, "image"), a, unit)
    shown = lambda metric: [sorted(map(tuple, d.select("label", "enrichment", *d.columns[3:]).collect()), key=str) for d in (x.select("image", "label", "enrichment", *[c for c in x.columns if c == "rep"]) for x in analysis.randomised(every, runs, areas, "image", "tissue", 25, "s", metric))]
    want = shown(by_place)
    monkeypatch.setattr(analysis, "null_draws", None)
    assert shown(None) == want and len(want[1]) == 25 * areas.count()


def test_ties_about_the_mean(spark):
    """A value as far above the mean as the observed one is below counts, whatever the order of the sum; a nearer one doesn't."""
    low, rows, seen, want = [45] * 13 + [47] * 6 + [46] * 2 + [40] * 35 + [50] * 15 + [52] * 21 + [49] * 2 + [51] * 5, [], [], {}
    assert (len(low), sum(low)) == (99, 99 * 46)
    for image in range(60):
        more, base = image % 3 - 1, 10**9 * (image % 2)
        counts = [base + n for n in low[:-1] + [low[-1] + more]]
        random.Random(image).shuffle(counts)
        share = lambda n: n / 2871 / 0.0158
        rows += [(image, rep, share(n)) for rep, n in enumerate(counts)]
        seen.append((image, share(base + 45)))
        want[image] = (sum(abs(99 * n - sum(counts)) >= abs(99 * (base + 45) - sum(counts)) for n in counts) + 1) / 100
    got = analysis.null_summary(spark.createDataFrame(seen, "image int, e double"), spark.createDataFrame(rows, "image int, rep int, e double"), ["image"], "e")
    assert {r.image: r.p for r in got.collect()} == want and set(want.values()) == {0.92, 0.98}


def test_any_statistic_on_both_sides(spark, tissue):
    """The mean of x as the statistic; and a constant, whose null is the constant."""
    runs, _, every, rows = tissue
    areas = spark.createDataFrame([(1, "x", 1.0)], "image int, label string, fraction double")
    mean = lambda places: sum(x for x, _ in places) / len(places)
    metric = lambda p, a, unit: p.groupBy(unit).agg(F.avg("x").alias("enrichment")).withColumn("label", F.lit("x"))
    r = analysis.randomness(every, runs, areas, "image", "tissue", 15, "t", metric).first()
    assert (r.observed, r.null_mean, r.null_sd, r.z, r.p) == pytest.approx(summary(mean([(x, y) for *_, x, y in rows]), [mean(p) for p in drawn(60, "t", 15)]))
    seven = lambda p, a, unit: a.select(unit, "label", F.lit(7.0).alias("enrichment"))
    r = analysis.randomness(every, runs, areas, "image", "tissue", 15, "t", seven).first()
    assert (r.observed, r.null_mean, r.null_sd, r.z, r.p) == (7.0, 7.0, 0.0, None, None)


def test_self_check(spark, tissue):
    runs, *_ = tissue
    areas = analysis.compartment_areas(runs, "image", "tissue").where("label = 'in'").select("image", "label", "fraction")
    more = areas.unionByName(spark.createDataFrame([(2, "in", 0.0)], areas.schema))
    got = {r.image: r for r in analysis.self_check(runs, more, "image", "tissue", "c").collect()}
    places = drawn(400, "c", 1)[0]
    assert got[1].n_points == 400 and got[1].worst == pytest.approx(abs(sum(x < 10 and y < 10 for x, y in places) / 400 / 0.25 - 1))
    assert (got[2].n_points, got[2].worst) == (0, None)


def copied(copies, n=40):
    """Some boxes, a few without an area, and so many copies of each."""
    rng = random.Random(8)
    shapes = [(x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(0, 14), y + rng.randrange(0, 14), rng.randrange(8), rng.choice(["confirmed", "excluded"])) for _ in range(n)]
    return [(100 * k + i, *s) for i, s in enumerate(shapes) for k in range(copies)]


def shared(p, q):
    w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
    return w * h if w > 0 and h > 0 else 0


def area(p):
    return (p[3] - p[1]) * (p[4] - p[2])


def brute(kind, boxes):
    new, kept = [b for b in boxes if b[0] % 2 == 0], [b for b in boxes if b[0] % 2]
    if kind == "overlaps":
        return {(p[0], q[0], s) for p in new for q in kept if (s := shared(p, q))}
    if kind == "protected":
        return {p[0] for p in new if not any((s := shared(p, q)) and s / min(area(p), area(q)) >= (0.3 if q[6] == "confirmed" else 0.8) for q in kept)}
    if kind == "covered":
        cells = {p[0]: {(x, y) for q in kept for x in range(max(p[1], q[1]), min(p[3], q[3])) for y in range(max(p[2], q[2]), min(p[4], q[4]))} for p in new}
        return {(p[0], "delete" if len(cells[p[0]]) / area(p) >= 0.7 else "trim") for p in new if cells[p[0]]}
    if kind == "merged":
        root = {b[0]: b[0] for b in boxes}
        links = [(p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and (s := shared(p, q)) and s / min(area(p), area(q)) > 0.7]
        for _ in boxes:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return {(a, root[a]) for link in links for a in link}
    taken = []
    for p in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if not any(shared(p, q) for q in taken):
            taken.append(p)
    return {p[0] for p in taken}


@pytest.mark.parametrize("kind", ["overlaps", "protected", "covered", "merged", "greedy"])
def test_equal_boxes_meet_once(spark, monkeypatch, kind):
    """Twelve copies of every box give the results of a plain loop, and no more rows meet than without copies."""
    found, real = [], levels.meetings
    monkeypatch.setattr(levels, "meetings", lambda a, b, keys=(): found.append((d := real(a, b, keys)).count()) or d)
    for copies in (1, 12):
        boxes = copied(copies)
        d = spark.createDataFrame(boxes, "id long, x0 long, y0 long, x1 long, y1 long, s long, state string")
        new, kept = d.where("id % 2 = 0"), d.where("id % 2 = 1")
        made = {
            "overlaps": lambda: spatial.overlaps(new, kept).select("a_id", "b_id", "shared"), "protected": lambda: spatial.protected(new, kept).select("id"), "covered": lambda: spatial.covered(new, kept),
            "merged": lambda: spatial.merged(d), "greedy": lambda: spatial.greedy(d, "s").select("id"),
        }[kind]().collect()
        got = [tuple(r) if len(r) > 1 else r[0] for r in made]
        assert len(got) == len(set(got)) and set(got) == brute(kind, boxes)
    assert len(found) == 2 and found[0] == found[1] > 0


def test_many_equal_boxes_as_several_rows(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MEMBERS", 10)
    d = spark.range(100).selectExpr("id", "0L as x0", "0L as y0", "2L as x1", "3L as y1")
    assert spatial.gathered(d).count() > 5
    assert {(r.a_id, r.b_id) for r in spatial.overlaps(d, d).collect()} == {(i, j) for i in range(100) for j in range(100)}


def test_shifts_of_equal_tiles(spark, monkeypatch):
    """Tiles in one place, of which few get a window, and places near each other: as one tile after another, but in few rounds."""
    kept, real = [], spatial.persist
    monkeypatch.setattr(spatial, "persist", lambda d: kept.append(1) or real(d))
    rng = random.Random(2)
    order = {(k, dx, dy): rng.random() for k in range(6) for dx in (0, 5) for dy in (0, 5)}
    places = [(k % 6, t) for t, k in enumerate(rng.randrange(60) for _ in range(400))]
    cands = [(t, 7 * (p % 3) + dx, 7 * (p // 3) + dy, order[p, dx, dy]) for p, t in places for dx in (0, 5) for dy in (0, 5)]
    got = {r.k: (r.cx, r.cy) for r in spatial.choose_shift(spark.createDataFrame(cands, "k int, cx int, cy int, s double"), "k", [F.desc("s")], 8, 0.3).collect()}
    taken = {}
    for t in range(400):
        for _, cx, cy, _s in sorted((c for c in cands if c[0] == t), key=lambda c: -c[3]):
            if all(max(0, 8 - abs(cx - x)) * max(0, 8 - abs(cy - y)) <= 0.3 * 64 for x, y in taken.values()):
                taken[t] = (cx, cy)
                break
    assert got == taken and len(taken) > 3 and len(kept) < 40


def test_boundary_of_runs(spark):
    """The same pixels as by looking at each one's neighbours; a large square is never written out."""
    rng = random.Random(4)
    cells = {(k, x, y) for k in range(3) for _ in range(25) for x0, y0 in [(rng.randrange(40), rng.randrange(20))] for x in range(x0, x0 + rng.randrange(1, 9)) for y in range(y0, y0 + 4)}
    cells |= {(1, x, 50) for x in range(5)} | {(1, 7, 50), (1, 9, 50), (1, 10, 50)}
    runs = spatial.runs_of(spark.createDataFrame(sorted(cells), "k int, x int, y int"), ["k"])
    got = [tuple(r) for r in labels.run_boundary(runs, ["k"]).select("k", "x", "y").collect()]
    assert sorted(got) == sorted((k, x, y) for k, x, y in cells if not {(k, x + 1, y), (k, x - 1, y), (k, x, y + 1), (k, x, y - 1)} <= cells)
    square = spark.range(100_000).selectExpr("1 as k", "id as y", "0L as x0", "99999L as x1")
    assert labels.run_boundary(square, ["k"]).count() == 4 * 99_999
