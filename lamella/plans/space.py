"""Spatial queries: parts give boxes, events give points and sparse grids; geometry is the same arithmetic on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.numbers import hash01
from lamella.operators import analysis, labels, order, spatial, tiles, vectors
from lamella.plans.binding import Book, Tables

BOOK = Book()
EXTENT = 2000


def boxes(t: Tables) -> DataFrame:
    """id, x0, y0, x1, y1: integer boxes, so areas are exact."""
    x, y = (F.col("p_partkey") * 7919) % EXTENT, (F.col("p_partkey") * 104729) % EXTENT
    return t.part.select(F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 5 + F.col("p_size")).alias("x1"), (y + 5 + F.col("p_size") % 17).alias("y1"), "p_retailprice", "p_type")


def points(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("point_id"), ((F.col("event_id") * 31) % EXTENT).cast("double").alias("x"), ((F.col("event_id") * 577 + F.col("user_id")) % EXTENT).cast("double").alias("y"), "user_id", "event_type")


B_SQL = f"bx AS (SELECT p_partkey AS id, (p_partkey * 7919) % {EXTENT} AS x0, (p_partkey * 104729) % {EXTENT} AS y0, (p_partkey * 7919) % {EXTENT} + 5 + p_size AS x1, (p_partkey * 104729) % {EXTENT} + 5 + p_size % 17 AS y1, p_retailprice, p_type FROM part)"
P_SQL = f"pt AS (SELECT event_id AS point_id, ((event_id * 31) % {EXTENT})::DOUBLE AS x, ((event_id * 577 + user_id) % {EXTENT})::DOUBLE AS y, user_id, event_type FROM events)"
OV = "ov AS (SELECT a.id AS a_id, b.id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared, (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b FROM bx a JOIN bx b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"


@BOOK.add(f"WITH {B_SQL}, {OV} SELECT a_id, b_id, shared, area_a, area_b FROM ov WHERE a_id < b_id")
def boxes_overlap(t: Tables) -> DataFrame:
    return spatial.overlaps(boxes(t), boxes(t)).where("a_id < b_id")


@BOOK.add(f"""WITH {B_SQL}, {OV} SELECT id FROM bx WHERE id % 2 = 0 AND id NOT IN (SELECT a_id FROM ov JOIN bx b ON b.id = b_id WHERE b_id % 2 = 1 AND ((b.p_type = 'PROMO' AND shared / least(area_a, area_b) >= 0.3) OR (b.p_type <> 'PROMO' AND shared / least(area_a, area_b) >= 0.8)))""")
def protected_boxes(t: Tables) -> DataFrame:
    b = boxes(t)
    kept = b.where("id % 2 = 1").withColumn("state", F.when(F.col("p_type") == "PROMO", "confirmed").otherwise("excluded"))
    return spatial.protected(b.where("id % 2 = 0"), kept).select("id")


@BOOK.add(f"WITH {B_SQL}, {P_SQL} SELECT point_id, id FROM pt JOIN bx ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def point_in_region(t: Tables) -> DataFrame:
    return spatial.containing(points(t), boxes(t))


@BOOK.add(f"""WITH {B_SQL}, {OV}, cut AS (SELECT a_id, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1, greatest(a.y0, b.y0) AS y0, least(a.y1, b.y1) AS y1, area_a FROM ov JOIN bx a ON a.id = a_id JOIN bx b ON b.id = b_id WHERE a_id % 2 = 0 AND b_id % 2 = 1),
rows_ AS (SELECT a_id, area_a, x0, x1, unnest(range(y0, y1)) AS y FROM cut), cells AS (SELECT DISTINCT a_id, area_a, unnest(range(x0, x1)) AS x, y FROM rows_)
SELECT a_id AS id, CASE WHEN count(*) / area_a >= 0.7 THEN 'delete' ELSE 'trim' END AS action FROM cells GROUP BY a_id, area_a""")
def covered_boxes(t: Tables) -> DataFrame:
    b = boxes(t)
    return spatial.covered(b.where("id % 2 = 0"), b.where("id % 2 = 1"))


@BOOK.add(f"WITH {B_SQL}, {OV}, {P_SQL} SELECT id FROM bx WHERE id % 2 = 0 AND id NOT IN (SELECT a.id FROM bx a JOIN bx r ON r.id % 2 = 1 AND a.id % 2 = 0 AND (a.x0 + a.x1) / 2 >= r.x0 AND (a.x0 + a.x1) / 2 < r.x1 AND (a.y0 + a.y1) / 2 >= r.y0 AND (a.y0 + a.y1) / 2 < r.y1)")
def outside_regions(t: Tables) -> DataFrame:
    b = boxes(t)
    return spatial.outside_regions(b.where("id % 2 = 0"), b.where("id % 2 = 1")).select("id")


@BOOK.add(f"WITH {B_SQL}, {OV} SELECT id, id IN (SELECT a_id FROM ov WHERE b_id % 2 = 1) AS touched FROM bx WHERE id % 2 = 0")
def touched_boxes(t: Tables) -> DataFrame:
    b = boxes(t)
    some, regions = b.where("id % 2 = 0"), b.where("id % 2 = 1")
    return spatial.touched(some, regions).select("id", F.lit(True).alias("touched")).unionByName(spatial.untouched(some, regions).select("id", F.lit(False).alias("touched")))


@BOOK.add(f"""WITH RECURSIVE {B_SQL}, {OV}, l AS (SELECT a_id AS a, b_id AS b FROM ov WHERE a_id <> b_id AND shared / least(area_a, area_b) > 0.7), r(node, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a)
SELECT node, min(root) AS root FROM r GROUP BY 1""")
def merged_boxes(t: Tables) -> DataFrame:
    return spatial.merged(boxes(t))


@BOOK.add(f"""WITH {P_SQL}, q AS (SELECT * FROM pt WHERE point_id % 20 = 0), d AS (SELECT q.point_id, r.point_id AS near_id, sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2) AS distance FROM q JOIN pt r ON q.point_id <> r.point_id)
SELECT point_id, near_id, round(distance, 9) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY distance, near_id) = 1""")
def nearest(t: Tables) -> DataFrame:
    """The stated queries, ids divisible by 20, against all other points."""
    p = points(t)
    return spatial.nearest(p.where("point_id % 20 = 0"), p, same=True).withColumn("distance", F.round("distance", 9))


@BOOK.add(f"""WITH {P_SQL}, d AS (SELECT q.point_id, min(sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2)) AS distance FROM pt q JOIN pt r ON q.point_id <> r.point_id GROUP BY 1), b AS (SELECT CASE WHEN distance < 5 THEN 0 WHEN distance < 10 THEN 1 WHEN distance < 20 THEN 2 ELSE 3 END AS band, distance FROM d)
SELECT band, count(*) AS n, count(*) / (SELECT count(*) FROM d)::DOUBLE AS share, round((SELECT median(distance) FROM d), 9) AS median FROM b GROUP BY 1""")
def neighbour_bands(t: Tables) -> DataFrame:
    p = points(t)
    return spatial.distance_bands(spatial.nearest(p, p, same=True), [5.0, 10.0, 20.0]).withColumn("median", F.round("median", 9))


@BOOK.add(f"""WITH {P_SQL}, h AS (SELECT DISTINCT a.point_id FROM pt a JOIN pt b ON a.point_id % 2 = 0 AND b.point_id % 2 = 1 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100) SELECT event_type, count(h.point_id) / count(*)::DOUBLE AS contact, count(*) AS n FROM pt LEFT JOIN h USING (point_id) WHERE point_id % 2 = 0 GROUP BY 1""")
def contact_fraction(t: Tables) -> DataFrame:
    p = points(t)
    return spatial.contact_fraction(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), 10.0, "event_type")


@BOOK.add(f"""WITH {B_SQL}, {OV}, rk AS (SELECT id, row_number() OVER (ORDER BY p_retailprice DESC, id) AS n FROM bx), riv AS (SELECT a.n, list(b.n) AS rivals FROM ov JOIN rk a ON a.id = a_id JOIN rk b ON b.id = b_id WHERE b.n < a.n GROUP BY 1),
o AS (SELECT list(list_prepend(rk.n, coalesce(rivals, [])) ORDER BY rk.n) AS steps FROM rk LEFT JOIN riv USING (n)), c AS (SELECT unnest(list_reduce(list_prepend([]::BIGINT[], steps), lambda m, x: CASE WHEN list_has_any(m, x[2:]) THEN m ELSE list_append(m, x[1]) END)) AS n FROM o)
SELECT id FROM c JOIN rk USING (n)""")
def greedy_selection(t: Tables) -> DataFrame:
    return spatial.greedy(boxes(t), "p_retailprice").select("id")


GRID = "px AS (SELECT user_id::BIGINT AS x, (extract(day FROM ts) * 24 + extract(hour FROM ts))::BIGINT AS y, event_type AS image, sum(value) AS v FROM events GROUP BY ALL)"


def grid(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("x"), (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("long").alias("y"), F.col("event_type").alias("image")).agg(F.sum("value").alias("v"))


@BOOK.add(f"""WITH RECURSIVE {GRID}, l AS (SELECT image, x, y, v FROM px WHERE v > 30), e AS (SELECT a.image, a.y * 100000 + a.x AS a, b.y * 100000 + b.x AS b FROM l a JOIN l b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r(image, node, root) AS (SELECT DISTINCT image, a, a FROM e UNION SELECT r.image, e.b, r.root FROM r JOIN e ON r.image = e.image AND r.node = e.a), c AS (SELECT image, node, min(root) AS root FROM r GROUP BY 1, 2)
SELECT c.image, count(*) AS area, round(sum(v), 6) AS total, round(sum(x * v) / sum(v), 6) AS mark_x, round(sum(y * v) / sum(v), 6) AS mark_y, round(max(v), 6) AS peak_value FROM c JOIN l ON c.image = l.image AND c.node = l.y * 100000 + l.x GROUP BY c.image, root""")
def components(t: Tables) -> DataFrame:
    d = spatial.detect(grid(t), ["image"], 30.0)
    return d.select("image", "area", *[F.round(c, 6).alias(c) for c in ("total", "mark_x", "mark_y", "peak_value")])


@BOOK.add("""WITH RECURSIVE k AS (SELECT DISTINCT conv_id, role || md5(split_part(text, ' ', 1)) AS k FROM conversations), l AS (SELECT a.conv_id AS a, b.conv_id AS b FROM k a JOIN k b ON a.k = b.k),
r(node, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def shared_key_clusters(t: Tables) -> DataFrame:
    k = t.conversations.select("conv_id", F.concat("role", F.md5(F.split("text", " ")[0])).alias("k")).distinct()
    head = k.groupBy("k").agg(F.min("conv_id").alias("b"))
    return spatial.label_components(k.join(head, "k").select(F.col("conv_id").alias("a"), "b"))


@BOOK.add(f"WITH {GRID} SELECT x, y, arg_min(v, image) AS v FROM px WHERE v > 0 GROUP BY 1, 2")
def earliest_wins(t: Tables) -> DataFrame:
    return spatial.earliest_wins(grid(t), ["image"])


LABEL = "lb AS (SELECT DISTINCT l_orderkey % 40 AS label, l_partkey % 60 AS x, l_suppkey % 50 AS y, 1 AS one FROM lineitem)"


@BOOK.add("""WITH d AS (SELECT l_orderkey AS label, count(*) AS area, avg(l_partkey) AS cx, avg(l_suppkey) AS cy, avg(l_partkey::DOUBLE * l_partkey) - avg(l_partkey) ** 2 + 1.0 / 12 AS vx, avg(l_suppkey::DOUBLE * l_suppkey) - avg(l_suppkey) ** 2 + 1.0 / 12 AS vy,
  avg(l_partkey::DOUBLE * l_suppkey) - avg(l_partkey) * avg(l_suppkey) AS vxy, avg(l_quantity) AS mean, min(l_partkey) AS x0, max(l_suppkey) + 1 AS y1 FROM lineitem GROUP BY 1), r AS (SELECT *, sqrt((vx - vy) ** 2 + 4 * vxy ** 2) AS root FROM d)
SELECT label, area, round(cx, 4) AS cx, round(cy, 4) AS cy, x0, y1, round(4 * sqrt((vx + vy + root) / 2), 3) AS major, round(sqrt(4 * area / 3.141592653589793), 6) AS diameter, round(mean, 6) AS mean FROM r""")
def object_measures(t: Tables) -> DataFrame:
    px = t.lineitem.select(F.col("l_orderkey").alias("label"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").alias("v"))
    d = analysis.measure_objects(px, ["label"], "v")
    return d.select("label", "area", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "x0", "y1", F.round("major", 3).alias("major"), F.round("diameter", 6).alias("diameter"), F.round("mean", 6).alias("mean"))


@BOOK.add("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def object_intensity(t: Tables) -> DataFrame:
    return analysis.intensity(t.lineitem, ["l_suppkey"], "l_quantity").withColumns({c: F.round(c, 6) for c in ("mean", "p10", "p50", "p90")})


#: Runs of six labels in two images; the tissue is a square that some of them reach beyond.
RUNS = f"""{B_SQL}, rn AS (SELECT (x1 - x0) % 2 AS image, p_type AS label, unnest(range(y0, y1)) AS y, x0, x1 - 1 AS x1 FROM bx),
cell AS (SELECT DISTINCT image, label, y, unnest(range(x0, x1 + 1)) AS x FROM rn), tissue AS (SELECT image, 'tissue' AS label, {EXTENT} * {EXTENT} AS area FROM (SELECT unnest(range(0, 2)) AS image))"""


def label_runs(t: Tables) -> DataFrame:
    """Runs of the different boxes: equal ones have the same."""
    b = boxes(t).select(((F.col("x1") - F.col("x0")) % 2).alias("image"), F.col("p_type").alias("label"), "x0", "y0", "x1", "y1").distinct()
    return b.select("image", "label", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", (F.col("x1") - 1).alias("x1"))


def runs(t: Tables) -> DataFrame:
    """The labels' runs and the tissue's."""
    rows = t.spark.range(EXTENT).select(F.explode(F.expr("array(0L, 1L)")).alias("image"), F.col("id").alias("y"))
    return spatial.run_union(label_runs(t), ["image", "label"]).unionByName(rows.select("image", F.lit("tissue").alias("label"), "y", F.lit(0).cast("long").alias("x0"), F.lit(EXTENT - 1).cast("long").alias("x1")))


@BOOK.add(f"WITH {RUNS} SELECT image, label, count(*) AS area FROM cell GROUP BY ALL")
def region_area(t: Tables) -> DataFrame:
    return spatial.run_area(label_runs(t), ["image", "label"])


@BOOK.add(f"WITH {RUNS} SELECT a.image, a.label AS a_label, b.label AS b_label, count(*) AS shared FROM cell a JOIN cell b USING (image, x, y) WHERE a.label < b.label GROUP BY ALL")
def region_overlap(t: Tables) -> DataFrame:
    r = spatial.run_union(label_runs(t), ["image", "label"])
    return spatial.run_overlap(r, r, ["image"]).where("a_label < b_label")


AREAS = f"{RUNS}, lb AS (SELECT image, label, count(*) FILTER (WHERE x < {EXTENT} AND y < {EXTENT}) AS area FROM cell GROUP BY ALL), ca AS (SELECT * FROM lb UNION ALL SELECT * FROM tissue UNION ALL SELECT t.image, 'cytoplasm', t.area - lb.area FROM tissue t JOIN lb ON lb.image = t.image AND lb.label = 'PROMO'), fr AS (SELECT ca.image, ca.label, ca.area::BIGINT AS area, (ca.area / t.area)::DOUBLE AS fraction FROM ca JOIN tissue t ON ca.image = t.image)"


@BOOK.add(f"WITH {AREAS} SELECT image, label, area, round(fraction, 9) AS fraction, round(area * 0.0025, 6)::DOUBLE AS area_um2 FROM fr")
def compartment_areas(t: Tables) -> DataFrame:
    return analysis.compartment_areas(runs(t), "image", "tissue", 50.0, "PROMO").withColumns({"fraction": F.round("fraction", 9), "area_um2": F.round("area_um2", 6)})


def image_points(t: Tables) -> DataFrame:
    return points(t).withColumn("image", F.col("point_id") % 2)


@BOOK.add(f"""WITH {P_SQL}, {AREAS}, p AS (SELECT point_id % 2 AS image, point_id, x::BIGINT AS x, y::BIGINT AS y FROM pt), hit AS (SELECT p.image, label, count(*) AS n FROM p JOIN cell USING (image, x, y) GROUP BY ALL UNION ALL SELECT image, 'tissue', count(*) FROM p GROUP BY 1), tot AS (SELECT image, count(*) AS total FROM p GROUP BY 1)
SELECT fr.image, fr.label, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 9)::DOUBLE AS share, round(coalesce(n, 0) / total / fraction, 6)::DOUBLE AS enrichment FROM fr JOIN tot ON fr.image = tot.image LEFT JOIN hit ON fr.image = hit.image AND fr.label = hit.label WHERE fr.label <> 'cytoplasm'""")
def enrichment(t: Tables) -> DataFrame:
    r = runs(t)
    areas = analysis.compartment_areas(r, "image", "tissue", nucleus="PROMO").where("label <> 'cytoplasm'")
    d = analysis.enrichment(analysis.assign_points(image_points(t), r, "image"), areas, "image")
    return d.withColumns({"share": F.round("share", 9), "enrichment": F.round("enrichment", 6)})


#: A tissue that leaves out much of the plane, in rows of changing width; places are drawn by ordinal along its rows.
NULLS = f"""{RUNS.rsplit(", tissue AS", 1)[0]}, {P_SQL}, tis AS (SELECT y, y % 400 AS x0, 1599 - y % 300 AS x1, (sum(1600 - y % 300 - y % 400) OVER (ORDER BY y))::BIGINT - (1600 - y % 300 - y % 400) AS frm FROM (SELECT unnest(range(0, 1800)) AS y)), size AS (SELECT sum(x1 - x0 + 1)::BIGINT AS area FROM tis),
ar AS (SELECT c.image, c.label, count(t.y) AS area FROM cell c LEFT JOIN tis t ON c.y = t.y AND c.x BETWEEN t.x0 AND t.x1 GROUP BY ALL UNION ALL SELECT i, 'tissue', area FROM size, (SELECT unnest([0, 1]) AS i)), fr AS (SELECT image, label, (ar.area / size.area)::DOUBLE AS fraction FROM ar, size),
ob AS (SELECT point_id % 2 AS image, -1 AS rep, point_id AS i, pt.x::BIGINT AS x, pt.y::BIGINT AS y FROM pt JOIN tis ON pt.y::BIGINT = tis.y AND pt.x::BIGINT BETWEEN tis.x0 AND tis.x1)"""
DRAWN = """dr AS (SELECT image, rep, unnest(range(1, n + 1)) AS i FROM (SELECT image, n, unnest(range(0, {reps})) AS rep FROM nn)), od AS (SELECT *, ('0x' || substr(md5('{seed}:' || image || ':' || rep || ':' || i), 1, 15))::BIGINT % (SELECT area FROM size) AS o FROM dr), nu AS (SELECT od.image, od.rep, od.i, tis.x0 + od.o - tis.frm AS x, tis.y FROM od ASOF JOIN tis ON od.o >= tis.frm),
ev AS (SELECT image, rep, i, x, y FROM nu {more}), hit AS (SELECT ev.image, rep, label, count(*) AS n FROM ev JOIN cell USING (image, x, y) GROUP BY ALL UNION ALL SELECT image, rep, 'tissue', count(*) FROM ev GROUP BY ALL),
en AS (SELECT r.image, r.rep, fr.label, coalesce(hit.n, 0)::DOUBLE / r.total / nullif(fr.fraction, 0) AS e FROM (SELECT image, rep, count(*)::DOUBLE AS total FROM ev GROUP BY ALL) r JOIN fr ON fr.image = r.image LEFT JOIN hit ON hit.image = r.image AND hit.rep = r.rep AND hit.label = fr.label)"""
BOTH = f"WITH {NULLS}, nn AS (SELECT image, count(*) AS n FROM ob GROUP BY 1), {DRAWN.format(reps=99, seed='csr', more='UNION ALL SELECT image, rep, i, x, y FROM ob')}"


def null_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Runs of labels and of the narrow tissue, and the labels' shares of it."""
    rows = t.spark.range(1800).select(F.explode(F.expr("array(0L, 1L)")).alias("image"), F.lit("tissue").alias("label"), F.col("id").alias("y"), (F.col("id") % 400).alias("x0"), (1599 - F.col("id") % 300).alias("x1"))
    r = spatial.run_union(label_runs(t), ["image", "label"]).unionByName(rows)
    return r, analysis.compartment_areas(r, "image", "tissue", nucleus="PROMO").where("label <> 'cytoplasm'").select("image", "label", "fraction")


@BOOK.add(f"""{BOTH}, st AS (SELECT image, label, avg(e) AS m, stddev_samp(e) AS sd, count(e) AS reps FROM en WHERE rep >= 0 GROUP BY ALL), o AS (SELECT image, label, e FROM en WHERE rep = -1), far AS (SELECT n.image, n.label, count(*) FILTER (abs(n.e - m) >= abs(o.e - m)) AS far FROM en n JOIN st ON st.image = n.image AND st.label = n.label JOIN o ON o.image = n.image AND o.label = n.label WHERE n.rep >= 0 GROUP BY ALL)
SELECT o.image, o.label, round(o.e, 6) AS observed, round(m, 6) AS null_mean, round(sd, 6) AS null_sd, round(CASE WHEN sd > 0 AND reps > 1 THEN (o.e - m) / sd END, 4) AS z, round(CASE WHEN sd > 0 AND reps > 1 THEN (far + 1) / (reps + 1) END, 6)::DOUBLE AS p FROM o JOIN st ON st.image = o.image AND st.label = o.label JOIN far ON far.image = o.image AND far.label = o.label""")
def null_test(t: Tables) -> DataFrame:
    r, areas = null_sides(t)
    d = analysis.randomness(image_points(t), r, areas, "image", "tissue", 99, "csr")
    return d.withColumns({c: F.round(c, 4 if c == "z" else 6) for c in ("observed", "null_mean", "null_sd", "z", "p")})


@BOOK.add(f"""{BOTH}, g AS (SELECT rep, label, avg(e) AS e, count(DISTINCT image) AS n FROM en GROUP BY ALL), st AS (SELECT label, avg(e) AS m, stddev_pop(e) AS sd FROM g WHERE rep >= 0 GROUP BY 1)
SELECT 'both' AS grp, label, n, round(e, 6) AS observed, round(m, 6) AS null_mean, round(sd, 6) AS null_sd, round(coalesce((e - m) / nullif(sd, 0), 0), 4) AS z FROM g JOIN st USING (label) WHERE rep = -1""")
def null_groups(t: Tables) -> DataFrame:
    """Both images as one group."""
    r, areas = null_sides(t)
    observed, null = analysis.randomised(image_points(t), r, areas, "image", "tissue", 99, "csr")
    units = t.spark.range(2).select(F.col("id").alias("image"), F.lit("both").alias("grp"))
    d = analysis.group_null(observed, null, units, ["grp", "label"], "image", "enrichment")
    return d.withColumns({c: F.round(c, 4 if c == "z" else 6) for c in ("observed", "null_mean", "null_sd", "z")})


@BOOK.add(f"""WITH {NULLS}, sm AS (SELECT image, min(fraction) AS smallest FROM fr WHERE fraction > 0 GROUP BY 1), nn AS (SELECT image, least(50000, (SELECT area FROM size), greatest(2000, floor(2000 / smallest)))::BIGINT AS n, smallest FROM sm), {DRAWN.format(reps=1, seed='check', more='')}
SELECT nn.image, n AS n_points, round(smallest, 9) AS smallest, round((SELECT max(abs(e - 1)) FROM en WHERE en.image = nn.image), 6) AS worst FROM nn""")
def null_control(t: Tables) -> DataFrame:
    r, areas = null_sides(t)
    return analysis.self_check(r, areas, "image", "tissue", "check").withColumns({"smallest": F.round("smallest", 9), "worst": F.round("worst", 6)})


#: The shifted copies of a mask's cells say in one grouping how many side neighbours each has.
SHIFTED = " UNION ALL ".join(f"SELECT image, label, x + {dx}, y + {dy}, 0, 1 FROM cell" for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@BOOK.add(f"WITH {RUNS}, every AS (SELECT image, label, x, y, 1 AS own, 0 AS beside FROM cell UNION ALL {SHIFTED}) SELECT image, label, x, y FROM every GROUP BY image, label, x, y HAVING sum(own) = 1 AND sum(beside) < 4")
def boundary_pixels(t: Tables) -> DataFrame:
    r = spatial.run_union(label_runs(t), ["image", "label"])
    return labels.run_boundary(r, ["image", "label"])


@BOOK.add(f"WITH {B_SQL}, {OV} SELECT id, id IN (SELECT a_id FROM ov WHERE b_id % 3 = 0) AS reviewed FROM bx WHERE id % 3 > 0")
def candidate_ground(t: Tables) -> DataFrame:
    """Candidates that may be confirmed, and those on reviewed ground, with the name of their frame."""
    b = boxes(t)
    free, reviewed = spatial.partition_candidates(b.where("id % 3 > 0"), b.where("id % 3 = 0"))
    return free.select("id", F.lit(False).alias("reviewed")).unionByName(reviewed.select("id", F.lit(True).alias("reviewed")))


@BOOK.add("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum([x * x for x in embedding::DOUBLE[]])) AS n FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0)
SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, e.v) / (q.n * e.n), 9) DESC, e.vec_id) AS rank FROM q JOIN e ON q.vec_id <> e.vec_id QUALIFY rank <= 5""")
def cosine_topk(t: Tables) -> DataFrame:
    d = vectors.cosine_topk(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return d.withColumn("cosine", F.round("cosine", 6))


@BOOK.add()
def principal_components(t: Tables) -> DataFrame:
    d = vectors.principal(t.embeddings, "vec_id", "embedding")
    return d.select("vec_id", F.round(F.abs(F.col("components")[0]), 6).alias("c0"), F.round(F.abs(F.col("components")[1]), 6).alias("c1"))


@BOOK.add()
def vector_probe(t: Tables) -> DataFrame:
    return vectors.probe(t.embeddings, "vec_id", "embedding", "label")


@BOOK.add("""WITH p AS (SELECT l_orderkey % 50 AS image, l_partkey % 40 AS x, l_suppkey % 40 AS y, (l_linenumber - 1) * 8 AS x0, 0 AS y0, l_discount AS p FROM lineitem WHERE l_partkey % 40 BETWEEN (l_linenumber - 1) * 8 AND (l_linenumber - 1) * 8 + 15 AND l_suppkey % 40 < 16),
w AS (SELECT *, sin(3.141592653589793 * (x - x0 + 0.5) / 16) ** 2 * sin(3.141592653589793 * (y - y0 + 0.5) / 16) ** 2 AS w FROM p) SELECT image, x, y, round(sum(w * p) / sum(w), 6) AS p FROM w GROUP BY ALL""")
def blended_tiles(t: Tables) -> DataFrame:
    d = t.lineitem.select((F.col("l_orderkey") % 50).alias("image"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 40).alias("y"), ((F.col("l_linenumber") - 1) * 8).alias("x0"), F.lit(0).alias("y0"), F.col("l_discount").alias("p"))
    return tiles.blend(d.where("x between x0 and x0 + 15 and y < 16"), 16).withColumn("p", F.round("p", 6))


@BOOK.add(f"""WITH {P_SQL}, q AS (SELECT * FROM pt WHERE event_type <> 'error'), r AS (SELECT * FROM pt WHERE event_type = 'error'), d AS (SELECT q.point_id, r.point_id AS near_id, sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2) AS distance FROM q, r)
SELECT point_id, near_id, round(CASE WHEN point_id % 2 = 0 THEN -distance ELSE distance END, 9) + 0.0 AS distance FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d.distance, near_id) = 1""")
def signed_distance(t: Tables) -> DataFrame:
    """The boundary is the points of one kind, the points are all others."""
    p = points(t)
    d = spatial.signed_nearest(p.where("event_type <> 'error'"), p.where("event_type = 'error'"), p.where("point_id % 2 = 0"))
    return d.withColumn("distance", F.round("distance", 9) + F.lit(0.0))


#: Two masks of each kind of event; one kind is in neither, and one in the first only.
SIDES = "a AS (SELECT DISTINCT event_type AS image, user_id::BIGINT AS x, extract(day FROM ts)::BIGINT AS y FROM events WHERE value > 20 AND event_type <> 'signup'), b AS (SELECT DISTINCT event_type AS image, user_id::BIGINT AS x, extract(day FROM ts)::BIGINT AS y FROM events WHERE value > 25 AND event_type NOT IN ('signup', 'view')), im AS (SELECT event_type AS image, max(user_id) + 1 AS width, 32 AS height FROM events GROUP BY 1)"
EDGE = "{n} AS (SELECT * FROM {m} p WHERE (SELECT count(*) FROM {m} q WHERE q.image = p.image AND abs(q.x - p.x) + abs(q.y - p.y) = 1) < 4)"


def sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    side = lambda v, *out: t.events.where((F.col("value") > v) & ~F.col("event_type").isin(*out)).select(F.col("event_type").alias("image"), F.col("user_id").cast("long").alias("x"), F.dayofmonth("ts").cast("long").alias("y")).distinct()
    return side(20, "signup"), side(25, "signup", "view"), t.events.groupBy(F.col("event_type").alias("image")).agg((F.max("user_id") + 1).alias("width"), F.lit(32).alias("height"))


@BOOK.add(f"""WITH {SIDES}, {EDGE.format(n='ea', m='a')}, {EDGE.format(n='eb', m='b')}, p AS (SELECT image, avg((EXISTS (SELECT 1 FROM eb WHERE eb.image = ea.image AND (eb.x - ea.x) ** 2 + (eb.y - ea.y) ** 2 <= 1))::INTEGER) AS precision FROM ea GROUP BY 1), r AS (SELECT image, avg((EXISTS (SELECT 1 FROM ea WHERE eb.image = ea.image AND (eb.x - ea.x) ** 2 + (eb.y - ea.y) ** 2 <= 1))::INTEGER) AS recall FROM eb GROUP BY 1),
f AS (SELECT image, coalesce(precision, CASE WHEN recall IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS precision, coalesce(recall, CASE WHEN precision IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall FROM im LEFT JOIN p USING (image) LEFT JOIN r USING (image))
SELECT image, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM f""")
def boundary_f1(t: Tables) -> DataFrame:
    a, b, images = sides(t)
    return labels.boundary_f1(a, b, images, "image", 1.0).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@BOOK.add(f"""WITH {SIDES}, {EDGE.format(n='ea', m='a')}, {EDGE.format(n='eb', m='b')}, d AS (SELECT ea.image, 'a' AS side, min(sqrt((ea.x - eb.x) ** 2 + (ea.y - eb.y) ** 2)) AS distance FROM ea JOIN eb ON ea.image = eb.image GROUP BY ea.image, ea.x, ea.y UNION ALL SELECT eb.image, 'b', min(sqrt((ea.x - eb.x) ** 2 + (ea.y - eb.y) ** 2)) FROM ea JOIN eb ON ea.image = eb.image GROUP BY eb.image, eb.x, eb.y),
q AS (SELECT image, side, quantile_cont(distance, 0.95) AS q FROM d GROUP BY 1, 2), m AS (SELECT image, max(q) AS q FROM q GROUP BY 1), edged AS (SELECT DISTINCT image FROM ea UNION SELECT DISTINCT image FROM eb)
SELECT im.image, round(CASE WHEN edged.image IS NULL THEN 0.0 ELSE coalesce(m.q, sqrt(width ** 2 + height ** 2)) END, 9)::DOUBLE AS hd95 FROM im LEFT JOIN m ON m.image = im.image LEFT JOIN edged ON edged.image = im.image""")
def boundary_hd95(t: Tables) -> DataFrame:
    a, b, images = sides(t)
    return labels.hd95(a, b, images, "image").withColumn("hd95", F.round("hd95", 9))


@BOOK.add(f"WITH {B_SQL}, s AS (SELECT id, p_type, CASE WHEN id % 5 > 0 THEN p_retailprice / 2000 END AS score, (x1 - x0) * (y1 - y0) AS area FROM bx) SELECT id, p_type, row_number() OVER (PARTITION BY p_type ORDER BY score IS NULL, score DESC, area, id) AS rank FROM s QUALIFY rank <= 20")
def ranked_hits(t: Tables) -> DataFrame:
    d = boxes(t).select("id", "p_type", F.when(F.col("id") % 5 > 0, F.col("p_retailprice") / 2000).alias("score"), spatial.box_area().alias("area"))
    return order.rank_hits(d, ["p_type"], "score", "area", "id").select("id", "p_type", "rank")


@BOOK.add("SELECT doc_id FROM (SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS s FROM documents) ORDER BY abs(s - 0.5), doc_id LIMIT 25")
def most_uncertain(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", hash01(F.col("doc_id").cast("string")).alias("s"))
    return order.most_uncertain(d, "s", "doc_id", 25).select("doc_id")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
