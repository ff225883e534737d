"""Queries of operators on tiles, crops, objects, labels and score tables, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import analysis, catalog, labels, library, rules, spatial, splits, stats, tiles
from lamella.plans.binding import Book, Tables

BOOK = Book()


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@BOOK.add("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS t, l_tax * 12 AS c, l_quantity / 50 AS b, l_discount * l_tax * 20 AS a, CASE WHEN l_returnflag = 'R' THEN 'thin;' || l_linestatus ELSE '' END AS w FROM lineitem),
s AS (SELECT *, greatest(0.0, least(1.0, 0.5 * t + 0.3 * c + 0.2 * (1 - b) - a)) AS score, [x FOR x IN [CASE WHEN t < 0.2 THEN 'low_tissue' END, CASE WHEN b > 0.9 THEN 'background' END] IF x IS NOT NULL] AS reasons, list_contains(string_split(w, ';'), 'F') AS bad FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, round(score, 9) AS score, array_to_string(reasons, ';') AS reasons, CASE WHEN bad THEN 'rejected' WHEN len(reasons) = 0 AND score >= 0.5 THEN 'accepted' WHEN score >= 0.3 THEN 'borderline' ELSE 'rejected' END AS status FROM s""")
def tissue_status(t: Tables) -> DataFrame:
    tissue, contrast, background, artifact = F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50, F.col("l_discount") * F.col("l_tax") * 20
    warning = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("thin;"), "l_linestatus")).otherwise("")
    d = t.lineitem.withColumn("score", tiles.tissue_score(tissue, contrast, background, artifact)).withColumn("r", tiles.score_reasons({"low_tissue": (tissue, "<", 0.2), "background": (background, ">", 0.9)}))
    d = d.withColumn("status", tiles.tile_status(F.col("score"), F.col("r"), tiles.normalization_rejected(warning, ["F"]), 0.5, 0.3))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 9).alias("score"), F.array_join("r", ";").alias("reasons"), "status")


_FACTORS = {"p_type": ["economy", "large", "promo", "small"]}


@BOOK.add("""WITH c AS (SELECT p_partkey, nullif(list_position(['economy', 'large', 'promo', 'small'], CASE WHEN lower(p_type) <> 'large' THEN lower(p_type) END), 0) - 1 AS code FROM part)
SELECT p_partkey::VARCHAR AS source_id, '' AS dataset_id, coalesce(code, -1)::INTEGER AS p_type_code, code IS NOT NULL AS p_type_valid, round(CASE WHEN p_size > 10 THEN (ln(p_size - 10) - 2.5) / 0.8 ELSE 0 END, 9) AS extra_z, p_size > 10 AS extra_valid FROM c JOIN part USING (p_partkey)""")
def factor_records(t: Tables) -> DataFrame:
    d = t.part.select(F.col("p_partkey").alias("source_id"), F.lit(None).cast("string").alias("dataset_id"), "p_type", (F.col("p_size") - 10).alias("extra"))
    return rounded(tiles.factor_record(d, ["p_type", "extra"], _FACTORS, {"extra": (2.5, 0.8)}, {"p_type": ["large"]}), "extra_z")


@BOOK.add("""SELECT l_orderkey, l_linenumber, l_partkey, round_even(CASE WHEN l_returnflag = 'A' THEN 255 - s ELSE s END, 0)::INTEGER AS level FROM (SELECT *, greatest(0.0, least(255.0, (l_quantity - 5) * 255 / 40)) AS s FROM lineitem)""")
def uint8_levels(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", tiles.to_uint8(F.col("l_quantity"), F.lit(5), F.lit(45), F.col("l_returnflag") == "A").alias("level"))


#: Pixels made of the order lines: an image of 40 orders, with a label of each pixel.
PX = "px AS (SELECT l_orderkey % 40 AS image, l_partkey % 60 AS x, l_suppkey % 50 AS y, max(l_linenumber)::BIGINT AS value, max(l_quantity) AS v, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2, 3)"


def pixels(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy((F.col("l_orderkey") % 40).alias("image"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_suppkey") % 50).alias("y"))
    return d.agg(F.max("l_linenumber").cast("long").alias("value"), F.max("l_quantity").alias("v"), F.max("l_returnflag").alias("flag"))


@BOOK.add(f"""WITH {PX}, b AS (SELECT *, image % 3 AS k, image * 0.5 AS bx0, 45.5 AS bx1, 2.5 AS by0, 30.5 AS by1 FROM px)
SELECT image, x, y FROM b WHERE v > 10 AND (k = 0 OR (x >= round_even(bx0, 0) AND x < round_even(bx1, 0) AND y >= round_even(by0, 0) AND y < round_even(by1, 0)))""")
def scored_region(t: Tables) -> DataFrame:
    cover = F.when(F.col("image") % 3 == 0, "full").when(F.col("image") % 3 == 1, "partial").otherwise("sparse")
    d = pixels(t).withColumns({"valid": F.col("v") > 10, "coverage": cover, "bx0": F.col("image") * 0.5, "bx1": F.lit(45.5), "by0": F.lit(2.5), "by1": F.lit(30.5)})
    return analysis.valid_region(d).select("image", "x", "y")


@BOOK.add("""WITH n AS (SELECT s_nationkey AS image, count(*) AS n FROM supplier GROUP BY 1) SELECT n_nationkey AS image, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / nullif(n_nationkey, 0), 9) AS density FROM nation LEFT JOIN n ON n.image = n_nationkey""")
def object_density(t: Tables) -> DataFrame:
    areas = t.nation.select(F.col("n_nationkey").alias("image"), F.col("n_nationkey").cast("double").alias("area_um2"))
    return rounded(analysis.density(t.supplier.select(F.col("s_nationkey").alias("image")), "image", areas), "density").select("image", "n", "density")


@BOOK.add(f"""WITH RECURSIVE {PX}, l AS (SELECT image, y * 1000 + x AS p FROM px WHERE v > 35), e AS (SELECT a.image, a.p AS a, b.p AS b FROM l a JOIN l b ON a.image = b.image AND (b.p IN (a.p, a.p - 1, a.p + 1, a.p - 1000, a.p + 1000))),
r(image, node, root) AS (SELECT image, p, p FROM l UNION SELECT r.image, e.b, r.root FROM r JOIN e ON r.image = e.image AND r.node = e.a), c AS (SELECT image, node, min(root) AS root FROM r GROUP BY 1, 2), k AS (SELECT image, root, count(*) AS area FROM c GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT image, root % 1000 AS x0, root // 1000 AS y, area, row_number() OVER (PARTITION BY image ORDER BY root) AS number FROM k""")
def kept_components(t: Tables) -> DataFrame:
    d = spatial.detect(pixels(t).select("image", "x", "y", "v"), ["image"], 35.0, diagonal=False)
    return spatial.drop_small(d, ["image"], 4).select("image", "x0", "y", "area", "number")


@BOOK.add(f"WITH {PX}, o AS (SELECT image, value, count(*) AS area FROM px WHERE value > 2 GROUP BY 1, 2), s AS (SELECT image, count(*) AS n, avg(area) AS mean_area, sum(area) AS area FROM o GROUP BY 1), ti AS (SELECT image, count(*) AS tissue_area FROM px GROUP BY 1) SELECT image, coalesce(n, 0) AS n, round(mean_area, 9) AS mean_area, round(coalesce(area, 0)::DOUBLE / tissue_area, 9) AS fraction FROM ti LEFT JOIN s USING (image)")
def object_rows(t: Tables) -> DataFrame:
    p = pixels(t)
    objects = p.where("value > 2").groupBy("image", "value").agg(F.count("*").alias("area"))
    return rounded(analysis.object_summary(objects, "image", p.groupBy("image").agg(F.count("*").alias("tissue_area"))), "mean_area", "fraction")


@BOOK.add(f"WITH {PX}, f AS (SELECT image, flag, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY image) AS f FROM px GROUP BY 1, 2) SELECT image, round(max(f) FILTER (WHERE flag = 'A'), 9) AS A, round(max(f) FILTER (WHERE flag = 'N'), 9) AS N, round(max(f) FILTER (WHERE flag = 'R'), 9) AS R FROM f GROUP BY 1")
def image_rows(t: Tables) -> DataFrame:
    p = pixels(t)
    areas = p.groupBy("image", F.col("flag").alias("label")).agg(F.count("*").alias("n")).join(p.groupBy("image").agg(F.count("*").alias("all")), "image")
    return rounded(analysis.image_summary(areas.withColumn("fraction", F.col("n") / F.col("all")), "image", ["A", "N", "R"]), "A", "N", "R")


@BOOK.add(f"WITH {PX} SELECT image, x // 16 AS wx, y // 16 AS wy, value, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px GROUP BY ALL")
def window_labels(t: Tables) -> DataFrame:
    d = pixels(t).withColumns({"wx": F.floor(F.col("x") / 16), "wy": F.floor(F.col("y") / 16)})
    return splits.window_summary(d, ["image", "wx", "wy"])


@BOOK.add(f"WITH {PX} SELECT image, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE v > 40 GROUP BY 1")
def content_boxes(t: Tables) -> DataFrame:
    return tiles.content_box(pixels(t).withColumn("v", F.when(F.col("v") > 40, F.col("v")).otherwise(0.0)), ["image"])


@BOOK.add("""WITH m AS (SELECT o_orderkey AS crop_id, 'img' || o_custkey AS s, o_orderstatus AS sp FROM orders WHERE o_orderkey % 4 > 0)
SELECT l_orderkey AS crop_id, l_linenumber, l_partkey, coalesce(m.s, 'own' || l_suppkey) AS source_image, m.sp AS manifest_split FROM lineitem LEFT JOIN m ON m.crop_id = l_orderkey""")
def source_splits(t: Tables) -> DataFrame:
    """A manifest a customer, each with its orders but every fourth; lines without an order there keep their own file."""
    entry = F.struct(F.col("o_orderkey").alias("crop_id"), F.concat(F.lit("img"), "o_custkey").alias("source_image"), F.col("o_orderstatus").alias("split"))
    manifests = t.orders.where("o_orderkey % 4 > 0").groupBy("o_custkey").agg(F.collect_list(entry).alias("entries"))
    crops = t.lineitem.select(F.col("l_orderkey").alias("crop_id"), "l_linenumber", "l_partkey", F.concat(F.lit("own"), "l_suppkey").alias("em_file"))
    return splits.source_map(crops, manifests).select("crop_id", "l_linenumber", "l_partkey", "source_image", "manifest_split")


@BOOK.add("""WITH f AS (SELECT DISTINCT url AS path FROM pages UNION SELECT 'local/' || page_id FROM pages WHERE page_id % 3 = 0) SELECT page_id, CASE WHEN 'local/' || page_id IN (SELECT path FROM f) THEN 'local/' || page_id ELSE url END AS path FROM pages""")
def resolved_paths(t: Tables) -> DataFrame:
    local = F.concat(F.lit("local/"), "page_id")
    files = t.pages.select(F.col("url").alias("path")).unionByName(t.pages.where("page_id % 3 = 0").select(local.alias("path"))).distinct()
    tried = F.array(F.concat(F.lit("none/"), "page_id"), F.concat(F.lit("local/"), "page_id"), F.col("url"))
    return tiles.resolve_paths(t.pages, files, "page_id", tried).select("page_id", "path")


@BOOK.add("""SELECT n_name AS dataset, s_suppkey AS crop_id, o AS organelle, 'p' || s_suppkey AS path, array_to_string(CASE WHEN s_suppkey % 2 = 0 AND o = 'mito' THEN [1, 3] WHEN o = 'mito' THEN [4, 5] ELSE [7] END, ',') AS vals FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (VALUES ('mito'), ('er')) v(o) WHERE s_suppkey % 3 = 0""")
def crop_labels(t: Tables) -> DataFrame:
    base = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("dataset"), F.col("s_suppkey").alias("crop_id"))
    rows = base.withColumn("organelle", F.explode(F.array(F.lit("mito"), F.lit("er")))).withColumn("split", F.when(F.col("crop_id") % 3 == 0, "test").otherwise("train"))
    names = F.when(F.col("crop_id") % 2 == 0, F.create_map(F.lit(3), F.lit("Mito b"), F.lit(1), F.lit("mito"), F.lit(2), F.lit("nucleus"))).otherwise(F.create_map(F.lit(9), F.lit("golgi")))
    d = labels.crop_specification(rows, base.select("dataset", "crop_id", F.concat(F.lit("p"), "crop_id").alias("path"), names.alias("names")), {"mito": [4, 5], "er": [7]})
    return d.select("dataset", "crop_id", "organelle", "path", F.array_join("values", ",").alias("vals"))


TILES = "nt AS (SELECT p_partkey AS tile, (p_partkey * 37) % 900 AS x, (p_partkey * 91) % 900 AS y FROM part)"


def nominal(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("tile"), ((F.col("p_partkey") * 37) % 900).alias("x"), ((F.col("p_partkey") * 91) % 900).alias("y"), F.lit(930).alias("width"), F.lit(920).alias("height"))


@BOOK.add(f"WITH {TILES}, m AS (SELECT unnest([-16, 0, 16]) AS d) SELECT DISTINCT tile, greatest(0, least(x + a.d, 930 - 64)) AS cx, greatest(0, least(y + b.d, 920 - 64)) AS cy FROM nt, m a, m b")
def candidate_shifts(t: Tables) -> DataFrame:
    return tiles.shifted(nominal(t), [-16, 0, 16], "width", "height", 64).select("tile", "cx", "cy")


@BOOK.add()
def chosen_shifts(t: Tables) -> DataFrame:
    """Compared with the plain loop in the tests."""
    d = tiles.shifted(nominal(t), [-16, 0, 16], "width", "height", 64)
    far = F.abs(F.col("cx") - F.col("x")) + F.abs(F.col("cy") - F.col("y"))
    return spatial.choose_shift(d, "tile", [F.desc((F.col("cx") * 31 + F.col("cy") * 17) % 101), far, F.col("cy"), F.col("cx")], 64).select("tile", "cx", "cy")


@BOOK.add("SELECT o_orderkey, CASE WHEN w < 64 THEN 0 ELSE (w - 64) // 48 + 1 + CASE WHEN (w - 64) % 48 > 0 THEN 1 ELSE 0 END END * CASE WHEN h < 64 THEN 0 ELSE (h - 64) // 48 + 1 + CASE WHEN (h - 64) % 48 > 0 THEN 1 ELSE 0 END END AS n FROM (SELECT o_orderkey, o_custkey % 700 AS w, o_orderkey % 500 AS h FROM orders)")
def tile_counts(t: Tables) -> DataFrame:
    n = lambda c, m: tiles.window_count(F.col(c) % m, F.lit(64), F.lit(48))
    return t.orders.select("o_orderkey", (n("o_custkey", 700) * n("o_orderkey", 500)).alias("n"))


@BOOK.add("""SELECT p_partkey, unnest(CASE WHEN p_size <= 8 THEN range(0, p_size) ELSE list_distinct([round_even(i * (p_size - 1) / 7.0, 0)::BIGINT FOR i IN range(0, 8)]) END)::INTEGER AS z FROM part""")
def even_planes(t: Tables) -> DataFrame:
    return splits.planes(t.part, "p_size", F.lit(1.0), 8).select("p_partkey", "z")


@BOOK.add(f"""WITH {PX}, c AS (SELECT image, value AS p, CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS g, count(*) AS n FROM px GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY image, p) AS ap, sum(n) OVER (PARTITION BY image, g) AS ag FROM c), i AS (SELECT image, p, g, n / (ap + ag - n) AS iou FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY iou DESC, p, g) AS r FROM i WHERE iou >= 0.05), b AS (SELECT image, list(p ORDER BY r) AS ps, list(g ORDER BY r) AS gs FROM k GROUP BY 1)
SELECT image, q // 10 AS p, q % 10 AS g FROM (SELECT image, unnest(m) AS q FROM (SELECT image, list_reduce(list_prepend([]::BIGINT[], [[ps[i] * 10 + gs[i]] FOR i IN range(1, len(ps) + 1)]), lambda m, x: CASE WHEN list_contains([q // 10 FOR q IN m], x[1] // 10) OR list_contains([q % 10 FOR q IN m], x[1] % 10) THEN m ELSE list_concat(m, x) END) AS m FROM b))""")
def one_to_one(t: Tables) -> DataFrame:
    code = F.when(F.col("flag") == "A", 1).when(F.col("flag") == "N", 2).otherwise(3).cast("long")
    pairs = labels.instance_pairs(labels.contingency(pixels(t).withColumn("g", code), ["image"], "value", "g"))
    return labels.mutual_best(pairs, ["image"], 0.05).select("image", "p", "g")


@BOOK.add(f"""WITH {PX}, m AS (SELECT image, x, y FROM px WHERE v > 20), o AS (SELECT DISTINCT m.image, m.x, m.y, dx, dy FROM m, (SELECT i AS dx, j AS dy FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i) + abs(j) BETWEEN 1 AND 2))
SELECT DISTINCT o.image, o.x, o.y FROM o LEFT JOIN m ON m.image = o.image AND m.x = o.x + dx AND m.y = o.y + dy WHERE m.x IS NULL""")
def boundary_band(t: Tables) -> DataFrame:
    return labels.band(pixels(t).where("v > 20").select("image", "x", "y"), ["image"], 2)


@BOOK.add(f"""WITH {PX}, c AS (SELECT image, count(*) FILTER (WHERE v > 25 AND flag = 'A') AS tp, count(*) FILTER (WHERE v > 25 AND flag <> 'A') AS fp, count(*) FILTER (WHERE v <= 25 AND flag = 'A') AS fn FROM px WHERE value <> 7 GROUP BY 1)
SELECT image, tp, fp, fn, round((2 * tp + 1.0) / (2 * tp + fp + fn + 1.0), 9) AS dice, round((tp + 1.0) / (tp + fp + fn + 1.0), 9) AS iou FROM c WHERE tp + fp + fn > 0""")
def ignored_confusion(t: Tables) -> DataFrame:
    """One label value is not scored; images where neither side has anything are left out; sums are smoothed by one."""
    d = labels.confusion(pixels(t).where("value <> 7"), ["image"], F.col("v") > 25, F.col("flag") == "A", "drop", 1.0)
    return rounded(d, "dice", "iou").select("image", "tp", "fp", "fn", "dice", "iou")


@BOOK.add("""WITH n AS (SELECT c_mktsegment AS cell, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
s AS (SELECT cell, n, i AS slot, unnest(range(0, 50)) AS replicate FROM n), d AS (SELECT replicate, cell, ('0x' || substr(md5('ci:' || replicate || ':' || cell || ':' || slot), 1, 8))::BIGINT % n AS i FROM s),
m AS (SELECT replicate, d.cell, avg(v) AS m FROM d JOIN n ON d.cell = n.cell AND d.i = n.i GROUP BY 1, 2), r AS (SELECT replicate, avg(m) AS macro FROM m GROUP BY 1) SELECT round(quantile_cont(macro, 0.025), 6) AS lo, round(quantile_cont(macro, 0.975), 6) AS hi FROM r""")
def macro_interval(t: Tables) -> DataFrame:
    reps = stats.bootstrap_macro(t.customer.withColumnRenamed("c_mktsegment", "cell"), "cell", "c_custkey", "c_acctbal", 50, "ci")
    return rounded(stats.bootstrap_interval(reps, "macro"), "lo", "hi", places=6)


@BOOK.add("SELECT l_returnflag AS model, l_linenumber AS dataset, round(avg(l_quantity), 9) AS score FROM lineitem WHERE (l_returnflag, l_linenumber) IN (('A', 1), ('N', 2), ('N', 9)) GROUP BY ALL")
def in_domain_cells(t: Tables) -> DataFrame:
    cells = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("dataset")).agg(F.round(F.avg("l_quantity"), 9).alias("score"))
    pairs = t.spark.createDataFrame([("A", 1), ("N", 2), ("N", 9)], "model string, dataset int")  # a fixed list
    return stats.in_domain(cells, pairs, ["model", "dataset"])


@BOOK.add("""WITH d AS (SELECT l_returnflag AS model, l_linestatus AS ds, l_orderkey AS crop, l_quantity AS pq, l_discount AS sq FROM lineitem WHERE l_quantity <> 7), p AS (SELECT model, ds, avg(pq) AS pq, avg(sq) AS sq FROM d GROUP BY 1, 2)
SELECT model, round(max(pq) FILTER (WHERE ds = 'F'), 9) AS F, round(max(pq) FILTER (WHERE ds = 'O'), 9) AS O, round(avg(pq), 9) AS mean_pq, round(avg(sq), 9) AS mean_sq, (SELECT count(DISTINCT crop) FROM d WHERE d.model = p.model) AS n FROM p GROUP BY model""")
def instance_scores(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("ds"), F.col("l_orderkey").alias("crop"), F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("pq"), F.col("l_discount").alias("sq"))
    return rounded(stats.instance_table(d, "model", "ds", "crop", ["pq", "sq"], ["F", "O"]), "F", "O", "mean_pq", "mean_sq")


@BOOK.add("""WITH c AS (SELECT o_orderpriority AS arm, o_orderstatus AS split, o_custkey % 5 AS sub, avg(o_totalprice) AS dice FROM orders WHERE o_orderkey % 9 > 0 GROUP BY ALL), n AS (SELECT o_orderpriority AS arm, o_orderstatus AS split, count(*) FILTER (WHERE o_orderkey % 9 > 0) AS n_evaluated, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS n_excluded FROM orders GROUP BY ALL)
SELECT arm, split, n_evaluated, n_excluded, round(avg(dice), 5) AS dice, round(min(dice), 5) AS worst_dice, arg_min(sub, dice) AS worst_subgroup FROM n LEFT JOIN c USING (arm, split) GROUP BY ALL""")
def arm_results(t: Tables) -> DataFrame:
    d = t.orders.select(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 5).alias("sub"), F.col("o_totalprice").alias("dice"), (F.col("o_orderkey") % 9 == 0).alias("out"))
    return stats.arm_table(d, ["arm", "split"], "sub", ["dice"], "out", "dice")


@BOOK.add("""WITH u AS (SELECT CASE WHEN o_orderpriority LIKE '%LOW%' THEN '' ELSE o_orderpriority END AS grp, o_custkey AS image, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT grp, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n FROM u GROUP BY 1""")
def successful_groups(t: Tables) -> DataFrame:
    runs = t.orders.select(F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.col("o_orderkey").alias("segmentation"), F.when(~F.col("o_orderpriority").contains("LOW"), F.col("o_orderpriority")).alias("grp"), F.col("o_custkey").alias("image"), F.col("o_totalprice").alias("value"))
    return rounded(analysis.group_query(runs, "value"), "mean", "sd", "sem", places=6).select("grp", "mean", "sd", "sem", "n")


STATES = {"O": "unlabelled", "F": "confirmed", "P": "rejected"}


@BOOK.add("WITH s AS (SELECT o_custkey AS segmentation, CASE o_orderstatus WHEN 'O' THEN 'unlabelled' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END AS label_state FROM orders) SELECT segmentation, label_state, count(*) AS n, (SELECT count(*) FROM s x WHERE x.segmentation = s.segmentation AND label_state = 'rejected') AS rejected FROM s GROUP BY ALL")
def label_states(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "unlabelled").when(F.col("o_orderstatus") == "F", "confirmed").otherwise("rejected")
    d = t.orders.select(F.col("o_custkey").alias("segmentation"), state.alias("label_state"))
    return library.label_states(d, "segmentation").join(library.rejected(d, "segmentation"), "segmentation")


@BOOK.add("""WITH r AS (SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN 'click' ELSE 'view' END AS image, (p_partkey * 7919) % 2000 AS x0, (p_partkey * 104729) % 2000 AS y0, (p_partkey * 7919) % 2000 + 40 AS x1, (p_partkey * 104729) % 2000 + 30 AS y1 FROM part), o AS (SELECT event_id, event_type AS image, ((event_id * 31) % 2000)::DOUBLE AS x, ((event_id * 577 + user_id) % 2000)::DOUBLE AS y FROM events)
SELECT image, event_id AS point_id, CASE WHEN image IN ('click', 'view') THEN EXISTS (SELECT 1 FROM r WHERE r.image = o.image AND x >= x0 AND x < x1 AND y >= y0 AND y < y1) END AS reviewed FROM o""")
def reviewed_objects(t: Tables) -> DataFrame:
    x, y = (F.col("p_partkey") * 7919) % 2000, (F.col("p_partkey") * 104729) % 2000
    regions = t.part.select(F.when(F.col("p_type") == "PROMO", "click").otherwise("view").alias("image"), F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 30).alias("y1"))
    objects = t.events.select(F.col("event_type").alias("image"), F.col("event_id").alias("point_id"), ((F.col("event_id") * 31) % 2000).cast("double").alias("x"), ((F.col("event_id") * 577 + F.col("user_id")) % 2000).cast("double").alias("y"))
    return analysis.reviewed_flags(objects, regions).select("image", "point_id", "reviewed")


@BOOK.add("""WITH d AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'zenodo_mitoem2' WHEN 'SMALL' THEN 'jrc_' || p_size WHEN 'LARGE' THEN 'x_Perez_' || p_size ELSE 'set' || p_size END AS ds, CASE WHEN p_size % 2 = 0 THEN 'ME2-S' || p_size || '_c' ELSE 'crop' END AS crop, p_size AS fg, p_retailprice AS area FROM part), k AS (SELECT *, CASE WHEN ds = 'zenodo_mitoem2' THEN 'zenodo_mitoem2/' || CASE WHEN p_partkey IS NOT NULL AND crop LIKE 'ME2-%' THEN regexp_extract(crop, '^ME2-[A-Za-z0-9]+') ELSE 'UNK' END ELSE ds END AS key FROM d)
SELECT p_partkey, key, CASE WHEN starts_with(key, 'zenodo_mitoem2/') THEN 600 ELSE 1000 END AS cap, NOT (starts_with(lower(ds), 'jrc_') OR regexp_matches(lower(ds), 'wei2020_mitoem|kasthuri|guay|openorganelle|bleck|cremi|perez')) AS clean, CASE WHEN fg / greatest(area, 1) < 0.02 THEN 'sparse' WHEN fg / greatest(area, 1) < 0.1 THEN 'partial' ELSE 'full' END AS tier FROM k""")
def source_rules(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    ds = F.when(F.col("p_type") == "PROMO", "zenodo_mitoem2").when(F.col("p_type") == "SMALL", F.concat(F.lit("jrc_"), size)).when(F.col("p_type") == "LARGE", F.concat(F.lit("x_Perez_"), size)).otherwise(F.concat(F.lit("set"), size))
    crop = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ME2-S"), size, F.lit("_c"))).otherwise("crop")
    key = splits.source_key(ds, crop)
    return t.part.select("p_partkey", key.alias("key"), splits.source_cap(key).alias("cap"), splits.clean_source(ds).alias("clean"), splits.coverage_tier(F.col("p_size"), F.col("p_retailprice")).alias("tier"))


#: Phrases by part type, to which the part's name is added.
PHRASES = {"PROMO": "SBF-SEM of mouse liver tissue sample", "SMALL": "Volume EM, HeLa cells", "LARGE": "FIB-SEM and ssTEM of human retina", "ECONOMY": "rat hepatocytes by transmission electron microscopy", "MEDIUM": "no method at all"}


@BOOK.add("""WITH d AS (SELECT p_partkey, p_type AS k, CASE p_partkey % 7 WHEN 0 THEN 'volume EM' WHEN 3 THEN 'Cryo Magic' END AS method, CASE p_partkey % 6 WHEN 0 THEN 'Human' WHEN 2 THEN 'Strange beast' END AS beast, CASE p_partkey % 5 WHEN 2 THEN 'Named thing' END AS thing FROM part),
m AS (SELECT *, [x FOR x IN [CASE WHEN method = 'Cryo Magic' THEN method END, CASE k WHEN 'PROMO' THEN 'SBF-SEM' WHEN 'LARGE' THEN 'FIB-SEM' WHEN 'ECONOMY' THEN 'TEM' END, CASE k WHEN 'LARGE' THEN 'ssTEM' END] IF x IS NOT NULL] AS told FROM d)
SELECT p_partkey, CASE WHEN len(told) > 0 THEN array_to_string(told, ' ; ') WHEN k = 'SMALL' OR method = 'volume EM' THEN 'volume EM' END AS methods, coalesce(beast, CASE k WHEN 'PROMO' THEN 'Mouse' WHEN 'SMALL' THEN 'Human' WHEN 'LARGE' THEN 'Human' WHEN 'ECONOMY' THEN 'Rat' END) AS organism,
 coalesce(thing, CASE k WHEN 'PROMO' THEN 'liver tissue sample' WHEN 'SMALL' THEN 'HeLa cell' WHEN 'LARGE' THEN 'retina' WHEN 'ECONOMY' THEN 'hepatocyte' END) AS sample FROM m""")
def told_samples(t: Tables) -> DataFrame:
    """Named values, some of which say nothing or too little, beside a text."""
    text = F.concat(F.coalesce(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.col("p_type")], F.lit("")), F.lit(" "), "p_name")
    pick = lambda n, *v: F.get(F.array(*[F.lit(x).cast("string") for x in v]), F.col("p_partkey") % n)
    method = catalog.first_known(F.array(pick(7, None, "unknown", " n/a ;", "N/A", None, "/", None), pick(7, "volume EM", "Unknown", None, " Cryo \t Magic,", None, "none", None)))
    organism, sample = pick(6, "Homo sapiens cells", "not specified", " Strange  beast; ", None, "NULL", ""), pick(5, "Tissue", "N/A", ",Named thing;", " cells ", None)
    return t.part.select("p_partkey", catalog.methods_of(method, text).alias("methods"), catalog.organism_of(organism, text).alias("organism"), catalog.sample_of(sample, text).alias("sample"))


@BOOK.add("""WITH RECURSIVE r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_custkey ELSE '' END AS doi, CASE WHEN o_orderkey % 5 = 0 THEN 'https://x/' || (o_custkey % 40) END AS url, o_orderkey AS own FROM orders WHERE o_custkey % 4 = 0),
k AS (SELECT id, 'd' || lower(trim(doi)) AS k FROM r WHERE doi <> '' UNION ALL SELECT id, 'u' || lower(trim(url)) FROM r WHERE url IS NOT NULL UNION ALL SELECT id, 's' || own FROM r), h AS (SELECT k, min(id) AS head FROM k GROUP BY 1), l AS (SELECT DISTINCT k.id AS a, head AS b FROM k JOIN h USING (k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON c.node = e.a) SELECT node AS id, min(root) AS root FROM c GROUP BY 1""")
def candidate_clusters(t: Tables) -> DataFrame:
    """Records that share a DOI, a link or an id, directly or through others."""
    k = lambda n: F.col("o_orderkey") % n == 0
    r = t.orders.where("o_custkey % 4 = 0").select(
        F.col("o_orderkey").alias("id"), F.when(k(3), F.concat(F.lit("10.1/"), "o_custkey")).otherwise("").alias("dataset_doi"), F.when(k(5), F.concat(F.lit("HTTPS://X/"), F.col("o_custkey") % 40, F.lit(" "))).alias("landing_url"),
        F.lit("s").alias("source_name"), F.col("o_orderkey").cast("string").alias("source_record_id"),
    )
    return catalog.same_records(r, "id")


@BOOK.add("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Given' ELSE CASE p_partkey % 7 WHEN 0 THEN 'SBF-SEM' WHEN 1 THEN 'cellular EM patch dataset' WHEN 2 THEN 'vEM' WHEN 3 THEN 'SSTEM' WHEN 4 THEN 'volume em' WHEN 5 THEN 'multibeam SEM' ELSE 'electron tomography' END END AS shown FROM part""")
def shown_modalities(t: Tables) -> DataFrame:
    """Given names, aliases, and terms without one."""
    hit = F.get(F.array(*map(F.lit, ["sbfsem", "cem500k", "vem", "sstem", "volume em", "multi-beam sem", "electron tomography"])), F.col("p_partkey") % 7)
    given = F.when(F.col("p_partkey") % 4 == 0, "Given").when(F.col("p_partkey") % 3 == 0, " ")
    return t.part.select("p_partkey", catalog.display_modality(given, hit).alias("shown"))


@BOOK.add("""SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'SBF-SEM ; SEM' WHEN 'SMALL' THEN 'EM' WHEN 'LARGE' THEN 'FIB-SEM ; ssTEM ; SEM' WHEN 'ECONOMY' THEN 'TEM' END AS methods, p_type IN ('PROMO', 'SMALL', 'LARGE', 'ECONOMY') AS relevant FROM part""")
def project_looks(t: Tables) -> DataFrame:
    """What texts of projects tell, and whether harvested records with them would be kept."""
    text = F.coalesce(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.col("p_type")], F.lit(""))
    return t.part.select("p_partkey", catalog.project_methods(text).alias("methods"), catalog.harvested_relevance(F.lower(text)).alias("relevant"))


@BOOK.add("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS org, o_orderkey % 5 AS f, o_orderkey % 3 AS st FROM orders), d AS (SELECT *, CASE org WHEN 0 THEN 'm-default' WHEN 1 THEN 'n-default' ELSE 'manual' END AS dflt FROM o)
SELECT o_orderkey, CASE WHEN f = 0 AND org = 0 THEN 'm-one' WHEN f = 0 AND org = 1 THEN 'n-one' WHEN f = 1 AND org = 0 THEN 'm-two' WHEN f IN (0, 1, 2) AND f = 2 THEN dflt WHEN st IN (0, 1) THEN 'manual' ELSE dflt END AS model FROM d""")
def source_models(t: Tables) -> DataFrame:
    """Objects with a family, a mark, no features, or a mark that says no; labels given by hand or not."""
    k = lambda n: F.col("o_orderkey") % n
    said = F.when(k(5) == 0, F.create_map(F.lit("model_family"), F.lit(" One "))).when(k(5) == 1, F.create_map(F.lit("model_family"), F.lit("two"))).when(k(5) == 2, F.create_map(F.lit("model_family"), F.lit("other"), F.lit("er_generated"), F.lit("true"))).when(k(5) == 3, F.create_map(F.lit("mito_generated"), F.lit("false")))
    organelle = F.when(k(4) == 0, "mito").when(k(4) == 1, "nucleus").when(k(4) == 2, "golgi")
    state = F.when(k(3) == 0, "CONFIRMED").when(k(3) == 1, "EXCLUDED").otherwise("CANDIDATE")
    model = analysis.source_model(said, state, organelle, {"mito": {"one": "m-one", "two": "m-two"}, "nucleus": {"one": "n-one"}}, {"mito": "m-default", "nucleus": "n-default"})
    return t.orders.select("o_orderkey", model.alias("model"))


@BOOK.add("""SELECT event_id, 'r.list[1].x' AS path, 'Infinity' AS value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'r.named.' || event_type, 'NaN' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'plain', '-Infinity' FROM events WHERE event_id % 7 = 0""")
def numbers_in_results(t: Tables) -> DataFrame:
    """Results with structs, lists and maps, some of whose numbers no JSON can hold."""
    when = lambda n, bad: F.when(F.col("event_id") % n == 0, F.lit(float(bad))).otherwise(F.col("value"))
    listed = F.array(F.struct(F.col("value").alias("x")), F.struct(when(3, "inf").alias("x")))
    r = F.struct(listed.alias("list"), F.create_map("event_type", when(5, "nan"), F.lit("_hidden"), F.lit(float("nan"))).alias("named"), F.lit(float("nan")).alias("_skipped"), F.col("event_type").alias("kind"))
    d = t.events.select("event_id", r.alias("r"), when(7, "-inf").alias("plain"))
    return analysis.non_finite(d, "event_id").withColumn("value", F.col("value").cast("string"))


@BOOK.add("SELECT event_id, CASE WHEN value > 5 THEN event_type END AS first, 2 + CASE WHEN value > 5 THEN 1 ELSE 0 END AS n FROM events")
def named_at_depth(t: Tables) -> DataFrame:
    """Each event as nested JSON, ten levels deep, with the names spelt in several ways."""
    kind = F.when(F.col("value") > 5, F.col("event_type"))
    inner = F.to_json(F.struct(F.array(F.struct(kind.alias("Sample Type"))).alias("a"), F.struct(F.array(F.col("user_id").cast("string")).alias("sample-type"), F.struct(F.col("value").alias("SAMPLE_TYPE")).alias("z")).alias("b")))
    deep = F.concat(F.lit('{"l":[{"l":[{"l":[{"l":'), inner, F.lit("}]}]}]}"))
    found = catalog.any_depth(deep, ["sample_type"])
    return t.events.select("event_id", F.when(kind.isNotNull(), F.get(found, F.lit(0))).alias("first"), F.size(found).cast("long").alias("n"))


@BOOK.add("""WITH v AS (SELECT DISTINCT role || ' ' || turn AS term FROM conversations UNION SELECT DISTINCT CASE WHEN role = 'user' THEN 'Patient ' ELSE 'donors ' END || turn FROM conversations) SELECT term, 'specimen' AS kind FROM v WHERE regexp_matches(term, '(?i)\\b(?:patient|donor|subject)\\s+[A-Z]?\\d')""")
def forbidden_terms(t: Tables) -> DataFrame:
    one, two = F.concat("role", F.lit(" "), "turn"), F.concat(F.when(F.col("role") == "user", "Patient ").otherwise("donors "), "turn")
    return rules.scan_terms(t.conversations.select(F.explode(F.array(one, two)).alias("term")), "term")


@BOOK.add("""WITH o AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS segment FROM orders), m AS (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS segment, c_name AS name FROM customer WHERE c_custkey % 3 > 0), j AS (SELECT o.segment AS have, m.* FROM o LEFT JOIN m USING (k))
SELECT 'segment' AS field, count(*) FILTER (WHERE have IS NULL AND segment IS NOT NULL) AS added, count(*) AS tiles, count(k) FILTER (WHERE name IS NOT NULL) AS matched FROM j UNION ALL SELECT 'name', count(name), count(*), count(name) FROM j""")
def metadata_counts(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("segment"))
    m = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_name").alias("name"))
    return tiles.enrich_counts(o, m, "k", ["segment", "name"])


@BOOK.add("SELECT count(*) AS images, count(*) FILTER (WHERE p_partkey % 5 = 0) AS unpaired FROM part")
def unpaired_images(t: Tables) -> DataFrame:
    path = lambda kind: F.concat(F.lit(f"a/{kind}/"), "p_partkey").alias("path")
    return tiles.unpaired(t.part.select(path("images")), t.part.where("p_partkey % 5 > 0").select(path("masks")), "path", "/images/", "/masks/")


@BOOK.add("SELECT sum(n)::BIGINT AS rows, count(*) AS kept, (sum(n) - count(*))::BIGINT AS dropped FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def repeated_texts(t: Tables) -> DataFrame:
    return tiles.distinct_counts(t.documents, ["text"])


@BOOK.add("""WITH m AS (SELECT DISTINCT o_custkey AS item, o_orderkey % 10 AS dataset FROM orders), v AS (SELECT c_custkey AS item, c_nationkey % 2 AS experiment FROM customer WHERE c_custkey % 3 = 0)
SELECT v.item, count(m.dataset) FILTER (WHERE m.dataset % 2 <> v.experiment) AS dropped FROM v LEFT JOIN m ON m.item = v.item GROUP BY 1""")
def lost_links(t: Tables) -> DataFrame:
    members = t.orders.select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 10).alias("dataset")).distinct()
    moves = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item"), (F.col("c_nationkey") % 2).cast("long").alias("experiment"))
    return library.dropped_links(members, moves, members.select("dataset").distinct().withColumn("experiment", F.col("dataset") % 2))


_NM = "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}') THEN {v}::DOUBLE" for p, v in splits.ESTIMATED_NM) + " END"


@BOOK.add(f"""WITH n AS (SELECT p_partkey, ['x/Protoplasma_Original', 'Figure 3_Original', 'z604', 'N22-Miao', 'xc10', 'xc07', 'cs10', 'wh5', 'C603', 'other'][p_partkey % 10 + 1] AS b0, ['mito;golgi', 'er_sheets| nuclei', 'lipid_droplets', ''][p_size % 4 + 1] AS o FROM part), l AS (SELECT *, lower(regexp_extract(b0, '[^/]*$')) AS b, [trim(x) FOR x IN string_split(replace(o, '|', ';'), ';')] AS os FROM n)
SELECT p_partkey, {_NM} AS nm, concat_ws(',', CASE WHEN list_contains(os, 'mito') THEN 'mito' END, CASE WHEN list_contains(os, 'er_sheets') THEN 'er' END, CASE WHEN list_contains(os, 'nuclei') THEN 'nucleus' END, CASE WHEN list_contains(os, 'lipid_droplets') THEN 'ld' END) AS families FROM l""")
def file_families(t: Tables) -> DataFrame:
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    base = at(["x/Protoplasma_Original", "Figure 3_Original", "z604", "N22-Miao", "xc10", "xc07", "cs10", "wh5", "C603", "other"], (F.col("p_partkey") % 10).cast("int"))
    kinds = at(["mito;golgi", "er_sheets| nuclei", "lipid_droplets", ""], F.col("p_size") % 4)
    return t.part.select("p_partkey", splits.estimated_nm(F.concat(F.lit("d/"), base, F.lit(".TIF"))).alias("nm"), F.array_join(splits.families(splits.organelle_set(kinds)), ",").alias("families"))


@BOOK.add(f"""WITH {PX}, st AS (SELECT unnest([0.2, 0.5, 0.8]) AS threshold), c AS (SELECT image, threshold, count(*) FILTER (WHERE v / 50 >= threshold AND flag = 'A') AS tp, count(*) FILTER (WHERE v / 50 >= threshold AND flag <> 'A') AS fp, count(*) FILTER (WHERE v / 50 < threshold AND flag = 'A') AS fn FROM px, st GROUP BY 1, 2),
d AS (SELECT image, threshold::DOUBLE AS threshold, CASE WHEN tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS dice FROM c), b AS (SELECT threshold FROM d WHERE image % 2 = 0 GROUP BY 1 ORDER BY avg(dice) DESC, threshold LIMIT 1) SELECT image, round(dice, 9) AS dice, d.threshold FROM d JOIN b ON d.threshold = b.threshold WHERE image % 2 = 1""")
def held_out_dice(t: Tables) -> DataFrame:
    d = pixels(t).select("image", (F.col("v") / 50).alias("prob"), (F.col("flag") == "A").cast("int").alias("truth"))
    swept = labels.threshold_sweep(d, "image", "prob", "truth", [0.2, 0.5, 0.8])
    return rounded(labels.held_out_threshold(swept.where("image % 2 = 0"), swept.where("image % 2 = 1"), "image"), "dice")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
