"""Scores of label tables: confusion ratios, contingency, instance matching, information distance, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.numbers import ratio
from lamella.operators.rounds import persist
from lamella.operators.scans import Scan, percentiles, scan
from lamella.operators.spatial import nearest


def confusion(df: DataFrame, keys: list[str], pred: Column, truth: Column, both_empty: str = "one", smooth: float = 0.0) -> DataFrame:
    """Counts and ratios by key. both_empty: one, null, or drop for keys where neither side has anything."""
    d = df.groupBy(*keys).agg(F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn"), F.count_if(~pred & ~truth).alias("tn"))
    empty = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    if both_empty == "drop":
        d = d.where(~empty)
    other = F.lit(1.0) if both_empty == "one" else F.lit(None).cast("double")
    part = lambda a, b: F.when(empty, other).otherwise(F.coalesce(ratio(a + smooth, b + smooth), F.lit(0.0)))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return d.withColumns({
        "dice": part(2 * tp, 2 * tp + fp + fn), "iou": part(tp, tp + fp + fn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "specificity": F.coalesce(ratio(tn, tn + fp), F.lit(1.0)),
    })


def contingency(df: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """keys, p, g, n with both areas; 0 is background."""
    d = df.groupBy(*keys, F.col(pred).alias("p"), F.col(truth).alias("g")).agg(F.count("*").alias("n"))
    area = lambda c: F.sum("n").over(Window.partitionBy(*keys, c))
    return d.withColumn("area_p", area("p")).withColumn("area_g", area("g"))


def instance_pairs(cont: DataFrame) -> DataFrame:
    return cont.where("p <> 0 and g <> 0").withColumn("iou", F.col("n") / (F.col("area_p") + F.col("area_g") - F.col("n")))


def mutual_best(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One-to-one matches by falling overlap: pairs that are best for both sides match, their rivals go, until none is left.

    Above 0.5 pairs are unique by themselves. Equal to the greedy order, with ties broken by ids.
    """
    live = pairs.where(F.col("iou") >= threshold)
    if threshold > 0.5:
        return live
    order = [F.desc("iou"), F.asc("p"), F.asc("g")]
    out, done = None, 0
    while True:
        ranked = live.withColumn("rp", F.row_number().over(Window.partitionBy(*keys, "p").orderBy(*order))).withColumn("rg", F.row_number().over(Window.partitionBy(*keys, "g").orderBy(*order)))
        won = persist(ranked.where("rp = 1 and rg = 1").drop("rp", "rg"))
        out = won if out is None else out.unionByName(won)
        live = persist(live.join(won.select(*keys, "p"), [*keys, "p"], "left_anti").join(won.select(*keys, "g"), [*keys, "g"], "left_anti"))
        if live.isEmpty():
            return out
        done += 1
        out = out if done % 20 else persist(out)


def panoptic(cont: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """n_pred, n_true, tp, sq, rq, pq, precision, recall and f1 by key; pairs must overlap by more than the threshold."""
    pairs = instance_pairs(cont).where(F.col("iou") > threshold)
    matched = pairs.groupBy(*keys).agg(F.count("*").alias("tp"), F.sum("iou").alias("s"))
    sides = cont.groupBy(*keys).agg(F.countDistinct(F.when(F.col("p") != 0, F.col("p"))).alias("n_pred"), F.countDistinct(F.when(F.col("g") != 0, F.col("g"))).alias("n_true"))
    d = sides.join(matched, keys, "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("s", F.coalesce("s", F.lit(0.0)))
    sq, rq = F.coalesce(ratio(F.col("s"), F.col("tp")), F.lit(0.0)), F.coalesce(ratio(2.0 * F.col("tp"), F.col("n_pred") + F.col("n_true")), F.lit(0.0))
    return d.select(*keys, "n_pred", "n_true", "tp", sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"), F.coalesce(ratio(F.col("tp"), F.col("n_pred")), F.lit(0.0)).alias("precision"), F.coalesce(ratio(F.col("tp"), F.col("n_true")), F.lit(0.0)).alias("recall"))


def average_precision(pairs: DataFrame, confidence: DataFrame, truths: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """All-point average precision by key and threshold: predictions in order of confidence, each true object found once.

    pairs: keys, p, g, iou; confidence: keys, p, score; truths: keys, n_true.
    """
    t = confidence.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    best = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("iou >= threshold")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "threshold", "p").orderBy(F.desc("iou"), "g"))).where("r = 1")
    best = best.join(confidence, [*keys, "p"]).withColumn("first", F.row_number().over(Window.partitionBy(*keys, "threshold", "g").orderBy(F.desc("score"), "p")))
    d = t.join(best.where("first = 1").select(*keys, "threshold", "p", F.lit(1).alias("hit")), [*keys, "threshold", "p"], "left").join(truths, keys)
    by = [*keys, "threshold"]
    d = scan(d, by, [F.desc("score"), F.asc("p")], tp=Scan(F.coalesce("hit", F.lit(0))), k=Scan(F.lit(1))).withColumn("precision", F.col("tp") / F.col("k"))
    d = scan(d, by, [F.asc("score"), F.desc("p")], envelope=Scan("precision", "max"))
    return d.groupBy(*keys, "threshold").agg((F.sum(F.when(F.col("hit") == 1, F.col("envelope") / F.col("n_true")).otherwise(0.0))).alias("ap"))


def variation_of_information(cont: DataFrame, keys: list[str]) -> DataFrame:
    """Split and merge parts in bits, background included."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    d = cont.withColumn("w", F.col("n") / total)
    return d.groupBy(*keys).agg((-F.sum(F.col("w") * F.log2(F.col("n") / F.col("area_g")))).alias("vi_split"), (-F.sum(F.col("w") * F.log2(F.col("n") / F.col("area_p")))).alias("vi_merge"))


def binned_auprc(df: DataFrame, keys: list[str], score: Column, truth: Column, bins: int = 256) -> DataFrame:
    """Average precision over score bins, from the highest down; null without positives."""
    b = F.least(F.lit(bins - 1), F.floor(score * bins))
    h = df.groupBy(*keys, b.alias("bin")).agg(F.count_if(truth).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    h = h.withColumn("tp", F.sum("pos").over(w)).withColumn("k", F.sum("n").over(w))
    return h.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("k")), F.sum("pos")).alias("auprc"))


def threshold_sweep(df: DataFrame, crop: str, prob: str, truth: str, steps: list[float]) -> DataFrame:
    """crop, threshold, dice: null where neither side has anything."""
    d = df.withColumn("threshold", F.explode(F.array(*map(F.lit, steps))))
    return confusion(d, [crop, "threshold"], F.col(prob) >= F.col("threshold"), F.col(truth) == 1, "null").select(crop, "threshold", "dice")


def best_threshold(swept: DataFrame) -> DataFrame:
    """threshold, dice: the best mean over crops that have one; the lowest threshold of equal ones."""
    m = swept.groupBy("threshold").agg(F.avg("dice").alias("dice"))
    return m.orderBy(F.desc("dice"), "threshold").limit(1)


def per_crop_best(swept: DataFrame, crop: str) -> DataFrame:
    return swept.where("dice is not null").groupBy(crop).agg(F.max("dice").alias("dice"), F.max_by("threshold", F.struct("dice", -F.col("threshold"))).alias("threshold"))


def boundary_pixels(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of a mask (keys, x, y) with a side neighbour outside it."""
    near = mask.select(*keys, F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("q")).select(*keys, "q.x", "q.y")
    inside = near.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")).where("n = 4")
    return mask.join(inside, [*keys, "x", "y"], "left_anti")


def run_boundary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, x, y) with a side neighbour outside a mask of maximal runs (keys, y, x0, x1); those inside are never written out.

    Three runs lie about a pixel inside: its own without the ends, and those of the rows above and below. Along each row
    the edges of all these are summed up, and the stretches of the mask that have fewer than three are its boundary.
    """
    x0, x1, y = F.col("x0"), F.col("x1"), F.col("y")
    stretch = lambda row, low, high, own, near: F.array(*[F.struct(row.alias("y"), at.alias("x"), F.lit(k * own).alias("own"), F.lit(k * near).alias("near")) for at, k in ((low, 1), (high, -1))])
    parts = F.concat(stretch(y, x0, x1 + 1, 1, 0), stretch(y, x0 + 1, F.greatest(x1, x0 + 1), 0, 1), stretch(y - 1, x0, x1 + 1, 0, 1), stretch(y + 1, x0, x1 + 1, 0, 1))
    edges = runs.select(*keys, F.explode(parts).alias("e")).groupBy(*keys, "e.y", "e.x").agg(F.sum("e.own").alias("own"), F.sum("e.near").alias("near"))
    w = Window.partitionBy(*keys, "y").orderBy("x")
    d = edges.select(*keys, "y", "x", F.sum("own").over(w).alias("own"), F.sum("near").over(w).alias("near"), F.lead("x").over(w).alias("end"))
    return d.where("own = 1 and near < 3").select(*keys, F.explode(F.sequence("x", F.col("end") - 1)).alias("x"), "y")


def band(mask: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Pixels of a mask within taxicab distance d of a pixel outside it."""
    edge = boundary_pixels(mask, keys).withColumnsRenamed({"x": "ex", "y": "ey"})
    reach = F.sequence(F.lit(-(d - 1)), F.lit(d - 1))
    near = edge.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach)).where(F.abs("dx") + F.abs("dy") <= d - 1)
    near = near.select(*keys, (F.col("ex") + F.col("dx")).alias("x"), (F.col("ey") + F.col("dy")).alias("y")).distinct()
    return mask.join(near, [*keys, "x", "y"], "left_semi")


def set_iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """iou of two pixel sets by key, 1 where both are empty."""
    every = a.select(*keys, "x", "y", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, "x", "y", F.lit(0).alias("a"), F.lit(1).alias("b")))
    d = every.groupBy(*keys, "x", "y").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return d.groupBy(*keys).agg((F.count_if((F.col("a") == 1) & (F.col("b") == 1)) / F.count("*")).alias("iou"))


def boundary_f1(pred: DataFrame, truth: DataFrame, images: DataFrame, image: str, tolerance: float) -> DataFrame:
    """image, precision, recall, f1 of boundary pixels within a tolerance of the other side's boundary, for every one of `images`; 1 where both sides are empty."""
    side = lambda df: boundary_pixels(df, [image]).select(image, F.struct(image, "x", "y").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p, t = side(pred), side(truth)

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        reach = max(tolerance, 1.0)
        near = F.explode(F.expr("flatten(transform(sequence(-1L, 1L), i -> transform(sequence(-1L, 1L), j -> struct(cx + i as cx, cy + j as cy))))"))
        cell = lambda df: df.withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
        probe = cell(a).select(image, "point_id", "x", "y", near.alias("c")).select(image, "point_id", "x", "y", "c.cx", "c.cy")
        hits = probe.join(cell(b).select(image, F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy"), [image, "cx", "cy"])
        hits = hits.where((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 <= tolerance**2).select("point_id").distinct()
        return a.join(hits.withColumn("hit", F.lit(1)), "point_id", "left").groupBy(image).agg((F.count("hit") / F.count("*")).alias(name))

    d = images.select(image).distinct().join(share(p, t, "precision"), image, "left").join(share(t, p, "recall"), image, "left")
    empty = F.when(F.col("precision").isNull() & F.col("recall").isNull(), 1.0).otherwise(0.0)
    d = d.select(image, *[F.coalesce(c, empty).alias(c) for c in ("precision", "recall")])
    return d.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def hd95(pred: DataFrame, truth: DataFrame, sizes: DataFrame, image: str) -> DataFrame:
    """image, hd95: the larger of both sides' 95th percentile of the distances from boundary pixels to the other side's boundary.

    An image of `sizes` (image, width, height) with one side only has its diagonal, and 0 if it has none.
    """
    side = lambda df: boundary_pixels(df.select(image, "x", "y").distinct(), [image]).select(image, F.struct("x", "y").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p, t = persist(side(pred)), persist(side(truth))
    far = lambda a, b, name: percentiles(nearest(a, b, within=(image,)), [image], "distance", [0.95]).select(image, F.col("q")[0].alias(name))
    some = p.select(image).unionByName(t.select(image)).distinct().withColumn("some", F.lit(True))
    d = sizes.select(image, F.sqrt(F.pow("width", 2) + F.pow("height", 2)).alias("diagonal")).join(some, image, "left")
    d = d.join(far(p, t, "a"), image, "left").join(far(t, p, "b"), image, "left")
    return d.select(image, F.when(F.col("some").isNull(), 0.0).otherwise(F.coalesce(F.greatest("a", "b"), "diagonal")).alias("hd95"))


def crop_specification(splits: DataFrame, manifest: DataFrame, values: dict[str, list[int]]) -> DataFrame:
    """Test crops (dataset, crop_id, organelle) with their manifest entry and the label values of the organelle: its own by name, else the fixed ones."""
    m = manifest.select("dataset", "crop_id", "path", "names")
    fixed = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.map_keys(F.map_filter("names", lambda k, v: F.contains(F.lower(v), F.lower(F.col("organelle")))))
    return splits.where("split = 'test'").join(m, ["dataset", "crop_id"]).withColumn("values", F.when(F.size(own) > 0, F.sort_array(own)).otherwise(fixed[F.col("organelle")])).drop("names")


def held_out_threshold(train: DataFrame, held: DataFrame, crop: str) -> DataFrame:
    """crop, dice, threshold: held-out crops of a sweep at the threshold that is best on the training crops."""
    best = best_threshold(train).select(F.col("threshold").alias("best"))  # one row
    return held.join(F.broadcast(best), F.col("threshold") == F.col("best")).select(crop, "dice", "threshold")
