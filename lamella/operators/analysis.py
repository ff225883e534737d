"""Objects, compartments and points: measures, enrichment, randomness nulls, roll-ups with warnings, bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.numbers import finite, ratio
from lamella.operators.rounds import persist
from lamella.operators.scans import Scan, scan, with_percentiles
from lamella.operators.levels import holding
from lamella.operators.spatial import run_overlap, run_union
from lamella.operators.stats import rollup_units

PI = 3.141592653589793


def measure_objects(pixels: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """Area, centre, box, diameter, axes, eccentricity, orientation and intensity of each object, from sums over its pixels (x, y)."""
    x, y, n = F.col("x").cast("double"), F.col("y").cast("double"), F.count("*")
    sums = [n.alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy")]
    if value:
        sums += [F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("sd")]
    d = pixels.groupBy(*keys).agg(*sums)
    vx, vy, vxy = F.col("xx") - F.col("cx") ** 2 + 1 / 12, F.col("yy") - F.col("cy") ** 2 + 1 / 12, F.col("xy") - F.col("cx") * F.col("cy")
    root = F.sqrt((vx - vy) ** 2 + 4 * vxy**2)
    d = d.withColumn("major", 4 * F.sqrt((vx + vy + root) / 2)).withColumn("minor", 4 * F.sqrt(F.greatest(F.lit(0.0), (vx + vy - root) / 2)))
    d = d.withColumn("orientation", 0.5 * F.atan2(2 * vxy, vx - vy)).withColumn("diameter", F.sqrt(4 * F.col("area") / PI))
    return d.withColumn("eccentricity", F.when(F.col("major") > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - (F.col("minor") / F.col("major")) ** 2)))).drop("xx", "yy", "xy")


def intensity(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    d = with_percentiles(pixels.groupBy(*keys).agg(F.avg(value).alias("mean")), pixels, keys, value, [0.1, 0.5, 0.9])
    return d.select(*keys, "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def object_summary(objects: DataFrame, image: str, tissue: DataFrame) -> DataFrame:
    """Per image the objects' number, mean area and their share of the tissue (image, tissue_area)."""
    d = objects.groupBy(image).agg(F.count("*").alias("n"), F.avg("area").alias("mean_area"), F.sum("area").alias("area"))
    return tissue.join(d, image, "left").select(image, F.coalesce("n", F.lit(0)).alias("n"), "mean_area", ratio(F.coalesce("area", F.lit(0)).cast("double"), F.col("tissue_area")).alias("fraction"))


def shape(df: DataFrame, nm: str) -> DataFrame:
    """Calibrated and derived shape values from area, perimeter and axes; missing stays missing, impossible circularity is refused."""
    um = F.col(nm) / 1000
    circ = 4 * PI * F.col("area") / F.nullif(F.col("perimeter") ** 2, F.lit(0.0))
    return df.withColumns({
        "area_um2": F.col("area") * um * um, "perimeter_um": F.col("perimeter") * um, "aspect": ratio(F.col("major"), F.col("minor")),
        "circularity": F.when(circ <= 1.0, circ), "refused": F.when(circ > 1.0, "circularity above 1"), "diameter_um": F.sqrt(4 * F.col("area") / PI) * um,
    })


def density(objects: DataFrame, image: str, areas: DataFrame) -> DataFrame:
    """Objects per area (image, area_um2); null without area."""
    n = objects.groupBy(image).agg(F.count("*").alias("n"))
    return areas.join(n, image, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("density", ratio(F.col("n").cast("double"), F.col("area_um2")))


def compartment_areas(runs: DataFrame, image: str, tissue: str, nm: float | None = None, nucleus: str = "nucleus", cytoplasm: str = "cytoplasm") -> DataFrame:
    """image, label, area, fraction, area_um2: each label's runs (image, label, y, x0, x1) inside the tissue, and its share of it.

    Where there is a nucleus and no cytoplasm, that is the tissue without the nucleus. Shares are 0 where there is no
    tissue; without a positive pixel size there are no micron areas.
    """
    merged = run_union(runs, [image, "label"])
    t = merged.where(F.col("label") == tissue)
    total = t.groupBy(image).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    inner = run_overlap(merged.where(F.col("label") != tissue), t, [image]).select(image, F.col("a_label").alias("label"), F.col("shared").alias("area"))
    every = runs.select(image, "label").distinct()
    d = every.join(inner.unionByName(total.select(image, F.lit(tissue).alias("label"), "area")), [image, "label"], "left").withColumn("area", F.coalesce("area", F.lit(0)))
    d = d.join(total.withColumnRenamed("area", "total"), image, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    cored = d.groupBy(image).agg(F.max(F.when(F.col("label") == nucleus, F.col("area"))).alias("core"), F.max("total").alias("total"), F.bool_or(F.col("label") == cytoplasm).alias("own"))
    rest = cored.where("core is not null and not own").select(image, F.lit(cytoplasm).alias("label"), (F.col("total") - F.col("core")).alias("area"), "total")
    um2 = F.col("area") * (nm / 1000) ** 2 if nm and nm > 0 else F.lit(None).cast("double")
    return d.unionByName(rest).select(image, "label", "area", F.coalesce(ratio(F.col("area").cast("double"), F.col("total")), F.lit(0.0)).alias("fraction"), um2.alias("area_um2"))


def assign_points(points: DataFrame, runs: DataFrame, image: str, width: int = 256) -> DataFrame:
    """Points (image, point_id, x, y) with the list of labels whose runs hold them; places are rounded half to even."""
    p = points.withColumn("px", F.rint("x").cast("long")).withColumn("py", F.rint("y").cast("long")).withColumn("c", F.floor(F.col("px") / width))
    r = runs.withColumn("c", F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width)))).withColumnRenamed("y", "py")
    hits = p.join(r, [image, "py", "c"]).where("px between x0 and x1").groupBy(image, "point_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return points.join(hits, [image, "point_id"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def enrichment(assigned: DataFrame, areas: DataFrame, image: str) -> DataFrame:
    """image, label, n, share, enrichment: point share over area share; null without points or area."""
    total = assigned.groupBy(image).agg(F.count_if(F.size("labels") > 0).alias("total"))
    n = assigned.select(image, F.explode("labels").alias("label")).groupBy(image, "label").agg(F.count("*").alias("n"))
    d = areas.select(image, "label", "fraction").join(total, image, "left").join(n, [image, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = ratio(F.col("n").cast("double"), F.col("total"))
    return d.select(image, "label", "n", share.alias("share"), ratio(share, F.col("fraction")).alias("enrichment"))


def readable(x: Column, y: Column) -> Column:
    return finite(x).isNotNull() & finite(y).isNotNull()


def out_of_image(x: Column, y: Column, width: Column, height: Column) -> Column:
    return ~(readable(x, y)) | (F.rint(x) < 0) | (F.rint(y) < 0) | (F.rint(x) >= width) | (F.rint(y) >= height)


def pixel_index(v: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.rint(v).cast("long"), n - 1))


#: So many draws of one replicate are made from one row.
DRAWS = 16_384


def ordinals(runs: DataFrame, image: str) -> DataFrame:
    """A mask's runs with `len` and `from`: a run holds a range of the ordinals of its image's area."""
    r = runs.withColumn("len", (F.col("x1") - F.col("x0") + 1).cast("long"))
    return scan(r, [image], ["y", "x0"], **{"from": Scan("len", inclusive=False)}).withColumn("from", F.coalesce("from", F.lit(0).cast("long")))


def drawn(runs: DataFrame, counts: DataFrame, image: str, replicates: int, seed: str) -> DataFrame:
    """image, rep, i, o, and further columns of counts: ordinals of a mask's area, picked by a hash of (seed, image, replicate, number).

    Stretches of numbers are dealt before they are written out, so that few images make tasks enough.
    """
    area = runs.groupBy(image).agg(F.sum("len").alias("area"))
    d = counts.where("n > 0").join(area, image).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    d = d.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n").cast("long") - 1), F.lit(DRAWS).cast("long"))))
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), image, "rep", "at")
    d = d.withColumn("__name", F.concat_ws(":", F.lit(seed), F.col(image).cast("string"), F.col("rep").cast("string"), F.lit("")))
    d = d.withColumn("i", F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + DRAWS, F.col("n").cast("long")))))
    o = F.pmod(F.conv(F.substring(F.md5(F.concat("__name", F.col("i").cast("string"))), 1, 15), 16, 10).cast("long"), F.col("area"))
    # never null, so that no join computes it once more to see
    return d.select(*[c for c in counts.columns if c != "n"], "rep", "i", F.coalesce(o, F.lit(-1).cast("long")).alias("o"))


def null_draws(runs: DataFrame, counts: DataFrame, image: str, replicates: int, seed: str) -> DataFrame:
    """image, rep, i, x, y: as many uniform places in a mask's runs as counted points (image, n), for each replicate.

    A hash of (seed, image, replicate, number) picks an ordinal of the mask's area; a run holds a range of ordinals, and
    both are bucketed by it.
    """
    r = ordinals(runs, image)
    d = drawn(r, counts, image, replicates, seed).withColumn("c", F.floor(F.col("o") / 1024))
    r = r.withColumn("c", F.explode(F.sequence(F.floor(F.col("from") / 1024), F.floor((F.col("from") + F.col("len") - 1) / 1024))))
    hit = d.join(r.select(image, "y", "x0", "from", "len", "c"), [image, "c"]).where("o >= `from` and o < `from` + len")
    return hit.select(image, "rep", "i", (F.col("x0") + F.col("o") - F.col("from")).alias("x"), "y")


def null_counts(tissue: DataFrame, runs: DataFrame, counts: DataFrame, image: str, replicates: int, seed: str, width: int = 256) -> DataFrame:
    """image, rep, label, n: how many of the places of null_draws lie in each label's runs; tissue has its `ordinals`.

    Each place, an ordinal of an image's mask, gets its set of labels, named by the first of its places. A draw is only
    counted under that name: it meets one row, and travels once, as two numbers.
    """
    images = persist(counts.select(image, F.row_number().over(Window.orderBy(image)).alias("__image")))  # a row an image
    counts, place = counts.join(images, image), (F.col("__image").cast("long") * 2**40 + F.col("o")).alias("place")
    cell = F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width)))
    a = tissue.select(image, "y", F.col("x0").alias("t0"), F.col("x1").alias("t1"), "from", cell.alias("c"))
    b = run_union(runs, [image, "label"]).select(image, "label", "y", "x0", "x1", cell.alias("c"))
    low, high = F.greatest("t0", "x0", F.col("c") * width), F.least("t1", "x1", F.col("c") * width + width - 1)
    met = a.join(b, [image, "y", "c"]).where(low <= high)
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, image, "y", "c")  # runs are few rows, their pixels many
    pixels = met.select(image, "label", F.explode(F.sequence(F.col("from") + low - F.col("t0"), F.col("from") + high - F.col("t0"))).alias("o"))
    held = pixels.join(images, image).select(image, "label", place)
    held = persist(held.repartition(parts, image, "place").groupBy(image, "place").agg(F.sort_array(F.collect_list("label")).alias("labels")))
    sets = persist(held.groupBy(image, "labels").agg(F.min("place").alias("set")))
    own = held.join(sets, [image, "labels"]).select("place", "set")
    n = drawn(tissue, counts, image, replicates, seed).select(place, "rep").join(own.hint("shuffle_hash"), "place").groupBy("rep", "set").agg(F.count("*").alias("n"))
    return n.join(sets, "set").select(image, "rep", F.explode("labels").alias("label"), "n").groupBy(image, "rep", "label").agg(F.sum("n").alias("n"))


def null_summary(observed: DataFrame, null: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, observed, null_mean, null_sd, z, p: p is two-sided with one added; z and p are null if the null doesn't vary.

    Two distances from the mean are equal if they differ by no more than rounding can make: that of the values (three
    times each), of their mean, in whatever order it is summed, and of the differences.
    """
    rounding = (F.count(value) + 16) * 2.0**-52 * F.max(F.abs(value))
    n = null.groupBy(*keys).agg(F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"), F.count(value).alias("reps"), rounding.alias("rounding"))
    d = observed.select(*keys, F.col(value).alias("observed")).join(n, keys)
    far = null.join(d.select(*keys, "observed", "null_mean", "rounding"), keys).groupBy(*keys).agg(F.count_if(F.abs(F.col(value) - F.col("null_mean")) + F.col("rounding") >= F.abs(F.col("observed") - F.col("null_mean"))).alias("far"))
    ok = (F.col("null_sd") > 0) & (F.col("reps") > 1)
    return d.join(far, keys).select(*keys, "observed", "null_mean", "null_sd", F.when(ok, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")).alias("z"), F.when(ok, (F.col("far") + 1) / (F.col("reps") + 1)).alias("p"))


def randomness(points: DataFrame, runs: DataFrame, areas: DataFrame, image: str, mask: str, replicates: int, seed: str, metric: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """image, label, observed, null_mean, null_sd, z, p: a statistic of the points in the mask against uniform places there.

    Each replicate draws as many places as the image has points in the mask, and only those points are observed: both
    sides see the same population. metric(points, areas, unit) gives (unit, label, enrichment) for points (unit, image,
    point_id, x, y) and areas (unit, label, fraction); it is applied to both sides. A unit is an image and a replicate.
    """
    return null_summary(*randomised(points, runs, areas, image, mask, replicates, seed, metric), [image, "label"], "enrichment")


def randomised(points: DataFrame, runs: DataFrame, areas: DataFrame, image: str, mask: str, replicates: int, seed: str, metric: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The statistic of the points in the mask (image, label, enrichment) and that of each replicate (with rep).

    Enrichment, the metric unless another is given, needs counts only. Where more places are drawn than the mask has
    pixels, these are counted by ordinal (null_counts); otherwise the places meet the runs one by one.
    """
    tissue = runs.where(F.col("label") == mask)
    inside = persist(assign_points(points.select(image, "point_id", "x", "y"), tissue, image).where(F.size("labels") > 0))
    counts = persist(inside.groupBy(image).agg(F.count("*").alias("n")))
    if metric is None:
        r = persist(ordinals(tissue, image))
        size = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
        if size(r, "len") <= replicates * size(counts, "n"):
            some = areas.join(counts.withColumnRenamed("n", "total"), image).select(image, "label", "fraction", "total")
            seen = enrichment(assign_points(inside.drop("labels"), runs, image), some, image).select(image, "label", "enrichment")
            n = null_counts(r, runs.where(F.col("label") != mask), counts, image, replicates, seed)
            every = some.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).join(n, [image, "rep", "label"], "left")
            share = ratio(F.when(F.col("label") == mask, F.col("total")).otherwise(F.coalesce("n", F.lit(0))).cast("double"), F.col("total"))
            return persist(seen), persist(every.select(image, "rep", "label", ratio(share, F.col("fraction")).alias("enrichment")))
    metric = metric or (lambda p, a, unit: enrichment(assign_points(p, runs, image), a, unit))
    draws = null_draws(tissue, counts, image, replicates, seed)
    place = [F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    seen = inside.select(image, F.lit(-1).alias("rep"), F.struct(F.lit(-1).alias("rep"), F.col("point_id").cast("string").alias("i")).alias("point_id"), *place)
    drawn = draws.select(image, "rep", F.struct("rep", F.col("i").cast("string").alias("i")).alias("point_id"), *place)
    unit = F.struct(F.col(image).alias("image"), "rep")
    every = seen.unionByName(drawn).withColumn("unit", unit)
    reps = inside.select(image).distinct().withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    unit_areas = areas.join(reps, image).select(unit.alias("unit"), "label", "fraction")
    found = persist(metric(every, unit_areas, "unit").select(F.col("unit.image").alias(image), F.col("unit.rep").alias("rep"), "label", "enrichment"))
    return found.where("rep < 0").drop("rep"), found.where("rep >= 0")


def internal_control(null_means: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """worst, ok: null enrichment must be about 1."""
    return null_means.agg(F.max(F.abs(F.col("null_mean") - 1)).alias("worst")).withColumn("ok", F.col("worst") <= tolerance)


#: Fixed values of the self-check: points that the smallest compartment should get, and bounds of the number drawn.
PER_COMPARTMENT, LEAST_POINTS, MOST_POINTS = 2_000, 2_000, 50_000


def self_check(runs: DataFrame, areas: DataFrame, image: str, mask: str, seed: str) -> DataFrame:
    """image, n_points, smallest, worst: how far from 1 the enrichment of uniform places is in any compartment of an image.

    So many places are drawn that the smallest compartment with an area gets enough, but no more than the mask has
    pixels. An image whose mask is empty has 0 points and nulls.
    """
    tissue = runs.where(F.col("label") == mask)
    total = tissue.groupBy(image).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    least = areas.groupBy(image).agg(F.min(F.when(F.col("fraction") > 0, F.col("fraction"))).alias("smallest"))
    want = F.greatest(F.lit(LEAST_POINTS), F.floor(F.lit(PER_COMPARTMENT) / F.coalesce("smallest", F.lit(1.0))))
    n = F.when(F.col("area") > 0, F.least(F.lit(MOST_POINTS), "area", want)).otherwise(0).cast("long")
    plan = persist(least.join(total, image, "left").select(image, n.alias("n"), F.when(F.col("area") > 0, F.coalesce("smallest", F.lit(1.0))).alias("smallest")))
    drawn = null_draws(tissue, plan, image, 1, seed).select(image, F.col("i").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = enrichment(assign_points(drawn, runs, image), areas, image).groupBy(image).agg(F.max(F.abs(F.col("enrichment") - 1)).alias("worst"))
    return plan.join(found, image, "left").select(image, F.col("n").alias("n_points"), "smallest", F.when(F.col("n") > 0, F.col("worst")).alias("worst"))


def group_warnings(runs: DataFrame, group: str, run: str) -> DataFrame:
    """group, warning, runs: warnings once each in order of first appearance, with the runs that gave them (warnings is a list)."""
    d = runs.select(group, run, F.posexplode("warnings").alias("ord", "warning"))
    return d.groupBy(group, "warning").agg(F.min("ord").alias("first"), F.sort_array(F.collect_set(run)).alias("runs"))


def group_caveats(runs: DataFrame, group: str) -> DataFrame:
    """group, caveats: images that repeat, no label, mixed calibration, mixed scale. runs: image, label, calibrated, nm."""
    d = runs.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct("image").alias("images"), F.bool_or(F.col("label").isNull()).alias("bare"), F.bool_or("calibrated").alias("some"), F.bool_and("calibrated").alias("all"), F.countDistinct("nm").alias("scales"))
    flags = F.array(F.when(F.col("images") < F.col("n"), F.lit("repeated images")), F.when(F.col("bare"), F.lit("no label")), F.when(F.col("some") & ~F.col("all"), F.lit("mixed calibration")), F.when(F.col("scales") > 1, F.lit("mixed scale")))
    return d.select(group, F.array_compact(flags).alias("caveats"))


def circular_columns(columns: list[str], used: list[str]) -> list[str]:
    """Columns of a result that are made from what selected its rows."""
    made = {u for c in used for u in (c, f"{c}_px", f"{c}_um", f"{c}_um2", f"mean_{c}")}
    return [c for c in columns if c in made]


def _bad_numbers(v: Column, kind: T.DataType, path: Column) -> Column | None:
    """An array of (path, v) of the numbers below a value that are NaN or infinite; None if there can be none."""
    none = F.array().cast("array<struct<path: string, v: double>>")
    if isinstance(kind, T.DoubleType | T.FloatType):
        x = v.cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.array(F.struct(path.alias("path"), x.alias("v")))).otherwise(none)
    if isinstance(kind, T.StructType):
        inner = [_bad_numbers(v[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if not f.name.startswith("_")]
        inner = [x for x in inner if x is not None]
        return F.coalesce(F.concat(*inner), none) if inner else None
    if isinstance(kind, T.ArrayType):
        if _bad_numbers(F.lit(None), kind.elementType, path) is None:
            return None
        each = F.transform(v, lambda x, i: _bad_numbers(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), none)
    if isinstance(kind, T.MapType):
        if _bad_numbers(F.lit(None), kind.valueType, path) is None:
            return None
        named = F.filter(F.map_entries(v), lambda e: ~e["key"].cast("string").startswith("_"))
        each = F.transform(named, lambda e: _bad_numbers(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
        return F.coalesce(F.flatten(each), none)
    return None


def non_finite(df: DataFrame, key: str) -> DataFrame:
    """key, path, value: the numbers of a result that are NaN or infinite, in its structs, lists and maps too.

    Paths read a.b[0].c; names that begin with _ are passed over.
    """
    own = [_bad_numbers(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name != key and not f.name.startswith("_")]
    own = [x for x in own if x is not None]
    if not own:
        return df.select(key, F.lit("").alias("path"), F.lit(0.0).alias("value")).limit(0)
    return df.select(key, F.explode(F.concat(*own)).alias("x")).select(key, "x.path", F.col("x.v").alias("value"))


def tally(df: DataFrame, value: str) -> DataFrame:
    """value, n: recorded values to 12 places, missing and NaN as null."""
    v = finite(F.col(value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)
    return df.groupBy((F.bround(v, 12) if dict(df.dtypes)[value] in ("double", "float") else v).alias("value")).agg(F.count("*").alias("n"))


def image_summary(areas: DataFrame, image: str, labels: list[str]) -> DataFrame:
    """One row an image with the share of each label."""
    return areas.groupBy(image).pivot("label", labels).agg(F.first("fraction"))


def pixel_size(df: DataFrame) -> DataFrame:
    """Usable pixel size, and whether the result was made without one or calibrated afterwards."""
    good = F.when(F.col("nm") > 0, F.col("nm"))
    return df.withColumns({"usable_nm": good, "produced_without": F.col("run_nm").isNull(), "calibrated_after": F.col("run_nm").isNull() & good.isNotNull()})


#: Organelles whose mark in an object's features says that a model made it, and states that a hand gave.
MARKERS = ["mito", "er", "nucleus", "lipid"]
BY_HAND = ["CONFIRMED", "EXCLUDED"]


def source_model(features: Column, state: Column, organelle: Column, models: dict[str, dict[str, str]], defaults: dict[str, str], fallback: str = "manual") -> Column:
    """The model that made an object: by its features' model_family among the organelle's models, else the organelle's default where a
    mark says that a model did, else `manual` for labels given by hand, else the default. features: a map of texts, or null.

    models: the organelles' models by family; defaults: their default models, and `fallback` for other organelles.
    """
    default = F.coalesce(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])[organelle], F.lit(fallback))
    family = F.lower(F.trim(features["model_family"]))
    named = F.coalesce(*[F.when((organelle == o) & (family == f), F.lit(v)) for o, own in models.items() for f, v in own.items()])
    said = lambda m: F.coalesce(~F.lower(features[f"{m}_generated"]).isin("", "false", "0", "0.0", "null"), F.lit(False))
    marked = said(MARKERS[0])
    for m in MARKERS[1:]:
        marked = marked | said(m)
    return F.coalesce(named, F.when(marked, default), F.when(state.isin(*BY_HAND), F.lit("manual")), default)


def valid_region(df: DataFrame) -> DataFrame:
    """Pixels of the valid region, cut to the crop's annotation box (half-even edges) where its coverage is partial or sparse."""
    inside = (F.col("x") >= F.rint("bx0")) & (F.col("x") < F.rint("bx1")) & (F.col("y") >= F.rint("by0")) & (F.col("y") < F.rint("by1"))
    return df.where(F.col("valid") & (~F.col("coverage").isin("partial", "sparse") | inside))


def group_null(observed: DataFrame, null: DataFrame, units: DataFrame, group: list[str], unit: str, value: str) -> DataFrame:
    """group, n, observed, null_mean, null_sd, z: group means over units, observed and in every replicate (null has `rep`).

    The null's spread is that of a population; z is 0 where there is none.
    """
    mean = lambda df, *keys: df.join(units, unit).groupBy(*keys).agg(F.avg(finite(F.col(value))).alias(value), F.countDistinct(unit).alias("n"))
    spread = mean(null, *group, "rep").groupBy(*group).agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"))
    d = mean(observed, *group).withColumnRenamed(value, "observed").join(spread, group)
    z = F.coalesce((F.col("observed") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0)), F.lit(0.0))
    return d.select(*group, "n", "observed", "null_mean", "null_sd", z.alias("z"))


def group_query(runs: DataFrame, value: str, segmentation: Column | None = None, group: str | None = None) -> DataFrame:
    """Group means over images of successful runs (status, segmentation, grp, image), of one segmentation or group if asked for; a blank group is the runs without one."""
    d = runs.where(F.col("status") == "success").withColumn("grp", F.coalesce("grp", F.lit("")))
    d = d.where(F.col("segmentation") == segmentation) if segmentation is not None else d
    d = d.where(F.col("grp") == group) if group is not None else d
    return rollup_units(d, "grp", "image", F.col(value))


def reviewed_flags(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """objects (image, point_id, x, y) with `reviewed`: their centre lies in a reviewed region (image, id, x0, y0, x1, y1) of the image; null where it has none."""
    some = regions.select("image").distinct().withColumn("some", F.lit(True))
    hit = holding(objects.select("image", "point_id", "x", "y"), regions, ["image"]).select("image", "point_id").distinct().withColumn("hit", F.lit(True))
    d = objects.join(some, "image", "left").join(hit, ["image", "point_id"], "left")
    return d.withColumn("reviewed", F.when(F.col("some"), F.coalesce("hit", F.lit(False)))).drop("some", "hit")
