"""Train, validation and test splits with leak guards, quotas, folds and supply grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.numbers import hash01
from lamella.operators.order import hashed_bin, placed, running_by_bin
from lamella.operators.scans import ranked


def organelle_set(text: Column) -> Column:
    """A list from a text split at ; or |, blanks dropped, each once."""
    return F.array_distinct(F.array_remove(F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), "|", ";"), ";"), lambda x: F.trim(x)), ""))


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[low], low)


def defaults_with_overrides(df: DataFrame, name: str, defaults: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Data-set defaults, replaced by the first override rule (by ord) whose text the name contains."""
    o = overrides.select("ord", "contains", *[F.col(f).alias(f"__{f}") for f in fields])
    ids = df.select(name).distinct()
    hit = ids.join(F.broadcast(o), F.expr(f"contains({name}, contains)")).groupBy(name).agg(F.min_by(F.struct(*[f"__{f}" for f in fields]), "ord").alias("o"))
    d = df.join(defaults, key, "left").join(hit, name, "left")
    return d.withColumns({f: F.coalesce(F.col(f"o.__{f}"), F.col(f)) for f in fields}).drop("o")


def leak_guard(train: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    """Rows of train that share none of the keys' combinations with a row of test."""
    return train.join(test.select(*on).distinct(), on, "left_anti")


def by_count(df: DataFrame, group: list[str], key: str, share: float) -> DataFrame:
    """Adds `split`: the first ceil(share * n) of a group in hash order are val."""
    d = df.withColumn("h", hash01(F.col(key).cast("string")))
    d = placed(d, group, F.floor(F.col("h") * 4096), ["h", key])
    return d.withColumn("split", F.when(F.col("place") <= F.ceil(F.lit(share) * F.col("members")), "val").otherwise("train")).drop("place", "members")


def by_budget(df: DataFrame, key: str, weight: str, share: float, group: list[str] | None = None) -> DataFrame:
    """Adds `split`: rows in hash order are val until the weights before them reach share of the total."""
    d = df.withColumn("h", hash01(F.col(key).cast("string"))).withColumn("hbin", F.floor(F.col("h") * 1024))
    d = running_by_bin(d, "hbin", ["h", key], weight, "before", group)
    keys = group or []
    total = df.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    d = d.join(total, keys) if keys else d.crossJoin(F.broadcast(total))  # one row
    return d.withColumn("split", F.when(F.col("before") < F.lit(share) * F.col("__total"), "val").otherwise("train")).drop("hbin", "__total")


def first_n(df: DataFrame, group: list[str], key: str, n: int) -> DataFrame:
    """The first n rows of each group by key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(key))).where(F.col("place") <= n)


def held_out_by_rule(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Adds `split` from a rule table (key, split): whole data sets, official splits or specimens; train without a rule."""
    return df.join(rules.select(key, F.col("split").alias("__split")), key, "left").withColumn("split", F.coalesce("__split", F.lit("train"))).drop("__split")


def held_out_band(df: DataFrame, volume: str, place: list[str], share: float = 0.15, least: int = 20) -> DataFrame:
    """Adds `split`: the last share of each volume's crops along its spatial key is held out, in volumes with enough crops."""
    d = ranked(df, [volume], [F.desc(p) for p in place], "__rank", "__n")
    held = (F.col("__n") >= least) & (F.col("__rank") <= F.greatest(F.lit(1), F.rint(F.lit(share) * F.col("__n"))))
    return d.withColumn("split", F.when(held, "heldout_image").otherwise("train")).drop("__rank", "__n")


def quota(supply: DataFrame, current: DataFrame, source: str, caps: Column) -> DataFrame:
    """source, supply, current, quota: what may still be drawn under each source's cap."""
    d = supply.join(current, source, "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("supply", "current")})
    return d.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("supply"), caps - F.col("current"))).cast("long"))


def solve_share(q: DataFrame, source: str, solved: str, share: float) -> DataFrame:
    """One source's quota is set so that it makes up `share` of the total."""
    rest = q.where(F.col(source) != solved).agg(F.sum(F.col("current") + F.col("quota")).alias("rest"))
    want = F.floor(F.col("rest") * share / (1 - share)) - F.col("current")
    d = q.crossJoin(F.broadcast(rest))  # one row
    return d.withColumn("quota", F.when(F.col(source) == solved, F.greatest(F.lit(0), F.least("supply", want))).otherwise(F.col("quota")).cast("long")).drop("rest")


def draw(rows: DataFrame, quotas: DataFrame, source: str, key: str, seed: str) -> DataFrame:
    d = rows.join(quotas.select(source, "quota"), source).withColumn("digest", F.sha1(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    return placed(d, [source], hashed_bin(F.col("digest")), ["digest", key]).where("place <= quota").drop("quota", "place", "members")


def stratified(df: DataFrame, group: str, key: str, share: float, seed: str) -> DataFrame:
    """A nested subset: at least one row a group, round(share * n) half to even, in seeded order."""
    d = df.withColumn("digest", F.sha1(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    d = placed(d, [group], hashed_bin(F.col("digest")), ["digest", key])
    return d.where(F.col("place") <= F.greatest(F.lit(1.0), F.rint(F.lit(share) * F.col("members")))).drop("members")


def oversample(df: DataFrame, cls: str, key: str) -> DataFrame:
    """Every class cycled to the size of the largest: adds `draw`, the turn in which the row comes."""
    most = df.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("n")).agg(F.max("n").alias("__most"))
    d = ranked(df.where(F.col(cls).isNotNull()), [cls], [key], "__place", "__n").crossJoin(F.broadcast(most))  # one row
    turns = F.floor((F.col("__most") - F.col("__place")) / F.col("__n"))
    return d.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), turns))).drop("__n", "__most", "__place")


def imbalance(df: DataFrame, cls: str) -> DataFrame:
    """Class sizes and how many times smaller than the largest they are."""
    n = df.groupBy(cls).agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.max("n").over(Window.partitionBy()) / F.col("n"))  # one row a class


def folds(df: DataFrame, image: str, region: str, rotate: bool = True) -> DataFrame:
    """Rows by fold with a role: one unit is held out in each fold; units are images if there are two, else regions."""
    several = df.agg((F.countDistinct(image) > 1).alias("by_image"))
    d = df.crossJoin(F.broadcast(several)).withColumn("unit", F.when(F.col("by_image"), F.col(image).cast("string")).otherwise(F.col(region).cast("string")))
    units = d.select("unit").distinct().withColumn("fold", F.row_number().over(Window.orderBy("unit")) - 1)  # one row a unit
    held = units if rotate else units.where("fold = 0")
    plan = d.drop("by_image").crossJoin(F.broadcast(held.select(F.col("unit").alias("held_unit"), "fold"))) if rotate is False else d.drop("by_image").join(held.select(F.col("unit").alias("held_unit"), "fold"))
    return plan.withColumn("role", F.when(F.col("unit") == F.col("held_unit"), "heldout").otherwise("train"))


def build_report(df: DataFrame, split: str, dataset: str, weight: str, foreground: str) -> DataFrame:
    return df.groupBy(split, dataset).agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"), F.count_if(F.col(foreground) == 0).alias("empty"))


def pivot_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n by both fields and by each alone (the other null)."""
    return df.groupingSets([[a, b], [a], [b]], a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def supply(pixels: DataFrame, keys: list[str], cell: int, valid: Column, foreground: Column, least_valid: int, least_foreground: int) -> DataFrame:
    """Grid cells with enough valid and foreground pixels."""
    d = pixels.groupBy(*keys, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    d = d.agg(F.count_if(valid).alias("valid"), F.count_if(valid & foreground).alias("foreground"))
    return d.where((F.col("valid") >= least_valid) & (F.col("foreground") >= least_foreground))


def legend(targets: DataFrame, codes: DataFrame, on: list[str], share: float = 0.01) -> DataFrame:
    """target, code, share of the target's area under each code, where it is at least `share`."""
    d = targets.join(codes, on).groupBy("target", "code").agg(F.count("*").alias("n"))
    d = d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("target")))
    return d.where(F.col("share") >= share)


def keep_for_training(df: DataFrame, least: int) -> DataFrame:
    """Test rows whole; train and val rows with enough foreground."""
    return df.where((F.col("split") == "test") | (F.col("fg_px") >= least))


def expand_box(x0: Column, y0: Column, x1: Column, y1: Column, share: float, least: int, width: Column, height: Column) -> Column:
    """A box grown by a share of its size, to a least size, slid back into the image. Struct of x0, y0, x1, y1."""

    def axis(lo: Column, hi: Column, n: Column) -> tuple[Column, Column]:
        size = F.least(n, F.greatest(F.rint((hi - lo) * (1 + 2 * share)), F.lit(float(least))))
        start = F.greatest(F.lit(0.0), F.least(F.rint((lo + hi) / 2 - size / 2), n - size))
        return start, start + size

    (a, b), (c, d) = axis(x0, x1, width), axis(y0, y1, height)
    return F.struct(a.cast("long").alias("x0"), c.cast("long").alias("y0"), b.cast("long").alias("x1"), d.cast("long").alias("y1"))


def scale_box(box: list[Column], scale: Column) -> list[Column]:
    return [F.rint(v * scale).cast("long") for v in box]


def planes(df: DataFrame, depth: str, spacing: Column, most: int | None = None) -> DataFrame:
    """Rows by plane z: at a constant step of at least `spacing` planes, or `most` spread evenly."""
    step = F.greatest(F.lit(1), F.ceil(spacing)).cast("int")
    at = F.sequence(F.lit(0), F.col(depth).cast("int") - 1, step)
    if most is not None:
        even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (F.col(depth) - 1) / max(most - 1, 1)).cast("int"))
        at = F.when(F.col(depth) <= most, F.sequence(F.lit(0), F.col(depth).cast("int") - 1)).otherwise(F.array_distinct(even))
    return df.where(F.col(depth) > 0).withColumn("z", F.explode(at))


def window_summary(labels: DataFrame, window: list[str], names: dict[int, str] | None = None, wanted: list[int] | None = None) -> DataFrame:
    """Per window and label value its area and bounding box; with `names` (for values without one value_<n>) also the name and whether
    the value is in scope: one of `wanted`, or any where none are given. The value 0 is background and left out then."""
    d = window_boxes(labels, window)
    if names is None:
        return d
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("value").cast("int")], F.concat(F.lit("value_"), F.col("value").cast("string")))
    return d.where("value <> 0").withColumns({"name": name, "in_scope": F.lit(True) if wanted is None else F.col("value").isin(*wanted)})


def window_boxes(labels: DataFrame, window: list[str]) -> DataFrame:
    return labels.groupBy(*window, "value").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def source_map(crops: DataFrame, manifests: DataFrame) -> DataFrame:
    """Crops with the source image and split that some manifest (entries: crop_id, source_image, split) gives them, else their own file."""
    m = manifests.select(F.explode("entries").alias("e")).select("e.*").groupBy("crop_id").agg(F.min("source_image").alias("__s"), F.min("split").alias("manifest_split"))
    return crops.join(m, "crop_id", "left").withColumn("source_image", F.coalesce("__s", "em_file")).drop("__s")


#: Data sets that a clean pool leaves out, by prefix and by part of the name.
DENIED_PREFIX, DENIED = "jrc_", ("wei2020_mitoem", "kasthuri", "guay", "openorganelle", "bleck", "cremi", "perez")
#: Foreground shares below which a crop is sparse, and partial.
SPARSE, PARTIAL = 0.02, 0.1
#: The data set that is capped by specimen, and the caps of its specimens and of other sources.
BY_SPECIMEN, SPECIMEN, CAP_SPECIMEN, CAP_SOURCE = "zenodo_mitoem2", r"^(ME2-[A-Za-z0-9]+)", 600, 1000


def clean_source(name: Column) -> Column:
    low = F.lower(name)
    return ~F.startswith(low, F.lit(DENIED_PREFIX)) & ~low.rlike("|".join(DENIED))


def coverage_tier(foreground: Column, area: Column) -> Column:
    share = foreground / F.greatest(area, F.lit(1))
    return F.when(share < SPARSE, "sparse").when(share < PARTIAL, "partial").otherwise("full")


def source_key(dataset: Column, crop: Column) -> Column:
    """The source that a crop counts for: its data set, or its specimen in the one that is capped by specimen."""
    specimen = F.coalesce(F.nullif(F.regexp_extract(crop, SPECIMEN, 1), F.lit("")), F.lit("UNK"))
    return F.when(dataset == BY_SPECIMEN, F.concat(F.lit(f"{BY_SPECIMEN}/"), specimen)).otherwise(dataset)


def source_cap(key: Column) -> Column:
    return F.when(F.startswith(key, F.lit(f"{BY_SPECIMEN}/")), CAP_SPECIMEN).otherwise(CAP_SOURCE)


#: Names of organelles by family.
FAMILIES = {
    "mito": ["mito"],
    "er": ["er", "er_sheets", "er_tubules", "peripheral_er", "er_other_cells", "er_at_the_close_proximity_to_chromosomes_(at_320_nm_distance)"],
    "nucleus": ["nucleus", "nuclei"],
    "ld": ["ld", "lipid_droplets", "lipid_droplet_above_nucleus", "lipid_droplet_below_nucleus", "lipid_droplet_touching_nucleus"],
}
#: Estimated nm a pixel by file name, the first rule that fits.
ESTIMATED_NM = [
    (r"^protoplasma_original", 18.51), (r"^figure[ _]*\d+_original", 14.81), (r"^z6\d\d$", 2.47), (r"^n22-miao", 2.47), (r"^xc10", 6.17),
    (r"^xc0", 4.63), (r"^cs10", 6.17), (r"^wh5", 4.63), (r"^c60\d$", 3.09), (r"^a_60", 3.09),
]


def families(organelles: Column) -> Column:
    """The families that a list of organelles has a member of."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(organelles, F.array(*map(F.lit, names))), F.lit(f)) for f, names in FAMILIES.items()]))


def estimated_nm(path: Column) -> Column:
    """The resolution that a file's name lets one guess; null if none does."""
    name = F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"\.(tif|tiff|png|jpg|jpeg)$", "")
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for pattern, nm in ESTIMATED_NM:
        out = out.when(name.rlike(pattern), F.lit(nm))
    return out
