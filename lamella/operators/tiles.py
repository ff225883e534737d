"""Tile corpora: window grids, scores, caps by spatial bin, enrichment, composition, coverage and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.order import running_by_bin
from lamella.operators.scans import ranked, with_percentiles


def starts(length: Column, tile: Column, stride: Column, edge: str = "floor") -> Column:
    """Window starts along an axis. edge: floor (whole windows only), flush (one more at the end), pull (same, if it overlaps no more than half)."""
    last = length - tile
    grid = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), stride.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = F.try_element_at(grid, F.lit(-1))
    if edge == "floor":
        return grid
    extra = (at < last) & (F.lit(True) if edge == "flush" else (at + tile - last) * 2 <= tile)
    return F.when(extra, F.array_append(grid, last.cast("long"))).otherwise(grid)


def window_count(length: Column, tile: Column, stride: Column) -> Column:
    """The size of the flush grid, without building it."""
    n = F.floor((length - tile) / stride) + 1
    return F.when(length < tile, 0).otherwise(n + F.when((length - tile) % stride > 0, 1).otherwise(0))


def windows(df: DataFrame, width: str, height: str, tile: int, stride: int, edge: str = "flush") -> DataFrame:
    """df with x, y of every window, in rows."""
    t, s = F.lit(tile), F.lit(stride)
    return df.withColumn("y", F.explode(starts(F.col(height), t, s, edge))).withColumn("x", F.explode(starts(F.col(width), t, s, edge)))


def shifted(df: DataFrame, shifts: list[int], width: str, height: str, tile: int) -> DataFrame:
    """Candidate windows around each nominal one, clipped to the image, each once a nominal window."""
    moves = F.array(*map(F.lit, shifts))
    clip = lambda v, n: F.greatest(F.lit(0), F.least(v, F.col(n) - tile))
    d = df.withColumn("dy", F.explode(moves)).withColumn("dx", F.explode(moves))
    return d.withColumn("cx", clip(F.col("x") + F.col("dx"), width)).withColumn("cy", clip(F.col("y") + F.col("dy"), height)).drop("dx", "dy").distinct()


def tissue_score(tissue: Column, contrast: Column, background: Column, artifact: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * tissue + 0.3 * contrast + 0.2 * (1 - background) - artifact))


def score_reasons(df_cols: dict[str, tuple[Column, str, float]]) -> Column:
    """Names of limits that are passed: name -> (value, '<' or '>', limit)."""
    return F.array_compact(F.array(*[F.when(v < lim if op == "<" else v > lim, F.lit(n)) for n, (v, op, lim) in df_cols.items()]))


def tile_status(score: Column, reasons: Column, rejected: Column, accept: float, borderline: float) -> Column:
    """Normalisation rejections decide first, then reasons and score."""
    return F.when(rejected, "rejected").when((F.size(reasons) == 0) & (score >= accept), "accepted").when(score >= borderline, "borderline").otherwise("rejected")


def normalization_rejected(warning: Column, tokens: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.coalesce(warning, F.lit("")), ";"), F.array(*map(F.lit, tokens)))


def to_uint8(v: Column, lo: Column, hi: Column, inverted: Column) -> Column:
    scaled = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - lo) * 255 / (hi - lo)))).otherwise(0.0)
    return F.rint(F.when(inverted, 255 - scaled).otherwise(scaled)).cast("int")


def spatial_cap(df: DataFrame, source: str, key: str, x: str, y: str, score: list[Column], cap: int, seed: str, grid: int = 10) -> DataFrame:
    """At most `cap` rows a source: bins of a grid over the source's extent take turns in seeded order, each with its best first."""
    extent = df.groupBy(F.col(source).alias("__source")).agg(*[f(c).alias(f"__{n}_{a}") for a, c in (("x", x), ("y", y)) for n, f in (("low", F.min), ("high", F.max))])
    at = lambda a, c: F.least(F.lit(grid - 1), F.coalesce(F.floor((F.col(c) - F.col(f"__low_{a}")) / F.nullif(F.col(f"__high_{a}") - F.col(f"__low_{a}"), F.lit(0)) * grid), F.lit(0)))
    d = df.join(extent, F.col(source).eqNullSafe(F.col("__source"))).withColumn("bin", at("y", y) * grid + at("x", x)).drop(*extent.columns)
    d = ranked(d, [source, "bin"], [*score, key], "turn")
    d = d.withColumn("bin_digest", F.sha1(F.concat_ws(":", F.lit(seed), F.col(source), F.col("bin").cast("string"))))
    d = running_by_bin(d.withColumn("__one", F.lit(1)), "turn", ["bin_digest"], "__one", "place", [source]).drop("__one")
    return d.withColumn("place", F.col("place") + 1).where(F.col("place") <= cap)


def enrich(tiles: DataFrame, meta: DataFrame, key: str, fields: list[str], overwrite: bool = False) -> DataFrame:
    """Metadata of a key onto tiles; what a tile has stays unless overwritten."""
    m = meta.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    d = tiles.join(m, key, "left")
    have = lambda f: F.col(f) if f in tiles.columns else F.lit(None)
    return d.withColumns({f: F.coalesce(F.col(f"__{f}"), have(f)) if overwrite else F.coalesce(have(f), F.col(f"__{f}")) for f in fields}).drop(*[f"__{f}" for f in fields])


def enrich_counts(tiles: DataFrame, meta: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, tiles, matched, added: tiles whose key has metadata, and those that get a value they had not."""
    m = meta.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    d = tiles.join(m, F.col(key) == F.col("__key"), "left")
    have = lambda f: F.col(f).isNotNull() if f in tiles.columns else F.lit(False)
    one = d.agg(F.count("*").alias("tiles"), F.count("__key").alias("matched"), *[F.count_if(~have(f) & F.col(f"__{f}").isNotNull()).alias(f) for f in fields])
    return one.select(F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', {f}" for f in fields) + ") as (field, added)"), "tiles", "matched")


def unpaired(images: DataFrame, masks: DataFrame, path: str, there: str, instead: str) -> DataFrame:
    """images, unpaired: how many images there are, and those whose mask, by the rewritten path, is missing."""
    wanted = images.select(F.replace(F.col(path), F.lit(there), F.lit(instead)).alias("__mask"))
    have = masks.select(F.col(path).alias("__mask"), F.lit(1).alias("have")).distinct()
    return wanted.join(have, "__mask", "left").agg(F.count("*").alias("images"), F.count_if(F.col("have").isNull()).alias("unpaired"))


def distinct_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, kept, dropped: what dropping repeated keys leaves."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def unmatched(tiles: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    return tiles.join(meta, key, "left_anti").select(key).distinct()


def require_match(tiles: DataFrame, meta: DataFrame, key: str, shown: int = 20) -> None:
    """Raises, naming some keys, if any tile's key has no metadata."""
    missing = [r[0] for r in unmatched(tiles, meta, key).orderBy(key).limit(shown).collect()]
    if missing:
        raise ValueError(f"no metadata for {key} in {missing}")


def composition(df: DataFrame, source: str, cap: int, facets: list[str]) -> DataFrame:
    """facet, label, tiles, sources, least, most, at_cap: tiles a source by each facet in long form; facet 'all' is the corpus."""
    pairs = ", ".join(["'all', 'all'", *[f"'{f}', cast({f} as string)" for f in facets]])
    long = df.select(source, F.expr(f"stack({len(facets) + 1}, {pairs}) as (facet, label)")).groupBy("facet", "label", source).agg(F.count("*").alias("t"))
    return long.groupBy("facet", "label").agg(F.sum("t").alias("tiles"), F.count("*").alias("sources"), F.min("t").alias("least"), F.max("t").alias("most"), F.count_if(F.col("t") >= cap).alias("at_cap"))


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, valid, missing, percent: blank texts count as missing."""
    counts = [F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).alias(f) for f in fields]
    one = df.agg(F.count("*").alias("total"), *counts)
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    return one.select("total", F.expr(f"stack({len(fields)}, {pairs}) as (field, valid)")).select("field", "valid", (F.col("total") - F.col("valid")).alias("missing"), (100 * F.col("valid") / F.col("total")).alias("percent"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def log_stats(df: DataFrame, value: str, qs: list[float], bin_width: float = 0.01) -> DataFrame:
    """q, at: the value at place round(q (n - 1)), half to even, of the ordered positive values, with n, the mean and the population sd of the logs.

    Values are counted by bins of their log; a place is found by its bin first, so no task sorts them all.
    """
    v = df.where(F.col(value) > 0).select(F.col(value).cast("double").alias("v")).withColumn("bin", F.floor(F.log("v") / bin_width))
    stats = v.agg(F.count("*").alias("n"), F.avg(F.log("v")).alias("log_mean"), F.stddev_pop(F.log("v")).alias("log_sd"))
    bins = v.groupBy("bin").agg(F.count("*").alias("c"))
    bins = bins.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a bin
    asked = stats.select("*", F.explode(F.array(*map(F.lit, qs))).alias("q")).withColumn("place", F.rint(F.col("q") * (F.col("n") - 1)).cast("long"))
    inside = asked.join(bins, (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c")))
    ranked = v.join(inside, "bin").withColumn("r", F.row_number().over(Window.partitionBy("q", "bin").orderBy("v")) - 1)
    return ranked.where("r = place - before").select("q", F.col("v").alias("at"), "n", "log_mean", "log_sd")


def fingerprint(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """A digest of a set of keys, whatever their order: a tree over the first hex digits of their hash.

    Keys that share all `digits` are joined in order and digested; then, two digits less at a time, the digests below. A
    list holds 256 digests at most, and at its leaves one key in 16**digits of all.
    """
    k = F.col(key).cast("string")
    d = df.select(k.alias("d")).distinct().select(F.substring(F.md5("d"), 1, digits).alias("at"), F.lit("").alias("own"), "d", F.lit(1).cast("long").alias("c"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("own", "d"))), lambda x: x["d"]), "\n")
        d = d.groupBy("at").agg(F.sha2(joined, 256).alias("d"), F.sum("c").alias("c"))
        if digits <= 0:
            return d.select(F.col("d").alias("fingerprint"), F.col("c").alias("n"))
        digits -= 2
        d = d.select(F.substring("at", 1, max(digits, 0)).alias("at"), F.col("at").alias("own"), "d", "c")


def shard_counts(sharded: DataFrame, source: str) -> DataFrame:
    """Per shard its rows and sources with its largest source; shard null is the whole set."""
    c = sharded.groupBy("shard", source).agg(F.count("*").alias("n"))
    every = c.groupBy(source).agg(F.sum("n").alias("n")).select(F.lit(None).cast("long").alias("shard"), source, "n")
    return c.unionByName(every).groupBy("shard").agg(F.sum("n").alias("rows"), F.count("*").alias("sources"), F.max("n").alias("most"), F.max_by(source, F.struct("n", source)).alias("largest"))


def factor_codes(df: DataFrame, factors: dict[str, list[str]], logs: dict[str, tuple[float, float]], denied: dict[str, list[str]]) -> DataFrame:
    """Per factor its vocabulary index (-1 unknown) or standardised log, and whether it is valid."""
    out = {}
    for f, words in factors.items():
        token = F.regexp_replace(F.lower(F.trim(F.col(f).cast("string"))), r"[^a-z0-9]+", "_")
        token = F.when(~token.isin(*denied.get(f, ["\0"])), token)
        out[f"{f}_code"] = F.coalesce(F.array_position(F.array(*map(F.lit, words)), token).cast("int") - 1, F.lit(-1))
        out[f"{f}_valid"] = out[f"{f}_code"] >= 0
    for f, (mean, sd) in logs.items():
        good = F.coalesce(F.col(f) > 0, F.lit(False))
        out[f"{f}_z"] = F.when(good, (F.log(f) - mean) / sd).otherwise(0.0)
        out[f"{f}_valid"] = good
    return df.withColumns(out)


def percentile_range(pixels: DataFrame, keys: list[str], value: str, low: float = 0.001, high: float = 0.999, support: int = 64, span: float = 16.0) -> DataFrame:
    """Normalisation range by key, with flags for thin support and a low dynamic range."""
    d = with_percentiles(pixels.groupBy(*keys).agg(F.count(value).alias("n")), pixels, keys, value, [low, high])
    return d.select(*keys, "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), (F.col("n") < support).alias("thin"), (F.col("q")[1] - F.col("q")[0] < span).alias("low_range"))


def tile_stats(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    d = with_percentiles(pixels.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")), pixels, keys, value, [0.01, 0.99])
    return d.select(*keys, "mean", "sd", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p99"))


def content_box(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.where("v <> 0").groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def blend(preds: DataFrame, tile: int) -> DataFrame:
    """Overlapping tile predictions (image, x, y, x0, y0, p) as one value a position, weighted by raised cosines of the place in the tile."""
    w = lambda at, start: F.pow(F.sin(F.lit(3.141592653589793) * (F.col(at) - F.col(start) + 0.5) / tile), 2)
    d = preds.withColumn("w", w("x", "x0") * w("y", "y0"))
    return d.groupBy("image", "x", "y").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


def resolve_paths(records: DataFrame, files: DataFrame, key: str, candidates: Column, predicate: Column | None = None) -> DataFrame:
    """The first of a record's candidate paths that the listing has; null without one. predicate: only records that it holds for are looked up."""
    records = records if predicate is None else records.where(predicate)
    tried = records.select(key, F.posexplode(candidates).alias("i", "path")).join(files.select("path"), "path", "left_semi")
    return records.join(tried.groupBy(key).agg(F.min_by("path", "i").alias("path")), key, "left")


def factor_record(df: DataFrame, wanted: list[str], factors: dict[str, list[str]], logs: dict[str, tuple[float, float]], denied: dict[str, list[str]]) -> DataFrame:
    """source_id and dataset_id (blank where missing), and the code or value of each wanted factor with its validity."""
    d = factor_codes(df, {f: v for f, v in factors.items() if f in wanted}, {f: v for f, v in logs.items() if f in wanted}, denied)
    shown = [c for f in wanted for c in (f"{f}_code" if f in factors else f"{f}_z", f"{f}_valid")]
    return d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source_id", "dataset_id")], *shown)
