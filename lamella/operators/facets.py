"""Facets of a published directory: dictionaries, trees, counts under the other filters, and saved filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.order import running_by_bin


def dictionary(df: DataFrame, label: str) -> DataFrame:
    """label, n, idx: labels by falling count, then name; null is not a label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), F.lower("label"), "label")) - 1)  # one row a label


def flat(df: DataFrame, label: str) -> DataFrame:
    """label, n with the rows that record nothing as a null label."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def tree(df: DataFrame, key: str, parents: Column, children: Column) -> DataFrame:
    """parent, child, n: items with both; child null is the parent's own total. An item counts once a pair."""
    p = df.select(key, F.explode(F.array_distinct(parents)).alias("parent"), children.alias("c"))
    pairs = p.select("parent", F.explode(F.array_distinct("c")).alias("child")).groupBy("parent", "child").agg(F.count("*").alias("n"))
    return p.groupBy("parent").agg(F.count("*").alias("n")).select("parent", F.lit(None).cast("string").alias("child"), "n").unionByName(pairs)


def nested(tree_rows: DataFrame) -> DataFrame:
    """parent, n, children: structs by falling count, then name."""
    kids = F.sort_array(F.collect_list(F.when(F.col("child").isNotNull(), F.struct((-F.col("n")).alias("k"), "child"))))
    return tree_rows.groupBy("parent").agg(F.max(F.when(F.col("child").isNull(), F.col("n"))).alias("n"), F.transform(kids, lambda x: F.struct(x["child"].alias("label"), (-x["k"]).alias("n"))).alias("children"))


@dataclass
class Selection:
    """Chosen labels by facet (None stands for not recorded), and a text search. Facets are columns, single or lists."""

    chosen: dict[str, list[str | None]] = field(default_factory=dict)
    query: str = ""

    def passes(self, df: DataFrame, facet: str) -> Column:
        labels = self.chosen.get(facet) or []
        if not labels:
            return F.lit(True)
        known = [x for x in labels if x is not None]
        if dict(df.dtypes)[facet].startswith("array"):
            hit = F.arrays_overlap(F.col(facet), F.array(*map(F.lit, known)).cast("array<string>"))
            none = F.coalesce(F.size(facet), F.lit(0)) <= 0
        else:
            hit, none = F.col(facet).isin(*known) if known else F.lit(False), F.col(facet).isNull()
        return F.coalesce(hit, F.lit(False)) | (none if None in labels else F.lit(False))

    def searched(self, text: Column) -> Column:
        out = F.lit(True)
        for word in self.query.lower().split():
            out = out & (F.instr(F.lower(text), word) > 0)
        return out


def select(df: DataFrame, selection: Selection, facets: list[str], text: Column) -> DataFrame:
    """OR inside a facet, AND between facets and with the text."""
    keep = selection.searched(text)
    for f in facets:
        keep = keep & selection.passes(df, f)
    return df.where(keep)


def _named(facet: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("label"))


def contextual_counts(df: DataFrame, selection: Selection, facets: list[str], text: Column) -> DataFrame:
    """facet, label, n: every facet is counted under all filters but its own, in one pass over the rows."""
    flags = df.select(*facets, selection.searched(text).alias("__q"), *[selection.passes(df, f).alias(f"__{f}") for f in facets])
    parts = []
    for f in facets:
        others = F.col("__q")
        for g in facets:
            others = others & F.col(f"__{g}") if g != f else others
        labels = F.array_distinct(F.when(F.size(f) > 0, F.col(f)).otherwise(F.array(F.lit(None).cast("string")))) if dict(df.dtypes)[f].startswith("array") else F.array(F.col(f).cast("string"))
        parts.append(F.when(others, F.transform(labels, _named(f))).otherwise(F.array().cast("array<struct<facet:string,label:string>>")))
    return flags.select(F.inline(F.concat(*parts))).groupBy("facet", "label").agg(F.count("*").alias("n"))


def saved_filters(df: DataFrame, url: str, facet: str, known: list[str]) -> DataFrame:
    """Adds `labels`: those of one facet in a query string (a=x,y&b=z) that the dictionary knows."""
    raw = F.str_to_map(F.regexp_replace(F.col(url), r"^[^?]*\?", ""), F.lit("&"), F.lit("="))[facet]
    return df.withColumn("labels", F.array_intersect(F.split(F.url_decode(F.coalesce(raw, F.lit(""))), ","), F.array(*map(F.lit, known))))


def query_string(pairs: dict[str, Column]) -> Column:
    """Lists of labels by facet as a query string; empty lists are left out."""
    return F.concat_ws("&", *[F.when(F.size(v) > 0, F.concat(F.lit(f"{k}="), F.url_encode(F.array_join(v, ",")))) for k, v in pairs.items()])


def toggle_parent(chosen: Column, parent: Column, children: Column) -> Column:
    """A tree parent switched on clears its children; switched off it goes."""
    return F.when(F.array_contains(chosen, parent), F.array_remove(chosen, parent)).otherwise(F.array_append(F.array_except(chosen, children), parent))


def encode(df: DataFrame, key: str, label: str, words: DataFrame) -> DataFrame:
    """key, codes, offset: dictionary numbers of a multi-valued label by key, and where they start if laid end to end."""
    found = df.join(words.select(F.col("label").alias(label), "idx"), label).groupBy(key).agg(F.sort_array(F.collect_set("idx")).alias("codes"))
    found = found.withColumn("n", F.size("codes").cast("long")).withColumn("bin", F.floor(F.col(key) / 4096))


    return running_by_bin(found, "bin", [key], "n", "offset").select(key, "codes", "offset")


def inventory(datasets: DataFrame, assets: DataFrame, key: str, three_d: Column) -> DataFrame:
    """Per data set its 2D and 3D assets; data sets without assets count 0."""
    n = assets.groupBy(key).agg(F.count("*").alias("n_assets"), F.count_if(three_d).alias("n_3d"))
    return datasets.join(n, key, "left").withColumns({"n_assets": F.coalesce("n_assets", F.lit(0)), "n_3d": F.coalesce("n_3d", F.lit(0))}).withColumn("n_2d", F.col("n_assets") - F.col("n_3d"))


def structure_failures(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, n: the rules whose frame of offending rows isn't empty."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def vocabulary_spec(df: DataFrame, label: str) -> DataFrame:
    """labels (in dictionary order) and the digest that names this vocabulary."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"])
    return dictionary(df, label).agg(words.alias("labels")).withColumn("digest", F.sha2(F.array_join("labels", "\n"), 256))


def unauthorised(published: DataFrame, allowed: DataFrame, derived: DataFrame) -> DataFrame:
    """Published vocabulary that is neither allowed nor derived."""
    return published.distinct().subtract(allowed).subtract(derived)
