"""Rules as data: lists of patterns, terms and thresholds that compile to columns."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.text import separators_to_blanks


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule whose pattern is found."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, value in rules:
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def bounded(term: str) -> str:
    """A term between characters that aren't letters or digits."""
    return f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])"


def term_hits(text: Column, terms: list[str]) -> Column:
    """The terms found in the text as it is or with separators as blanks, in list order. Few texts hold a term at all, so patterns are only tried on those."""
    other = separators_to_blanks(text)
    found = lambda x, t: F.contains(x, F.lit(t)) & x.rlike(bounded(t))
    return F.array_compact(F.array(*[F.when(found(text, t) | found(other, t), F.lit(t)) for t in terms]))


def substring_hits(text: Column, terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.instr(text, t) > 0, F.lit(t.strip())) for t in terms]))


def bands(value: Column, edges: list[tuple[str, float | None]], unknown: str | None = None) -> Column:
    """The label of the first band whose upper edge is above the value; the last band is open."""
    out = F.when(value.isNull(), F.lit(unknown))
    for label, upper in edges:
        out = out.when(value < upper, F.lit(label)) if upper is not None else out.when(F.lit(True), F.lit(label))
    return out


@dataclass(frozen=True)
class RecordFilter:
    """Limits of a tile filter; None switches a check off. reason() is the first check that fails, null if none does."""

    statuses: tuple[str, ...] = ("accepted",)
    source_kinds: tuple[str, ...] | None = None
    licences: tuple[str, ...] | None = None
    unlicensed: bool = True
    dtype: str | None = "uint8"
    dynamic_range: bool = True
    warnings: tuple[str, ...] = ("insufficient_valid_support", "low_dynamic_range")
    min_side: int = 0
    max_artifact: float | None = None
    min_tissue: float | None = None
    max_background: float | None = None

    def reason(self) -> Column:
        checks: list[tuple[Column, Column]] = []
        fails = lambda test, name: checks.append((F.coalesce(test, F.lit(False)), name if isinstance(name, Column) else F.lit(name)))
        if self.statuses:
            fails(~F.coalesce(F.col("status").isin(*self.statuses), F.lit(False)), "status!=" + "|".join(sorted(self.statuses)))
        if self.source_kinds:
            fails(~F.coalesce(F.col("source_kind").isin(*self.source_kinds), F.lit(False)), "source_kind_excluded")
        if self.licences is not None:
            licence = F.trim(F.coalesce(F.col("license"), F.lit("")))
            if not self.unlicensed:
                fails(licence == "", "license:unlicensed")
            fails((licence != "") & ~licence.isin(*self.licences), F.concat(F.lit("license:"), licence))
        if self.dtype:
            fails(~F.col("tile_storage_dtype").eqNullSafe(self.dtype), f"dtype!={self.dtype}")
        if self.dynamic_range:
            fails(F.col("low_dynamic_range"), "low_dynamic_range")
        if self.warnings:
            blocked = F.filter(F.split(F.coalesce(F.col("normalization_warning"), F.lit("")), ";"), lambda t: t.isin(*self.warnings))
            fails(F.size(blocked) > 0, F.concat(F.lit("warning:"), F.try_element_at(blocked, F.lit(1))))
        if self.min_side > 0:
            side = F.least(F.col("width"), F.col("height"))
            fails(F.col("width").isNull() | F.col("height").isNull() | (side < self.min_side), f"min_side<{self.min_side}")
        for column, limit, above in (("artifact_fraction", self.max_artifact, True), ("tissue_score", self.min_tissue, False), ("background_fraction", self.max_background, True)):
            if limit is not None:
                fails(F.col(column) > limit if above else F.col(column) < limit, f"{column}{'>' if above else '<'}{limit}")
        return functools.reduce(lambda out, c: out.when(*c), checks, F.when(F.lit(False), F.lit(None).cast("string")))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """Rows by reason with the kept ones (null) and the total."""
    name = F.when(F.grouping(reason) == 1, "total").otherwise(F.coalesce(F.col(reason), F.lit("kept")))
    return df.rollup(reason).agg(name.alias("outcome"), F.count("*").alias("n")).select("outcome", "n")


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail (or can't be told), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def gate(values: DataFrame, allowed: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the allow table has, and the keys it has no rule for."""
    return values.join(allowed, on, "left_semi"), values.join(allowed, on, "left_anti").select(*on).distinct()


def scan(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, kind, found: every distinct span of each pattern."""
    one = lambda kind, p: F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))
    every = F.concat(*[one(k, p) for k, p in patterns.items()])
    return df.where(F.col(text).isNotNull()).select(key, F.inline(every))


def override_values(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df: key, grp, name; rules: grp, original, replacement, dropped. A value is rewritten or dropped for its group."""
    r = rules.withColumnRenamed("original", "name")
    return df.join(r, ["grp", "name"], "left").where(~F.coalesce("dropped", F.lit(False))).withColumn("name", F.coalesce("replacement", "name")).drop("replacement", "dropped")


#: Kinds of content that must not be published anywhere.
FORBIDDEN = {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "orcid": r"\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b", "contributor": r"\{'(?:name|affiliation|orcid)'"}
#: What a curated vocabulary must not hold; titles of depositors are left as they are.
FORBIDDEN_TERMS = {"specimen": r"(?i)\b(?:patient|donor|subject)\s+[A-Z]?\d"}


def scan_terms(df: DataFrame, term: str, patterns: dict[str, str] = FORBIDDEN_TERMS) -> DataFrame:
    """term, kind: values of a vocabulary that no facet may show."""
    terms = df.select(F.col(term).alias("term")).distinct()
    return terms.select("term", F.explode(F.array_compact(F.array(*[F.when(F.col("term").rlike(p), F.lit(k)) for k, p in patterns.items()]))).alias("kind"))
