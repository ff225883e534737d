"""Running values, ranks and exact percentiles in any order, without a task that sees a whole group.

Rows are range-partitioned by group and order: Spark samples the keys for splitters, so a large group lies in many parts
of about equal size. Each part is scanned by itself; the groups' totals by part, a row each, are scanned in turn, and
what lies before a part is added to its rows. Any associative operation goes; orders must be total, or rows that tie
fall into one part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.rounds import persist


class Scan(NamedTuple):
    """A running value: of the rows before, or up to this one. `total`: a column for the whole group's value, if wanted."""

    value: Column | str
    op: str = "sum"
    inclusive: bool = True
    total: str | None = None


#: What sums parts up, and what puts two parts together; nulls are no values.
OPS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def scan(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], **scans: Scan) -> DataFrame:
    """df with a column for each of `scans`, in `order` inside each group. An empty stretch has the value null."""
    group, order = list(group), [F.col(o) if isinstance(o, str) else o for o in order]
    values = {f"__v_{name}": F.col(s.value) if isinstance(s.value, str) else s.value for name, s in scans.items()}
    d = df.withColumns(values)
    d = d.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, *order)
    d = persist(d.withColumn("__part", F.spark_partition_id()))
    parts = d.groupBy("__part", *group).agg(*[OPS[s.op][0](f"__v_{n}").alias(f"__t_{n}") for n, s in scans.items()])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    every = Window.partitionBy(*group)
    made = [OPS[s.op][0](f"__t_{n}").over(before).alias(f"__b_{n}") for n, s in scans.items()]
    made += [OPS[s.op][0](f"__t_{n}").over(every).alias(f"__w_{n}") for n, s in scans.items() if s.total]
    bases = parts.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group], *made)
    own = Window.partitionBy("__part", *group).orderBy(*order)
    for n, s in scans.items():
        d = d.withColumn(f"__o_{n}", OPS[s.op][0](f"__v_{n}").over(own.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)))
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    d = d.join(bases, on)
    out = {n: OPS[s.op][1](F.col(f"__b_{n}"), F.col(f"__o_{n}")) for n, s in scans.items()}
    out |= {s.total: F.col(f"__w_{n}") for n, s in scans.items() if s.total}
    return d.select(*[c for c in df.columns if c not in out], *[v.alias(n) for n, v in out.items()])


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], place: str = "place", members: str | None = None) -> DataFrame:
    """df with each row's place (from 1) in `order` inside its group, and the group's size if `members` names a column."""
    return scan(df, group, order, **{place: Scan(F.lit(1).cast("long"), total=members)})


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], out: str = "q") -> DataFrame:
    """group, `out` (an array): exact percentiles, interpolated as F.percentile does and with the same result to the bit.

    Values are counted first, so that a frequent one is a row; the rows at the places asked for are found by running
    counts. A task holds its part of the distinct values, whatever share of the rows a group has.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__value")).agg(F.count("*").alias("__n"))
    d = scan(counts, group, ["__value"], __upto=Scan("__n", total="__all"))
    found = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__n"))
            found.append(F.max(F.when(here, F.col("__value"))).alias(f"__{name}{i}"))
    d = d.groupBy(*group).agg(F.max("__all").alias("__all"), *found)
    made = []
    for i, share in enumerate(shares):
        at, lo, hi = F.lit(float(share)) * (F.col("__all") - 1), F.col(f"__lo{i}"), F.col(f"__hi{i}")
        made.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return d.select(*group, F.array(*made).alias(out))


def with_percentiles(d: DataFrame, rows: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], out: str = "q") -> DataFrame:
    """d (a row a group) with the percentiles of each group of rows; null where it has no values."""
    q = percentiles(rows, group, value, shares, out).withColumnsRenamed({g: f"__{g}" for g in group})
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    return d.join(q, on, "left").drop(*[f"__{g}" for g in group])
