"""Embedding tables: cosine neighbours of sampled queries, principal components, decodability probes."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import index


def cosine_topk(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, cells: int | None = None) -> DataFrame:
    """query, key, cosine, rank: the k nearest other rows of each query, exactly, by the cells of an inverted file."""
    found = index.search(index.build(df, key, vector, cells), queries, key, vector, k)
    return found.select("query", F.col("id").alias(key), "cosine", "rank")


def near_pairs(df: DataFrame, key: str, vector: str, distance: float, cells: int | None = None) -> DataFrame:
    """a, b, distance: all pairs of rows whose unit vectors are at most `distance` apart, exactly."""
    found = index.near(index.build(df, key, vector, cells), df, key, vector, 1 - distance * distance / 2 - 1e-12)
    pairs = found.where("query < id").withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))))
    return pairs.select(F.col("query").alias("a"), F.col("id").alias("b"), "distance")


def principal(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    d = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(d).transform(d).select(key, vector_to_array("p").alias("components"))


def probe(df: DataFrame, key: str, vector: str, label: str, folds: int = 3, regression: bool = False) -> DataFrame:
    """fold, score: balanced accuracy (or 1 - residual share) of a linear model on held-out folds by hash."""
    d = df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("raw"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold")).where("label is not null")
    out = None
    for f in range(folds):
        train, test = d.where(F.col("fold") != f), d.where(F.col("fold") == f)
        scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        model = (LinearRegression(regParam=1.0) if regression else LogisticRegression(regParam=0.01, maxIter=30)).fit(scale.transform(train))
        got = model.transform(scale.transform(test))
        if regression:
            s = got.agg((1 - F.sum((F.col("label") - F.col("prediction")) ** 2) / (F.var_pop("label") * F.count("*"))).alias("score"))
        else:
            s = got.groupBy("label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("r")).agg(F.avg("r").alias("score"))
        s = s.select(F.lit(f).alias("fold"), "score")
        out = s if out is None else out.unionByName(s)
    return out
