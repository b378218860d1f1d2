"""K-means, standardisation and per-cluster summaries of embeddings, on Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def kmeans(df: DataFrame, col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with the cluster of each row."""
    v = vectors(df, col, "__v")
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")


def silhouette_sweep(df: DataFrame, col: str, ks: range = range(2, 9), seed: int = 0) -> DataFrame:
    """(k, silhouette) by squared Euclidean distance; each k is a distributed fit."""
    v = vectors(df, col, "__v").select("__v").persist()
    rate = ClusteringEvaluator(featuresCol="__v", predictionCol="cluster")
    rows = [(k, float(rate.evaluate(KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v)))) for k in ks]
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def standardize(df: DataFrame, col: str, out: str = "scaled") -> DataFrame:
    """Every dimension to mean 0 and population deviation 1 (Spark scales by the sample deviation; the rest is a factor)."""
    v = vectors(df, col, "__v")
    n = v.count()
    scaled = StandardScaler(withMean=True, inputCol="__v", outputCol="__s").fit(v).transform(v)
    grow = float((n / (n - 1)) ** 0.5) if n > 1 else 1.0
    return scaled.withColumn(out, F.transform(vector_to_array("__s"), lambda x: x * grow)).drop("__v", "__s")


def project(df: DataFrame, col: str, k: int = 2, out: str = "xy") -> DataFrame:
    """The first k principal components; a linear stand-in for manifold embeddings, which Spark lacks."""
    v = vectors(df, col, "__v")
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(v).transform(v).withColumn(out, vector_to_array("__p")).drop("__v", "__p")


def mean_vectors(df: DataFrame, key: str, col: str, out: str = "mean") -> DataFrame:
    """The mean embedding of each group (mean pooling)."""
    return vectors(df, col, "__v").groupBy(key).agg(Summarizer.mean(F.col("__v")).alias("__m")).select(key, vector_to_array("__m").alias(out))


def mean_by_cluster(df: DataFrame, value: str, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
