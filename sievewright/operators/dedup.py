"""Near-duplicate removal: by band collisions, and with exact verification of greedy extremes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import token_set
from sievewright.operators import minhash
from sievewright.operators.graph import connected_components
from sievewright.session import materialize


def collision_clusters(docs: DataFrame, id_col: str, text_col: str, num_perm: int = 256, ngram: int = 5, threshold: float = 0.7) -> DataFrame:
    """(id, component) of documents that any band collision links to another; the component is its least id."""
    n_bands, rows = minhash.best_banding(threshold, num_perm)
    signed = minhash.signatures(docs, id_col, text_col, num_perm, ngram)
    return connected_components(minhash.star_edges(materialize(minhash.bands(signed, n_bands, rows), "bands")))


def drop_collisions(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """docs with only the least id of every cluster of collision_clusters(); texts too short for an n-gram collide with each other."""
    gone = collision_clusters(docs, id_col, text_col, **options).where("id <> component").select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")


def greedy_clusters(docs: DataFrame, id_col: str, text_col: str, path_col: str, num_perm: int = 256, threshold: float = 0.85, min_tokens: int = 10) -> DataFrame:
    """(cluster, id, path, copies, is_extreme): duplicate clusters reduced to extremes.

    Documents are added in the order of their ids. A document that shares a band with earlier ones
    joins the cluster of the least of them that is a cluster's base, or else opens one on the least.
    In each cluster, base first, a document is an extreme unless its Jaccard similarity with an
    earlier extreme reaches the threshold, which then counts one copy more. is_extreme holds for
    documents that are an extreme in any cluster; copies is null for the others. Documents with fewer
    than min_tokens tokens take no part.

    Additions only touch documents of the same component of the band graph, so components are
    replayed independently of each other, each within one task.
    """
    n_bands, rows = minhash.best_banding(threshold, num_perm)
    signed = minhash.signatures(docs, id_col, text_col, num_perm, 1, min_tokens)
    banded = materialize(minhash.bands(signed, n_bands, rows), "bands")
    members = connected_components(minhash.star_edges(banded))
    keys = banded.join(members, "id").groupBy("component", "id").agg(F.collect_list(F.concat_ws(":", "band", "key")).alias("keys"))
    keys = materialize(keys, "keys")
    # only the texts of documents in a component are read again
    some = docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).join(keys.select("id"), "id", "left_semi")
    texts = some.select("id", "path", F.transform(token_set(F.col("text")), lambda t: F.xxhash64(t)).alias("tokens"))
    full = keys.join(texts, "id")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, tokens = pdf["id"].tolist(), [set(np.asarray(t).tolist()) for t in pdf["tokens"]]
        bucket: dict = {}
        clusters: dict = {}
        for i, ks in enumerate(pdf["keys"]):
            close = sorted({j for k in ks for j in bucket.get(k, ())})
            for k in ks:
                bucket.setdefault(k, []).append(i)
            if close:
                base = next((j for j in close if j in clusters), close[0])
                clusters.setdefault(base, []).append(i)
        rows_, best = [], {}
        for base, rest in clusters.items():
            extremes: list = []
            for i in [base, *rest]:
                for e in extremes:
                    both = len(tokens[i] & tokens[e[0]])
                    if both >= threshold * (len(tokens[i]) + len(tokens[e[0]]) - both):
                        e[1] += 1
                        break
                else:
                    extremes.append([i, 1])
            best.update(dict(extremes))
        for base, rest in clusters.items():
            for i in [base, *rest]:
                rows_.append((ids[base], ids[i], pdf["path"][i], best.get(i), i in best))
        out = pd.DataFrame(rows_, columns=["cluster", "id", "path", "copies", "is_extreme"])
        return out.astype({"copies": "Int64"})

    kind = docs.schema[id_col].dataType.simpleString()
    return full.groupBy("component").applyInPandas(replay, f"cluster {kind}, id {kind}, path string, copies long, is_extreme boolean")


def drop_greedy(docs: DataFrame, clusters: DataFrame, id_col: str) -> DataFrame:
    """docs without the cluster members that aren't extremes."""
    gone = clusters.where("not is_extreme").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Number, largest, least, mean and median size of clusters."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.median("n").alias("median"))


def nested_clusters(clusters: DataFrame) -> DataFrame:
    """One row for each cluster with its members as structs, in the order of ids."""
    member = F.struct(F.col("id").alias("base_index"), F.col("path").alias("original_path"), "copies", "is_extreme")
    return clusters.groupBy("cluster").agg(F.sort_array(F.collect_list(member)).alias("members"))


def dedup_counts(docs: DataFrame, clusters: DataFrame, id_col: str) -> DataFrame:
    """Rows, clusters, documents in clusters, extremes and rows left."""
    flags = clusters.groupBy("id").agg(F.bool_or("is_extreme").alias("e")).agg(F.count("*").alias("in_clusters"), F.count_if("e").alias("extremes"))
    n = docs.agg(F.count(id_col).alias("rows"))
    c = clusters.agg(F.count_distinct("cluster").alias("clusters"))
    return n.crossJoin(c).crossJoin(flags).withColumn("rows_left", F.col("rows") - F.col("in_clusters") + F.col("extremes"))


def drop_exact(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with only the least id of every text; texts meet by digest, so only digests are shuffled."""
    digest = F.sha2(F.col(text_col), 256)
    keep = docs.where(F.col(text_col).isNotNull()).groupBy(digest.alias("__d")).agg(F.min(id_col).alias("__keep"))
    marked = docs.select(F.col(id_col), digest.alias("__d")).join(keep, "__d").where(F.col(id_col) != F.col("__keep")).select(id_col)
    return docs.join(marked, id_col, "left_anti")
