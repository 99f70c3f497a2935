"""Rebuilding the topics of a corpus, and reading them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, clustering, vector_search
from ..sources.config import Clustering


def document_vectors(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, embedding): the mean vector of all chunks of each fetched document."""
    fetched = documents.where("state = 'fetched'").select(F.col("id").alias("document_id"))
    return vector_search.mean_pooled(vectors.join(fetched, "document_id", "left_semi"), ["document_id"]).select(F.col("document_id").alias("id"), "embedding")


def titles_of(members: DataFrame, documents: DataFrame, most: int = 12) -> DataFrame:
    """(label, rank, title) of each cluster's most central members; the URL stands in for a missing title. A member whose document is
    gone is left out."""
    docs = documents.select("id", F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("url")).alias("title"))
    return members.where(F.col("rank") <= most).join(docs, "id").select("label", "rank", "title")


#: Points (id, embedding) and settings to (id, label); label -1 is noise.
Clusterer = Callable[[DataFrame, Clustering], DataFrame]


def knn_graph(points: DataFrame, s: Clustering) -> DataFrame:
    return clustering.cluster(points, s.k, s.min_similarity, s.min_cluster_size, s.max_iters, s.center)


def rebuild(tables: catalog.Tables, now: Column, settings: Clustering | None = None, labeler: Callable[[DataFrame], DataFrame] | None = None, tenant: str = "local", clusterer: Clusterer | None = None) -> str:
    """Clusters the fetched documents anew and returns the id of the run that now holds.

    Without vectors an earlier run stays, and its id is returned. A failure marks the new run failed and leaves the last done one in place.
    labeler: titles (label, rank, title) to (label, name, summary); clusters that it leaves out are named by their terms.
    """
    s = settings or Clustering()
    runs = tables.read("cluster_runs") if tables.exists("cluster_runs") else None
    documents = tables.read("documents").where(F.col("tenant_id") == tenant)
    points = document_vectors(tables.read("chunk_vectors"), documents)
    before = catalog.latest_run(runs, True, tenant).select("id").collect() if runs is not None else []
    if before and points.isEmpty():
        return before[0]["id"]
    spark = documents.sparkSession
    moment = spark.range(1).select(now.cast("timestamp").alias("now")).first()["now"]
    at = F.lit(moment)
    run_id = spark.range(1).select(catalog.stable_id(F.lit(tenant), F.lit("run"), at.cast("string"), F.lit(len(before)))).first()[0]
    params = {"k": s.k, "min_similarity": s.min_similarity, "min_cluster_size": s.min_cluster_size, "max_iters": s.max_iters, "center": s.center}

    def run(status: str, n: int = 0, clusters: int = 0, noise: int = 0, error: str | None = None) -> DataFrame:
        return spark.range(1).select(
            F.lit(run_id).alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(status).alias("status"), F.lit("knn-graph" if clusterer is None else getattr(clusterer, "__name__", "custom")).alias("algo"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), F.lit(error).cast("string").alias("error"),
            F.lit(n).alias("num_documents"), F.lit(clusters).alias("num_clusters"), F.lit(noise).alias("num_noise"), at.alias("started_at"), at.alias("finished_at"), at.alias("created_at"), at.alias("updated_at"),
        )

    def keep_done(new: DataFrame) -> DataFrame:
        return new if runs is None else runs.where("status = 'done'").unionByName(new)

    try:
        labels = tables.scratch((clusterer or knn_graph)(points, s))  # read three times below; the propagation runs once
        sizes, members = clustering.summaries(points, labels, s.center)
        titles = titles_of(members, documents)
        named = clustering.term_labels(titles.withColumnRenamed("label", "cluster"), ["cluster"]).withColumnRenamed("label", "term_name")
        given = labeler(titles) if labeler is not None and s.labeler == "llm" else None
        out = sizes.join(named, F.col("label") == F.col("cluster"), "left").drop("cluster")
        if given is not None:
            out = out.join(given.select("label", "name", "summary"), "label", "left")
        else:
            out = out.withColumn("name", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
        shown = F.lit(None).cast("string") if s.labeler == "off" else F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("term_name"))
        own_id = catalog.stable_id(F.lit(run_id), F.col("label").cast("string"))
        # Rows of the last done run stay until the new one is done: a failure on the way changes nothing for readers.
        tables.append("clusters", out.select(own_id.alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(run_id).alias("run_id"), shown.alias("label"), "summary", F.col("size").cast("int").alias("size"), "cohesion"))
        tables.append("cluster_documents", members.select(own_id.alias("cluster_id"), F.col("id").alias("document_id"), "similarity"))
        n = labels.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("c"), F.count_if(F.col("label") < 0).alias("x")).first()
        tables.replace("cluster_runs", keep_done(run("done", n["n"], n["c"], n["x"])))
        kept = tables.read("clusters").where(F.col("run_id") == run_id)
        tables.drop(labels)
        tables.replace("cluster_documents", tables.read("cluster_documents").join(kept.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select("cluster_id", "document_id", "similarity"))
        tables.replace("clusters", kept)
        tables.replace("cluster_runs", tables.read("cluster_runs").where(F.col("id") == run_id))
    except Exception as e:
        tables.replace("cluster_runs", keep_done(run("failed", error=str(e)[:500])))
        raise
    return run_id


def interests(clusters: DataFrame, members: DataFrame, documents: DataFrame, limit: int = 50, each: int = 5) -> DataFrame:
    """The largest clusters, then the most cohesive, each with its most central members and their titles."""
    from pyspark.sql import Window as W

    best = clusters.orderBy(F.desc("size"), F.desc("cohesion"), "id").limit(max(1, min(limit, 500)))
    order = W.partitionBy("cluster_id").orderBy(F.desc("similarity"), "document_id")
    top = members.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max(0, min(each, 1000)))
    docs = documents.select(F.col("id").alias("document_id"), "title", "url")
    shown = top.join(docs, "document_id", "left").groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "document_id", "similarity", "title", "url"))), lambda x: x.dropFields("_k")).alias("members"))
    return best.join(shown, F.col("id") == F.col("cluster_id"), "left").drop("cluster_id").orderBy(F.desc("size"), F.desc("cohesion"), "id")
