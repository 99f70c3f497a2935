"""Ranking quality: recall, precision, NDCG and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(rankings: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, num_relevant, recall, precision, ndcg, rr) of rankings (query_id, rank, id) against judged (query_id, id).

    Every judged query is returned, also one without results. precision divides by the results looked at, which may be fewer
    than k; the reciprocal rank looks at all of them; an id that a ranking repeats counts each time.
    """
    relevant = judged.select("query_id", "id").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("num_relevant"))
    hits = rankings.join(relevant.withColumn("hit", F.lit(True)), ["query_id", "id"], "left")
    found, within = F.coalesce("hit", F.lit(False)), F.col("rank") <= k
    sums = hits.groupBy("query_id").agg(
        F.count_if(within).alias("seen"),
        F.count_if(within & found).alias("hits"),
        F.sum(F.when(within & found, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(found, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("num_relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = F.lit(0.0)
    return sizes.join(sums, "query_id", "left").select(
        "query_id",
        "num_relevant",
        F.coalesce(F.col("hits") / F.col("num_relevant"), zero).alias("recall"),
        F.coalesce(F.when(F.col("seen") > 0, F.col("hits") / F.col("seen")), zero).alias("precision"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), zero).alias("rr"),
    )


def sharing_passages(documents: DataFrame, queries: DataFrame, words: int = 8) -> DataFrame:
    """(query_id, id): the documents (id, text) that have `words` words in a row in common with a query (query_id, text), as judgements.

    Runs of words are compared by a hash of 64 bits, as an equi-join. The queries are a stated set: their runs are sent round, and none of a document's is
    shuffled. Texts of fewer words, and null ones, share nothing.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        split = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
        cut = df.select(key, F.transform(split, lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= words)
        return cut.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.slice("w", i, words)))).alias("run"))

    return runs(documents, "id").join(F.broadcast(runs(queries, "query_id").distinct()), "run").select("query_id", "id").distinct()


def means(results: DataFrame) -> DataFrame:
    """One row: the number of queries and the mean of each measure."""
    names = {"recall": "mean_recall", "precision": "mean_precision", "ndcg": "mean_ndcg", "rr": "mrr"}
    return results.agg(F.count("*").alias("queries"), *(F.avg(k).alias(v) for k, v in names.items()))
