"""Ranks, reciprocal-rank fusion, and the collapse of chunks to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank from 1. For results that are cut to a limit already: all of them are numbered in one task."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, key: tuple[str, ...] = (), carried: list[dict[str, str]] | None = None) -> DataFrame:
    """(key columns, id, score, ...) of ranked lists (id, rank, ...): the sum of weight / (k + rank) over the lists that hold an id.

    k of 0 or less stands for 60, a missing weight for 1; ranks below 1 count nothing. carried has, for each list, columns that it brings
    along, by the names they get; a column of several lists is that of the first one that holds the id. Each list is read once.
    """
    k = k if k > 0 else 60
    weights = list(weights or [])
    carried = carried or [{}] * len(lists)
    kinds = {name: x.schema[c].dataType for x, own in zip(lists, carried, strict=True) for c, name in own.items()}
    each = []
    for n, (x, own) in enumerate(zip(lists, carried, strict=True)):
        of = {name: c for c, name in own.items()}
        part = (F.lit(float(weights[n]) if n < len(weights) else 1.0) / (k + F.col("rank"))).alias("part")
        brought = [(F.col(of[name]) if name in of else F.lit(None).cast(kind)).alias(f"_{name}") for name, kind in kinds.items()]
        each.append(x.where("rank >= 1").select(*key, "id", part, F.lit(n).alias("list"), *brought))
    both = each[0]
    for x in each[1:]:
        both = both.unionByName(x)
    # The order of addition is that of the lists, so equal ranks give equal sums.
    parts = F.transform(F.sort_array(F.collect_list(F.struct("list", "part"))), lambda x: x["part"])
    first = [F.min_by(f"_{name}", F.when(F.col(f"_{name}").isNotNull(), F.col("list"))).alias(name) for name in kinds]
    return both.groupBy(*key, "id").agg(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b).alias("score"), *first)


def collapse_score(strategy: str, score: str = "score") -> Column:
    """Aggregate: a document's score from its chunks'. max (0 at least), sum, or top3_avg; others are max."""
    if strategy == "sum":
        return F.aggregate(F.sort_array(F.collect_list(score), asc=False), F.lit(0.0), lambda a, b: a + b)
    if strategy == "top3_avg":
        best = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 3)
        return F.aggregate(best, F.lit(0.0), lambda a, b: a + b) / F.size(best)
    return F.greatest(F.lit(0.0), F.max(score))


def collapse(chunks: DataFrame, strategy: str = "max", k: int = 10, key: tuple[str, ...] = (), chunks_each: int = 3) -> DataFrame:
    """(key columns, document_id, score, rank, chunks) of the k best documents of scored chunks (document_id, chunk_id, score, ...).

    Equal scores go by document. chunks holds the best `chunks_each` chunks with all their columns, best first, equal
    scores by chunk.
    """
    rest = [c for c in chunks.columns if c not in (*key, "document_id", "score", "chunk_id")]
    packed = F.struct((-F.col("score")).alias("_order"), "chunk_id", "score", *rest)
    best = F.transform(F.slice(F.sort_array(F.collect_list(packed)), 1, chunks_each), lambda x: x.dropFields("_order"))
    docs = chunks.groupBy(*key, "document_id").agg(collapse_score(strategy).alias("score"), best.alias("chunks"))
    order = W.partitionBy(*key).orderBy(F.desc("score"), "document_id")
    if not key:
        docs = docs.orderBy(F.desc("score"), "document_id").limit(k)
    return docs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*key, "document_id", "score", "rank", "chunks")
