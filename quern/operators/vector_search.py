"""Exact vector search and pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from .fusion import ranked


def nearest(chunks: DataFrame, query: DataFrame, limit: int = 50, vector_col: str = "embedding") -> DataFrame:
    """chunks' columns but the vector, with distance, score and rank: the `limit` rows nearest to the one row of query.

    query has one column, the vector. Filters belong on chunks: they hold before the limit, so no row that passes them is
    missed. Null vectors are near nothing, and a null query finds nothing; vectors of another length than the query's raise an error. The query is one row, and each task keeps its
    best `limit` rows only.
    """
    asked = query.first()  # one vector
    if asked is None or asked[0] is None:
        asked, chunks = ([],), chunks.where("false")
    q = np.asarray(asked[0], dtype=np.float64)

    @F.pandas_udf(T.DoubleType())
    def away(rows: pd.Series) -> pd.Series:
        if any(len(v) != len(q) for v in rows):
            raise ValueError("vectors of different lengths")
        x = np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, len(q)))
        return pd.Series(np.sqrt(((x - q) ** 2).sum(axis=1)))

    best = chunks.where(F.col(vector_col).isNotNull()).withColumn("distance", away(F.col(vector_col))).drop(vector_col).orderBy("distance", "chunk_id").limit(limit)
    return ranked(best.withColumn("score", vectors.similarity(F.col("distance"))), F.asc("distance"), F.asc("chunk_id"))


def nearest_many(chunks: DataFrame, queries: DataFrame, limit: int = 50, vector_col: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, chunks' columns but the vector, distance, score, rank): the `limit` rows nearest to each of queries (query_id, the vector), equal ones by chunk.

    The queries are a stated set, sent round in blocks; each task keeps a query's best `limit` of each batch, and the shuffle what is best of a task. Null
    vectors are near nothing, also as queries; an id that queries repeat counts once. Vectors of other lengths raise an error.
    """
    asked = queries.where(F.col(vector_col).isNotNull()).select("query_id", vector_col).toPandas().drop_duplicates("query_id")
    own = chunks.where(F.col(vector_col).isNotNull())
    rest = [f for f in own.schema.fields if f.name != vector_col]
    kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *rest, T.StructField("distance", T.DoubleType())])
    parts = [own.mapInPandas(_near(asked[s : s + block], vector_col, limit), kind) for s in range(0, max(1, len(asked)), block)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = W.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("score", vectors.similarity(F.col("distance"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def _near(asked: pd.DataFrame, vector_col: str, limit: int):
    ids = asked["query_id"].to_numpy()
    q = np.stack([np.asarray(v, dtype=np.float64) for v in asked[vector_col]]) if len(asked) else None

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if q is None or not len(b):
                continue
            if any(len(v) != q.shape[1] for v in b[vector_col]):
                raise ValueError("vectors of different lengths")
            x, rest = np.stack(b[vector_col]).astype(np.float64), b.drop(columns=[vector_col])
            for i in range(len(q)):
                away = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                # all that are as near as the last one stay, so that ties go by chunk
                at = np.flatnonzero(away <= np.partition(away, limit - 1)[limit - 1]) if len(away) > limit else np.arange(len(away))
                out = rest.iloc[at].copy()
                out.insert(0, "query_id", ids[i])
                yield out.assign(distance=away[at])

    return of


def mean_pooled(rows: DataFrame, key_cols: list[str], vector_col: str = "embedding", as_float: bool = True) -> DataFrame:
    """(keys, n, embedding): the mean of each group's vectors, summed in double precision.

    Each task first adds up its own rows, a batch at a time, into a vector and a count for each key; those partial sums are added place
    by place. So a group of any size costs one vector for each batch, and no group is gathered in one task.
    """
    fields = [rows.schema[k] for k in key_cols]
    part = T.StructType([*fields, T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # vectors of one group have one length; groups may differ
            for _, same in b.groupby(b["_v"].map(len)) if len(b) else ():
                own = same.groupby(key_cols, dropna=False, sort=False)
                place = own.ngroup().to_numpy()
                sums = np.zeros((own.ngroups, len(same["_v"].iloc[0])))
                np.add.at(sums, place, np.stack(same["_v"]).astype(np.float64))
                first = np.unique(place, return_index=True)[1]
                yield same.iloc[first][key_cols].assign(s=list(sums), n=np.bincount(place))

    partial = rows.select(*key_cols, F.col(vector_col).alias("_v")).where("_v is not null").mapInPandas(add_up, part)
    sums = partial.select(*key_cols, "n", F.posexplode("s").alias("at", "x")).groupBy(*key_cols, "at").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    packed = sums.groupBy(*key_cols).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", (F.col("s") / F.col("n")).alias("m")))).alias("p"))
    out = F.transform("p", lambda x: x["m"].cast("float") if as_float else x["m"])
    return packed.select(*key_cols, "n", out.alias(vector_col))


def leading_mean(chunks: DataFrame, document, limit: int = 64, vector_col: str = "embedding") -> DataFrame:
    """(embedding): the mean vector of a document's first `limit` chunks by ord."""
    own = chunks.where(F.col("document_id") == document).orderBy("ord").limit(limit)
    return mean_pooled(own.withColumn("_all", F.lit(1)), ["_all"], vector_col).select(vector_col)
