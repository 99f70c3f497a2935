"""An index of vectors in cells with coded residuals, for near vectors without a scan of all (Jegou, Douze and Schmid, 2011).

k-means on a bounded sample gives cells, and for what is left of a vector less its cell's centre, cut into parts, a code book for each part. All rows are then put
into their cells with one byte for each part. The table is partitioned by cell, so a search reads the folders of the cells it looks into and no others,
and of these the codes alone. Distances to codes are sums of looked-up numbers; the best of them are ranked again by their vectors.

Filters hold before any cut: rows that may not be returned are never ranked. How many cells are looked into is fitted on a bounded sample of rows, whose true
neighbours one scan finds, to a recall that is asked for; where that takes most cells, looking into all of them is what is done.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vector_search

#: Rows of a table up to which all vectors are compared, and queries that are sent round at a time.
SMALL, QUERIES = 20_000, 1024


@dataclass(frozen=True)
class Codes:
    """centres (cells x length), books (parts x codes x length of a part); probe: how many cells a search looks into. recall: what that reached on the sample; rows: how many
    rows had a vector."""

    centres: np.ndarray
    books: np.ndarray
    probe: int
    recall: float
    rows: int = 0

    @property
    def bytes(self) -> int:
        return self.centres.nbytes + self.books.nbytes

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_squared(x[k : k + 1024], self.centres).argmin(axis=1) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0, dtype=int)

    def ranked_cells(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(_squared(x, self.centres), axis=1, kind="stable")

    def coded(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(rows x parts) bytes: the code nearest to each part of what a vector is beyond its cell's centre."""
        width, out = self.books.shape[2], np.zeros((len(x), len(self.books)), dtype=np.uint8)
        for k in range(0, len(x), 1024):
            rest = x[k : k + 1024] - self.centres[cell[k : k + 1024]]
            for p, book in enumerate(self.books):
                out[k : k + 1024, p] = _squared(rest[:, p * width : (p + 1) * width], book).argmin(axis=1)
        return out

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to rows of one cell, as their codes have it."""
        rest, width = q - self.centres[cell], self.books.shape[2]
        tables = np.stack([((rest[p * width : (p + 1) * width] - book) ** 2).sum(axis=1) for p, book in enumerate(self.books)])
        return tables[np.arange(len(self.books)), codes].sum(axis=1)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :])


def _means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """k centres of the rows of x by Lloyd's steps; a centre without rows starts anew at a row."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        at = np.concatenate([_squared(x[s : s + 4096], centres).argmin(axis=1) for s in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def train(
    rows: DataFrame, k: int = 10, cells: int | None = None, parts: int = 16, codes: int = 256, sample: int = 65_536, asked: int = 64,
    recall: float = 0.95, seed: int = 3, most_cells: int = 65_536,
) -> Codes:
    """Cells and code books of rows (id, embedding), from at most `sample` of them by a hash of their ids: about the root of the number of rows in cells.

    `asked` other rows, as queries, fix how many cells are looked into: as many as hold the share `recall` of their k nearest rows, which
    one scan of all rows finds. Rows without a vector take no part; vectors of several lengths are an error, as is a table without any.
    """
    held = rows.where("embedding is not null").select("id", "embedding")
    drawn = held.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample + asked).toPandas()
    if not len(drawn):
        raise ValueError("there are no vectors")
    x, n, rng = _matrix(drawn["embedding"]), held.count(), np.random.default_rng(seed)
    few = min(asked, len(x) // 2)
    q, q_ids, x = x[:few], drawn["id"].to_numpy()[:few], x[few:]
    count = min(most_cells, len(x), cells or max(1, round(math.sqrt(n))))
    centres = _means(x, count, rng)
    parts = math.gcd(parts, x.shape[1])
    rest, width = x - centres[Codes(centres, np.zeros((0, 0, 0)), 0, 0.0).cells(x)], x.shape[1] // parts
    books = np.stack([_means(rest[:, p * width : (p + 1) * width], min(codes, len(x)), rng) for p in range(parts)])
    made = Codes(centres, books, count, 1.0, n)
    if not few:
        return made
    truth = _true(held, q_ids, q, k)
    order = {i: {c: r for r, c in enumerate(row)} for i, row in zip(q_ids.tolist(), made.ranked_cells(q).tolist(), strict=True)}
    at = made.cells(_matrix(truth["embedding"])).tolist()
    ranks = np.sort([order[i][c] for i, c in zip(truth["query_id"].tolist(), at, strict=True)])
    probe = int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1 if len(ranks) else count
    return Codes(centres, books, probe, float((ranks < probe).mean()) if len(ranks) else 1.0, n)


def _matrix(column: pd.Series) -> np.ndarray:
    if len({len(v) for v in column}) > 1:
        raise ValueError("vectors of different lengths")
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _true(held: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """(query_id, id, embedding) of the k rows nearest to each of the sample's vectors, but itself."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            away = _squared(q, _matrix(b["embedding"])) if len(b) else np.zeros((len(q), 0))
            away[q_ids[:, None] == ids[None, :]] = np.inf
            at = np.argsort(away, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(q)), at.shape[1]), at.reshape(-1)
            yield pd.DataFrame({"query_id": q_ids[i], "id": ids[j], "away": away[i, j], "embedding": b["embedding"].to_numpy()[j]})

    kind, vector = (held.schema[c].dataType.simpleString() for c in ("id", "embedding"))
    found = held.mapInPandas(scan, f"query_id {kind}, id {kind}, away double, embedding {vector}").where("away < double('inf')")
    best = W.partitionBy("query_id").orderBy("away", "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).toPandas()


@dataclass(frozen=True)
class VectorIndex:
    """rows (id, the columns that were kept, code, embedding, cell), partitioned by cell."""

    rows: DataFrame
    codes: Codes


def write(rows: DataFrame, codes: Codes, path: str, keep: tuple[str, ...] = ("document_id",), most_bytes: int = 1 << 28) -> None:
    """Writes rows (id, embedding, columns of keep) in their cells. Large cells are spread over files; rows without a vector are left out.

    What is sent round is bounded: code books of more than most_bytes are an error.
    """
    if codes.bytes > most_bytes:
        raise ValueError(f"{codes.bytes} bytes of code books are too many to send to every task")
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(codes)

    @F.pandas_udf("struct<cell: int, code: binary>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        x = _matrix(vectors)
        cell = sent.value.cells(x)
        code = sent.value.coded(x, cell) if len(x) else []
        return pd.DataFrame({"cell": cell, "code": [c.tobytes() for c in code]})

    placed = rows.where("embedding is not null").select("id", *keep, "embedding", place("embedding").alias("at")).select("id", *keep, "at.code", "embedding", "at.cell")
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/rows")
    books = {"centres": codes.centres.tolist(), "books": codes.books.tolist(), "probe": codes.probe, "recall": codes.recall, "rows": codes.rows}
    spark.createDataFrame([(json.dumps(books),)], "books string").coalesce(1).write.parquet(f"{path}/books")


def read(spark: SparkSession, path: str) -> VectorIndex:
    books = json.loads(spark.read.parquet(f"{path}/books").first()[0])
    codes = Codes(np.array(books["centres"]), np.array(books["books"]), books["probe"], books["recall"], books["rows"])
    return VectorIndex(spark.read.parquet(f"{path}/rows"), codes)


def search(index: VectorIndex, queries: DataFrame, k: int = 50, rerank: int = 10, probe: int | None = None, documents: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(query_id, id, kept columns, distance, score, rank): the k rows found nearest to each of queries (query_id, embedding), equal ones by id.

    rerank * k rows with the least coded distances are ranked by their vectors. documents (document_id): only their rows are ranked at all; a
    query that finds fewer than k of them in its cells is asked again in all cells. queries are read in blocks of QUERIES; null
    vectors find nothing. Of a table of up to `small` rows all vectors are compared.
    """
    if index.codes.rows <= small:
        rows = index.rows if documents is None else index.rows.join(documents.select("document_id").distinct(), "document_id", "left_semi")
        found = vector_search.nearest_many(rows.drop("code", "cell").withColumnRenamed("id", "chunk_id"), queries.select("query_id", "embedding"), k)
        return found.withColumnRenamed("chunk_id", "id")
    asked = queries.where("embedding is not null").select("query_id", "embedding").toPandas().drop_duplicates("query_id")  # the stated query set
    parts = [_search(index, asked[s : s + QUERIES], k, rerank, probe or index.codes.probe, documents) for s in range(0, len(asked), QUERIES)] or [_search(index, asked, k, rerank, 1, documents)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _least(away: np.ndarray, ids: np.ndarray, most: int, who: np.ndarray | None = None) -> np.ndarray:
    """Places of the `most` least distances, of each of who if given; equal ones by id."""
    if who is not None:
        order = np.lexsort((ids, away, who))
        who = who[order]
        return order[np.arange(len(who)) - np.searchsorted(who, who) < most]
    if len(away) <= most:
        return np.arange(len(away))
    at = np.flatnonzero(away <= np.partition(away, most - 1)[most - 1])
    return at if len(at) == most else at[np.lexsort((ids[at], away[at]))[:most]]


def _rough(batches: Iterator[pd.DataFrame], codes: Codes, q: np.ndarray, wanted: dict[int, np.ndarray], most: int) -> Iterator[pd.DataFrame]:
    """(query, cell, id, away): the `most` rows of a task (cell, id, code) with the least coded distances to each of q. What is held is cut to these
    whenever it is twice as much and more, so it depends on `most` and the queries, not on rows or cells."""
    held: list[tuple[np.ndarray, ...]] = []
    n, limit = 0, max(1 << 16, 2 * most * len(q))

    def cut() -> tuple[np.ndarray, ...]:
        who, cell, ids, away = map(np.concatenate, zip(*held, strict=True))
        at = _least(away, ids, most, who)
        return who[at], cell[at], ids[at], away[at]

    for b in batches:
        for c, part in b.groupby("cell"):
            code, ids = np.stack([np.frombuffer(x, dtype=np.uint8) for x in part["code"]]), part["id"].to_numpy()
            for i in wanted[c]:
                away = codes.distances(q[i], c, code)
                at = _least(away, ids, most)
                held.append((np.full(len(at), i), np.full(len(at), c), ids[at], away[at]))
                n += len(at)
                if n > limit:
                    held = [cut()]
                    n = len(held[0][0])
    if held:
        yield pd.DataFrame(dict(zip(("query", "cell", "id", "away"), cut(), strict=True)))


def _search(index: VectorIndex, asked: pd.DataFrame, k: int, rerank: int, probe: int, documents: DataFrame | None) -> DataFrame:
    codes, rows, spark = index.codes, index.rows, index.rows.sparkSession
    if documents is not None:
        rows = rows.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    q, q_ids, count = _matrix(asked["embedding"]), asked["query_id"].to_numpy(), len(codes.centres)
    order = codes.ranked_cells(q) if len(q) else np.zeros((0, count), dtype=int)
    near = order[:, :probe]
    if documents is not None and len(q):  # cells are added until they hold k rows of these documents
        held = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # a row for each cell
        sizes = np.cumsum(np.array([[held.get(c, 0) for c in row] for row in order.tolist()]), axis=1)
        enough = np.maximum(probe, (sizes < k).sum(axis=1) + 1)
        near = [row[:n] for row, n in zip(order, enough, strict=True)]
    lists: dict[int, list[int]] = {}
    for i, row in enumerate(near):
        for c in row.tolist():
            lists.setdefault(c, []).append(i)
    wanted = {c: np.array(i, dtype=np.int32) for c, i in lists.items()}
    most, sent = rerank * k, spark.sparkContext.broadcast((codes, q, q_ids, wanted))
    own = rows.where(F.col("cell").isin(*wanted))  # folders of these cells alone

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, q, q_ids, wanted = sent.value
        for found in _rough(batches, codes, q, wanted, most):
            yield pd.DataFrame({"query_id": q_ids[found["query"].to_numpy()], "cell": found["cell"], "id": found["id"], "away": found["away"]})

    kind, queries_kind = rows.schema["id"].dataType.simpleString(), "string" if len(q_ids) and isinstance(q_ids[0], str) else "long"
    rough = own.select("cell", "id", "code").mapInPandas(score, f"query_id {queries_kind}, cell int, id {kind}, away double")
    first = W.partitionBy("query_id").orderBy("away", "id")
    kept = rough.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("query_id", "cell", "id")
    by_id = {i: v for i, v in zip(q_ids.tolist(), q, strict=True)}

    @F.pandas_udf("double")
    def exact(who: pd.Series, vectors: pd.Series) -> pd.Series:
        if not len(who):
            return pd.Series([], dtype=float)
        return pd.Series(np.sqrt(((_matrix(vectors) - np.stack([by_id[i] for i in who])) ** 2).sum(axis=1)))

    found = own.drop("code").join(kept, ["cell", "id"]).withColumn("distance", exact("query_id", "embedding")).drop("embedding", "cell")
    best = W.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    rest = [c for c in ranked.columns if c not in ("query_id", "id", "distance", "rank")]
    return ranked.select("query_id", "id", *rest, "distance", (1.0 / (1.0 + F.col("distance"))).alias("score"), "rank")
