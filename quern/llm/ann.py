"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables.

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; the signed axis nearest to
the result is a hash of it. A table joins the hashes of one or more rotations into a bucket, as many as it takes for buckets of
about `bucket_rows` rows; the last rotation may count fewer axes, so the number of buckets grows with the rows and not in
steps. A query looks into the buckets that lose least, over all tables, against the axes that are nearest to it. Candidates are then ranked by
exact cosine in double precision.

How many buckets are looked into comes from a bounded sample of rows that are no queries, whose true neighbours one scan of all
rows finds: as many as reach the recall that is asked for. Where the neighbours are far that may be most buckets, up to all of them, with which
none is missed. What the buckets reach is then measured on other rows of the sample.

Rows and queries meet in bins of buckets: a query goes to a bin once, with all buckets that it looks into there. A bucket of more
than `chunk` rows is dealt over several bins of its own, to each of which its queries go, so no task holds an unbounded bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of the rows of x; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        a = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """x under the pseudo-rotation of a table, padded with zeros to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for signs in np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, d)):
        x = hadamard(x * signs)
    return x


@dataclass(frozen=True)
class Tables:
    """How vectors of one length are hashed: `tables` tables of `rotations` rotations, the last of which counts `axes`
    axes; queries look into `probe` buckets, of which at most `most` are of one table. recall is what the `sampled` rows reached that
    fixed `probe` (without any: 1), held_out what `measured` others reach."""

    length: int
    tables: int
    rotations: int
    axes: int
    seed: int
    most: int = 4096
    probe: int = 0
    recall: float = 1.0
    sampled: int = 0
    held_out: float = 1.0
    measured: int = 0

    @property
    def padded(self) -> int:
        return 1 << max(0, self.length - 1).bit_length()

    def _counted(self, k: int) -> int:
        return self.axes if k == self.rotations - 1 else self.padded

    def _rotated(self, x: np.ndarray, table: int) -> Iterator[np.ndarray]:
        for k in range(self.rotations):
            yield rotated(x, table * self.rotations + k, self.seed)[:, : self._counted(k)]

    @property
    def cells(self) -> int:
        return math.prod(2 * self._counted(k) for k in range(self.rotations))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each unit vector in each table; buckets of all tables have numbers of their own."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for y in self._rotated(x, t):
                axis = np.abs(y).argmax(axis=1)
                out[:, t] = out[:, t] * 2 * y.shape[1] + 2 * axis + (y[np.arange(len(y)), axis] < 0)
            out[:, t] += t * self.cells
        return out

    @property
    def listed(self) -> int:
        return self.tables * min(self.most, self.cells)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """For each query, the `count` buckets that lose least against the best one of their table; at most `most` of each table."""
        step = max(1, (1 << 22) // max(1, self.tables * min(self.cells, 2 * self.padded * min(count, self.most))))
        return np.concatenate([self._probes(x[k : k + step], count) for k in range(0, max(1, len(x)), step)])

    def _probes(self, x: np.ndarray, count: int) -> np.ndarray:
        losses, codes, kept = [], [], min(count, self.most)
        for t in range(self.tables):
            loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
            for y in self._rotated(x, t):
                both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                own = (both.max(axis=1, keepdims=True) - both) ** 2
                loss = (loss[:, :, None] + own[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * own.shape[1] + np.arange(own.shape[1])).reshape(len(x), -1)
                if loss.shape[1] > kept:
                    best = np.argpartition(loss, kept - 1, axis=1)[:, :kept]
                    loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
            losses.append(loss)
            codes.append(code + t * self.cells)
        loss, code = np.concatenate(losses, axis=1), np.concatenate(codes, axis=1)
        return np.take_along_axis(code, np.lexsort((code, loss), axis=1)[:, :count], 1)


def tables_for(rows: int, length: int, tables: int, bucket_rows: int, seed: int) -> Tables:
    """Tables in which `rows` rows fill about bucket_rows a bucket; one whole rotation at least."""
    padded = 1 << max(0, length - 1).bit_length()
    rotations, axes, cells = 1, padded, 2 * padded
    while cells * bucket_rows < rows and padded > 1:
        axes = min(padded, 1 << max(0, math.ceil(math.log2(rows / (2 * cells * bucket_rows)))))
        rotations, cells = rotations + 1, cells * 2 * axes
    return Tables(length, tables, rotations, axes, seed)


def proper(vector):
    """Whether an array column is a vector that has a direction: neither null, empty or zero, nor with null,
    infinite or NaN components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of unit rows with a unit query; equal rows get equal figures wherever they stand."""
    return (rows * query).sum(axis=1)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, d) of the rows that take part."""
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return out.where(proper(F.col("v")) & F.col("id").isNotNull()).withColumn("d", F.size("v"))


def _true_neighbours(own: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """(query_id, d, id, score, v) of the k nearest rows to each vector of the sample, by a scan of all rows: k for each
    of the sample, its bound, come back."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("d") if len(b) else ():
                if d not in asked:
                    continue
                ids, x = part["id"].to_numpy(), unit(stacked(part["v"]))
                q_ids, q = asked[d]
                score = q @ x.T
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                at = np.argpartition(-score, min(k, len(ids)) - 1, axis=1)[:, :k]
                row, col = np.repeat(np.arange(len(q)), at.shape[1]), at.reshape(-1)
                fine = np.isfinite(score[row, col])
                row, col = row[fine], col[fine]
                yield pd.DataFrame({"query_id": q_ids[row], "d": d, "id": ids[col], "score": score[row, col], "v": part["v"].to_numpy()[col]})

    kind = own.schema["v"].dataType.simpleString()
    found = own.mapInPandas(scan, f"query_id long, d int, id long, score double, v {kind}")
    best = W.partitionBy("query_id", "d").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank").toPandas()


def first_lists(t: Tables, q_ids: np.ndarray, q: np.ndarray, asked_by: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each neighbour (a row of near, of the query with the id asked_by), how many buckets its query looks into before the first that holds it;
    t.listed if none of the listed ones does."""
    order = dict(zip(q_ids.tolist(), t.probes(q, t.listed), strict=True))
    return np.array([int(np.append(np.flatnonzero(np.isin(order[i], b)), t.listed)[0]) for i, b in zip(asked_by.tolist(), t.buckets(near), strict=True)], dtype=np.int64)


def reaching(t: Tables, q_ids: np.ndarray, q: np.ndarray, asked_by: np.ndarray, near: np.ndarray, recall: float) -> Tables:
    """t with as many probes as find the share `recall` of these neighbours; more buckets of a table are listed, up to all, until they do."""
    t = replace(t, most=min(t.most, t.cells))
    while True:
        ranks = np.sort(first_lists(t, q_ids, q, asked_by, near))
        probe = int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1
        if probe <= t.listed or t.most >= t.cells:
            probe = min(probe, t.listed)
            return replace(t, probe=probe, recall=float((ranks < probe).mean()), sampled=len(q))
        t = replace(t, most=min(t.cells, 4 * t.most))


def _drawn(own: DataFrame, asked: DataFrame, sample: int, seed: int) -> pd.DataFrame:
    """(id, v, d, place) of at most `sample` rows of each length by a hash of their ids: of rows that are no queries as long as there are enough."""
    first = W.partitionBy("d").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    rows = own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 4 * sample).toPandas().drop_duplicates("id")
    among = asked.where(F.col("id").isin(*rows["id"].tolist())).select("id").distinct() if len(rows) else None
    also = {r["id"] for r in among.collect()} if among is not None else set()
    rows = rows.assign(also=rows["id"].isin(also)).sort_values(["also", "place"], kind="stable")
    return rows.groupby("d").head(sample).drop(columns="also")


def fit(own: DataFrame, asked: DataFrame, k: int, tables: int, bucket_rows: int, recall: float, sample: int, seed: int, least: float = 0.9) -> dict[int, Tables]:
    """The tables for each length of vectors (id, v, d); a row for each length comes to the driver.

    A sample of at most `sample` rows of a length, by a hash of their ids, fixes how many buckets are looked into; half as many others measure
    what that reaches. Rows of asked are drawn only where there are too few others. A fit below `least` is an error.
    """
    rows = {r["d"]: r["count"] for r in own.groupBy("d").count().collect()}
    drawn = _drawn(own, asked, sample + sample // 2, seed)
    by = {int(d): (part["id"].to_numpy(), unit(stacked(part["v"]))) for d, part in drawn.groupby("d")}
    truth = _true_neighbours(own, by, k) if by else pd.DataFrame({"d": []})
    out = {}
    for d, n in rows.items():
        t = tables_for(n, d, tables, bucket_rows, seed)
        q_ids, q = by[d]
        fitted = max(1, min(sample, 2 * len(q) // 3))
        parts = []
        for at in (slice(0, fitted), slice(fitted, None)):
            near = truth[(truth["d"] == d) & truth["query_id"].isin(q_ids[at])]
            parts.append((q_ids[at], q[at], near["query_id"].to_numpy(), unit(stacked(near["v"])) if len(near) else np.zeros((0, d))))
        if not len(parts[0][2]):
            out[d] = replace(t, probe=t.listed)
            continue
        t = reaching(t, *parts[0], recall)
        if t.recall < min(least, recall):
            raise ValueError(f"the buckets of vectors of length {d} reach a recall of {t.recall}")
        if len(parts[1][2]):
            t = replace(t, held_out=float((first_lists(t, *parts[1]) < t.probe).mean()), measured=len(parts[1][1]))
        out[d] = t
    return out


def search(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = 4, recall: float = 0.97, sample: int = 128,
    bucket_rows: int = 512, chunk: int = 4096, bin_rows: int = 16_384, seed: int = 11, index: dict[int, Tables] | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of df found nearest to each row of queries.

    queries has the same two columns; a row with the query's own id is no candidate. Nearest first, ties to
    the smaller id. Vectors that `proper` refuses and null ids take no part; a query meets vectors of its own length. Repeated
    ids are returned once, with their nearest vector. Fewer than k are returned if fewer are found; an empty table gives an
    empty result. Other columns take no part. index: what `fit` gave, else it is fitted here, on at most `sample` rows of a length that are no
    queries, to reach the recall on them.
    """
    own, asked = _vectors(df, id_col, vector_col), _vectors(queries, id_col, vector_col)
    index = fit(own, asked, k, tables, bucket_rows, recall, sample, seed) if index is None else index

    def place(vs: pd.Series, how) -> pd.Series:
        out: list = [None] * len(vs)
        size = vs.map(len).to_numpy()
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            found = how(index[d], unit(stacked(vs.iloc[at]))) if d in index else np.zeros((len(at), 0), dtype=np.int64)
            for j, row in zip(at.tolist(), found, strict=True):
                out[j] = row
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<long>")
    def buckets_of(vs: pd.Series) -> pd.Series:
        return place(vs, lambda t, x: t.buckets(x))

    @F.pandas_udf("array<long>")
    def probes_of(vs: pd.Series) -> pd.Series:
        return place(vs, lambda t, x: t.probes(x, t.probe))

    placed = materialise(own.withColumn("buckets", buckets_of("v")))
    rows = placed.select("d", F.explode("buckets").alias("bucket"), "id", "v")
    hot = materialise(rows.groupBy("d", "bucket").count().where(F.col("count") > chunk).select("d", "bucket", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    bins = max(1, math.ceil(tables * placed.count() / bin_rows))
    # Hot buckets have bins of their own, which negative numbers keep apart.
    common, split = F.expr(f"pmod(xxhash64(d, bucket), {bins}L)"), F.expr("-1L - shiftrightunsigned(xxhash64(d, bucket, chunk), 1)")
    dealt = (
        rows.join(hot, ["d", "bucket"], "left")
        .withColumn("chunk", F.expr("cast(pmod(xxhash64(id), chunks) as int)"))
        .select("d", F.when(F.col("chunk").isNull(), common).otherwise(split).alias("bin"), F.lit(False).alias("query"), "id", "v", F.array("bucket").alias("buckets"))
    )
    looked = (
        asked.select("d", "id", F.explode(probes_of("v")).alias("bucket"))
        .join(hot, ["d", "bucket"], "left")
        .withColumn("chunk", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
        .select("d", F.when(F.col("chunk").isNull(), common).otherwise(split).alias("bin"), "id", "bucket")
        .groupBy("id", "d", "bin")
        .agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # as many as a query probes at most
        .join(asked, ["id", "d"])
        .select("d", "bin", F.lit(True).alias("query"), "id", "v", "buckets")
    )

    def near(b: pd.DataFrame) -> pd.DataFrame:
        ask = b["query"].to_numpy()
        rows, queries = b[~ask], b[ask]
        out: list[tuple] = []
        if len(rows) and len(queries):
            bucket = np.concatenate(rows["buckets"].to_list())
            ids, x = rows["id"].to_numpy(), unit(stacked(rows["v"]))
            order = np.lexsort((ids, bucket))
            bucket, ids, x = bucket[order], ids[order], x[order]
            q_ids, q = queries["id"].to_numpy(), unit(stacked(queries["v"]))
            wanted = np.concatenate(queries["buckets"].to_list())
            asker = np.repeat(np.arange(len(q)), [len(p) for p in queries["buckets"]])
            by = np.lexsort((asker, wanted))
            wanted, asker = wanted[by], asker[by]
            edges = np.flatnonzero(np.r_[True, wanted[1:] != wanted[:-1], True])
            for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                lo, hi = np.searchsorted(bucket, [wanted[a], wanted[a] + 1]).tolist()
                for s in range(a, e if hi > lo else a, 256):
                    at = asker[s : min(e, s + 256)]
                    out += nearest(x[lo:hi], ids[lo:hi], q[at], q_ids[at], k)
        found = pd.DataFrame(out, columns=["query_id", "id", "score"])
        found = found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).drop_duplicates(["query_id", "id"])
        return found.groupby("query_id").head(k)

    found = dealt.unionAll(looked).groupBy("d", "bin").applyInPandas(near, "query_id long, id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.groupBy("query_id", "id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def nearest(rows: np.ndarray, row_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, exact cosine) of the k distinct ids nearest to each query; row_ids are sorted."""
    out: list[tuple[int, int, float]] = []
    firsts = np.flatnonzero(np.r_[True, row_ids[1:] != row_ids[:-1]])  # k counts ids, however many rows they have
    rough = q @ rows.T
    rough[q_ids[:, None] == row_ids[None, :]] = -np.inf
    most = rough if len(firsts) == len(row_ids) else np.maximum.reduceat(rough, firsts, axis=1)
    low = np.partition(most, -min(k, len(firsts)), axis=1)[:, -min(k, len(firsts))] - 1e-9
    for i in range(len(q)):
        at = np.flatnonzero(rough[i] >= max(low[i], -2.0))
        score = cosines(rows[at], q[i])
        seen: dict[int, float] = {}
        for j in np.lexsort((row_ids[at], -score)):
            seen.setdefault(int(row_ids[at[j]]), float(score[j]))
            if len(seen) == k:
                break
        out += [(int(q_ids[i]), c, s) for c, s in seen.items()]
    return out
