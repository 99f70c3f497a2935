"""Embedding near-dedup: Euclidean p-stable hashing of unit vectors, then exact cosines.

In each table, projections on random normal directions, shifted and cut into cells of one width, give
a vector's bucket (Datar et al., 2004). Two unit vectors at cosine c are sqrt(2 - 2c) apart, which fixes the probability that
they share a bucket. The number of projections grows with the logarithm of the rows, so that a vector meets about `crowd` unrelated ones in a
bucket whatever the size of the table, and the number of tables grows with it, so that a pair at the threshold is
missed with a probability of `miss` at most, and nearer ones far more rarely.

Only ids and bucket numbers are dealt out by bucket; vectors are fetched for those that share one, and pairs in a bucket
are then compared by exact cosine. A pair counts in the first table whose bucket it shares, so counts need no list of pairs; links leave a
task as a spanning forest. Equal vectors are one vector with a count from the start. Buckets of over `chunk`
vectors are dealt over chunks, and pairs of chunks are compared in tasks of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import proper, stacked, unit
from .common import components, forget, materialise
from .simhash import _roots


def together(distance: float, width: float) -> float:
    """The probability that two points this far apart fall into one cell of a projection."""
    t = width / max(distance, 1e-9)
    return max(0.0, 1 - math.erfc(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2)))


def sizes(rows: int, least: float, width: float, crowd: float, miss: float) -> tuple[int, int]:
    """(tables, projections) for so many distinct vectors."""
    near, far = together(math.sqrt(max(0.0, 2 - 2 * least)), width), together(math.sqrt(2), width)
    projections = max(1, math.ceil(math.log(max(1.0, rows / crowd)) / -math.log(far)))
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(near**projections, 1 - 1e-12)))), projections


def cells(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A 32-bit bucket number of each unit vector in each table."""
    d = x.shape[1]
    rng = np.random.default_rng([seed, d])
    a = rng.standard_normal((d, tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cut = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections)
    mix = rng.integers(1, 2**63 - 1, (tables, projections), dtype=np.int64) | 1
    h = ((cut + 1024) * mix).sum(axis=2)
    return ((h ^ (h >> 32)) * 0x9E3779B1 >> 16).astype(np.int32)


def _small_pairs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within runs."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stop = np.repeat(end, end - start)
    at = np.concatenate([np.arange(s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]) if len(start) else np.zeros(0, np.int64)
    step = 1
    while len(at):
        inside = at + step < stop
        at, stop = at[inside], stop[inside]
        i.append(at)
        j.append(at + step)
        step += 1
    return np.concatenate(i), np.concatenate(j)


def _fresh(i: np.ndarray, j: np.ndarray, sig: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which pairs share no bucket in a table before that of their run."""
    out = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 65_536):
        p = slice(s, s + 65_536)
        out[p] = (sig[i[p]] == sig[j[p]]).argmax(axis=1) == table[i[p]]
    return out


def compared(x: np.ndarray, sig: np.ndarray, n: np.ndarray, table: np.ndarray, run: np.ndarray, left: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, label of each row) from the pairs of each run: of rows in left with rows that aren't, if a
    run has both, else all. Rows stand in the order of their runs, those in left first."""
    links, label = np.zeros(len(x), dtype=np.int64), np.arange(len(x))

    def add(i: np.ndarray, j: np.ndarray) -> None:
        fresh = _fresh(i, j, sig, table)
        i, j = i[fresh], j[fresh]
        if len(i):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            _roots(i, j, label)

    edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
    start, end = edge[:-1], edge[1:]
    small = (end - start <= 32) & (left[start] == left[end - 1])
    i, j = _small_pairs(start[small], end[small])
    for s in range(0, len(i), 65_536):
        a, b = i[s : s + 65_536], j[s : s + 65_536]
        near = np.einsum("nd,nd->n", x[a], x[b]) >= least
        add(a[near], b[near])
    for s, e in zip(start[~small].tolist(), end[~small].tolist(), strict=True):
        mid = s + int(left[s:e].sum()) if left[s] != left[e - 1] else e
        first = mid if mid < e else s
        step = max(1, 1_000_000 // max(1, e - first))
        for k in range(s, mid, step):
            a, b = np.nonzero(x[k : min(k + step, mid)] @ x[first:e].T >= least)
            a, b = a + k, b + first
            add(a[a < b], b[a < b])
    return links, label


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, miss: float = 0.005, crowd: float = 0.03, width: float = 2.0, chunk: int = 1024, bin_rows: int = 2048, seed: int = 5
) -> DataFrame:
    """(id, n_links long, component_id long, kept boolean) of every row.

    Vectors link at a cosine of at least `least`, in double precision; none below links. n_links counts
    the other rows linked directly, component_id is the smallest id that links reach, itself included, and
    kept says whether that is the row's own. Vectors that `proper` refuses link with nothing; so do null ids,
    whose component is null and which are kept. Vectors of different lengths do not link. Repeated rows are
    vectors of their own: copies link with each other. An empty table gives an empty result. Other columns take no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = rows.where(proper(F.col("v")) & F.col("id").isNotNull())
    total = good.count()
    tables, projections = sizes(total, least, width, crowd, miss)

    @F.pandas_udf("array<int>")
    def signature(vs: pd.Series) -> pd.Series:
        out: list = [None] * len(vs)
        size = vs.map(len).to_numpy()
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            for s in range(0, len(at), 1024):
                some = at[s : s + 1024]
                for j, c in zip(some.tolist(), cells(unit(stacked(vs.iloc[some])), tables, projections, width, seed), strict=True):
                    out[j] = c
        return pd.Series(out, dtype=object)

    classes = materialise(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("sig", signature("v")))
    # a bucket's number: its table, its cell, and the length of its vectors
    key = F.expr("shiftleft(cast(t as long), 48) + (cell & 4294967295L) * 65536L + d % 65536")
    placed = classes.select("rep", F.size("v").alias("d"), F.posexplode("sig").alias("t", "cell")).select("rep", key.alias("key"))
    shared = materialise(placed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("size > 1"))
    # most buckets that are shared have two rows, which their bounds tell
    two = shared.where("size = 2").select("key", F.lit(None).cast("int").alias("chunks"), F.explode(F.array("low", "high")).alias("rep"))
    more = shared.where("size > 2").select("key", F.when(F.col("size") > chunk, F.ceil(F.col("size") / chunk).cast("int")).alias("chunks"))
    met = materialise(two.unionByName(placed.join(more, "key")))
    bins = max(1, -(-met.count() // bin_rows))
    # a row of a hot bucket goes to the tasks of all pairs of chunks that have its own
    own = F.expr("cast(pmod(xxhash64(rep), chunks) as int)")
    pairs = F.expr("transform(sequence(0, chunks - 1), o -> struct(least(o, own) as a, greatest(o, own) as b))")
    dealt = (
        met.withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(pairs)))
        # bins of hot buckets have negative numbers
        .withColumn("bin", F.when(F.col("chunks").isNull(), F.expr(f"pmod(xxhash64(key), {bins}L)")).otherwise(F.expr("-1L - shiftrightunsigned(xxhash64(key, pair.a, pair.b), 1)")))
        .select("bin", "key", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), (F.col("own") == F.col("pair.a")).alias("first"), "rep")
        .join(classes, "rep")
    )

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in b.groupby(b["v"].map(len)):
            part = part.sort_values(["key", "a", "b", "first", "rep"], ascending=[True, True, True, False, True], kind="stable")
            table = part["key"].to_numpy() >> 48
            run = np.cumsum(np.r_[0, np.any([part[k].to_numpy()[1:] != part[k].to_numpy()[:-1] for k in ("key", "a", "b")], axis=0)])
            n, rep = part["n"].to_numpy(), part["rep"].to_numpy()
            links, label = compared(unit(stacked(part["v"])), np.stack(part["sig"].to_list()), n, table, run, part["first"].to_numpy(), least)
            own_rows = np.flatnonzero(links)
            out.append(pd.DataFrame({"rep": rep[own_rows], "root": rep[label[own_rows]], "links": links[own_rows]}))
        return pd.concat(out)

    found = materialise(dealt.groupBy("bin").applyInPandas(compare, "rep long, root long, links long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    linked = materialise(counts.join(roots, counts["rep"] == roots["node"], "left").select("rep", "links", "root"))
    forget(found, shared, met, roots)
    whole = classes.join(linked, "rep", "left").select(F.xxhash64("v").alias("_g"), F.col("v").alias("_w"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    fine = proper(F.col("v")) & F.col("id").isNotNull()
    # the hash comes first, so rows are sorted by it and vectors compared where it is equal
    joined = rows.withColumn("_v", F.when(fine, F.col("v"))).withColumn("_h", F.when(fine, F.xxhash64("v"))).join(whole, (F.col("_h") == F.col("_g")) & (F.col("_v") == F.col("_w")), "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )
