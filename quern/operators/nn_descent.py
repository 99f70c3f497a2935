"""Graphs of near neighbours by descent: lists of neighbours are improved by comparing neighbours of the same node (Dong, Moses and Li, 2011).

The first lists come from leaves of random hyperplanes: points on the same side of all planes of a tree are compared, in bounded leaves. In each round a
node brings together a bounded sample of those on its list and of those that list it, and each pair of them with at least one that is new there is
compared. So a point costs the same number of comparisons a round however many points there are. Rounds end when hardly any list changes.

A vector is sent to every node that meets it, so lists are improved with one byte for each component. What may be among the best of a list, by a bound on
what the bytes are off, is compared once more by the vectors themselves at the end.

clustering.knn_edges is the exact graph, of which this one has most edges; how many depends on the data and on `pool`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from .stage import drop, keep


@dataclass(frozen=True)
class Graph:
    """edges (src, dst, w); how many pairs were compared, in how many rounds; points: how many have a direction."""

    edges: DataFrame
    compared: int
    rounds: int
    points: int


def _weights(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows of x in pairs, added from the first component to the last, so that a pair has one weight wherever it is met."""
    w = np.zeros(len(i))
    for c in range(x.shape[1]):
        w += x[i, c] * x[j, c]
    return w


def _best(src: np.ndarray, dst: np.ndarray, w: np.ndarray, most: int) -> pd.DataFrame:
    """The `most` best edges of each src, without repeats; equal ones by dst."""
    order = np.lexsort((dst, -w, src))
    src, dst, w = src[order], dst[order], w[order]
    if len(src):
        fine = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
        src, dst, w = src[fine], dst[fine], w[fine]
    at = np.arange(len(src)) - np.searchsorted(src, src)
    return pd.DataFrame({"src": src[at < most], "dst": dst[at < most], "w": w[at < most]})


def _codes(units: Column, trees: int, planes: int, seed: int) -> Column:
    """For each tree, on which side of its planes a vector lies, as bits of a number."""

    @F.pandas_udf("array<long>")
    def of(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        size = rows.map(len).to_numpy()
        for d in np.unique(size).tolist():  # the planes are those of the vectors' length
            at = np.flatnonzero(size == d)
            normal = np.random.default_rng([seed, d]).standard_normal((d, trees * planes))
            side = (np.stack(rows.iloc[at]).astype(np.float64) @ normal > 0).reshape(len(at), trees, planes)
            for i, code in zip(at.tolist(), side @ (1 << np.arange(planes)), strict=True):
                out[i] = code
        return pd.Series(out, dtype=object)

    return of(units)


_CODED = T.StructType([T.StructField("code", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in ("scale", "off", "norm"))])


@F.pandas_udf(_CODED)
def _bytes(units: pd.Series) -> pd.DataFrame:
    """A vector as one byte for each component and their scale; how far these are off, and its length. One that isn't finite has a scale of NaN."""
    out = []
    for v in units:
        x = np.asarray(v, dtype=np.float64)
        top = float(np.abs(x).max()) if len(x) else 0.0
        if not math.isfinite(top):
            out.append((bytes(len(x)), math.nan, 0.0, 0.0))
            continue
        scale = top / 127
        code = np.rint(x / scale) if scale > 0 else np.zeros(len(x))
        out.append((code.astype(np.int8).tobytes(), scale, float(np.sqrt(((x - code * scale) ** 2).sum())), float(np.sqrt((x * x).sum()))))
    return pd.DataFrame(out, columns=["code", "scale", "off", "norm"])


def _vectors(b: pd.DataFrame) -> np.ndarray:
    """What codes and scales stand for, as rows."""
    return np.frombuffer(b"".join(b["code"]), dtype=np.int8).reshape(len(b), -1) * b["scale"].to_numpy()[:, None]


def _leaves(rows: DataFrame, points: int, pool: int, trees: int, leaf: int, seed: int, count) -> DataFrame:
    """First lists (src, dst, w): the best `pool` of a point in each of its leaves, of about `leaf` points and twice as many at most on average."""
    planes = max(0, math.ceil(math.log2(max(1, points / leaf))))
    placed = rows.select("id", "code", "scale", F.posexplode(_codes(F.col("unit"), trees, planes, seed) if planes else F.array_repeat(F.lit(0).cast("long"), trees)).alias("tree", "leaf"))
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / leaf).cast("long").alias("parts"))
    dealt = placed.join(sizes, ["tree", "leaf"]).withColumn("part", F.expr(f"pmod(xxhash64(id, tree, {seed}), parts)"))
    kind = rows.schema["id"].dataType.simpleString()

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        x, ids = _vectors(b), b["id"].to_numpy()
        near = x @ x.T
        near[ids[:, None] == ids[None, :]] = -np.inf
        count.add(len(ids) * (len(ids) - 1) // 2)
        k = min(pool, len(ids) - 1)
        at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), dtype=int)
        i, j = np.repeat(np.arange(len(ids)), at.shape[1]), at.reshape(-1)
        fine = np.isfinite(near[i, j])
        i, j = i[fine], j[fine]
        return pd.DataFrame({"src": ids[i], "dst": ids[j], "w": _weights(x, i, j)})

    return dealt.groupBy("tree", "leaf", "part").applyInPandas(compare, f"src {kind}, dst {kind}, w double")


def _listed(edges: DataFrame, pool: int, k: int, n: int) -> DataFrame:
    """(src, dst, w, fresh, new, at, floor, kth, place) from edges (src, dst, w, fresh, new): the best `pool` of each src. An edge that was there before is
    neither fresh nor new. at: its place; floor: what an edge must be over to get onto the list; kth: the weight in place k; place: in which it is drawn in
    round n among fresh ones or the others. All is by src, so edges are exchanged once."""
    once = edges.repartition("src").groupBy("src", "dst").agg(F.max("w").alias("w"), F.bool_and("fresh").alias("fresh"), F.bool_and("new").alias("new"))
    best = once.withColumn("at", F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("at") <= pool)
    own = W.partitionBy("src")
    floor, kth = F.when(F.count("*").over(own) >= pool, F.min("w").over(own)).otherwise(-2.0), F.max(F.when(F.col("at") == k, F.col("w"))).over(own)
    drawn = F.row_number().over(W.partitionBy("src", "fresh").orderBy(F.xxhash64("src", "dst", F.lit(n))))
    return best.withColumns({"floor": floor, "kth": kth}).withColumn("place", drawn)


def _exact(lists: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of each list by the vectors themselves. Sums over bytes are off by no more than `most`, so an edge that is further below the one in
    place k than twice that is not among them."""
    off, norm = rows.agg(F.max("off"), F.max("norm")).first()
    most = off * norm + (norm + off) * off + 1e-9
    may = lists.where((F.col("kth").isNull() | (F.col("w") >= F.col("kth") - 2 * most)) & (F.col("w") >= least - most)).select("src", "dst")
    there = may.join(rows.select(F.col("id").alias("dst"), F.col("unit").alias("_there")), "dst")
    both = there.join(rows.select(F.col("id").alias("src"), F.col("unit").alias("_here")), "src")
    found = both.select("src", "dst", vectors.dot(F.col("_here"), F.col("_there")).alias("w")).where(F.col("w") >= least)
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).select("src", "dst", "w")


def graph(
    units: DataFrame, k: int = 10, least: float = -1.0, pool: int = 30, trees: int = 4, leaf: int = 256, sample: int = 12, rounds: int = 12,
    stop: float = 0.001, group_rows: int = 16_384, seed: int = 5, id_col: str = "id",
) -> Graph:
    """The k near neighbours that were found for each point of units (id, unit: a vector of length 1), at a cosine of at least `least`; equal ones by id.

    A list holds `pool` neighbours while it is improved; `sample` of each kind (new or not, listed or listing) are brought together at a node. Ends when a
    round changes no more than `stop` of all places on lists, or after `rounds`. Points whose vector is null or zero have no edges; ids are
    distinct. Vectors of several lengths are an error, as in the exact graph. An empty table gives no edges.
    """
    spark, kind = units.sparkSession, units.schema[id_col].dataType.simpleString()
    coded = units.where(F.exists("unit", lambda x: x != 0)).select(F.col(id_col).alias("id"), "unit", _bytes("unit").alias("_coded"))
    rows = keep(coded.select("id", "unit", "_coded.*"))
    points, compared = rows.count(), spark.sparkContext.accumulator(0)
    if rows.agg(F.count_distinct(F.size("unit"))).first()[0] > 1:
        raise ValueError("vectors of different lengths")
    first = _leaves(rows, max(1, points), pool, trees, leaf, seed, compared)
    lists, n = keep(_listed(first.withColumns({"fresh": F.lit(True), "new": F.lit(True)}), pool, k, 1)), 0

    def join(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node", kind="stable")
        x, ids = _vectors(b), b["member"].to_numpy()
        fresh, floor, node = b["fresh"].to_numpy(), b["floor"].to_numpy(), b["node"].to_numpy()
        edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        left, right, pairs = [], [], 0
        for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            near = x[a:e] @ x[a:e].T
            meet = (fresh[a:e, None] | fresh[None, a:e]) & (ids[a:e, None] != ids[None, a:e])
            pairs += int(meet.sum()) // 2
            i, j = np.nonzero(meet & (near > floor[a:e, None] - 1e-9))
            left.append(i + a)
            right.append(j + a)
        compared.add(pairs)
        i, j = np.concatenate(left), np.concatenate(right)
        return _best(ids[i], ids[j], _weights(x, i, j), pool)

    while n < rounds:
        n += 1
        listing = lists.where(F.col("place") <= sample).select(F.col("src").alias("node"), F.col("dst").alias("member"), "fresh")
        back = F.row_number().over(W.partitionBy("dst", "fresh").orderBy(F.xxhash64("dst", "src", F.lit(n))))
        listed = lists.select("src", "dst", "fresh").repartition("dst").withColumn("back", back).where(F.col("back") <= sample)
        # a member of both kinds is one member; where none is fresh no pair meets
        all_ = listing.unionByName(listed.select(F.col("dst").alias("node"), F.col("src").alias("member"), "fresh")).repartition("node")
        members = all_.groupBy("node", "member").agg(F.bool_or("fresh").alias("fresh"))
        members = members.withColumn("any", F.bool_or("fresh").over(W.partitionBy("node"))).where("any").drop("any")
        floors = lists.where("at = 1").select(F.col("src").alias("id"), "floor")
        held = rows.select("id", "code", "scale").join(floors, "id", "left").select(F.col("id").alias("member"), "code", "scale", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        groups = max(1, math.ceil(points * 4 * sample / group_rows))
        met = members.join(held, "member").withColumn("group", F.expr(f"pmod(xxhash64(node), {groups})"))
        found = met.groupBy("group").applyInPandas(join, f"src {kind}, dst {kind}, w double")
        old = lists.select("src", "dst", "w", (F.col("fresh") & (F.col("place") > sample)).alias("fresh"), F.lit(False).alias("new"))
        # lists only get better, so an edge that the other side didn't take when it was new is none that it takes later
        turned = lists.where("new").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        better = keep(_listed(old.unionByName(found.unionByName(turned).withColumns({"fresh": F.lit(True), "new": F.lit(True)})), pool, k, n + 1))
        changed = better.where("new").count()
        drop(lists)
        lists = better
        if changed <= stop * pool * points:
            break
    return Graph(_exact(lists, rows, k, least) if points else lists.select("src", "dst", "w"), compared.value, n, points)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (edges, found, recall): the share of exact edges (src, dst) that were found; 1 without any."""
    both = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return both.agg(F.count("*").alias("edges"), F.count("hit").alias("found")).withColumn("recall", F.when(F.col("edges") > 0, F.col("found") / F.col("edges")).otherwise(1.0))
