"""Clustering of documents: a graph of nearest neighbours and label propagation in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import nn_descent, propagation
from .catalog import shared_folder
from .vector_search import mean_pooled

NOISE = -1


def corpus_mean(points: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: the mean vector, in doubles; none for fewer than two points."""
    return mean_pooled(points.withColumn("_all", F.lit(1)), ["_all"], vector_col, as_float=False).where("n >= 2").select(F.col(vector_col).alias("mean"))


def unit_residuals(points: DataFrame, center: bool = True, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, unit): each vector, less the corpus mean if center is set, at length 1; a zero one stays zero."""
    if not center:
        return points.select(id_col, vectors.unit(F.col(vector_col)).alias("unit"))
    both = points.join(F.broadcast(corpus_mean(points, vector_col)), how="left")  # one row at most
    v = F.when(F.col("mean").isNull(), F.transform(vector_col, lambda x: x.cast("double"))).otherwise(vectors.minus(F.col(vector_col), F.col("mean")))
    return both.select(id_col, vectors.unit(v).alias("unit"))


def _pair_edges(x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray, k: int, least: float, same: bool, cells: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The best k of y for each row of x and, unless they are the same rows, the best k of x for each row of y; both in the order of ids.

    Products are made once for both sides, a strip of about `cells` at a time, in single precision; what these may be off is left as a margin, and what may be among the best is
    weighed in double precision. Of y's rows the best k so far are held, and what is not better than the last of these is left out.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        far = np.sqrt(max((x * x).sum(axis=1).max(), (y * y).sum(axis=1).max()))
    off = (x.shape[1] + 8) * 1.2e-7 * far * far
    if not (off < 1e-3 and np.isfinite(x32).all() and np.isfinite(y32).all()):  # vectors that are not of length 1
        x32, y32, off = x, y, 1e-9

    def exact(r: np.ndarray, j: np.ndarray) -> np.ndarray:
        # added from the first component to the last, whatever the size of the block
        w = np.zeros(len(r))
        for c in range(x.shape[1]):
            w += x[r, c] * y[j, c]
        return w

    def likely(side: np.ndarray, w: np.ndarray) -> np.ndarray:
        order = np.lexsort((-w, side))
        first = np.searchsorted(side[order], side[order])
        last = np.minimum(first + k - 1, np.searchsorted(side[order], side[order], side="right") - 1)
        return order[w[order] >= w[order][last] - 2 * off]

    def best(side: np.ndarray, other: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((other, -w, side))
        side, other, w = side[order], other[order], w[order]
        at = np.arange(len(side)) - np.searchsorted(side, side) < k
        return side[at], other[at], w[at]

    floor, held, n = np.full(len(y), least), [], 0
    step = max(1, cells // max(1, len(y)))
    for s in range(0, len(x), step):
        rough = x32[s : s + step] @ y32.T
        if same:
            rough[xi[s : s + step][:, None] == yi[None, :]] = -np.inf
        r, j = np.nonzero(rough >= least - off)
        w = rough[r, j].astype(np.float64)
        one = likely(r, w)
        a, b, v = s + r[one], j[one], exact(s + r[one], j[one])
        a, b, v = best(a[v >= least], b[v >= least], v[v >= least])
        yield pd.DataFrame({"src": xi[a], "dst": yi[b], "w": v})
        if same:
            continue
        fine = w >= floor[j] - off
        r, j, w = r[fine], j[fine], w[fine]
        one = likely(j, w)
        a, b, v = j[one], s + r[one], exact(s + r[one], j[one])
        held.append(best(a[v >= least], b[v >= least], v[v >= least]))
        n += len(held[-1][0])
        if n > 2 * k * len(y):
            held = [best(*map(np.concatenate, zip(*held, strict=True)))]
            a, _, v = held[0]
            n, last = len(a), np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k - 1)
            floor[a[last]] = v[last]
    if held:
        a, b, v = best(*map(np.concatenate, zip(*held, strict=True)))
        yield pd.DataFrame({"src": yi[a], "dst": xi[b], "w": v})


def knn_edges(units: DataFrame, k: int = 10, least: float = 0.5, block: int = 16_384, id_col: str = "id") -> DataFrame:
    """(src, dst, w): each node's k nearest others at a cosine of at least `least`, equal ones by id.

    Exact: blocks of rows (of `block` on average, less where there are fewer than 16) meet in pairs, each unordered pair in one task that multiplies two bounded matrices and
    keeps the best k of each row of either side; a second step keeps the best k of those. A row is sent once for each block, so blocks are as large as a
    task's memory has room for. Zero vectors have no edges. Vectors of different lengths are an error.
    """
    n_blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / block), F.least(F.lit(16), F.ceil(F.count("*") / min(block, 2048)))).cast("int")
    counts = units.agg(n_blocks.alias("blocks"))
    rows = units.where(F.exists("unit", lambda x: x != 0)).crossJoin(F.broadcast(counts))  # one row
    rows = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64({id_col}), blocks) as int)"))
    sides = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high"))))
    dealt = rows.select(F.col(id_col).alias("id"), "unit", "block", sides.alias("s")).select("id", "unit", "block", "s.*")
    kind = units.schema[id_col].dataType.simpleString()

    def best(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        low = (b["block"] == b["low"]).to_numpy()
        x, ids = np.stack(b["unit"].to_list()).astype(np.float64), b["id"].to_numpy()
        same = bool((b["low"] == b["high"]).iloc[0])
        if not same and (low.all() or not low.any()):
            return pd.DataFrame({"src": [], "dst": [], "w": []})
        other = low if same else ~low
        return pd.concat(list(_pair_edges(x[low], ids[low], x[other], ids[other], k, least, same)))

    found = dealt.groupBy("low", "high").applyInPandas(best, f"src {kind}, dst {kind}, w double")
    order = W.partitionBy("src").orderBy(F.desc("w"), "dst")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, with the larger weight where both were found."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def propagate(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, iters: int = 20) -> np.ndarray:
    """Labels 0 to n - 1 after label propagation in the order of nodes.

    A node takes the label with the largest sum of weights among its neighbours, the smaller one of equals, and the next
    node sees that at once; it ends when a sweep changes nothing, or after `iters` sweeps.
    """
    order = np.lexsort((dst, src))
    src, dst, w = src[order], dst[order], w[order]
    bounds = np.searchsorted(src, np.arange(n + 1))
    label = np.arange(n)
    for _ in range(iters):
        changed = False
        for i in np.flatnonzero(np.diff(bounds)):
            votes: dict[int, float] = {}
            for j in range(bounds[i], bounds[i + 1]):
                near = int(label[dst[j]])
                votes[near] = votes.get(near, 0.0) + float(w[j])
            top = max(votes.values())
            new = min(k for k, v in votes.items() if v == top)
            if new != label[i]:
                label[i], changed = new, True
        if not changed:
            break
    return label


def cluster(points: DataFrame, k: int = 10, min_similarity: float = 0.5, min_size: int = 3, max_iters: int = 20, center: bool = False, id_col: str = "id", vector_col: str = "embedding", block: int = 16_384, most_edges: int = 1 << 22, exact: bool = True) -> DataFrame:
    """(id, label) of each point; label -1 is noise.

    Neighbours are found in parallel: all of them, or, unless exact is set, most of them by descent (nn_descent). Propagation goes node by node, each
    step seeing the one before; labels never leave a connected component of the graph, so a component of at most most_edges edges is swept in a task of
    its own, and larger ones by wavefronts (propagation); the result is that of one sweep over all. Points without edges never go
    there. Clusters are numbered by size, largest first, then by their first member in the order of ids; those below min_size are noise.
    """
    units = unit_residuals(points, center, id_col, vector_col)
    near = knn_edges(units, k, min_similarity, block, id_col) if exact else nn_descent.graph(units, k, min_similarity, id_col=id_col).edges
    edges = undirected(near)
    kind = points.schema[id_col].dataType.simpleString()

    def sweep(e: pd.DataFrame) -> pd.DataFrame:
        ids = np.array(sorted(set(e["src"])))
        lab = propagate(len(ids), np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy()), e["w"].to_numpy(), max_iters)
        return pd.DataFrame({"id": ids, "root": ids[lab]})

    # Nodes keep their order among those of their component, so leaving the others out changes no label.
    placed = with_component(edges)
    large = placed.groupBy("component").count().where(F.col("count") > most_edges).select("component")
    if large.isEmpty():
        lab = placed.groupBy("component").applyInPandas(lambda e: sweep(e), f"id {kind}, root {kind}")
    else:
        small = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(lambda e: sweep(e), f"id {kind}, root {kind}")
        lab = small.unionByName(propagation.propagate(placed.join(large, "component", "left_semi").select("src", "dst", "w"), max_iters))
    groups = lab.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("first")).where(F.col("size") >= min_size)
    numbered = groups.withColumn("label", (F.row_number().over(W.orderBy(F.desc("size"), "first")) - 1).cast("int"))  # a row for each cluster
    named = lab.join(numbered.select("root", "label"), "root").select(F.col("id").alias("_id"), "label")
    return points.select(id_col).join(named, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("label", F.lit(NOISE)).alias("label"))


def with_component(edges: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, ...; both directions) with component, the smallest node that each is connected to.

    Every node takes the smallest of its own and its neighbours' components, and then that node's, until none changes: each round groups by node
    alone, and a long chain is halved by the second step. Each round is checkpointed in the folder that executors share.
    """
    shared_folder(edges.sparkSession)
    keep = lambda df: df.checkpoint()
    edges = keep(edges)
    at = keep(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = edges.select("src", F.col("dst").alias("node")).join(at, "node").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = at.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = low.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = keep(low.join(up, "component").select("node", "old", F.least("component", "up").alias("component")))
        changed = not new.where("old <> component").isEmpty()
        at = new.select("node", "component")
        if not changed:
            return edges.join(at, F.col("src") == F.col("node")).drop("node")


def summaries(points: DataFrame, labels: DataFrame, center: bool = True, id_col: str = "id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(clusters, members): (label, size, cohesion) and (label, id, similarity, rank).

    A cluster's centroid is the sum of its members' unit residuals at length 1; a member's similarity is its cosine with it, 0 at
    least, and cohesion their mean. rank goes by similarity, then id. Noise has no cluster.
    """
    units = unit_residuals(points, center, id_col, vector_col).join(labels.where(F.col("label") >= 0), id_col)
    sums = mean_pooled(units, ["label"], "unit", as_float=False)
    norm = F.sqrt(vectors.squared(F.col("unit")))
    centroids = sums.select("label", F.when(norm > 0, F.transform("unit", lambda x: x / norm)).otherwise(F.col("unit")).alias("centroid"))
    members = units.join(centroids, "label").select("label", id_col, F.greatest(F.lit(0.0), vectors.dot(F.col("unit"), F.col("centroid"))).alias("similarity"))
    members = members.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("similarity"), id_col)))
    return members.groupBy("label").agg(F.count("*").alias("size"), F.avg("similarity").alias("cohesion")), members


def term_labels(titles: DataFrame, key_cols: list[str], order_col: str = "rank", title_col: str = "title", terms: int = 4) -> DataFrame:
    """(keys, label): the most frequent terms of each group's titles, those seen first among equals, capitalised.

    Terms are counted by (key, term) with partial sums; only each group's best ones are gathered. A group without terms has none.
    """
    each = titles.select(*key_cols, order_col, F.posexplode(text.label_terms(F.col(title_col))).alias("at", "term"))
    counted = each.groupBy(*key_cols, "term").agg(F.count("*").alias("n"), F.min(F.struct(order_col, "at")).alias("first"))
    best = counted.withColumn("_k", F.row_number().over(W.partitionBy(*key_cols).orderBy(F.desc("n"), "first"))).where(F.col("_k") <= terms)
    named = F.transform(F.sort_array(F.collect_list(F.struct("_k", "term"))), lambda x: text.title_cased(x["term"]))
    return best.groupBy(*key_cols).agg(F.array_join(named, " ").alias("label"))


def label_prompt(titles: Column) -> Column:
    """What a language model is asked about a group of titles; label_answer reads its answer."""
    listed = F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat(
        F.lit("Below are titles of documents that one reader saved and that were found to be alike. Use nothing but the titles.\n\n"), listed,
        F.lit("\n\nAnswer in two lines. The first: NAME: and what they have in common, in at most four words. The second: SUMMARY: and a sentence about it."),
    )


def generated_labels(titles: DataFrame, generate: Callable[[Column], Column]) -> DataFrame:
    """(label, name, summary) of groups of titles (label, rank, title) by a language model: generate, a function from a column of prompts
    to a column of answers, such as a pandas UDF that asks a service for a batch at a time. A group whose answer names nothing is left out."""
    best = F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])  # a few titles of each group
    asked = titles.groupBy("label").agg(best.alias("titles")).select("label", generate(label_prompt(F.col("titles"))).alias("answer"))
    named = asked.select("label", label_answer(F.coalesce("answer", F.lit(""))).alias("said"))
    return named.select("label", "said.name", "said.summary").where("name <> ''")


def label_answer(answer: Column) -> Column:
    """(name, summary) of a language model's answer with NAME and SUMMARY lines.

    Without a NAME line the first line is the name. A name of over six words is none: it is the start of a sentence.
    """
    lines = F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")), r"^[#*\->•· \t]+", ""))

    def clean(x: Column) -> Column:
        x = F.trim(F.regexp_replace(F.trim(x), "^[\"'*`_]+|[\"'*`_]+$", ""))
        return F.when(F.octet_length(x) > 200, F.trim(F.substring(x, 1, 200))).otherwise(x)

    def field(name: str) -> Column:
        return F.try_element_at(F.filter(lines, lambda x: x.rlike(rf"(?i)^{name}[ \t]*[:\-=–—]")), F.lit(-1))

    def value(x: Column) -> Column:
        return clean(F.regexp_replace(x, r"(?i)^(name|summary)[ \t]*[:\-=–—]", ""))

    first = F.get(F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    name = F.coalesce(F.when(value(field("name")) != "", value(field("name"))), clean(first), F.lit(""))
    fits = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) <= 6
    return F.struct(F.when(fits, name).otherwise("").alias("name"), F.coalesce(value(field("summary")), F.lit("")).alias("summary"))
