"""Ranked lexical search: postings in shards, merged document at a time.

A shard holds the documents of a stretch of the table, up to a number of terms: for each term the documents that hold it, in the order of their ids, as
differences, and how often, both as bytes of seven bits. Shards are made where the texts are read; no text is shuffled.

A search takes each shard's postings of the terms that a block of items asks for to one task. There a heap of cursors, keyed by the
next document of each, merges an item's postings in the order of documents: the documents up to `span` after the least one are completed, then the next.
Completed documents go through a heap of k results keyed by score, then document. The shards' results are merged by item.

Scores are integers but for one floor of a logarithm, so they don't depend on the order of addition or on the shards.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: A term: a run of ASCII letters and digits and of any other characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What becomes of each byte of a text in UTF-8: a space, but for bytes of terms.
_FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
INDEX = "shard long, term string, df long, terms long, postings binary, ids binary"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("terms", pa.int64()), ("postings", pa.binary()), ("ids", pa.binary())])


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLDED).split()


def term_column(text: Column) -> Column:
    """The terms of a string column, repeats included."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of seven bits a byte, the lowest first, the last byte of each below 128; and where each number ends."""
    v = values.astype(np.uint64)
    width = np.ones(len(v), dtype=np.int64)
    for bits in range(7, 64, 7):
        width += v >= np.uint64(1 << bits)
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    for k in range(int(width.max(initial=0))):
        at = np.flatnonzero(width > k)
        more = (width[at] > k + 1).astype(np.uint64) << np.uint64(7)
        out[ends[at] - width[at] + k] = (v[at] >> np.uint64(7 * k)) & np.uint64(127) | more
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    width = last - first + 1
    out = np.zeros(len(last), dtype=np.int64)
    for k in range(int(width.max(initial=0))):
        at = np.flatnonzero(width > k)
        out[at] |= (b[first[at] + k] & 127).astype(np.int64) << (7 * k)
    return out


class Shard:
    """Documents on their way into a shard."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int, data: bytes) -> None:
        own = terms_of(data)
        if own:
            self.ids.append(doc_id)
            self.found.append(np.fromiter(map(self.number.__getitem__, own), dtype=np.int64, count=len(own)))
            self.size += len(own)

    def rows(self, shard: int, batch: int = 4096) -> Iterator[pa.RecordBatch]:
        """The row of the documents, which has no term: their lengths and ids; then one for each term."""
        order = np.argsort(np.array(self.ids, dtype=np.int64), kind="stable")
        lengths = np.array([len(x) for x in self.found], dtype=np.int64)
        ids, blob = np.array(self.ids, dtype="<i8")[order], packed(lengths[order])[0].tobytes()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "term": [None], "df": [len(ids)], "terms": [self.size], "postings": [blob], "ids": [ids.tobytes()]}, _ARROW)
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        each, tf = np.unique(np.concatenate(self.found) * len(ids) + np.repeat(place, lengths), return_counts=True)
        term, doc = np.divmod(each, len(ids))
        first = np.flatnonzero(np.diff(term, prepend=-1))  # every number is there, so a term's number is its place
        df = np.diff(first, append=len(term))
        step = np.diff(doc, prepend=0)
        step[first] = doc[first]
        # a term's differences, then its counts
        at = np.arange(len(term)) + np.repeat(first, df)
        values = np.empty(2 * len(term), dtype=np.int64)
        values[at], values[at + np.repeat(df, df)] = step, tf
        out, ends = packed(values)
        edges = np.concatenate([[0], ends[2 * (first + df) - 1]]).tolist()
        words, out = list(self.number), out.tobytes()
        for s in range(0, len(words), batch):
            part = range(s, min(s + batch, len(words)))
            blobs = [out[edges[k] : edges[k + 1]] for k in part]
            names = pa.array(words[s : s + batch], pa.binary()).cast(pa.string())
            none = pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int64()), names, pa.array(df[s : s + batch]), none[0], pa.array(blobs, pa.binary()), none[1]], schema=_ARROW)


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = 1 << 20) -> DataFrame:
    """The index of all texts, in shards of at least shard_terms terms (the last one of a partition may have fewer).

    Rows with a null id take no part; null and empty texts, and those without a term, are in no shard. Rows that share an id are documents of their own.
    A text is never split, however long. Other columns are not read.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition that is read again gives the same shards under the same numbers
        number, held = TaskContext.get().partitionId() << 32, Shard()
        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.add(doc_id, data)
                if held.size >= shard_terms:
                    yield from held.rows(number)
                    number, held = number + 1, Shard()
        if held.size:
            yield from held.rows(number)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(shards, INDEX)


def best(cursors: list[tuple[np.ndarray, np.ndarray]], k: int, span: int = 1024) -> list[tuple[int, int]]:
    """(score, document) of the k documents with the highest sums, in no order; of equal ones the smaller documents.

    cursors: a term's documents, ascending, and what it adds to each. A heap keyed by the next document of each cursor merges them; `span`
    documents from the least one on are completed at a time. Ends when all that is left can add no more than the least result.
    """
    heads = [(int(docs[0]), j) for j, (docs, _) in enumerate(cursors) if len(docs)]
    heapq.heapify(heads)
    at = [0] * len(cursors)
    bound = {j: int(cursors[j][1].max()) for _, j in heads}
    left = sum(bound.values())
    results: list[tuple[int, int]] = []  # (score, -document): the first is the one to go
    while heads:
        floor = results[0][0] if len(results) == k else 0
        if left <= floor:
            break
        start = heads[0][0]
        end, sums = start + span, np.zeros(span, dtype=np.int64)
        while heads and heads[0][0] < end:
            j = heads[0][1]
            docs, adds = cursors[j]
            a, e = at[j], at[j] + int(np.searchsorted(docs[at[j] :], end))
            sums[docs[a:e] - start] += adds[a:e]  # a term has a document once
            if e < len(docs):
                at[j] = e
                heapq.heapreplace(heads, (int(docs[e]), j))
            else:
                heapq.heappop(heads)
                left -= bound[j]
        found = np.flatnonzero(sums > floor)
        if len(found) > k:
            found = found[sums[found] >= np.partition(sums[found], -k)[-k]]
        for i in found.tolist():
            one = (int(sums[i]), -(start + i))
            if len(results) < k:
                heapq.heappush(results, one)
            elif one > results[0]:
                heapq.heapreplace(results, one)
    return [(score, -doc) for score, doc in results]


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", k: int = 50, block: int = 64, span: int = 1024) -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of a written index with the highest scores above 0 for each item, equal scores by id.

    Items' texts are cut into terms like documents; a term counts once for an item. Items that share an id are one item with all their terms;
    items with a null id, and null texts, take no part. An item without a term, or an empty index, gives no rows. Documents that share an
    id may both be returned. A block of about `block` items is searched in one task for each shard, so neither the items nor the postings of a term are
    gathered whole anywhere; ids of items of a block and their terms are all that is sent beside postings.
    """
    own = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(term_column(F.col(text_col))).alias("term")).distinct()
    n_items, totals = own.agg(F.count_distinct("item")).first()[0], index.where("term is null").agg(F.sum("df"), F.sum("terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    blocks = max(1, math.ceil(n_items / block))
    kind = items.schema[item_col].dataType.simpleString()

    wanted = own.groupBy(F.expr(f"cast(pmod(xxhash64(item), {blocks}) as int)").alias("block"), "term").agg(F.collect_list("item").alias("items"))  # a block's items at most
    held = index.where("term is not null").select("shard", "term", "df", "postings")
    df = held.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weights = df.select("term", F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))
    asked = held.join(wanted.join(weights, "term"), "term").select("shard", "block", "postings", F.lit(None).cast("binary").alias("ids"), "items", "w")
    every = index.where("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "postings", "ids", F.lit(None).cast(f"array<{kind}>").alias("items"), F.lit(None).cast("long").alias("w"))

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        documents = b["ids"].notna().to_numpy()
        one = b[documents].iloc[0]
        ids, m = np.frombuffer(one["ids"], dtype="<i8"), 100 - 50 + 50 * unpacked(one["postings"]) * n_docs // n_terms
        cursors: dict = {}
        for data, names, w in zip(b["postings"][~documents], b["items"][~documents], b["w"][~documents], strict=True):
            values = unpacked(data)
            docs, tf = np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :]
            adds = int(w) * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
            for name in names:
                cursors.setdefault(name, []).append((docs, adds))
        out = [(name, int(ids[doc]), score) for name, own in cursors.items() for score, doc in best(own, k, span)]
        return pd.DataFrame(out, columns=["item", "id", "score"])

    found = asked.unionByName(every).groupBy("shard", "block").applyInPandas(merge, f"item {kind}, id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def indexed(df: DataFrame, **how) -> DataFrame:
    """`build`, written to the shared folder."""
    return materialise(build(df, **how))
