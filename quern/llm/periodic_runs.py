"""Periodic runs of words, by comparing a text with itself at every lag.

A run is a stretch of words with smallest period q, at least min_exp times as long as q and min_length words long, that no
neighbouring word extends. A text's word ids are compared with themselves shifted by each lag up to n / min_exp; true stretches of
a lag are its periodic stretches. A stretch whose smallest period is another one is found, with the same ends, at that smaller lag
too (Fine and Wilf, 1965), so of equal stretches the smallest lag is kept.

Lags are compared by blocks, in two steps. A run of lag p has at least (min_exp - 1) * p true places in a row, so three true ones in a row
among every s-th place, for s = (min_exp - 1) * p / 3 rounded down. The first step compares those places for all lags of a block at once; the
second compares all places for the lags that have three such places. No run is lost, and ordinary text costs n log n.

Texts of more than `long_words` words, as their bytes bound them, are not scanned in one task: their lags are dealt out in ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, unused

#: Elements of a comparison at a time.
_BLOCK = 1 << 20
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    held: dict[bytes, int] = {}
    return np.fromiter((held.setdefault(w, len(held)) for w in words), dtype=np.int32, count=len(words))


def last_lag(n: int, min_exp: int) -> int:
    return n // min_exp


def candidates(padded: np.ndarray, n: int, lo: int, hi: int, step: int) -> np.ndarray:
    """The lags from lo to hi - 1 that have three true places in a row among every step-th of n; padded: the ids with hi numbers of no word after them."""
    rows = -(-n // step)
    shifted = np.lib.stride_tricks.sliding_window_view(padded[lo:], hi - lo)[:n:step]
    same = shifted == padded[:n:step, None][: len(shifted)]
    if rows < 3:
        return np.arange(0)
    return lo + np.flatnonzero((same[:-2] & same[1:-1] & same[2:]).any(axis=0))


def stretches(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least so many places that equal the place a lag further on."""
    same = np.zeros(len(ids) - lag + 2, dtype=np.int8)
    same[1:-1] = ids[:-lag] == ids[lag:]
    change = np.diff(same)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = end - start >= least
    return start[long], end[long]


def lag_runs(ids: np.ndarray, lo: int, hi: int, min_exp: int = 4, min_length: int = 6) -> np.ndarray:
    """Rows (start, length, lag) of the stretches of lags lo to hi - 1 that are long enough for a run; those of multiples of a run's period too."""
    n, found = len(ids), []
    hi = min(hi, last_lag(n, min_exp) + 1)
    while lo < hi:
        step = max(1, (min_exp - 1) * lo // 3)
        to = min(hi, 2 * lo, lo + max(1, _BLOCK // -(-n // step)))
        padded = np.concatenate([ids, np.full(to, -1, dtype=ids.dtype)])
        for lag in candidates(padded, n, lo, to, step).tolist() if (min_exp - 1) * lo >= 3 else range(lo, to):
            start, end = stretches(ids, lag, max(min_length - lag, (min_exp - 1) * lag))
            if len(start):
                found.append(np.stack([start, end - start + lag, np.full(len(start), lag)], axis=1))
        lo = to
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def primitive(found: np.ndarray) -> np.ndarray:
    """Of stretches with the same ends the one with the smallest period; in the order of start, then period."""
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run has after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0)])


ARROW_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).cast(pa.string())


def _records(runs: np.ndarray) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]


def ranges(n: int, min_exp: int, lags: int, most: int) -> list[tuple[int, int]]:
    """The lags of a text of n words in ranges of at least `lags`, at most `most` ranges."""
    last = last_lag(n, min_exp)
    width = max(lags, -(-last // most))
    return [(a, min(a + width, last + 1)) for a in range(1, last + 1, width)]


def collapse(df: DataFrame, text_col: str = "text", min_exp: int = 4, min_length: int = 6, long_words: int = 8192, lags: int = 2048, most_ranges: int = 64) -> DataFrame:
    """df with runs (array of start, length and period, by start, then period) and collapsed, the text without repetitions.

    Words are runs of anything but ASCII white space; they are numbered from 0 and compared byte by byte. collapsed joins the words that no run has
    after its first period by single spaces. min_exp: 2 at least. Null and empty texts have no runs and an empty collapsed text. Equal
    texts get equal results, also rows that are repeated; other columns stay as they are, and only `runs` and `collapsed` must not
    be there already. An empty table gives an empty result. A text that may have more than long_words words is searched by ranges of at
    least `lags` lags, in at most most_ranges tasks; it is gathered whole only where its collapsed text is made.
    """
    if min_exp < 2:
        raise ValueError("min_exp must be 2 at least")
    fresh(df, "runs", "collapsed")
    key, gathered = unused(df, "_key", "_runs")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed_runs, out = [], []
            for data in b.column(text_col).cast(pa.binary()).to_pylist():
                words = data.split() if data else []
                runs = primitive(lag_runs(word_ids(words), 1, len(words) + 1, min_exp, min_length))
                listed_runs.append(_records(runs))
                out.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(listed_runs, ARROW_RUNS), _strings(out)], [*b.schema.names, "runs", "collapsed"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b[key], b["data"], strict=True):
                ids = word_ids(data.split())
                for lo, hi in ranges(len(ids), min_exp, lags, most_ranges):
                    yield pd.DataFrame({key: [k], "lo": [lo], "hi": [hi], "ids": [ids.tobytes()]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, lo, hi, ids in zip(b[key], b["lo"], b["hi"], b["ids"], strict=True):
                found = lag_runs(np.frombuffer(ids, dtype=np.int32), lo, hi, min_exp, min_length)
                yield pd.DataFrame({key: k, "start": found[:, 0], "length": found[:, 1], "period": found[:, 2]})

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, runs in zip(b.column(text_col).cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                out.append(collapsed(data.split(), np.array([(r["start"], r["length"], r["period"]) for r in runs], dtype=np.int64).reshape(-1, 3)))
            yield pa.RecordBatch.from_arrays([*b.columns, _strings(out)], [*b.schema.names, "collapsed"])

    # n words have at least 2 n - 1 bytes
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    with_runs = T.StructType([*df.schema.fields, T.StructField("runs", T.ArrayType(RUN))])
    with_both = T.StructType([*with_runs.fields, T.StructField("collapsed", T.StringType())])
    short = df.where(size < 2 * long_words).mapInArrow(whole, with_both)

    long = df.where(size >= 2 * long_words).withColumn(key, F.sha2(text_col, 256))
    texts = long.select(key, F.col(text_col).cast("binary").alias("data")).dropDuplicates([key])
    dealt = texts.mapInPandas(pieces, f"{key} string, lo long, hi long, ids binary").repartition(key, "lo")
    found = dealt.mapInPandas(scan, f"{key} string, start long, length long, period long")
    smallest = found.groupBy(key, "start", "length").agg(F.min("period").alias("period"))
    # a text's runs are fewer than its words
    runs = smallest.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias(gathered))
    runs = runs.select(key, F.transform(gathered, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    joined = long.join(runs, key, "left").withColumn("runs", F.coalesce("runs", F.array().cast(T.ArrayType(RUN))))
    return short.unionByName(joined.select(*df.columns, "runs").mapInArrow(kept, with_both))


def longest(runs):
    """The run with the greatest length of an array of them; of equal ones the first, then the one with the smallest period; null without any."""
    least = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(least.isNotNull(), F.struct(least["start"].alias("start"), (-least["size"]).alias("length"), least["period"].alias("period")))


def listed(runs):
    """Runs as text: start, length and period of each on a line."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def planted(text, doc_id):
    """The text with repetitions put in, for every tenth document by a hash of its id: from a word a on, the p words from there repeat to the end.

    Columns (text string, doc_id long) to a column. With h = crc32(doc_id as text) and g = floor(h / 10): a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    # one array, so that the words are found once
    def repeated(own):
        n, g = F.size(own).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(own, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    chosen = F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, repeated(own)).otherwise(text))
    return F.when(h % 10 == 0, F.get(chosen, F.lit(0))).otherwise(text)
