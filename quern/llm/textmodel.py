"""A linear classifier over hashed words, fitted on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
_WORDS = re.compile(r"[^\W\d_]+")


def number(feature: str) -> int:
    return crc32(feature.encode("utf-8", "ignore")) & ((1 << BITS) - 1)


def word_features(text: str | None) -> set[int]:
    """Bins of a text's distinct words, in lower case, and of their first four letters."""
    words = set(_WORDS.findall((text or "").lower()))
    return {number(w) for w in words} | {number("^" + w[:4]) for w in words if len(w) > 4}


@dataclass
class Linear:
    """Bins without a weight count nothing. pairs: how many counterfactual pairs training had, of texts and their copies, and
    gap: the root of the mean squared difference of their scores (before the logistic function)."""

    bias: float
    weights: dict[int, float]
    pairs: int = 0
    gap: float = 0.0

    def score(self, features: set[int]) -> float:
        get = self.weights.get
        z = self.bias + sum(get(k, 0.0) for k in features)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(y int, text) of rows of df that have a label, at most max_rows labels, by the order of a hash of their id.

    The bound makes the labels safe to send to all executors. Null ids, labels and labels other than 0 and 1
    take no part. A row counts once for each of its labels, so contradicting labels are two rows; so do rows that share an id.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "y").limit(max_rows)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("y", "text")


def collect_features(sample: DataFrame, features: Callable[[str | None], set[int]], terms: Callable[[str | None], list[int]] | None = None) -> tuple[np.ndarray, list[np.ndarray], list[list[int]]]:
    """Labels, bins and identity terms of the sample: at most a row's distinct bins for each of its rows."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "y": b["y"], "bins": [np.array(sorted(features(t)), dtype=np.int32) for t in b["text"]],
                "terms": [np.array(terms(t) if terms else [], dtype=np.int32) for t in b["text"]],
            })

    # Arrow keeps the bins as plain numbers; rows of Python objects would take ten times the driver's memory
    rows = sample.mapInPandas(of, "y int, bins array<int>, terms array<int>").toArrow()
    y = rows["y"].to_numpy().astype(float)
    bins, found = _lists(rows["bins"]), _lists(rows["terms"])
    order = sorted(range(len(y)), key=lambda k: (y[k], len(bins[k]), bins[k].tobytes()))
    return y[order], [bins[k] for k in order], [found[k].tolist() for k in order]


def _lists(column) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


class Loss:
    """Mean logistic loss of labelled rows, each by its weight, plus l2 / 2 times the sum of squared weights, plus invariance times the mean squared difference of
    the scores (before the logistic function) of counterfactual pairs. The bias is the last weight.

    A row is the places of its weights. A pair is the places that only the text has, and those that only its copy has.
    """

    def __init__(self, y: np.ndarray, rows: list[np.ndarray], n_weights: int, pairs: list[tuple[list[int], list[int]]], invariance: float, l2: float, weight: np.ndarray | None = None) -> None:
        self.share = np.full(len(y), 1 / len(y)) if weight is None else weight / weight.sum()
        self.y, self.n, self.invariance, self.l2, self.n_pairs = y, n_weights, invariance, l2, len(pairs)
        self.col, self.row = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.repeat(np.arange(len(y)), [len(r) for r in rows])
        flat = [(k, place, sign) for k, both in enumerate(pairs) for sign, places in zip((1.0, -1.0), both, strict=True) for place in places]
        self.pair, self.place = (np.array([f[k] for f in flat], dtype=np.int64) for k in (0, 1))
        self.sign = np.array([f[2] for f in flat], dtype=float)

    def gaps(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair, weights=self.sign * w[self.place], minlength=self.n_pairs)

    def value(self, w: np.ndarray) -> float:
        s = self._scores(w)
        far = float((self.gaps(w) ** 2).mean()) if self.n_pairs else 0.0
        return float(((np.logaddexp(0, s) - self.y * s) * self.share).sum()) + self.l2 / 2 * float((w[:-1] ** 2).sum()) + self.invariance * far

    def _scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=len(self.y)) + w[-1]

    def gradient(self, w: np.ndarray) -> np.ndarray:
        g = (1 / (1 + np.exp(-np.clip(self._scores(w), -500, 500))) - self.y) * self.share
        out = np.r_[np.bincount(self.col, weights=g[self.row], minlength=self.n) + self.l2 * w[:-1], g.sum()]
        if self.n_pairs:
            out[:-1] += 2 * self.invariance / self.n_pairs * np.bincount(self.place, weights=self.sign * self.gaps(w)[self.pair], minlength=self.n)
        return out


def fit(y: np.ndarray, bins: list[np.ndarray], pairs: list[tuple[set[int], set[int]]] = (), invariance: float = 0.0, keep: int = 4096, least_rows: int = 4, always: set[int] = frozenset(), l2: float = 3e-5, steps: int = 400, balance: float = 0.0, weight: np.ndarray | None = None) -> Linear:
    """Logistic regression on the `keep` bins that tell the labels apart best, and on those of always.

    pairs: (bins that only a text has, bins that only its counterfactual has); invariance is the weight of the mean squared difference of
    their scores in the loss. weight: of each row, of which those of less than 1 have no say in which bins are chosen; balance: from 0, labels weigh as their rows do, to 1, both weigh alike. Without rows, or with one label only, the
    classifier gives all texts the smoothed rate of label 1.
    """
    n, ones = len(y), float(y.sum())
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if n == 0 or ones in (0, n):
        return Linear(bias, {}, len(pairs))
    weight = np.ones(n) if weight is None else weight
    own = np.flatnonzero(weight >= 1)  # bins are chosen by whole rows
    n, ones = len(own), float(y[own].sum())
    flat, label = np.concatenate([bins[k] for k in own]), np.repeat(y[own], [len(bins[k]) for k in own])
    all_, pos = np.bincount(flat, minlength=1 << BITS), np.bincount(flat, weights=label, minlength=1 << BITS)
    neg = all_ - pos
    odds = np.log((pos + 0.5) / (ones - pos + 0.5)) - np.log((neg + 0.5) / (n - ones - neg + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) + 1 / (ones - pos + 0.5) + 1 / (n - ones - neg + 0.5))
    z[all_ < least_rows] = 0
    best = np.argsort(-z, kind="stable")[:keep]
    chosen = np.array(sorted(set(best[z[best] > 2].tolist()) | set(always)), dtype=np.int64)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    weighed = lambda b: place[b][place[b] >= 0]
    weight = weight * np.where(y == 1, n / ones, n / (n - ones)) ** balance
    loss = Loss(y, [weighed(b) for b in bins], len(chosen), [tuple([int(place[b]) for b in side if place[b] >= 0] for side in pair) for pair in pairs], invariance, l2, weight)
    w = np.zeros(len(chosen) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = loss.gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    gap = float(np.sqrt((loss.gaps(w) ** 2).mean())) if pairs else 0.0
    return Linear(float(w[-1]), {int(k): float(x) for k, x in zip(chosen, w[:-1], strict=True) if x}, len(pairs), gap)
