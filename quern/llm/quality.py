"""Quality classifier with hierarchical empirical Bayes.

A linear classifier gives evidence on each document. Its evidence on a site's other documents makes the
site's posterior, which is shrunk toward the global rate; a path's posterior is shrunk toward its
site's. How strongly comes from the data: the spread of sites (and of paths within sites) beyond what chance
gives, by the method of moments. A document's score adds the log odds of its own evidence and what its
path's posterior adds to the global rate.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textmodel
from .common import materialise, share
from .textmodel import Linear, number

_MARKS = re.compile(r"[^\w\s]+")


def features(text: str | None) -> set[int]:
    """Bins of a text's words, of its shape, and of its runs of marks: a run of over four is the feature of its first four."""
    text = text or ""
    words, marks = text.split(), _MARKS.findall(text)
    letters = sum(map(str.isalpha, text))
    n = max(1, len(words))
    shape = {
        "length": int(np.log2(1 + len(words))),
        "marks": int(10 * min(2, len(marks) / n)),
        "letters": int(20 * letters / max(1, len(text))),
        "distinct": int(10 * len(set(words)) / n),
        "word": min(15, int(len(text) / n)),
        "lines": int(np.log2(1 + text.count("\n"))),
    }
    out = textmodel.word_features(text) | {number(f"#{k}:{v}") for k, v in shape.items()}
    return out | {number("!" + m[:4]) for m in set(marks)}


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12_000) -> Linear:
    """A classifier of label_col, learned from at most max_rows labelled rows (the documented bound of the sample). Contradicting
    labels of a row are two rows."""
    y, bins, _ = textmodel.collect_features(textmodel.labelled_sample(df, labels, id_col, label_col, text_col, max_rows), features)
    return textmodel.fit(y, bins)


def _strength(n, ones, rate):
    """Aggregate: the prior's weight, in documents, for groups of n documents with `ones` expected good ones, whose
    parent's rate is `rate`. Spread beyond chance makes it small, none makes it large."""
    chance = F.sum(rate * (1 - rate))
    spread = F.sum(n * F.pow(ones / n - rate, 2))
    excess = (spread - chance) / F.sum(n)
    mean = F.sum(n * rate * (1 - rate)) / F.sum(n)
    return F.when(excess > mean / 1e4, F.greatest(F.lit(1.0), mean / excess - 1)).otherwise(1e4)


def score(df: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text", host_col: str = "host", path_col: str = "path") -> DataFrame:
    """(id, evidence, prior, score, keep) of each row of df.

    evidence is the classifier's probability of label 1, prior the rate of the row's path without the row itself,
    shrunk toward its host's and that toward the global rate, and score their combination; keep is score >= 0.5.
    A null host or path is one of its own; a null text is scored as an empty one; repeated rows
    count each time. An empty table gives an empty result.
    """
    held = share(df.sparkSession, model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([held().score(features(t)) for t in texts], dtype=float)

    rows = materialise(df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), of(F.col(text_col)).alias("p")))
    # sums of whole millionths do not depend on the order of addition
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("p") * 1e6).cast("long")) / 1e6).alias("ones")))
    all_ = paths.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).first()
    rate = float(np.clip(all_["ones"] / all_["n"], 1e-6, 1 - 1e-6)) if all_["n"] else 0.5
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("ones").alias("host_ones")))
    m1 = float(hosts.agg(_strength(F.col("host_n"), F.col("host_ones"), F.lit(rate)).alias("m")).first()["m"] or 1e4)
    both = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    inner = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("host_ones") + m1 * rate) / (F.col("host_n") + m1)))
    m2 = float(both.agg(_strength(F.col("n"), F.col("ones"), inner).alias("m")).first()["m"] or 1e4)
    table = materialise(both.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "ones", "host_n", "host_ones"))
    host_prior = (F.greatest(F.lit(0.0), F.col("host_ones") - F.col("p")) + m1 * rate) / (F.col("host_n") - 1 + m1)
    prior = (F.greatest(F.lit(0.0), F.col("ones") - F.col("p")) + m2 * host_prior) / (F.col("n") - 1 + m2)
    clip = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
    odds = lambda c: F.log(c / (1 - c))
    total = odds(clip(F.col("p"))) + odds(clip(F.col("prior"))) - float(np.log(rate / (1 - rate)))
    return (
        rows.join(table, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
        .withColumn("prior", prior)
        .withColumn("score", 1 / (1 + F.exp(-total)))
        .select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "prior", "score", (F.col("score") >= 0.5).alias("keep"))
    )
