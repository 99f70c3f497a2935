"""Toxicity: a classifier that is regularised by counterfactuals.

A labelled text that names a group is paired with copies in which the identity term is swapped for others
of its list. The loss penalises any change of the score between a text and its copies, so the terms
themselves earn no weight and a neutral mention of a group is not taken for an insult.

Labels may hold few such texts, or none. A bounded number of labelled texts without a term therefore become carriers:
each also stands in the training with a term put into it, under its own label, and is paired like the others. What
terms chance to stand with which label would earn them weights; the penalty takes these away.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textmodel
from .common import fresh, share
from .textmodel import Linear

#: Lists of terms that may stand for each other; each has a neutral word.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("person", "woman", "man", "girl", "boy", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics", "musulmanes", "cristianos", "judíos", "musulmans", "chrétiens", "juifs", "muslime", "christen", "juden"),
    ("person", "muslim", "christian", "jewish", "jew", "hindu", "buddhist", "atheist", "sikh", "catholic"),
    ("human", "gay", "straight", "lesbian", "bisexual", "transgender", "trans", "queer", "heterosexual", "homosexual"),
    ("human", "black", "white", "asian", "latino", "latina", "hispanic", "african", "european", "arab", "mexican", "chinese", "indian"),
    ("people", "immigrants", "refugees", "foreigners", "migrants", "inmigrantes", "refugiados", "immigrés", "réfugiés", "einwanderer", "flüchtlinge"),
    ("people", "disabled", "blind", "deaf", "elderly", "old", "young"),
)
_PLACE = {t: (g, k) for g, terms in enumerate(IDENTITY_TERMS) for k, t in enumerate(terms) if k}
_FLAT = [t for terms in IDENTITY_TERMS for t in terms]
_NUMBER = {}
for _k, _t in enumerate(_FLAT):
    _NUMBER.setdefault(_t, _k)


def terms_of(text: str | None) -> list[int]:
    """Numbers of the identity terms in a text."""
    words = set(textmodel._WORDS.findall((text or "").lower()))
    return sorted(_NUMBER[w] for w in words if w in _PLACE)


def counterfactuals(bins: set[int], terms: list[int]) -> list[tuple[set[int], set[int]]]:
    """(bins that the text alone has, bins that its copy alone has) for each of its identity terms and each other of the term's list."""
    out = []
    for k in terms:
        group, _ = _PLACE[_FLAT[k]]
        own = textmodel.word_features(_FLAT[k])
        for t in IDENTITY_TERMS[group]:
            if t != _FLAT[k]:
                other = textmodel.word_features(t)
                out.append(((bins & own) - other, other - bins))
    return out


def carriers(y: np.ndarray, bins: list[np.ndarray], terms: list[list[int]], most: int) -> list[tuple[int, int]]:
    """(row, number of the term to put into it): at most `most` rows without a term, as many of either label as there
    are, by a hash of their bins."""
    named = [_NUMBER[t] for t in _PLACE]
    out: list[tuple[int, int]] = []
    for label in (1.0, 0.0):
        free = sorted((crc32(bins[k].tobytes()), k) for k in range(len(y)) if y[k] == label and not terms[k])
        out += [(k, named[(h >> 7) % len(named)]) for h, k in free[: most - len(out) if label == 0 else most // 2]]
    return out


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, invariance: float = 1.0, most_carriers: int = 2000, carried: float = 0.1, balance: float = 0.75) -> Linear:
    """A classifier of label_col, learned from at most max_rows labelled rows and most_carriers copies of them with a term
    put in (the documented bounds of the sample), each of which weighs `carried` of a row. The rarer label weighs more, by `balance`, as
    textmodel.fit says. Contradicting labels of a row are two rows."""
    sample = textmodel.labelled_sample(df, labels, id_col, label_col, text_col, max_rows)
    y, bins, terms = textmodel.collect_features(sample, textmodel.word_features, terms_of)
    new = carriers(y, bins, terms, most_carriers)
    put = [sorted(set(bins[k].tolist()) | textmodel.word_features(_FLAT[t])) for k, t in new]
    weight = np.r_[np.ones(len(y)), np.full(len(new), carried)]
    y = np.r_[y, [y[k] for k, _ in new]]
    bins, terms = [*bins, *(np.array(b, dtype=np.int32) for b in put)], [*terms, *([t] for _, t in new)]
    pairs = [p for b, t in zip(bins, terms, strict=True) if t for p in counterfactuals(set(b.tolist()), t)]
    always = {b for t in _FLAT for b in textmodel.word_features(t)} if pairs else set()
    return textmodel.fit(y, bins, pairs, invariance, always=always, balance=balance, weight=weight)


def predict(df: DataFrame, model: Linear, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5).

    A null text scores as an empty one: by the classifier's bias alone. Whole texts are scored, repeated rows alike. Columns of df by
    these names are an error.
    """
    fresh(df, "score", "predicted")
    held = share(df.sparkSession, model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([held().score(textmodel.word_features(t)) for t in texts], dtype=float)

    return df.withColumn("score", of(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
