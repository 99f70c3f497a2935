"""Mixing sources to target weights.

Every document has a hash-random key. Within a source, documents in the order of their keys are
taken until the source's budget of words is met: whole epochs first, then a prefix of that order. The
place of the cut comes from prefix sums in two levels: totals of key ranges, then the documents of the
one range that holds the cut. So no source is gathered in one task, and documents themselves (their
texts) are never sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, unused

#: Key ranges of a source at most; a range is meant to hold RANGE_ROWS documents.
MAX_RANGES, RANGE_ROWS = 65_536, 512


def word_count(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(ids, seed: int):
    """32 hexadecimal digits that depend on the id and the seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n) with target: words of each source.

    Sources by code point, null last, weigh as weights, repeating. They share `share` times all sizes
    by weight; none gets over `most` times its own size, and the excess is shared among the others by
    weight until none is above. Sources in the order of most * size / weight reach that limit one after
    the other, so one pass over the sources (not the documents) finds the level.
    """
    level = W.orderBy("full", "place").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1) % len(weights) + 1)
    return (
        sizes.withColumn("place", order)
        .withColumn("weight", weight)
        .withColumn("full", most * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (share * F.col("total") - most * F.coalesce(F.sum("source_size").over(level), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(level), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("full") >= F.col("level"), F.col("level"))).over(everything))
        .withColumn("target", F.least(most * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), most * F.col("source_size"))))
        .select("source", "source_size", "n", "target")
    )


def _range_of(key, ranges):
    """The range of a key when its source has so many (a power of two): the key's leading bits."""
    return F.expr(f"cast(floor(cast(conv(substring({key}, 1, 4), 16, 10) as int) * {ranges} / {MAX_RANGES}) as int)")


def cuts(rows: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, epochs, cut, part) of (id, source, size, key) rows.

    cut is the (key, id, size) at which the source's budget ends, and part what each such row gives;
    smaller ones give their whole size once more than epochs, larger ones don't. cut is null where whole
    epochs meet the budget.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranges = F.least(F.lit(MAX_RANGES), F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / RANGE_ROWS)))))
    budgets = materialise(
        source_targets(sizes, **how)
        .withColumn("ranges", ranges.cast("int"))
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
        .withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    keys = budgets.where("left > 0").select(F.col("source").alias("_source"), "ranges", "left")
    dealt = rows.join(keys, F.col("source").eqNullSafe(F.col("_source"))).withColumn("range", _range_of("key", "ranges"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    held = (
        dealt.groupBy("source", "range", "left")
        .agg(F.sum("size").alias("held"))
        .withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .where("before < left and left <= before + held")
        .select(F.col("source").alias("_s"), F.col("range").alias("_r"), "before")
    )
    inside = W.partitionBy("source").orderBy("key", "id", "size").rangeBetween(W.unboundedPreceding, W.currentRow)
    alike = W.partitionBy("source", "key", "id", "size")
    cut = (
        dealt.join(held, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
        .withColumn("copies", F.count("*").over(alike))
        .withColumn("upto", F.col("before") + F.sum("size").over(inside))
        .withColumn("start", F.col("upto") - F.col("copies") * F.col("size"))
        .where("start < left and left <= upto")
        .select(F.col("source").alias("_source"), F.struct("key", "id", "size").alias("cut"), F.expr("(left - start) div copies").alias("part"))
        .distinct()
    )
    return budgets.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", "epochs", "cut", "part")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, **how) -> DataFrame:
    """df with size, source_size, target and taken: how many of its words the mix takes, repeats counted.

    A source's taken words add up to its target, rounded down (less, by fewer words than a repeated
    row has copies, if the cut falls on one). A null text has size 0; a null source is one source;
    rows that repeat, null ids included, are taken alike. An empty table gives an empty result. how: weights,
    share and most of source_targets. Reruns agree, as keys depend on ids and the seed alone. Columns of df by the names that are
    added are an error.
    """
    fresh(df, "size", "source_size", "target", "taken")
    source, epochs, cut, part = unused(df, "_source", "_epochs", "_cut", "_part")
    spelled = materialise(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    ).withColumn("key", random_key(F.col("id"), seed))
    per = materialise(cuts(spelled, **how)).select(F.col("source").alias(source), "source_size", "target", F.col("epochs").alias(epochs), F.col("cut").alias(cut), F.col("part").alias(part))
    here = F.struct(random_key(F.col(id_col).cast("long"), seed).alias("key"), F.col(id_col).cast("long").alias("id"), F.col("size").alias("size"))
    once = F.when(F.col(cut).isNull() | (here > F.col(cut)), 0).when(here < F.col(cut), F.col("size")).otherwise(F.col(part))
    return (
        df.withColumn("size", word_count(F.col(text_col)))
        .join(per, F.col(source_col).eqNullSafe(F.col(source)))
        .withColumn("taken", (F.col(epochs) * F.col("size") + once).cast("long"))
        .drop(source, epochs, cut, part)
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """df's documents as often as the mix takes them, each with its whole text.

    A document is repeated ceil(taken / size) times; those of size 0 and those not taken go. The document
    at which a source's budget ends is kept whole, so a source exceeds its budget by less than that document.
    """
    own = [c for c in df.columns if c.lower() in ("size", "source_size", "target", "taken")]
    away = dict(zip(own, unused(df, *(f"_own_{c}" for c in own)), strict=True))
    safe = df.withColumnsRenamed(away)
    ids = [away.get(c, c) for c in (id_col, source_col, text_col)]
    (again_col,) = unused(safe, "_again")
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    again = F.explode(F.array_repeat(F.lit(0), times)).alias(again_col)
    out = mix(safe, *ids, **how).select(*safe.columns, again).drop(again_col)
    return out.withColumnsRenamed({new: old for old, new in away.items()})
