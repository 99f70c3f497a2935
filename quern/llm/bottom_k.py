"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the k smallest distinct hashes of a text's shingles, ascending. The sketch of two parts together is the k smallest of both sketches, so sketches
of parts merge; two sketches estimate the resemblance and the containment of the sets of shingles they stand for, and one how many
distinct shingles there are. A sketch of fewer than k hashes is the whole set, and its figures are exact.

Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, unused

#: Hashes are numbers of so many bits.
BITS = 48
K, WORDS = 128, 5
#: Stands for a null id, so that it has a place in the order.
NO_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    """A hash of each word of a text, in lower case; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: str, words: int = WORDS) -> Column:
    """A hash of each run of so many words, from a column of words' hashes; fewer words are one shingle, none have none."""
    h = F.col(hashes)
    runs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (words - 1), F.lit(0))), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, words))), 64 - BITS))
    return F.when(F.size(h) >= words, runs).when(F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))).otherwise(F.array().cast("array<long>"))


def with_sketch(df: DataFrame, text_col: str = "text", out: str = "sketch", words: int = WORDS, k: int = K) -> DataFrame:
    """df with the sketch (array of long) of a text column. Null, empty and wordless texts have an empty one; white space and case don't count.
    A text is one row's array of hashes, however long it is. Other columns stay; `out` must not be there already."""
    fresh(df, out)
    h, s = unused(df, "_words", "_shingles")
    # each step is a column that the next one reads: none is copied into another
    each = df.withColumn(h, word_hashes(F.col(text_col))).withColumn(s, shingle_hashes(h, words))
    return each.withColumn(out, least(F.col(s), k)).drop(h, s)


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(parts: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """(keys, sketch): the sketch of each key's parts together, one for each key. Null keys are a key; a null sketch is an empty one.

    No key is gathered: hashes are made distinct in partial steps, and each task keeps a key's k least before rows move on.
    """
    each = parts.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_hash"))
    best = each.withColumn("_place", place).where(F.col("_place") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))
    # a key whose parts are all empty
    every = parts.select(*keys, F.array().cast("array<long>").alias(sketch)).distinct()
    pair = F.struct(F.size(sketch).alias("n"), F.col(sketch).alias("s"))
    return best.unionByName(every).groupBy(*keys).agg(F.max(pair)["s"].alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """What share of the shingles of either text both have, from 0 to 1; 1 for two texts without any."""
    either = merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), either)) / F.size(either))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """What share of the shingles of the first text the second one has too, from 0 to 1; 1 if the first has none."""
    whole = F.lit(1 << BITS)
    upto = F.least(F.when(F.size(a) >= k, F.try_element_at(a, F.lit(-1))).otherwise(whole), F.when(F.size(b) >= k, F.try_element_at(b, F.lit(-1))).otherwise(whole))
    seen, shared = F.size(F.filter(a, lambda x: x <= upto)), F.size(F.filter(F.array_intersect(a, b), lambda x: x <= upto))
    return F.when(F.size(a) == 0, 1.0).when(seen == 0, 0.0).otherwise(shared / seen)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """How many distinct shingles a text has: exact below k, else (k - 1) / the place of the k-th hash among all numbers."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << BITS) / (F.try_element_at(sketch, F.lit(-1)) + 1.0))


def written(sketch: Column) -> Column:
    """The sketch as text: twelve lower-case hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def _order(rows: DataFrame, part: str) -> DataFrame:
    """(id, h, to_id, to_h, n) of rows (id, h, n) in the order of their part, then id and h, all descending: each with the row before it in
    that order; before the first comes the last. Parts are few: one row of each is put in order in one task."""
    this = F.struct("id", "h", "n")
    within = W.partitionBy(part).orderBy(F.desc("id"), F.desc("h"))
    ends = rows.groupBy(part).agg(F.min(this).alias("last"))
    whole = W.orderBy(part)
    last = F.last("last").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = ends.select(part, F.coalesce(F.lag("last").over(whole), last).alias("ahead"))
    linked = rows.withColumn("before", F.lag(this).over(within)).join(F.broadcast(ends), part)  # a row for each partition
    before = F.coalesce("before", "ahead")
    return linked.select("id", "h", before["id"].alias("to_id"), before["h"].alias("to_h"), before["n"].alias("to_n"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """(id_col, n_chars, edited, sketch, next_sketch) of each row.

    The next document is the one with the next smaller id; after the last comes the first, so a table of one document has itself. edited: the text whose last
    n_chars / 2 code points, rounded down, are replaced by the first as many (or all) of the next document. Null texts are empty. Rows that share an
    id follow each other by a hash of their texts; rows with the same id and text are one document and get equal results. Null ids come last (as does the least long number, which stands for them).
    An empty table gives an empty result; other columns take no part.

    The order is found on ids alone, by ranges; then each document sends what its predecessor needs of it to where that one's kept part goes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("id", "text"))
    ranged = materialise(docs.select("id", "h", F.length("text").cast("long").alias("n")).distinct().repartitionByRange(F.desc("id"), F.desc("h")).withColumn("part", F.spark_partition_id()))
    # texts are dealt out by id once: both joins read that exchange, which has the same three columns for each
    here = docs.join(_order(ranged, "part").hint("merge"), ["id", "h"]).withColumn("copy", F.row_number().over(W.partitionBy("id", "h").orderBy("to_id")))
    sent = with_sketch(here.where("copy = 1"), "text", "next_sketch", words, k)
    sent = sent.select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), F.expr("left(text, cast(to_n div 2 as int))").alias("given"), "next_sketch")
    n = F.length("text").cast("long")
    met = with_sketch(docs.join(sent.hint("merge"), ["id", "h"]), "text", "sketch", words, k).withColumn("n_chars", n)
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), "given")
    return met.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_chars", edited.alias("edited"), "sketch", "next_sketch")
