"""SimHash near-duplicates: 64-bit fingerprints and a tiled exact comparison.

Fingerprints are compared in tiles by exclusive-or and bit counts. A tile holds fingerprints with the
same population counts of each of their parts (runs of bits). Changing one bit changes one of the
counts by one, so two tiles whose counts differ in sum by more than the radius hold no link and are
never paired: no link is lost. There are more parts the more fingerprints there are, so that a tile keeps about as many and the share of
tiles that are paired falls as their number grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, forget, materialise, small_batches, tidy, unused

#: Shingles whose bits are counted at a time; comparisons of a task; the base in which a cell's counts are digits, more than twice a count and the radius.
_BLOCK, _WORK, _DIGIT = 65_536, 1 << 32, 101


def shingle_hashes(data: bytes | None, words: int, seed: int = 42) -> Iterator[int]:
    """XXH64 of each run of so many words of a UTF-8 text, in lower-case ASCII; a shorter text is one run, one without words has none."""
    import xxhash

    w = data.lower().split() if data else []
    runs = ([b" ".join(w)] if w else []) if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return map(xxhash.xxh64_intdigest, runs, repeat(seed))


def fingerprint(data: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 for null and for a text without words."""
    hashes = shingle_hashes(data, words, seed)
    return of_hashes(np.fromiter(islice(hashes, _BLOCK), dtype=np.uint64) for _ in repeat(None))


def of_hashes(blocks: Iterable[np.ndarray]) -> int:
    """The unsigned fingerprint of hashes that come in blocks, until an empty one."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for block in blocks:
        if not len(block):
            break
        n += len(block)
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text, words: int = 3, seed: int = 42):
    """The signed 64-bit fingerprint of a string column."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(x, words, seed) for x in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(found.view(np.int64))

    return of(text.cast("binary"))


def _roots(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> None:
    """Lowers the labels of linked positions to the smallest of their group, in place."""
    while True:
        low = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, was, label)
        label[:] = label[label]
        if (label == was).all():
            return


def tile_links(fp_a: np.ndarray, id_a: np.ndarray, fp_b: np.ndarray | None, id_b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one (fp_b None): fewer edges than
    fingerprints, however many pairs link."""
    ids = id_a if fp_b is None else np.concatenate([id_a, id_b])
    fps = fp_a if fp_b is None else np.concatenate([fp_a, fp_b])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    label = np.arange(len(ids))
    first = 0 if fp_b is None else len(id_a)
    right = fps[first:]
    rows = max(1, 262_144 // max(1, len(right)))
    for s in range(0, len(id_a), rows):
        start = s if fp_b is None else 0
        near = np.bitwise_count(fp_a[s : s + rows, None] ^ right[None, start:]) <= radius
        i, j = np.nonzero(near)
        i, j = i + s, j + start + first
        keep = i != j
        if keep.any():
            _roots(place[i[keep]], place[j[keep]], label)
    child = np.flatnonzero(label != np.arange(len(ids)))
    ids = ids[order]
    return ids[child], ids[label[child]]


def parts_for(prints: int, fill: int = 2048) -> int:
    """How many parts of 64 bits: as many as leave about `fill` of so many evenly spread fingerprints in a cell, at least 2 and at most 8."""
    parts = 2
    # two counts of n fair bits are equal with a probability of about 1 / sqrt(pi * n)
    while parts < 8 and prints * (math.pi * 64 / (parts + 1)) ** (-(parts + 1) / 2) >= fill:
        parts += 1
    return parts


def _cell(fp: str, parts: int) -> Column:
    """The population counts of the parts as digits of one number."""
    bits = [64 * k // parts for k in range(parts + 1)]
    return sum((F.expr(f"bit_count(shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1 if b - a < 64 else -1}L)") * F.lit(_DIGIT**k) for k, (a, b) in enumerate(zip(bits[:-1], bits[1:], strict=True))), F.lit(0).cast("long"))


def _steps(parts: int, radius: int) -> list[int]:
    """What leads from a cell to those after it whose counts differ by no more than radius in sum, and to itself."""
    found = {(0, 0)}  # (step, how far)
    for k in range(parts):
        found = {(s + d * _DIGIT**k, far + abs(d)) for s, far in found for d in range(far - radius, radius - far + 1)}
    return sorted(s for s, _ in found if s >= 0)


def links(prints: DataFrame, radius: int = 3, tile: int = 16_384, parts: int | None = None) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs of prints (fp long, id long; fp
    distinct) at Hamming distance of at most radius."""
    parts = parts_for(prints.count()) if parts is None else parts
    prints = prints.select("fp", "id", _cell("fp", parts).alias("cell"))
    cells = materialise(prints.groupBy("cell").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / tile).cast("int")))
    tiles = materialise(
        prints.join(cells, "cell")
        .withColumn("chunk", F.expr("cast(pmod(xxhash64(fp, 7L), chunks) as int)"))
        .groupBy("cell", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("id", "fp"))).alias("rows"))  # about `tile` rows
        .select("cell", "chunk", F.col("rows.id").alias("ids"), F.col("rows.fp").alias("fps"))
    )
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    held = (F.col("n") / F.col("chunks")).alias("held")
    there = cells.select(F.col("cell").alias("cell2"), chunk.alias("chunk2"), held.alias("held2"))
    pairs = materialise(
        cells.select("cell", F.explode(F.array(*map(F.lit, _steps(parts, radius)))).alias("step"), "chunks", held)
        .withColumn("cell2", F.col("cell") + F.col("step"))
        .join(cells.select(F.col("cell").alias("cell2")), "cell2")
        .select("cell", chunk.alias("chunk"), "cell2", "held")
        .join(there, "cell2")
        .where("cell <> cell2 or chunk <= chunk2")
    )
    work = pairs.agg(F.sum(F.col("held") * F.col("held2"))).first()[0] or 0
    other = tiles.select(F.col("cell").alias("cell2"), F.col("chunk").alias("chunk2"), F.col("ids").alias("ids2"), F.col("fps").alias("fps2"))
    both = pairs.join(tiles, ["cell", "chunk"]).join(other, ["cell2", "chunk2"])
    same = F.expr("(cell, chunk) = (cell2, chunk2)")
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / _WORK))
    both = both.repartition(n, F.xxhash64("cell", "chunk", "cell2", "chunk2")).select("ids", "fps", *(F.when(same, None).otherwise(F.col(c)).alias(c) for c in ("ids2", "fps2")))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                ids, fps, ids2, fps2 = (batch.column(c)[k] for c in range(4))
                a = [np.asarray(x.values) for x in (ids, fps)]
                b = [np.asarray(x.values) for x in (ids2, fps2)] if ids2.is_valid else [None, None]
                src, dst = tile_links(a[1].view(np.uint64), a[0], None if b[1] is None else b[1].view(np.uint64), b[0], radius)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
            tidy()

    out = materialise(both.mapInArrow(compare, "src long, dst long"))
    forget(cells, tiles, pairs)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, tile: int = 16_384) -> DataFrame:
    """(id, fingerprint long, component_id long): the class of every row under links of fingerprints.

    Rows whose fingerprints differ in at most radius bits link; component_id is the smallest id that
    links reach. Null and wordless texts have fingerprint 0 and link like any other. A null id gets the
    component of its fingerprint, null if no row there has an id. Repeated rows and ids stay, each
    with its class. Other columns of df take no part.
    """
    small_batches(df.sparkSession)
    found = materialise(df.select(F.col(id_col).cast("long").alias("id"), fingerprint_column(F.col(text_col), words).alias("fp")))
    prints = materialise(found.groupBy("fp").agg(F.min("id").alias("id")))
    near = links(prints.where("id is not null"), radius, tile)
    own = components(near)
    classes = materialise(prints.join(own, prints["id"] == own["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id")))
    forget(prints, near, own)
    return found.join(classes, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classify: Callable[..., DataFrame] = near_duplicates, **how) -> DataFrame:
    """df with one document of each class that classify finds: the one with the smallest id.

    Rows that share an id are one document, and one of them stays. Rows with a null id stay only if no
    row of their class has an id, and then one of them does.
    """
    (name,) = unused(df, "_id")
    classes = materialise(classify(df, id_col, text_col, **how).select(F.col(id_col).alias(name), "component_id"))
    own, first = F.col(id_col).cast("long").eqNullSafe(F.col(name)), F.col(name).eqNullSafe(F.col("component_id"))
    gone = classes.where(~first).select(name).distinct()
    again = classes.where(first).groupBy(name).count().where("count > 1").select(name)
    stay = df.join(gone, own, "left_anti")
    if again.isEmpty():
        return stay
    return stay.join(again, own, "left_anti").unionByName(stay.join(again, own, "left_semi").dropDuplicates([id_col]))


def hexadecimal(col):
    """16 lower-case hexadecimal digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
