"""Near-duplicates by the exact Jaccard similarity of word shingles, a wider relation than SimHash can find.

Two of 64 bits in ten differ between texts of a similarity of 0.8, so a radius of 3 bits misses most such pairs, and one that
finds them (19) pairs all tiles. Here, texts with the same set of shingles are one set. Sets that share a band of
minima (MinHash) are candidates of each other, and all that candidates reach is a group. Within a group, sets are compared
exactly in tiles of bounded size, each of which also holds the group's first set; then only sets outside the largest class that this gives
(as a rule, that of the first set) are compared with all others of the group, in pairs of tiles. So a large group of copies costs about as much as reading it once, it
spreads over tasks, and only links that join something leave a tile. A pair is compared or already in one class
if a band leads from one to the other: two sets of similarity 0.8 share a band with probability 0.9999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, forget, materialise, maybe_among, small_batches, tidy
from .simhash import _roots

#: Hashes that are permuted, and columns of a matrix that are multiplied, at a time; rows sent back at a time; hashes whose bits are counted.
_BLOCK, _COLUMNS, _ROWS, _FP_BLOCK = 512, 4096, 512, 65_536


def shingles(data: bytes | None, words: int = 5) -> np.ndarray:
    """The hashes of a text's runs of so many words, repeats included."""
    return np.fromiter(simhash.shingle_hashes(data, words), dtype=np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """A signed 64-bit key of each band: so many minima of the permuted hashes. No keys without hashes."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    by, add = np.random.default_rng(seed).integers(0, 1 << 64, (2, bands * rows), dtype=np.uint64)
    by |= np.uint64(1)
    low = np.full(bands * rows, ~np.uint64(0))
    for s in range(0, len(hashes), _BLOCK):
        low = np.minimum(low, (hashes[s : s + _BLOCK, None] * by + add).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(bands, rows))], dtype=np.uint64).view(np.int64)


def set_links(ids: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least `least`, by id."""
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = n[column] > 1
    place = np.cumsum(n > 1) - 1
    row, column = row[shared], place[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [c, c + _COLUMNS])
        block = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - c)), dtype=np.float32)
        block[row[a:b], column[a:b] - c] = 1
        both += block @ block.T
    i, j = np.nonzero(np.triu(both >= least * (sizes[:, None] + sizes - both.astype(np.float64)) - 1e-9, 1))
    label = np.arange(len(sets))
    if len(i):
        _roots(i, j, label)
    child = np.flatnonzero(label != np.arange(len(sets)))
    return ids[child], ids[label[child]]


def _arrays(values: list[np.ndarray], kind):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)]), kind))


def _sketches(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, text) to (id, sig binary, fp long, bands array<long>)."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for s in range(0, batch.num_rows, _ROWS):
                part = batch.slice(s, _ROWS)
                sigs, fps, keys = [], [], []
                for x in part.column(1):
                    all_ = shingles(x.as_py(), words)
                    once = np.unique(all_)
                    sigs.append(xxhash.xxh3_128_digest(once.tobytes()))
                    fps.append(simhash.of_hashes(all_[k : k + _FP_BLOCK] for k in range(0, len(all_), _FP_BLOCK)))
                    keys.append(band_keys(once, bands, rows))
                fp = np.array(fps, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary()), pa.array(fp), _arrays(keys, pa.int64())], names=["id", "sig", "fp", "bands"])
            tidy()

    return df.mapInArrow(of, "id long, sig binary, fp long, bands array<long>")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(id, root, text) to (id, root, hashes array<long>)."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, _ROWS):
                part = batch.slice(s, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _arrays([np.unique(shingles(x.as_py(), words)) for x in part.column(2)], pa.int64())], names=["id", "root", "hashes"])
            tidy()

    return df.mapInArrow(of, "id long, root long, hashes array<long>")


def _linked(tiles: DataFrame, least: float) -> DataFrame:
    """(src, dst): a spanning forest of the links within each row of tiles (ids, sets)."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.asarray(batch.column(0)[k].values)
                rows = [np.asarray(x.values).view(np.uint64) for x in batch.column(1)[k]]
                src, dst = set_links(ids, rows, least)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
            tidy()

    return tiles.select("ids", "sets").mapInArrow(compare, "src long, dst long")


def links(sets: DataFrame, least: float, tile: int, tile_rows: int) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs of sets (id, root, hashes) of the same root with a
    similarity of at least `least`; the root is one of its sets. A tile holds about `tile` hashes and tile_rows sets at most."""

    def chunks() -> Column:
        return F.greatest(F.ceil(F.col("w") / tile), F.ceil(F.col("n") / tile_rows)).cast("int").alias("chunks")

    def gathered(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, "chunk").agg(F.collect_list(F.struct("id", "hashes")).alias("rows")).select(*by, "chunk", F.col("rows.id").alias("ids"), F.col("rows.hashes").alias("sets"))

    measured = (F.count("*").alias("n"), F.sum(F.size("hashes")).alias("w"))
    own = F.expr("cast(pmod(xxhash64(id, 7L), chunks) as int)")
    groups = materialise(sets.groupBy("root").agg(*measured).where("n > 1").select("root", chunks()))
    # the first set of a group stands in all of its tiles
    dealt = sets.join(groups, "root").withColumn("chunk", F.explode(F.when(F.col("id") == F.col("root"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))))
    found = materialise(_linked(gathered(dealt, "root"), least))
    wide = groups.where("chunks > 1").select("root")
    if wide.isEmpty():
        forget(groups)
        return found
    wide = sets.join(wide, "root").select("id", "root", "hashes")
    # A link leads from a set to the first of its class within the tile; that of the group's first set is one class in all tiles.
    known = found.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    labelled = materialise(wide.join(known, "id", "left").withColumn("label", F.coalesce("label", "id")))
    classes = labelled.groupBy("root", "label").agg(*measured)
    first = classes.groupBy("root").agg(F.max(F.struct(F.col("w"), (-F.col("label")).alias("minus"))).alias("most"), F.count("*").alias("classes")).where("classes > 1").select("root", (-F.col("most.minus")).alias("main"))
    sided = labelled.join(first, "root").select("id", "root", "hashes", (F.col("label") == F.col("main")).alias("main"))
    sides = materialise(sided.groupBy("root", "main").agg(*measured).select("root", "main", chunks()))
    tiles = materialise(gathered(sided.join(sides, ["root", "main"]).withColumn("chunk", own), "root", "main"))
    each = sides.select("root", "main", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    other = lambda df: df.select("root", *(F.col(c).alias(c + "2") for c in df.columns if c != "root"))
    pairs = each.where("not main").join(other(each), "root").where("main2 or chunk <= chunk2")
    both = pairs.join(tiles, ["root", "main", "chunk"]).join(other(tiles), ["root", "main2", "chunk2"])
    same = F.expr("not main2 and chunk = chunk2")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n, F.xxhash64("root", "main2", "chunk", "chunk2")).select(*(F.when(same, F.col(c)).otherwise(F.concat(c, c + "2")).alias(c) for c in ("ids", "sets")))
    out = materialise(found.unionAll(_linked(both, least)))
    forget(groups, found, labelled, sides, tiles)
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int | None = None, bands: int = 30, rows: int = 6, tile: int = 65_536, tile_rows: int = 512
) -> DataFrame:
    """(id, component_id long): the class of every row under links of texts whose sets of word shingles have a
    Jaccard similarity of at least `least`, and, given a radius, of texts whose SimHash fingerprints of the same shingles, compared
    in tiles, differ in at most so many bits.

    component_id is the smallest id that links reach. Null and wordless texts are one class. A null id gets
    the component of the rows with its set, null if none there has an id. Repeated rows and ids stay,
    each with its class. Other columns take no part. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = materialise(_sketches(texts, words, bands, rows))
    prints = materialise(found.groupBy("sig", "bands").agg(F.min("id").alias("id")))
    keys = prints.where("id is not null").select("id", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head")
    groups = components(keys.join(heads, "key").where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst")))
    members = groups.select(F.col("node").alias("id"), "root").unionAll(groups.select(F.col("root").alias("id"), "root").distinct())
    sets = materialise(_sets(maybe_among(texts, members).join(members, "id").select("id", "root", "text").distinct(), words))
    held = [links(sets, least, tile, tile_rows)]
    all_links = held[0]
    if radius is not None:
        firsts = found.where("id is not null").select("fp", "sig").distinct().join(prints.where("id is not null").select("sig", "id"), "sig")
        by_print = materialise(firsts.groupBy("fp").agg(F.min("id").alias("id")))
        near = simhash.links(by_print, radius)
        alike = firsts.join(by_print.select("fp", F.col("id").alias("dst")), "fp").where("id <> dst").select(F.col("id").alias("src"), "dst")
        all_links, held = all_links.unionAll(near).unionAll(alike), [*held, by_print, near]
    own = components(all_links)
    classes = materialise(prints.join(own, prints["id"] == own["node"], "left").select("sig", F.coalesce("root", "id").alias("component_id")))
    forget(prints, groups, sets, own, *held)
    return found.join(classes, "sig").select(F.col("id").alias(id_col), "component_id")


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, **how) -> DataFrame:
    """near_duplicates under both kinds of links."""
    return near_duplicates(df, id_col, text_col, radius=radius, **how)
