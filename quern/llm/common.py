"""What several operators share: written intermediate tables, connected components, and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> None:
    """An operator's output columns must not be there already."""
    clash = sorted({n.lower() for n in names} & {c.lower() for c in df.columns})
    if clash:
        raise ValueError(f"the table has columns that this operator adds: {', '.join(clash)}")


def small_batches(spark: SparkSession, rows: int = 2000, most_bytes: int = 1 << 24) -> None:
    """From now on at most so many rows, and about so many bytes, go to a Python worker at a time: whole texts are what most operators here send, and a
    batch of them is held in the executor and in the worker at once. Smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        held = spark.conf.get(key)
        if not (held.rstrip("b").isdigit() and 0 < int(held.rstrip("b")) <= most):
            spark.conf.set(key, str(most))


def tidy() -> None:
    """In a worker: gives memory that is free back to the system, as a worker lives on beside the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, for an operator's own columns beside them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is spark.checkpoint.dir where that is set. Elsewhere a local session uses a temporary
    folder, and a cluster the warehouse, which its executors share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-"))
        return spark.sparkContext.getCheckpointDir()
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern"


def share(spark: SparkSession, value, most_bytes: int = 1 << 28) -> Callable:
    """A function that gives value on the executors: broadcast once, with its classes, and loaded once in each worker. A value of more
    than most_bytes is an error: it would be one that grows with the data."""
    data = cloudpickle.dumps(value)
    if len(data) > most_bytes:
        raise ValueError(f"{len(data)} bytes are too many to send to every executor")
    held = spark.sparkContext.broadcast(data)

    def get():
        found = getattr(held, "_loaded", None)
        if found is None:
            found = held._loaded = cloudpickle.loads(held.value)
        return found

    return get


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, its size is known to
    the planner, and an executor's loss costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes what materialise wrote for these, when nothing that is still to run reads it."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if f.rsplit("/", 1)[1].startswith("quern-"):
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(conf).delete(path, True)


def maybe_among(df: DataFrame, ids: DataFrame, id_col: str = "id", bits: int = 26) -> DataFrame:
    """The rows of df whose id may be one of ids (id long): all that are, and by chance few others while there are fewer ids than 2 ** bits.

    A bitmap of hashed ids is what is sent round: 2 ** (bits - 6) rows of two numbers at most, however many ids there are. So a join by id
    that follows need not move rows that it would drop.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << bits))
    word, bit = unused(df, "_word", "_bit")
    bitmap = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("b")).groupBy(F.expr("cast(b div 64 as int)").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias(bit))
    held = df.join(F.broadcast(bitmap), F.floor(place / 64).cast("int") == F.col(word))
    return held.where(F.expr(f"shiftrightunsigned(`{bit}`, cast(pmod(xxhash64(`{id_col}`), {1 << bits}L) % 64 as int)) & 1L") == 1).drop(word, bit)


def components(edges: DataFrame, few: int = 1024) -> DataFrame:
    """Connected components of undirected links: (src long, dst long) to (node long, root long).

    root is the smallest node that links reach; only nodes with a link are returned. Alternates
    the large-star and small-star steps (Kiveris et al., 2014): each only groups by node with
    map-side minima, and the number of links never grows. A hub's links, of which it is the smaller end, are not gathered: the minima of
    nodes with more than a hundred-thousandth of all links (200,000 such nodes at most) are sent to where links are. Each round's links are
    written to the shared folder. Empty input gives an empty result; null ends take no part. Nodes with `few` links or less are never hubs.
    """
    at = materialise(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    sign = _sign(at)
    while sign[0]:
        after = materialise(_stars(at, sign[0], few))
        new = _sign(after)
        forget(at)
        at = after
        if new == sign:
            break
        sign = new
    return at.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(at: DataFrame, count: int, few: int) -> DataFrame:
    """A large-star and a small-star step on `count` links (u, v), u > v."""
    both = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = low.where(F.col("n") > max(few, count // 100_000)).select("u", F.col("m").alias("hub"))
    marked = at.select(F.col("v").alias("u"), F.col("u").alias("v")).join(F.broadcast(hubs), "u", "left")
    near = marked.where("hub is not null").select("u", "v", F.col("hub").alias("m"))
    rest = marked.where("hub is null").join(low, "u").select("u", "v", "m")
    # a centre keeps its own links: its smallest neighbour may be larger than itself; links that come twice go at the end
    large = near.unionAll(rest).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        large.join(least, "u")
        .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.*")
        .where("u <> v")
        .distinct()
    )


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
