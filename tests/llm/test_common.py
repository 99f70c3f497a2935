import random

import pytest
from pyspark.sql import functions as F

from quern.llm.common import components, forget, materialise, maybe_among, share, shared_dir


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("few", [1024, 2])
@pytest.mark.parametrize("kind", ["path", "star", "hubs", "random", "rings", "empty"])
def test_components(spark, kind, few):
    rng = random.Random(5)
    edges = {
        "path": [(k, k + 1) for k in range(40)],
        "star": [(100, k) for k in range(60)],
        "hubs": [(h, 10 * h + k) for h in (7, 80, 3) for k in range(40)] + [(80, 3)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "rings": [(10 * g + k, 10 * g + (k + 1) % 7) for g in range(5) for k in range(7)],
        "empty": [],
    }[kind]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (5, 5), (None, 3), (3, None)], "src long, dst long")
    got = {r["node"]: r["root"] for r in components(df, few).collect()}
    assert got == {x: r for x, r in brute([e for e in edges if e[0] != e[1]]).items() if x != r}


class Named:
    """A session whose cluster names a shared folder."""

    def __init__(self, spark, folder):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, spark.sparkContext


def test_the_named_folder_comes_first(spark):
    assert shared_dir(Named(spark, "file:///shared/x/")) == "file:///shared/x"
    assert shared_dir(spark)


def test_materialise(spark):
    got = materialise(spark.range(5).withColumn("x", F.lit("a")))
    assert got.count() == 5 and all(shared_dir(spark).removeprefix("file:").lstrip("/") in f for f in got.inputFiles())
    assert materialise(spark.range(0)).count() == 0
    forget(got)
    with pytest.raises(Exception):  # noqa: B017
        got.count()


def test_maybe_among(spark):
    ids = spark.range(0, 3000, 3).union(spark.createDataFrame([(-5,), (None,)], "id long"))
    df = spark.range(-10, 3000).withColumn("_word", F.lit("own"))
    for bits in (6, 12, 26):
        got = {r["id"]: r["_word"] for r in maybe_among(df, ids, bits=bits).collect()}
        assert {*range(0, 3000, 3), -5} <= set(got) and set(got.values()) == {"own"}
        assert bits < 26 or len(got) < 1010
    assert maybe_among(df, ids.where("false")).count() == 0


def test_share_is_bounded(spark):
    assert share(spark, [1, 2])() == [1, 2]
    with pytest.raises(ValueError, match="too many"):
        share(spark, b"x" * 2000, most_bytes=1000)
