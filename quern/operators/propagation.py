"""Label propagation in the order of nodes, by wavefronts: the result of one sweep after the other, without a task for each component.

In a sweep a node sees the new labels of its smaller neighbours and the old ones of its larger neighbours. So a node waits for its smaller neighbours
alone: its level is the number of edges of the longest chain of ever smaller neighbours, and nodes of one level don't wait for each
other. A level is one join of its edges with the labels of the levels before it. The largest task holds a share of a level's edges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import shared_folder
from .stage import drop, keep

#: Weights are added up in steps of 2 ** -40, so that sums don't depend on the order of addition.
_STEP = float(1 << 40)


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) of undirected edges (src, dst; both directions), kept: how many nodes the longest chain of ever smaller neighbours from a node has after it."""
    down = keep(edges.where("dst < src").select("src", F.col("dst").alias("node")))
    reached, n = [keep(edges.select(F.col("src").alias("node")).distinct().withColumn("level", F.lit(0)))], 0
    while True:
        n += 1
        after = keep(down.join(reached[-1].select("node"), "node").select(F.col("src").alias("node")).distinct().withColumn("level", F.lit(n)))
        reached.append(after)
        if after.isEmpty():
            break
    every = reached[0]
    for r in reached[1:]:
        every = every.unionByName(r)
    out = keep(every.groupBy("node").agg(F.max("level").alias("level")))
    drop(down, *reached)
    return out


def propagate(edges: DataFrame, iters: int = 20) -> DataFrame:
    """(id, root): the label of each node of edges (src, dst, w; both directions, no loops) after label propagation, itself a node.

    Labels start as the nodes. A node takes the label with the largest sum of weights among its neighbours, the smaller one of equals; sweeps
    end when one changes nothing, or after `iters`. Without edges the result is empty.
    """
    spark = edges.sparkSession
    if edges.isEmpty():
        return edges.select(F.col("src").alias("id"), F.col("src").alias("root"))
    root = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    placed = levels(edges)
    count = (placed.agg(F.max("level")).first()[0] or 0) + 1
    weighed = edges.select("src", "dst", F.round(F.col("w") * _STEP).cast("decimal(20,0)").alias("w"))
    weighed.join(placed.withColumnRenamed("node", "src"), "src").write.partitionBy("level").parquet(f"{root}/edges")
    held = spark.read.parquet(f"{root}/edges")
    labels = keep(placed.select("node", F.col("node").alias("label")))
    drop(placed)
    for sweep in range(iters):
        # what larger neighbours say, for all levels at once
        old = held.where("dst > src").join(labels.withColumnRenamed("node", "dst"), "dst").select("level", "src", "label", "w")
        old.groupBy("level", "src", "label").agg(F.sum("w").alias("w")).write.partitionBy("level").parquet(f"{root}/old-{sweep}")
        said, done = spark.read.parquet(f"{root}/old-{sweep}"), []
        for level in range(count):
            votes = said.where(F.col("level") == level).select("src", "label", "w")
            if done:
                new = spark.read.schema(labels.schema).parquet(*done).withColumnRenamed("node", "dst")
                near = held.where((F.col("level") == level) & (F.col("dst") < F.col("src"))).join(new, "dst").select("src", "label", "w")
                votes = votes.unionByName(near.select("src", "label", F.col("w").cast(votes.schema["w"].dataType).alias("w")))
            sums = votes.groupBy("src", "label").agg(F.sum("w").alias("w"))
            best = sums.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("label"))
            done.append(f"{root}/new-{sweep}/{level}")
            best.write.parquet(done[-1])
        after = keep(spark.read.schema(labels.schema).parquet(*done))
        changed = not after.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty()
        drop(labels)
        labels = after
        _delete(spark, f"{root}/old-{sweep}", f"{root}/new-{sweep}")
        if not changed:
            break
    _delete(spark, root)
    return labels.select(F.col("node").alias("id"), F.col("label").alias("root"))


def _delete(spark, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
