"""Steps of iterative operators, written to the folder that all executors see, and deleted when the next step is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .catalog import shared_folder


def keep(df: DataFrame) -> DataFrame:
    """df written and read again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes what keep wrote for these; nothing that is still to run may read it."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("step-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
