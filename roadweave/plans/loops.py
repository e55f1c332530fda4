"""Loops of DataFrame steps: lineage is cut in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadweave.sources.shared import new_path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a lost executor costs no recomputation, and the plans of later rounds know its size."""
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._roadweave_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what cut() has written, once no frame that is still to be computed reads it."""
    for df in tables:
        path = getattr(df, "_roadweave_path", None)
        if path:
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
