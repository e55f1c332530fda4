"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of results that a task gathers before it hands them on.
BATCH_BYTES = 16_000_000


def gathered(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some thousand, or of about BATCH_BYTES of strings."""
    out, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(out) >= 5000 or held > BATCH_BYTES:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and Spark runs on one machine (tests) one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_roadweave_shared", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="roadweave-shared-")
            spark.sparkContext._roadweave_shared = found
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Python workers of this session get at most so many rows at once: a batch of whole texts is held by the JVM and by the worker, on every core."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def byte_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Python workers of this session get about so many bytes at once, or one row; the JVM and the worker hold a batch each, on every core."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def forget() -> None:
    """Frees what this Python worker keeps of earlier stages, as workers are used again: what tokenizers remember, and memory that Arrow holds unused."""
    held = [(sys.modules.get(f"{__package__}.{module}"), name) for module, name in (("tokens", "encoder"), ("byte_bpe", "codec"))]
    for cached in [getattr(module, name) for module, name in held if module]:
        if cached.cache_info().currsize:
            cached.cache_clear()
            gc.collect()
    pa.default_memory_pool().release_unused()


def named(id_col: str, *taken: str) -> None:
    """Raises ValueError if an id column is called like one of an operator's own output columns."""
    if id_col in taken:
        raise ValueError(f"the id column can't be called {id_col!r}: the result has such a column")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/roadweave-{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str, file_rows: int = 0) -> DataFrame:
    """df written to the shared folder and read again: cuts its lineage so that a lost executor costs no recomputation.

    A file gets at most file_rows rows (0: any number): a reader holds thousands of rows of a file at once, which is too much where a row has megabytes.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._roadweave_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes what stored() wrote; its DataFrame can't be used afterwards."""
    path = getattr(df, "_roadweave_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
