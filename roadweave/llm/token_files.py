"""Token ids in Arrow stream files of fixed-size lists, read by position without copying.

A part file holds the ids of its documents in order of their id, one after another, cut into rows of `width` ids.
All batches have `rows` rows but the last, so the bytes of batch k begin at a computed place: neither a footer nor
a scan is needed, and a memory-mapped row is a view of the file. `mask` is 0 where the last row is filled up,
else 1: a byte each, so that masks are views as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import named, stored
from .tokens import encoder

WIDTH, ROWS = 2048, 64


def _schema(dtype: np.dtype, width: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), width)), ("mask", pa.list_(pa.uint8(), width))])


class TokenWriter:
    """Appends ids; close() fills up the last row and moves the file to its name, so that a task that is run again leaves one whole file."""

    def __init__(self, uri: str, dtype: np.dtype, width: int = WIDTH, rows: int = ROWS):
        self._fs, self._path = fs.FileSystem.from_uri(uri)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        ctx = TaskContext.get()
        self._temp = f"{self._path}.{ctx.taskAttemptId() if ctx else 0}.tmp"
        self.dtype, self._width, self._rows = dtype, width, rows
        self._schema = _schema(dtype, width)
        self._sink = self._fs.open_output_stream(self._temp)
        self._stream = pa.ipc.new_stream(self._sink, self._schema)
        self._held: list[np.ndarray] = []
        self._n = 0

    def _put(self, ids: np.ndarray, used: int) -> None:
        mask = (np.arange(len(ids)) < used).astype(np.uint8)
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._width) for x in (ids, mask)]
        self._stream.write_batch(pa.RecordBatch.from_arrays(cols, schema=self._schema))

    def append(self, ids: np.ndarray) -> None:
        self._held.append(ids.astype(self.dtype))
        self._n += len(ids)
        size = self._width * self._rows
        if self._n >= size:
            whole = np.concatenate(self._held)
            at = 0
            while self._n - at >= size:
                self._put(whole[at : at + size], size)
                at += size
            self._held, self._n = [whole[at:]], self._n - at

    def close(self) -> None:
        if self._n:
            ids = np.zeros(-(-self._n // self._width) * self._width, self.dtype)
            ids[: self._n] = np.concatenate(self._held)
            self._put(ids, self._n)
        self._stream.close()
        self._sink.close()
        self._fs.move(self._temp, self._path)


class TokenFile:
    """Random access to a part file; rows of a local file are views of the mapped bytes."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self._file = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self._schema = pa.ipc.read_schema(self._file)
        self.width = self._schema.field("ids").type.list_size
        self._base = self._file.tell()
        self._batches: dict[int, tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = {}
        first = self._read(self._base)
        self._stride, self._rows = self._file.tell() - self._base, first.num_rows if first else 1

    def _read(self, at: int) -> pa.RecordBatch | None:
        self._file.seek(at)
        message = pa.ipc.read_message(self._file)
        return pa.ipc.read_record_batch(message, self._schema)

    def batch(self, k: int) -> pa.RecordBatch:
        return self._batch(k)[2]

    def _batch(self, k: int) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
        if k not in self._batches:
            self._batches.clear()
            b = self._read(self._base + k * self._stride)
            self._batches[k] = *(b.column(c).values.to_numpy(zero_copy_only=True) for c in (0, 1)), b
        return self._batches[k]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row i, as views."""
        ids, mask, _ = self._batch(i // self._rows)
        at = i % self._rows * self.width
        return ids[at : at + self.width], mask[at : at + self.width].view(np.bool_)

    def span(self, start: int, n: int) -> np.ndarray:
        """The n ids from place `start` of the part's stream."""
        size, out = self.width * self._rows, []
        while n > 0:
            ids = self._batch(start // size)[0]
            x = ids[start % size : start % size + n]
            out.append(x)
            start, n = start + len(x), n - len(x)
        return np.concatenate(out) if len(out) != 1 else out[0]


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the ids of each text and `end_id` in ascending order of `id_col` to part files in `path`; returns their index.

    Index: part, file, `id_col`, at (place in its part), n_tokens, start (ids of all rows before it). Null text: empty, so its ids are the end id
    alone. Null ids come first; rows with the same id follow each other in either order. Empty table: no rows. Other columns of df are not read.
    An id column may not have the name of another column of the index: ValueError.
    """
    named(id_col, "part", "file", "at", "n_tokens", "start", "ids")
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        dtype = np.dtype("<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4")
        part = TaskContext.get().partitionId()
        uri, writer, at = f"{path}/ids/part-{part:06d}.arrow", None, 0
        for batch in batches:
            writer = writer or TokenWriter(uri, dtype)
            sizes = []
            for text in batch.column(1):
                ids = np.append(np.frombuffer(enc.ids(text.as_py() or ""), "<u4"), np.uint32(end_id))
                writer.append(ids)
                sizes.append(len(ids))
            ends = at + np.cumsum(sizes)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([uri] * n), batch.column(0), pa.array(ends - sizes), pa.array(np.array(sizes, np.int64))], names=["part", "file", "id", "at", "n_tokens"])
            at = int(ends[-1]) if n else at
        if writer:
            writer.close()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id")
    index = stored(rows.mapInArrow(write, f"part int, file string, id {kind}, at long, n_tokens long"), "token-index")
    # one row a part file: the ids of all parts before it
    before = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = index.join(before, "part").withColumn("start", F.col("at") + F.col("before")).drop("before")
    return out.withColumnRenamed("id", id_col)


def read_tokens(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of an index of write_tokens() with `ids`, binary: little-endian unsigned 32-bit, read from the part files."""
    kind = index.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = []
            for uri, at, n in zip(*(batch.column(k).to_pylist() for k in ("file", "at", "n_tokens")), strict=True):
                if uri != name:
                    name, file = uri, TokenFile(uri)
                ids.append(file.span(at, n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("start"), batch.column("n_tokens"), pa.array(ids, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    return index.select(id_col, "start", "n_tokens", "file", "at").mapInArrow(read, f"{id_col} {kind}, start long, n_tokens long, ids binary")
