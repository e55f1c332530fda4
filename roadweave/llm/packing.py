"""Packing of token ids into sequences of bounded length and balanced attention cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import named
from .tokens import encoder

#: Tokens that are packed together; bounds a task's memory.
GROUP_TOKENS = 2_000_000


def cost(length: np.ndarray | int, linear: float = 1.0, quadratic: float = 1.0 / 1024):
    """Estimated work of a piece: its layers grow with its length, its attention with the square."""
    return linear * length + quadratic * length * length


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Whole sequences are cut off first. The rests go, dearest first, each to the sequence of the least cost that has room for it;
    there are as many sequences as the rests fill. A rest that fits nowhere is cut to fill what room is left, so only the last sequence is not full.
    """
    out, seq = [], 0
    rests = []
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rests.append((n % capacity, d))
    rests.sort(key=lambda x: (-x[0], x[1]))
    n_seq = -(-sum(r for r, _ in rests) // capacity)
    room, spent = np.full(n_seq, capacity), np.zeros(n_seq)
    over = []

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, seq + s, capacity - int(room[s])))
        room[s] -= n
        spent[s] += cost(n, linear, quadratic)

    for n, d in rests:
        s = int(np.argmin(np.where(room >= n, spent, np.inf)))
        if room[s] >= n:
            put(d, lengths[d] - n, n, s)
        else:
            over.append((n, d))
    if over:
        places = iter(np.argsort(-room, kind="stable").tolist())
        s = next(places)
        for n, d in over:
            start = lengths[d] - n
            while n:
                if not room[s]:
                    s = next(places)
                    continue
                k = min(n, int(room[s]))
                put(d, start, k, s)
                start, n = start + k, n - k
    return out


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row per piece: `id_col`, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A row's ids are those of its text and then `end_id`; each lies in one piece. Rows are packed in groups of about GROUP_TOKENS ids as they
    are read, without a shuffle; only the last sequence of a group is not full. Null text: empty, one piece with the end id. Null or repeated
    ids: each row is a document of its own. Empty table: no rows. Other columns are not read. sequence_id is unique, not dense.
    An id column called like an output: ValueError.
    """
    named(id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        ids: list = []
        docs: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal base, ids, docs, held
            pieces = pack([len(x) // 4 for x in docs], capacity, linear, quadratic)
            cols = list(zip(*pieces, strict=True))
            out = pa.RecordBatch.from_arrays([
                pa.array([ids[d] for d in cols[0]], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                pa.array([docs[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces], pa.binary()), pa.array([len(docs[d]) // 4 for d in cols[0]], pa.int64()),
                pa.array([base + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64()),
            ], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            base += max(cols[3]) + 1
            ids, docs, held = [], [], 0
            return out

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                docs.append(enc.ids(text.as_py() or "") + end)
                held += len(docs[-1]) // 4
                if held >= GROUP_TOKENS:
                    yield packed()
        if docs:
            yield packed()

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
