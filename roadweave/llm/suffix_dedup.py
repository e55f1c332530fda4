"""Removal of every byte that lies in a repeated `length`-byte string, by difference-cover suffix arrays.

1. Every document is winnowed: each `length`-byte window selects the smallest hash among its `GRAM`-byte strings
   (its anchor). The choice depends on the window's bytes alone, so equal windows have equal anchors, and only
   windows whose anchor occurs twice can be repeated. No window is lost and no text is dropped.
2. The windows of one anchor occurrence form one run; its bytes are its context. Equal contexts are collapsed to
   one with a count, so groups of copies and common passages are aggregated before they are shuffled.
3. Contexts are dealt into shards by their anchor: equal windows always meet in one shard. Anchors with very many
   occurrences are dealt by anchor, offset and the bytes that all windows of the piece share instead; a deal of
   contexts that is still too large for a shard is dealt window by window, equal ones collapsed to one with a count.
4. Each shard is suffix-sorted by the difference cover {1, 2} mod 3: sampled triples are sorted and named, the
   names are sorted by recursion, the remaining suffixes are merged in, and neighbours' prefixes are compared.
5. The repeated starts go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import drop, named, stored

GRAM = 40
#: Window starts that are hashed at once; bounds the memory that a very long text takes.
CHUNK = 1 << 18
#: Occurrences beyond which an anchor's windows are dealt by their bytes as well.
HOT = 2_000
#: Starts in a piece of a hot anchor's run.
PIECE = 16
SHARD_BYTES = 500_000
#: Rows that are turned into Python objects at once.
ROWS = 256
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte string of a."""
    n = len(a)
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        _powers[size] = _geometric(int(_MULT), size), _geometric(pow(int(_MULT), -1, 1 << 64), size)
    up, down = _powers[size]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchor_runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, offset of the anchor from the first start, anchor hash) of each run of windows that select the same anchor."""
    width = length - GRAM + 1
    starts = len(data) - length + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    places, hashes = [], []
    whole = np.frombuffer(data, np.uint8)
    for c in range(0, starts, CHUNK):
        h = _gram_hashes(whole[c : min(starts, c + CHUNK) + length - 1])
        m = len(h)
        # equal hashes: the rightmost wins, which again depends on the window's bytes alone
        key = (h >> np.uint64(20) << np.uint64(20)) | (np.uint64((1 << 20) - 1) - np.arange(m, dtype=np.uint64))
        padded = np.full(-(-m // width) * width + width, np.uint64(2**64 - 1))
        padded[:m] = key
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = m - width + 1
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        at = ((1 << 20) - 1) - (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        places.append(at + c)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, len(at)]), at[first] - first, h[first]


def _packed(*letters: np.ndarray) -> np.ndarray:
    """Letters or ranks under 2**21 as one number, the first of the most weight."""
    out = letters[0]
    for x in letters[1:]:
        out = out << np.uint64(21) | x
    return out


def _named(keys: np.ndarray) -> np.ndarray:
    """The rank from 1 of each key; equal keys, equal ranks."""
    order = np.argsort(keys)
    k = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]])
    return names


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t (letters of at least 1, under 2**20) in order, by the difference cover {1, 2} mod 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.zeros(n + 5, np.uint64)
    s[:n] = t
    # name the sampled triples, those at 1 mod 3 first
    n1, n2 = -(-n // 3), n // 3  # n1 at 0 and at 1 mod 3 (the last one empty where n is 1 mod 3), n2 at 2 mod 3
    s0, s1, s2, s3, s4 = s[: 3 * n1 : 3], s[1 : 3 * n1 + 1 : 3], s[2 : 3 * n1 + 2 : 3], s[3 : 3 * n1 + 3 : 3], s[4 : 3 * n2 + 4 : 3]
    names = _named(np.concatenate([_packed(s1, s2, s3), _packed(s2[:n2], s3[:n2], s4)]))
    if names.max() < n1 + n2:
        # recurse on the names: the suffixes at 1 mod 3, then those at 2 mod 3
        names[suffix_array(names)] = np.arange(1, n1 + n2 + 1)
    r1, r2 = names[:n1].astype(np.uint64), np.zeros(n1 + 1, np.uint64)
    r2[:n2] = names[n1:]
    r4 = np.append(r1[1:], np.uint64(0))[:n2]
    by_name = np.empty(n1 + n2, np.int64)
    by_name[names - 1] = np.arange(n1 + n2)
    first = by_name < n1
    ones, twos = by_name[first], by_name[~first] - n1
    sampled = np.where(first, 3 * by_name + 1, 3 * (by_name - n1) + 2)
    if n % 3 == 1:
        ones, sampled = ones[ones < n1 - 1], sampled[sampled < n]
    # the remaining suffixes, by a letter and the rank of the rest
    key = _packed(s0, r1)
    order = np.argsort(key)
    rest = 3 * order
    # merge: against suffixes at 1 mod 3 by a letter and a rank, at 2 mod 3 by two letters and a rank
    place = np.arange(n1)
    place += np.searchsorted(_packed(s1, r2[:n1])[ones], key[order])
    place += np.searchsorted(_packed(s2[:n2], s3[:n2], r4)[twos], _packed(s0, s1, r2[:n1])[order])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sampled
    return out


def repeated_starts(texts: list[bytes], counts: list[int], starts: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its first `starts` positions begin a `length`-byte string that begins elsewhere too; a text counts `counts` times."""
    sizes = np.array([len(x) for x in texts]) + 1
    ends = np.cumsum(sizes)
    t = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    letters = t.astype(np.int64) + 2
    letters[ends - 1] = 1
    n = len(letters)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = np.arange(n) - begins[owner] < np.array(starts)[owner]
    order = suffix_array(letters)
    order = order[valid[order]]
    # compare adjacent prefixes, eight bytes at a time, from their ends: their beginnings are mostly equal
    padded = np.zeros(n + length + 16, np.uint8)
    padded[:n] = t
    words = np.ndarray((n + length + 8,), np.uint64, padded, strides=(1,))
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for k in [length - 8, *range(0, length - 8, 8)[::-1]]:
        same = same[words[a[same] + k] == words[b[same] + k]]
    hit = (np.array(counts) > 1)[owner] & valid
    hit[a[same]] = True
    hit[b[same]] = True
    return [hit[i : i + k] for i, k in zip(begins.tolist(), starts, strict=True)]


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _listed(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each element of a column of lists of structs, and the elements; null: no element."""
    return np.repeat(np.arange(len(lists)), np.array(lists.value_lengths().fill_null(0))), lists.flatten()


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            runs = [anchor_runs(_bytes(text.as_py()), length) for text in batch.column(2)]
            n = [len(r[0]) for r in runs]
            keys = [pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in (0, 1)]
            rest = [pa.array(np.concatenate([r[k] for r in runs]).astype(t)) for k, t in enumerate((np.int64, np.int16, np.int16))]
            yield pa.RecordBatch.from_arrays([*keys, *rest, pa.array(np.concatenate([r[3] for r in runs]).view(np.int64))], names=["k1", "k2", "first", "n", "off", "anchor"])

    return run


def _key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cut_contexts(length: int):
    """Contexts of a document's repeated anchors; those of hot anchors in pieces that are dealt by the bytes all their windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = [_bytes(x) for x in batch.column(2).to_pylist()]
            at, runs = _listed(batch.column(3))
            out = []
            for i, first, n, off, anchor, hot in zip(at.tolist(), *(runs.field(c).to_pylist() for c in ("first", "n", "off", "anchor", "hot")), strict=True):
                data = texts[i]
                if not hot:
                    out.append((i, first, n, anchor, data[first : first + n + length - 1]))
                    continue
                # offsets from the anchor run from off down to off - n + 1; pieces lie on a grid of offsets
                s = first
                while s < first + n:
                    cell = (off - (s - first)) // PIECE
                    e = min(first + n, first + off - cell * PIECE + 1)
                    p = first + off
                    shared = data[p - cell * PIECE : p - cell * PIECE - PIECE + 1 + length]
                    deal = int.from_bytes(_key(b"%d %d " % (anchor, cell) + shared)[:8], "little", signed=True)
                    out.append((i, s, e - s, deal, data[s : e + length - 1]))
                    s = e
            rows, *rest, contexts = zip(*out, strict=True) if out else [()] * 5
            at = pa.array(rows, pa.int64())
            cols = [pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int16(), pa.int64()), strict=True)]
            keys = pa.array([_key(x + bytes([n])) for x, n in zip(contexts, rest[1], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *cols, keys, pa.array(contexts, pa.binary())], names=["k1", "k2", "first", "n", "deal", "key", "context"])

    return run


def _sort_shard(length: int):
    """Suffix-sorts a shard in parts that hold whole deals; parts are small enough for a processor's cache."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("deal", kind="stable", ignore_index=True)
        size = pdf["context"].str.len().to_numpy() + 1
        deal = pdf["deal"].to_numpy()
        first = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
        total = np.add.reduceat(size, first) if len(pdf) else size
        keys, masks = [], []
        at, held = 0, 0
        for k, n in enumerate(total.tolist() + [None]):
            if n is None or held and held + n > SHARD_BYTES // 4:
                part = pdf.iloc[at : first[k] if n is not None else len(pdf)]
                hit = repeated_starts(part["context"].tolist(), part["count"].tolist(), part["n"].tolist(), length)
                for key, x in zip(part["key"], hit, strict=True):
                    if x.any():
                        keys.append(key)
                        masks.append(np.packbits(x).tobytes())
                at, held = at + len(part), 0
            held += n or 0
        return pd.DataFrame({"key": keys, "mask": masks})

    return run


#: Bytes of a deal's contexts beyond which it is dealt window by window; letters of what is sorted at once fit in 20 bits of a packed key.
MOST = (1 << 20) - 8


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows and about SHARD_BYTES bytes of text; a longer text stands alone."""
    for batch in _sliced(batches):
        sizes = np.array(pc.binary_length(batch.column("text")).fill_null(0), np.int64)
        part = (np.cumsum(sizes) - sizes) // SHARD_BYTES
        cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (sizes[1:] > SHARD_BYTES)]) if len(sizes) else sizes
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
            yield batch.slice(a, b - a)


def _hit_starts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every window that is marked in the masks of a column of hits, in order."""
    row, hits = _listed(lists)
    masks = hits.field("mask").to_pylist()
    size = np.array([len(x) for x in masks], np.int64)
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(masks), np.uint8)))
    hit = np.repeat(np.arange(len(masks)), size)[bits >> 3]
    start = np.array(hits.field("first"), np.int64)[hit] + bits - 8 * (np.cumsum(size) - size)[hit]
    row = row[hit]
    order = np.lexsort((start, row))
    return row[order], start[order]


def _take_out(length: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            row, start = _hit_starts(batch.column("hits"))
            # windows that overlap or touch are one span
            new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] - start[:-1] > length)][: len(row)]
            begin, owner = start[new], row[new]
            end = start[np.r_[new[1:], True][: len(row)]] + length
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            removed = np.r_[0, np.cumsum(end - begin)]
            texts, kept = [_bytes(x) for x in batch.column("text").to_pylist()], []
            begins, ends = begin.tolist(), end.tolist()
            for data, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                x = b"".join(data[e:s] for e, s in zip([0, *ends[a:b]], [*begins[a:b], len(data)], strict=True)) if b > a else data
                kept.append(x.decode("utf-8", "ignore") if as_text else x)
            pairs = pa.ListArray.from_arrays(pa.array(2 * np.arange(len(begin) + 1), pa.int32()), pa.array(np.column_stack([begin, end]).ravel()))
            cols = [
                pa.array([len(x) for x in texts], pa.int64()), pa.array(removed[bounds[1:]] - removed[bounds[:-1]]), pa.array(np.diff(bounds)),
                pa.array(kept, pa.string() if as_text else pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs),
            ]
            rest = [k for k, name in enumerate(batch.schema.names) if name not in ("text", "hits")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *cols], names=[*(batch.schema.names[k] for k in rest), "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per input row: `id_col`, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the remaining bytes), spans (array of [start, end)).

    A byte goes if a `length`-byte string over it starts anywhere else too, in this or another row; strings never cross rows.
    Null text: empty. Ids may be null or repeat: every row counts and gets a row of its own.
    Empty table: no rows. Long texts are read whole. An id column called like an output: ValueError. Columns named in `carry` are returned too, in a struct `carried`; other columns of df are neither read nor returned.
    as_text: kept is a string; what a cut has left of a character goes too.
    """
    named(id_col, "n_bytes", "n_removed", "n_spans", "kept", "spans", "carried")
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows with one id and one text are alike in all that follows, so hashes of both stand for a row
    rows = rows.withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.xxhash64("text", "id", F.lit(1)))
    anchors = stored(rows.select("k1", "k2", "text").mapInArrow(_find_anchors(length), "k1 long, k2 long, first long, n short, off short, anchor long"), "anchors")
    # written, so that both sides of the join are plain shuffles, whose large partitions can be split
    often = stored(anchors.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1"), "often")
    runs = (
        anchors.join(often, "anchor")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("first", "n", "off", "anchor", (F.col("seen") > HOT).alias("hot"))).alias("runs"))
    )
    cut = rows.drop("id").join(runs, ["k1", "k2"]).select("k1", "k2", "text", "runs")
    contexts = stored(cut.mapInArrow(_cut_contexts(length), "k1 long, k2 long, first long, n short, deal long, key binary, context binary"), "contexts")
    drop(anchors)
    drop(often)
    size = F.octet_length("context") + 1
    deals = contexts.groupBy("deal", "key").agg(F.first(size).alias("size")).groupBy("deal").agg(F.sum("size").alias("size"))
    deals = stored(deals.where(F.col("size") > MOST).select("deal"), "large-deals")
    large = contexts.join(deals, "deal")
    windows = large.select("k1", "k2", F.posexplode(F.expr(f"transform(sequence(0, n - 1), i -> substring(context, i + 1, {length}))")).alias("i", "context"), "first")
    windows = windows.select("k1", "k2", (F.col("first") + F.col("i")).alias("first"), F.lit(1).cast("short").alias("n"), F.xxhash64("context").alias("deal"), F.unhex(F.md5("context")).alias("key"), "context")
    dealt = contexts.join(deals, "deal", "left_anti").select(*windows.columns).unionByName(windows)
    distinct = dealt.groupBy("deal", "key", "n", "context").agg(F.count("*").alias("count"))
    total = contexts.agg(F.sum(size).alias("x")).head()["x"] or 0
    shards = max(1, -(-total // (4 * SHARD_BYTES)))
    found = (
        distinct.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_sort_shard(length), "key binary, mask binary")
    )
    hits = dealt.select("k1", "k2", "first", "n", "key").join(found, "key")
    hits = stored(hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n", "mask")).alias("hits")), "hits")
    drop(deals)
    drop(contexts)
    if carry:
        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*carry).alias("carried"))
        rows = rows.withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.xxhash64("text", "id", F.lit(1)))
    out = rows.join(hits, ["k1", "k2"], "left").drop("k1", "k2")
    carried = f"carried {rows.schema['carried'].dataType.simpleString()}, " if carry else ""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, {carried}n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, spans array<array<long>>"
    out = out.select("id", *(["carried"] if carry else []), "text", "hits")
    return out.mapInArrow(_take_out(length, as_text), schema).withColumnRenamed("id", id_col)
