"""Benchmark passages in training texts, by spaced-seed hashing.

A seed is the hash of the words that a fixed mask selects from a span; a substituted word at an ignored place leaves it as it is.
Seeds of the training texts are held against a Bloom filter of the benchmark's seeds where they are made; those that pass are joined
with the benchmark's seeds on the hash, and each alignment they propose is verified word by word around the hit. A row of the verification
holds one alignment: the item's words and those of the text that stand against them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import named, stored

#: Places that a mask selects. Of any LONG words or more of which 0.8 are the same, one of the first four hits some;
#: of five or six, one of the next four. An item of fewer words must be there whole, and its mask is all of it.
LONG = 7
MASKS = (
    (0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5), (0, 1, 3, 6, 7),
    (0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4),
    (0,), (0, 1), (0, 1, 2), (0, 1, 2, 3),
)
WHOLE = 8
MIN_WORDS = 13
SIMILARITY = 0.8
#: Bits of the Bloom filter: this many a seed, at most MOST_BITS (4 MB). A fuller filter only lets more seeds through to the join.
BITS_A_SEED, MOST_BITS, PROBES = 256, 1 << 25, 3
#: Words that a task remembers the hash of.
MEMO = 400_000
_ASCII_TO_SPACE = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = v = xxhash.xxh32_intdigest(word)
        return v


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of a text's words: lower case, cut at whatever ASCII character is neither letter nor digit."""
    if not text:
        return np.zeros(0, np.uint32)
    words = text.lower().encode("utf-8", "surrogatepass").translate(_ASCII_TO_SPACE).split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint32, len(words))


def masks_of(n_words: int) -> range:
    """The masks, by their place in MASKS, that find an item of so many words."""
    if n_words >= LONG:
        return range(4)
    return range(4, WHOLE) if n_words >= 5 else range(WHOLE + n_words - 1, WHOLE + n_words) if n_words else range(0)


def seeds(words: np.ndarray, masks: Iterable[int] = range(4)) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each mask at each place; of a mask that is a whole item, each hash's first place."""
    at, out = [], []
    wide = words.astype(np.uint64)
    for k in masks:
        mask = MASKS[k]
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        h = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) % (1 << 64), np.uint64)
        for place in mask:
            h = (h ^ wide[place : place + n]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        if k >= WHOLE:
            h, first = np.unique(h, return_index=True)
        at.append(first if k >= WHOLE else np.arange(n))
        out.append(h)
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _place(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """A seed's k-th bit in the filter."""
    return (h + np.uint64(k) * ((h >> np.uint64(33)) | np.uint64(1))) & np.uint64(bits - 1)


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [word_hashes(x) for x in pdf["text"]]
        yield pd.DataFrame({"item_id": pdf["id"], "words": [x.view(np.int32) for x in words], "n_words": [len(x) for x in words]})


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for item, words in zip(pdf["item_id"], pdf["words"], strict=True):
            at, h = seeds(np.asarray(words, np.int32).view(np.uint32), masks_of(len(words)))
            out.append(pd.DataFrame({"seed": h.view(np.int64), "item_id": item, "item_at": at}))
        yield pd.concat(out) if out else pd.DataFrame({"seed": [], "item_id": [], "item_at": []})


def _filter_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([_place(h, k, bits) for k in range(PROBES)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["place", "bits"])

    return run


def _probe(shared, bits: int, masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows, words, hits = [], [], []
            for i, text in enumerate(batch.column(0)):
                w = word_hashes(text.as_py())
                at, h = seeds(w, masks)
                for k in range(PROBES):
                    if len(h):
                        place = _place(h, k, bits)
                        ok = (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                        at, h = at[ok], h[ok]
                if len(h):
                    rows.append(i)
                    words.append(w.view(np.int32))
                    hits.append([{"seed": int(s), "at": int(a)} for s, a in zip(h.view(np.int64), at, strict=True)])
            if rows:
                keys = [batch.column(k).take(pa.array(rows)) for k in (1, 2, 3)]
                hit_type = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(words, pa.list_(pa.int32())), pa.array(hits, hit_type)], names=["id", "k1", "k2", "words", "hits"])

    return run


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> tuple[int, int, int]:
    """(first item word, words, matches) of the alignment's best segment of min_words words or more, or of all its words if it has fewer.

    Each match counts 1 - similarity, each substitution -similarity. The best sum is below zero only if no such segment has the similarity.
    """
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if b <= a:
        return 0, 0, 0
    same = item[a:b] == doc[a + diagonal : b + diagonal]
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))])
    least_words = min(min_words, b - a)
    least = np.minimum.accumulate(sums[: len(sums) - least_words])
    gain = sums[least_words:] - least
    end = len(gain) - 1 - int(np.argmax((gain >= gain.max() - 1e-9)[::-1]))
    start = int(np.flatnonzero(sums[: end + 1] <= least[end] + 1e-9)[0])
    end += least_words
    return a + start, end - start, int(same[start:end].sum())


def _verify(similarity: float, min_words: int):
    """Of alignments (words of the item, words against them from its word `first` on) those that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            items, against = batch.column("words"), batch.column("against")
            for i, (first, diagonal) in enumerate(zip(batch.column("first").to_pylist(), batch.column("diagonal").to_pylist(), strict=True)):
                item, doc = (x[i].values.to_numpy() for x in (items, against))
                start, n, same = overlap(doc, item, -first, similarity, min_words)
                if n and same >= similarity * n - 1e-9 and (n >= min(len(item), min_words) or same >= similarity * len(item) - 1e-9):
                    out.append((i, start + diagonal, start, n, same, len(item)))
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("k1", "k2", "item_id")), *(pa.array([x[k] for x in out], pa.int32()) for k in range(1, 6))], names=["k1", "k2", "item_id", "word_at", "item_word_at", "n_words", "n_same", "item_words"])

    return run


def overlaps(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per text and benchmark item that overlap: `id_col`, item_id, word_at and item_word_at (where the overlap begins), n_words, n_same, similarity, item_words.

    An overlap is an alignment's best stretch of min_words words or more (of all the item's words if it has fewer) of which `similarity` or more are
    the same, or `similarity` of the item where the text ends before it. All are found if similarity is 0.8 and min_words LONG at least. Items with
    the same words are compared once, and each gets the rows. Of an item under five words, the first occurrence is reported. Null or empty texts
    overlap nothing; long ones are read whole. Equal rows give one row. Empty tables: no rows. Other columns are not read. An id column called like an
    output: ValueError.
    """
    named(id_col, "item_id", "word_at", "item_word_at", "n_words", "n_same", "similarity", "item_words")
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), tests.schema[item_col].dataType.simpleString()
    items = tests.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    named_items = stored(items.mapInPandas(_item_rows, f"item_id {item_kind}, words array<int>, n_words int").where("item_id IS NOT NULL"), "named-items")
    items = stored(named_items.groupBy("words", "n_words").agg(F.min("item_id").alias("item_id")).select("item_id", "words"), "items")
    members = named_items.join(items.select("words", F.col("item_id").alias("first_id")), "words").select("first_id", "item_id").distinct()
    item_seeds = stored(items.mapInPandas(_item_seeds, f"seed long, item_id {item_kind}, item_at int"), "seeds")
    n = item_seeds.count()
    sizes = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(LONG)).alias("n")).distinct().collect()]  # at most LONG + 1
    masks = sorted({k for x in sizes for k in masks_of(x)})
    bits = min(MOST_BITS, 1 << max(12, (BITS_A_SEED * max(n, 1)).bit_length()))
    filled = item_seeds.select("seed").mapInArrow(_filter_rows(bits), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    table = np.zeros(bits >> 6, np.uint64)
    table[filled["place"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where("text IS NOT NULL")
    rows = rows.select("text", "id", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit(1)).alias("k2"))
    found = stored(rows.mapInArrow(_probe(shared, bits, masks), f"id {kind}, k1 long, k2 long, words array<int>, hits array<struct<seed: long, at: long>>"), "hits")
    hits = found.select("k1", "k2", F.explode("hits").alias("h")).select("k1", "k2", "h.*")
    lines = hits.join(item_seeds, "seed").select("k1", "k2", "item_id", (F.col("at") - F.col("item_at")).cast("int").alias("diagonal")).distinct()
    texts = found.dropDuplicates(["k1", "k2"]).select("k1", "k2", "id", F.col("words").alias("own"))
    # only the words that stand against the item's go on: no row grows with the number of its text's alignments
    pairs = lines.join(items.select("item_id", "words"), "item_id").join(texts.select("k1", "k2", "own"), ["k1", "k2"])
    pairs = pairs.withColumn("first", F.greatest(-F.col("diagonal"), F.lit(0))).withColumn("begin", F.greatest("diagonal", F.lit(0)))
    pairs = pairs.select("k1", "k2", "item_id", "diagonal", "first", "words", F.slice("own", F.col("begin") + 1, F.greatest(F.size("words") - F.col("first"), F.lit(0))).alias("against"))
    good = pairs.mapInArrow(_verify(similarity, min_words), f"k1 long, k2 long, item_id {item_kind}, word_at int, item_word_at int, n_words int, n_same int, item_words int")
    best = F.max(F.struct("n_same", (-F.col("item_word_at")).alias("a"), (F.col("item_word_at") - F.col("word_at")).alias("b"), "word_at", "item_word_at", "n_words", "item_words")).alias("x")
    out = good.groupBy("k1", "k2", "item_id").agg(best).join(texts.select("k1", "k2", "id"), ["k1", "k2"])
    out = out.withColumnRenamed("item_id", "first_id").join(members, "first_id")
    return out.select(F.col("id").alias(id_col), "item_id", "x.word_at", "x.item_word_at", "x.n_words", "x.n_same", (F.col("x.n_same") / F.col("x.n_words")).alias("similarity"), "x.item_words")
