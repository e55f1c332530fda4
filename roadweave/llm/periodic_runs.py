"""Runs (maximal periodic stretches) of words, from the Lyndon arrays of two opposite orders of the words.

The suffix at each place is compared with those before it that no smaller one hides (a stack). Two suffixes whose comparison ends the one's
Lyndon word, or finds its previous smaller suffix, are an edge, and its common extension is kept. Place by place, what has been matched so
far is a window: words from `here` to `end` equal those from `there` on. An edge inside the window is a copy of an edge found before, so its
extension is known as far as the window reaches, and words are compared only beyond the window's end, which then moves on. Each place is
the end of a window once and each comparison fails once, so the work is linear in the words; nothing but their order is used, neither hashes
nor suffix arrays, trees or ranks.

The Lyndon words of a run, a period long each, follow each other; under one of the orders they are edges, extended to the run's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import gathered, named

#: Different words that a task numbers before it starts anew.
WORDS = 2_000_000


def lyndon_edges(x: list, least: float) -> list[tuple[int, int, int]]:
    """(j, i, n): the longest Lyndon word at j ends before i, and the words at j and i agree for n, n > least * (i - j). The end is smaller than any word."""
    size = len(x)
    smaller = [-1] * size  # previous smaller suffix
    greater_to = [0] * size  # where the Lyndon word of a place ends
    up, out_ = [0] * size, [0] * size  # common extension with the previous smaller, with the end of the Lyndon word
    there, here, end = 0, 0, 0
    found = []
    for i in range(1, size):
        c = x[i]
        j = i - 1
        last, common = -1, 0  # the suffix taken from the stack before, and its common extension with i
        while j >= 0:
            y = x[j]
            if y < c:
                break
            if c < y:
                greater_to[j] = i
                last, common = j, 0
                j = smaller[j]
                continue
            # the first words are equal
            n, known = 1, False
            if last >= 0 and common != up[last]:
                n, known = min(common, up[last]), True
            elif i < end and j >= here:
                gap = here - there
                a, b = j - gap, i - gap
                n = out_[a] if greater_to[a] == b else up[b]
                if i + n < end:
                    known = True
                else:
                    n = end - i
            elif common:
                n = common
            if known:
                # smaller if the extension ends where the one before went on, or as the copied edge was
                pop = common < up[last] if last >= 0 and common != up[last] else x[i + n] < x[j + n]
            else:
                while i + n < size and x[i + n] == x[j + n]:
                    n += 1
                if i + n >= end:
                    there, here, end = j, i, i + n
                pop = i + n == size or x[i + n] < x[j + n]
            if not pop:
                up[i] = n
                break
            greater_to[j], out_[j] = i, n
            if n > least * (i - j):
                found.append((j, i, n))
            last, common = j, n
            j = smaller[j]
        smaller[i] = j
    return found


class Alphabet(dict):
    """self[word] numbers words as they come, so that their order can be turned round."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def find_runs(x: list[int], min_length: int, min_exponent: float) -> list[tuple[int, int, int]]:
    """(start, length, period), by start, then period, of every maximal stretch of that least period, at least min_length and min_exponent (2 or more) periods long."""
    runs = set()
    for order in (x, [-k for k in x]):
        for j, i, n in lyndon_edges(order, min_exponent - 2):
            p = i - j
            b = 0
            while b < p and b < j and x[j - 1 - b] == x[i - 1 - b]:
                b += 1
            # a whole period to the left begins an edge of the same run
            if b < p and p + n + b >= max(min_length, min_exponent * p):
                runs.add((j - b, p + n + b, p))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains behind its first period, joined by spaces."""
    kept, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return b" ".join(kept + words[at:])


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: float = 4) -> DataFrame:
    """One row per row of df: `id_col`, n_words, runs (start, length, period; by start, then period), collapsed (binary): the runs of words of each text, and what is left without repeats.

    Words stand between spaces, tabs, line feeds and the like (0x20, 0x09 to 0x0D). Null or empty text: no words, no runs, empty. Null or repeated
    ids: each row is a document of its own. Empty table: no rows. There is no shuffle; a task holds one text at a time, its words and some ten
    numbers for each. Other columns are not read. min_exponent is at least 2. An id column called like an output: ValueError.
    """
    named(id_col, "n_words", "runs", "collapsed")
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()

        def row(i: pa.Scalar, text: pa.Scalar) -> tuple:
            words = (text.as_py() or b"").split()
            if len(alphabet) > WORDS:
                alphabet.clear()
            found = find_runs(list(map(alphabet.__getitem__, words)), min_length, min_exponent)
            return i.as_py(), len(words), [{"start": s, "length": n, "period": p} for s, n, p in found], collapsed(words, found)

        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            schema = pa.schema([("_id", batch.column(0).type), ("n_words", pa.int64()), ("runs", pa.list_(one)), ("collapsed", pa.binary())])
            yield from gathered((row(i, t) for i, t in zip(*batch.columns, strict=True)), schema)

    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary"))
    out = out.mapInArrow(run, f"_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumnRenamed("_id", id_col)


def longest(runs_col: str) -> Column:
    """The run of the greatest length, ties to the least start, then period; null if there is none."""
    best = F.array_max(F.transform(runs_col, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["n"].alias("length"), (-best["p"]).alias("period")))


def runs_text(runs_col: str) -> Column:
    """`start,length,period` and a line feed for each run."""
    return F.array_join(F.transform(runs_col, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, `text_col`): every tenth text by the CRC of its id repeats some words of its own up to its end: from word a on, word i is word a + (i - a) % p. A null id: as it stands."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return df.select(id_col, F.when(h % 10 == 0, text).otherwise(F.col(text_col)).alias(text_col))
