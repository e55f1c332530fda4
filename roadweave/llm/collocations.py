"""Phrases of words that stand together more often than their parts suggest, found with position bitmaps.

Texts are cut into pieces and words and dealt into shards: the words of one language in a row, an empty place between pieces. In a shard each
word has a bitmap of its places, kept as the blocks of 64 places that aren't empty. A phrase's bitmap marks its last word's places: shifted by
one place and ANDed with a following word's bitmap it is that of the longer phrase, and its population count is how often that occurs. Empty
places stop phrases at the ends of pieces. Phrases are extended depth first, over a range of first words at a time.

Only the sums of the counts over all shards tell which phrases are frequent, so a phrase is counted in every shard or in none: words first,
then pairs of frequent words, then what frequent pairs make up. Pairs are many, most of them rare: they are summed by 64-bit keys first, and
those whose key may be frequent are then counted as words. What is frequent is told to the shards by a Bloom filter of bounded size: a
phrase that it lets through by mistake is counted too, and dropped after the sum. With more frequent phrases than the filter separates,
more is counted, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_batches, drop, stored

#: Places of a shard, about, and bytes of a text that are cut at once; a piece is never parted.
SHARD_WORDS, TEXT_BYTES = 1 << 19, 1 << 22
#: Shards in a file: a task reads a file's rows all at once.
FILE_SHARDS = 4
#: Rows of bitmaps that are extended at once.
RANGE_ROWS = 1 << 18
#: The most bits of the filter of frequent phrases (16 MB).
FILTER_BITS = 1 << 27
#: Parts in which a language's best phrases are ranked before they are ranked together.
RANK_PARTS = 64
UND = "und"

_GAP = b"\xff"  # no byte of UTF-8
_LETTERS = bytes(range(65, 91))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_LETTERS + _ENDS + b"\t", _LETTERS.lower() + _GAP * len(_ENDS) + b" ")
_ONE = np.uint64(1)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in small ASCII letters, with _GAP for what ends a piece, in parts of about TEXT_BYTES."""
    text = text.translate(_PLAIN)
    at = 0
    while len(text) - at > TEXT_BYTES:
        cut = text.rfind(_GAP, at, at + TEXT_BYTES)
        if cut < 0:
            cut = text.find(_GAP, at + TEXT_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def shards(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, words, counts, places): a shard's different words, how often each occurs, and the number of the word at each place (0: none, else from 1; 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Numbers, list]] = {}
        sizes: dict[str, int] = {}

        def closed(lang: str) -> pa.RecordBatch:
            numbers, runs = open_.pop(lang)
            del sizes[lang]
            ids = np.concatenate(runs)
            words = list(numbers)[1:]
            counts = np.bincount(ids, minlength=len(numbers))[1:]
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], pa.array(words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64())), pa.array([ids.tobytes()], pa.binary())],
                names=["lang", "words", "counts", "places"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _parts(text.as_py()):
                    if lang not in open_:
                        open_[lang], sizes[lang] = (_Numbers({_GAP: 0}), []), 0
                    numbers, runs = open_[lang]
                    words = part.replace(_GAP, b" \xff ").split()
                    words.append(_GAP)
                    runs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    sizes[lang] += len(words)
                    if sizes[lang] >= SHARD_WORDS:
                        yield closed(lang)
            # the texts of many languages together are bounded too
            while sum(sizes.values()) > 4 * SHARD_WORDS:
                yield closed(max(sizes, key=sizes.get))
        for lang in list(open_):
            yield closed(lang)

    x = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    return x.mapInArrow(run, "lang string, words array<string>, counts array<long>, places binary")


class Bitmaps:
    """Bitmaps by label (phrases, in order): row after row a label, one of its blocks of 64 places, and its bits there."""

    def __init__(self, label: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.label, self.block, self.bits = label, block, bits

    @staticmethod
    def of_words(ids: np.ndarray) -> tuple[Bitmaps, np.ndarray]:
        """The words' bitmaps, and the row in which each place's bit stands (-1: none)."""
        at = np.argsort(ids, kind="stable")
        at = at[np.searchsorted(ids[at], 1) :]
        label, block = ids[at].astype(np.int64), at >> 6
        new = np.diff(label, prepend=-1).astype(bool) | np.diff(block, prepend=-1).astype(bool)
        first = np.flatnonzero(new)
        bits = np.bitwise_or.reduceat(_ONE << (at & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
        row = np.full(len(ids), -1, np.int64)
        row[at] = np.cumsum(new) - 1
        return Bitmaps(label[first], block[first], bits), row

    def part(self, keep) -> Bitmaps:
        return Bitmaps(self.label[keep], self.block[keep], self.bits[keep])

    def shifted(self) -> Bitmaps:
        """One place further; a block's last place goes to a row of its own for the next block."""
        over = np.flatnonzero(self.bits >> np.uint64(63))
        stay = self.bits << _ONE
        here = np.flatnonzero(stay)
        return Bitmaps(
            np.concatenate([self.label[here], self.label[over]]), np.concatenate([self.block[here], self.block[over] + 1]), np.concatenate([stay[here], np.ones(len(over), np.uint64)]),
        )

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every bit."""
        rows, places, left, row = [], [], self.bits, np.arange(len(self.bits))
        while len(left):
            low = left & (~left + _ONE)
            rows.append(row)
            places.append(self.block[row] * 64 + np.bitwise_count(low - _ONE))
            left = left ^ low
            more = np.flatnonzero(left)
            left, row = left[more], row[more]
        return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Found:
    """Phrases with a bitmap each: `bitmaps` by phrase, and for each phrase how often it occurs and a place where it ends."""

    def __init__(self, key: np.ndarray, block: np.ndarray, bits: np.ndarray, place: np.ndarray):
        order = np.argsort(key, kind="stable")
        key, place, bits = key[order], place[order], bits[order]
        new = np.diff(key, prepend=-1).astype(bool)
        first = np.flatnonzero(new)
        self.bitmaps = Bitmaps(np.cumsum(new) - 1, block[order], bits)
        self.place = place[first]
        self.count = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def only(self, good: np.ndarray) -> Found:
        """The phrases for which good is true."""
        out = object.__new__(Found)
        out.bitmaps = self.bitmaps.part(good[self.bitmaps.label])
        out.bitmaps.label = (np.cumsum(good) - 1)[out.bitmaps.label]
        out.place, out.count = self.place[good], self.count[good]
        return out


def extend(phrases: Bitmaps, ends: Bitmaps, row_of: np.ndarray, last: np.ndarray, n_last: int) -> Found:
    """The phrases longer by one word: their bitmaps shifted and ANDed with those of `ends`.

    The bitmaps worth trying are those that have a bit where the shifted one has; row_of tells each place's row in `ends` (-1: none), last its word.
    """
    shift = phrases.shifted()
    row, place = shift.places()
    inside = np.flatnonzero(place < len(row_of))
    row, place = row[inside], place[inside]
    other = row_of[place]
    keep = np.flatnonzero(other >= 0)
    row, place, other = row[keep], place[keep], other[keep]
    both = shift.bits[row] & ends.bits[other]
    # a pair of rows is met once for each common bit; the lowest stands for it
    once = np.flatnonzero((both & (~both + _ONE)) == _ONE << (place & 63).astype(np.uint64))
    row, place, both = row[once], place[once], both[once]
    return Found(shift.label[row] * n_last + last[place], place >> 6, both, place)


class Filter:
    """Tells of 64-bit keys whether they are among those it was made of; wrong only where it says yes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """keys: a column `key`. The bits are set in Spark; the driver gathers at most FILTER_BITS."""
        bits = 1 << 16
        n = keys.count()
        while bits < min(32 * n, FILTER_BITS):
            bits *= 2
        at = F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))).alias("at")
        slots = keys.select(at).groupBy(F.shiftright("at", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS INT)))").alias("bits"))
        found = slots.toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.words) * 64 - 1)
        out = np.ones(len(keys), bool)
        for at in (keys & mask, (keys >> np.uint64(32)) & mask):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & _ONE).astype(bool)
        return out


def _word_keys(lang: str, words: pa.Array) -> np.ndarray:
    """As xxhash64(lang, word) in SQL; place 0 is for no word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in [b"", *words.cast(pa.binary()).to_pylist()]), np.uint64, len(words) + 1)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << _ONE | b >> np.uint64(63))


def _phrases(words: pa.Array, ids: np.ndarray, place: np.ndarray, size: int) -> pa.Array:
    """The words of phrases of this size that end at the places, joined by spaces."""
    return pc.binary_join_element_wise(*(words.take(pa.array(ids[place - k] - 1)) for k in range(size - 1, -1, -1)), " ")


def _each(all_shards: DataFrame, made: Callable[[str, pa.Array, np.ndarray], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """The rows that `made` gives for the shards' language, words and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                lang, words = batch.column(0)[k].as_py(), batch.column(1)[k].values
                for columns in made(lang, words, np.frombuffer(batch.column(2)[k].as_py(), np.int32)):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return all_shards.select("lang", "words", "places").mapInArrow(run, schema)


def _ranges(labels: np.ndarray) -> Iterator[slice]:
    """Of rows in order of label, about RANGE_ROWS at a time; a label isn't parted."""
    a = 0
    while a < len(labels):
        b = min(a + RANGE_ROWS, len(labels))
        b = int(np.searchsorted(labels, labels[b - 1], "right"))
        yield slice(a, b)
        a = b


def frequent(df: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text", most_words: int = 4) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(totals, phrases, tables): totals (lang, n) counts each language's words; phrases (lang, phrase, size, f) those of 1 to most_words words that occur at least `least` times; tables are to be dropped after use."""
    byte_batches(df.sparkSession)
    base = stored(shards(df, lang_col, text_col), "shards", FILE_SHARDS)
    one = base.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    totals = base.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))
    words1 = stored(one.groupBy("lang", F.col("x.words").alias("phrase")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= least), "words")
    context = df.sparkSession.sparkContext
    ok_words = context.broadcast(Filter.of(words1.select(F.xxhash64("lang", "phrase").alias("key"))))

    def pairs_of(lang: str, words: pa.Array, ids: np.ndarray) -> Iterator[tuple[Found, np.ndarray]]:
        """Pairs of frequent words, over ranges of first words, with the words' keys."""
        keys = _word_keys(lang, words)
        good = ok_words.value(keys)
        good[0] = False
        ids = np.where(good[ids], ids, 0)
        one, row_of = Bitmaps.of_words(ids)
        for part in _ranges(one.label):
            yield extend(one.part(part), one, row_of, ids, len(keys)), keys

    def keyed_pairs(lang: str, words: pa.Array, ids: np.ndarray) -> Iterator[list[pa.Array]]:
        for found, keys in pairs_of(lang, words, ids):
            yield [pa.array(_pair_keys(keys[ids[found.place - 1]], keys[ids[found.place]]).view(np.int64)), pa.array(found.count, pa.int64())]

    sums = _each(base, keyed_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    pairs = stored(sums.select("key"), "pairs")
    ok_pairs = context.broadcast(Filter.of(pairs))

    def phrases(lang: str, words: pa.Array, ids: np.ndarray) -> Iterator[list[pa.Array]]:
        def row(found: Found, size: int) -> list[pa.Array]:
            return [pa.array([lang] * len(found.place), pa.string()), _phrases(words, ids, found.place, size), pa.array(found.count, pa.int64())]

        parts: list[Bitmaps] = []
        row_of = np.full(len(ids), -1, np.int64)
        n = labels = 0
        for found, keys in pairs_of(lang, words, ids):
            found = found.only(ok_pairs.value(_pair_keys(keys[ids[found.place - 1]], keys[ids[found.place]])))
            two = found.bitmaps
            at, place = two.places()
            row_of[place] = at + n
            parts.append(Bitmaps(two.label + labels, two.block, two.bits))
            n, labels = n + len(two.label), labels + len(found.place)
            yield row(found, 2)
        if not n:
            return
        two = Bitmaps(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("label", "block", "bits")))
        for part in _ranges(two.label):
            now = two.part(part)
            for size in range(3, most_words + 1):
                found = extend(now, two, row_of, ids, len(words) + 1)
                if not len(found.place):
                    break
                yield row(found, size)
                now = found.bitmaps

    counted = _each(base, phrases, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    longer = stored(counted.where(F.col("f") >= least), "phrases")
    out = words1.unionByName(longer)
    return totals, out.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), [base, words1, pairs, longer]


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, most_words: int = 4, best: int = 2000, cover: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `best` phrases of 2 to `most_words` words.

    a is how often the phrase occurs (at least `least` times), l and r how often its two parts, n the language's words. score is
    floor(2,000,000 * a / (l + r)) of the cut where it is lowest, ties to the first. Phrases inside a longer frequent one that
    occurs at least `cover` percent as often are left out. Order: score, a, both descending, phrase in byte order.

    Null text: empty. Null language: `und`. Empty table or no frequent phrase: no rows. Repeated rows count each. A text's pieces may be of any
    length; a task holds one piece and a few shards. Other columns are not read.
    """
    totals, f, tables = frequent(df, least, lang_col, text_col, most_words)
    f = f.withColumn("f", F.col("f").cast("decimal(20,0)"))
    w = F.split("phrase", " ")
    long = f.where("size > 1").withColumn("w", w)
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = long.select("lang", "phrase", "size", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("2000000 * a div (l + r)").alias("score"), "k", "l", "r")).alias("m"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda a: F.array_join(F.slice("w", a, n), " "))))
    covers = long.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(F.expr(f"above IS NULL OR 100 * above < {int(cover)} * a"))
    order = [F.col("m.score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    first = kept.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    out = stored(ranked.join(totals, "lang").select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in ("a", "m.l", "m.r", "n", "m.score")]), "collocations")
    for t in tables:
        drop(t)
    return out


#: The same rows in SQL.
ORACLE = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM piece),
grams AS (SELECT lang, k AS size, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k),
total AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY lang, phrase, size HAVING count(*) >= 30),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS rest FROM long, (VALUES (1), (2), (3)) AS s(k) WHERE k < size),
rated AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS score FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS above FROM long, (VALUES (1), (2), (3)) AS s(i), (VALUES (2), (3)) AS t(n) WHERE n < size AND i + n - 1 <= size GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.above IS NULL OR CAST(100 AS HUGEINT) * i.above < CAST(80 AS HUGEINT) * b.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
