"""Near-duplicates by SimHash: the fingerprints within a Hamming distance, found by the generalised pigeonhole principle.

The bits are grouped into partitions so that correlated bits stand together. Thresholds t_i >= -1 with
sum(t_i) = distance - partitions + 1 are dealt to the partitions: two fingerprints within the distance then differ in at most t_i
bits of some partition i. Dynamic programming picks the thresholds of the least estimated number of candidates, so a partition of
skewed bits may get -1 (never probed) and an even one more. A fingerprint's probes for t_i are its partition's bits with each set
of t_i bits masked; fingerprints that share a probe are verified. A probe's value that too many share is probed once more on the
bits it leaves out, in distance + 1 parts of which such fingerprints must agree in one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import drop, forget, named, stored, text_batches
from .components import components

#: Fingerprints of one probe's value that are compared at once. More are probed again, LEVELS times at most (each time they agree in more bits, so that few
#: different ones are left); what is more even then is dealt into blocks, and each pair of blocks is compared.
BLOCK, LEVELS = 4096, 2
#: What a probe's row costs in compared pairs.
ROW_COST = 250.0
#: Texts, and shingles of them, whose common shingles are counted at once.
TILE, TILE_SHINGLES = 256, 100_000


def fingerprint(text: str | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 hashes of the word shingles. Fewer words: they are one shingle. None: 0."""
    return _fingerprints_of(_words(text), words_in_shingle, (seed,))[0]


def _fingerprints_of(words: list[bytes], words_in_shingle: int, seeds: tuple[int, ...]) -> list[int]:
    """A fingerprint for each seed."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return [0] * len(seeds)
    if len(words) <= words_in_shingle:
        return [digest(b" ".join(words), seed) for seed in seeds]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -words_in_shingle]]).tolist()
    ends = (ends[words_in_shingle - 1 :] - 1).tolist()
    joined = b" ".join(words)
    total, ones = len(starts), np.zeros((len(seeds), 64), np.int64)
    for i in range(0, total, 1 << 16):
        shingles = [joined[a:b] for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)]
        for k, seed in enumerate(seeds):
            h = np.fromiter(map(digest, shingles, itertools.repeat(seed)), "<u8", len(shingles))
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * x > total, bitorder="little").tobytes(), "little") for x in ones]


def _fingerprints(words_in_shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words_in_shingle, seed) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return run


def _co_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy().astype(np.int64)
        for i in range(0, len(fp), 1 << 16):
            bits = np.unpackbits(fp[i : i + (1 << 16)].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    i, j = np.indices((64, 64)).reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "c"])


def correlated_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of almost equal size; a group starts with the two most correlated bits left and takes the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = list(max(itertools.combinations(sorted(left), 2), key=lambda x: (corr[x], -x[0], -x[1])))
        left -= set(group)
        while len(group) < size:
            b = max(sorted(left), key=lambda x: corr[x, group].sum())
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The least cost, and its thresholds; infinite if there are none. Thresholds t_i >= -1 with the given sum and the least sum of costs[i][t_i + 1], by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                x = (c + row[t + 1], [*ts, t])
                if spent + t not in then or x < then[spent + t]:
                    then[spent + t] = x
        best = then
    return best.get(total, (math.inf, []))


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _plan(nodes: DataFrame, distance: int) -> list[int]:
    """The probes: masks of the bits compared. Partitions and thresholds are those of the least estimated cost: a compared pair counts 1, a probe's row ROW_COST."""
    n = nodes.count()
    rows = nodes.select("fp").mapInArrow(_co_occurrences, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()  # 64 x 64 sums
    both = np.zeros((64, 64))
    for r in rows:
        both[r["i"], r["j"]] = r["c"]
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 1 - 1e-6)
    choices = {m: correlated_groups(both, n, m) for m in sorted({2, 3, 4, (distance + 2) // 2, (3 * distance + 6) // 4, distance + 1}) if 2 <= m <= distance + 1}
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("v")) for m, groups in choices.items() for k, g in enumerate(groups)])).alias("x")
    counts = nodes.select(parts).select("x.*").groupBy("m", "part", "v").count().groupBy("m", "part").agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("c")).collect()
    equal = {(r["m"], r["part"]): float(r["c"]) for r in counts}
    best: tuple[float, list[int]] | None = None
    for m, groups in choices.items():
        costs = []
        for k, g in enumerate(groups):
            # exact for 0; for more, the agreeing pairs times the odds that so many of the partition's bits differ, as if independent
            ways, row = np.zeros(distance + 2), [0.0]
            ways[0] = 1
            for o in differ[g] / (1 - differ[g]):
                ways[1:] += ways[:-1] * o
            agree = max(equal.get((m, k), 0.0), n * n / 2 * float(np.prod(1 - differ[g])))
            for t in range(min(distance, 3) + 1):
                row.append(agree * ways[: t + 1].sum() * math.comb(len(g), t) ** 0.5 + ROW_COST * max(n, 1) * math.comb(len(g), t))
            costs.append(row)
        total, thresholds = allocate(costs, distance - m + 1)
        if thresholds and (best is None or total < best[0]):
            best = total, [_mask(set(g) - set(off)) for g, t in zip(groups, thresholds, strict=True) if t >= 0 for off in itertools.combinations(g, t)]
    return best[1]


@dataclass(frozen=True)
class _Probe:
    """mask: the bits agreed in so far; beside: the masks probed together with it, in order, of which it is the nth; within: what it probes again."""

    mask: int
    nth: int
    beside: tuple[int, ...]
    within: _Probe | None = None

    def again(self, parts: int) -> list[_Probe]:
        left = [b for b in range(64) if not self.mask >> b & 1]
        cuts = [len(left) * k // parts for k in range(parts + 1)]
        masks = tuple(self.mask | _mask(left[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        return [_Probe(m, k, masks, self) for k, m in enumerate(masks)]

    def is_first(self, differ: np.ndarray) -> np.ndarray:
        """Whether this is the first probe that pairs with these differing bits share, at each level: true at one probe for each pair."""
        ok, at = np.ones(len(differ), bool), self
        while at is not None:
            ok &= ((differ[:, None] & np.array(at.beside[: at.nth + 1], np.uint64)) == 0).argmax(axis=1) == at.nth
            at = at.within
        return ok


def _dealt(nodes: DataFrame, masks: list[int], distance: int) -> tuple[DataFrame, list[_Probe]]:
    """Rows (probe, value, cell, fp, node) of the probes' values that at least two nodes share; a row's cell is twice its block pair, plus one if it is of the pair's second block."""
    spark = nodes.sparkSession
    probes = [_Probe(m, k, tuple(masks)) for k, m in enumerate(masks)]
    deal = lambda rows, on: rows.select("fp", "node", F.explode(on).alias("x")).select("x.probe", "x.value", "fp", "node")
    now = deal(nodes, F.array(*[F.struct(F.lit(k).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)]))
    out: DataFrame | None = None
    for level in range(LEVELS + 1):
        sizes = stored(now.groupBy("probe", "value").agg(F.count("*").alias("n")).where("n > 1"), "probe-sizes")
        hot = [r["probe"] for r in sizes.where(F.col("n") > BLOCK).select("probe").distinct().collect()] if level < LEVELS else []  # at most one row a probe
        rows = now.join(sizes.where(F.col("n") <= BLOCK) if hot else sizes, ["probe", "value"])
        out = rows if out is None else out.unionByName(rows)
        if not hot:
            break
        then, first = [], len(probes)
        for k in hot:
            for p in probes[k].again(distance + 1):
                then.append((k, len(probes), _signed(p.mask)))
                probes.append(p)
        table = spark.createDataFrame(then, "probe int, again int, mask long")  # at most (distance + 1) rows a probe of the last level
        crowd = now.join(sizes.where(F.col("n") > BLOCK).select("probe", "value"), ["probe", "value"]).select("probe", "fp", "node")
        now = stored(crowd.join(F.broadcast(table), "probe").select(F.col("again").alias("probe"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp", "node"), "probed-again")
        assert first < len(probes)
    out = out.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # a row's block meets each other one; rows of a block meet in its pair with itself
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda a, b: (a.cast("long") * F.col("blocks") + b) * 2
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.when(o == own, pair(own, own)).when(own < o, pair(own, o)).otherwise(pair(o, own) + 1))
    return out.select("probe", "value", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(cells)).alias("cell"), "fp", "node"), probes


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of _dealt() shuffled and sorted so that those which meet stand together."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("pair", F.shiftright("cell", 1)).repartition(n, "probe", "value", "pair").sortWithinPartitions("probe", "value", "pair", "fp", "node").drop("pair")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, begins of their groups) of sorted rows whose first columns are probe, value and cell; a group is never cut."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int, n: int) -> np.ndarray:
        return np.stack([batch.column(0).to_numpy()[i : i + n], batch.column(1).to_numpy()[i : i + n], batch.column(2).to_numpy()[i : i + n] >> 1], axis=1)

    def whole() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        k = np.concatenate([key(x, 0, x.num_rows) for x in held])
        return rows, np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])

    for batch in batches:
        if not batch.num_rows:
            continue
        k = key(batch, 0, batch.num_rows)
        if held and (key(held[-1], held[-1].num_rows - 1, 1) != k[:1]).any():
            yield whole()
            held = []
        ends = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(ends):
            held.append(batch.slice(0, ends[-1]))
            yield whole()
            held, batch = [], batch.slice(ends[-1])
        held.append(batch)
    if held:
        yield whole()


def _close_pairs(fp: np.ndarray, side: np.ndarray, starts: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows of one group within the distance, a batch for each number of rows between them."""
    n = len(fp)
    sizes = np.diff(np.r_[starts, n])
    end = np.repeat(np.r_[starts[1:], n], sizes)
    across = np.repeat(np.maximum.reduceat(side, starts), sizes) == 1
    at = np.arange(n)
    for d in range(1, n):
        at = at[at + d < end[at]]
        if not len(at):
            return
        a, b = at, at + d
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        ok &= ~across[a] | (side[a] != side[b])  # two blocks' rows are compared across; within a block its pair with itself does it
        yield a[ok], b[ok]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the least root of linked rows the root of each."""
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (then := root[root])).any():
            root[:] = then
        left = root[a] != root[b]
        a, b = a[left], b[left]


def _spanning(distance: int):
    """Links between fingerprints within the distance; of a group's only as many as join what they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches):
            fp, side = rows["fp"].to_numpy().view(np.uint64), rows["cell"].to_numpy() & 1
            root, links = np.arange(len(fp)), []
            for a, b in _close_pairs(fp, side, starts, distance):
                new = root[a] != root[b]
                if new.any():
                    links.append((a[new], b[new]))
                    _join(root, *links[-1])
            a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
            node = rows["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])

    return run


def _candidates(distance: int, probes: list[_Probe]):
    """The rows with another one within the distance in their group; a pair counts only where it first meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches):
            fp, side, probe = rows["fp"].to_numpy().view(np.uint64), rows["cell"].to_numpy() & 1, rows["probe"].to_numpy()
            met = np.zeros(len(fp), bool)
            for a, b in _close_pairs(fp, side, starts, distance):
                new = ~(met[a] & met[b])
                a, b = a[new], b[new]
                for k in np.unique(probe[a]):
                    own = probe[a] == k
                    x, y = a[own], b[own]
                    first = probes[k].is_first(fp[x] ^ fp[y])
                    met[x[first]] = True
                    met[y[first]] = True
            yield from rows.filter(pa.array(met)).combine_chunks().to_batches()

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words_in_shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: `id_col`, fp (the fingerprint as a signed long), component_id (the least id reachable over links of at most `distance` bits, itself included).

    Null and blank texts have fingerprint 0 and link like any other. Equal fingerprints are one node, so copies cost nothing after they are
    counted. Rows with a null id belong to their component, whose id is the least that is not null (null if there is none). Empty table: no rows.
    Other columns are not read. An id column called like an output: ValueError.
    """
    named(id_col, "fp", "component_id")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    fps = stored(rows.mapInArrow(_fingerprints(words_in_shingle, seed), f"id {kind}, fp long"), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.col("fp")), "distinct")
    if not distance:
        return fps.join(distinct, "fp").select(F.col("id").alias(id_col), "fp", F.col("least").alias("component_id"))
    dealt, _ = _dealt(distinct.select("fp", "node"), _plan(distinct, distance), distance)
    roots = components(_grouped(dealt).mapInArrow(_spanning(distance), "a long, b long")).withColumnRenamed("node", "linked")
    found = distinct.join(roots, distinct["fp"] == roots["linked"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = found.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _text_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingle_set(words: list[bytes], words_in_shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different word shingles; fewer words are one shingle."""
    joined = (b" ".join(words[i : i + words_in_shingle]) for i in range(max(1, len(words) - words_in_shingle + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64))


def _text_rows(feature_words: int, seeds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keys, fps = [], np.zeros((batch.num_rows, len(seeds)), np.uint64)
            for i, text in enumerate(batch.column(1)):
                words = _words(text.as_py())
                keys.append(_text_key(words))
                fps[i] = _fingerprints_of(words, feature_words, seeds)
            cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in fps.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *cols], names=["id", "node", *(f"fp{k}" for k in range(len(seeds)))])

    return run


def _shingle_rows(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(text.as_py())
                if _text_key(words) == node:  # another text may have the same id
                    nodes.append(node)
                    sets.append(shingle_set(words, words_in_shingle).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def alike(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets (sorted, of different values) of a and b have the Jaccard similarity."""
    own, other = np.concatenate(a), np.concatenate(b)
    known = np.intersect1d(own, other)

    def matrix(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        sizes = [len(x) for x in sets]
        at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
        hit = known[at] == values if len(known) else np.zeros(len(values), bool)
        out = np.zeros((len(sets), len(known)), np.float32)
        out[np.repeat(np.arange(len(sets)), sizes)[hit], at[hit]] = 1
        return out

    both = matrix(a, own) @ matrix(b, other).T
    union = np.add.outer([len(x) for x in a], [len(x) for x in b]) - both
    return both >= similarity * union - 1e-6 * union


def _exact(distance: int, similarity: float):
    """Links between the candidates of a group whose shingles have the similarity; only as many as join what they link."""

    def linked(fp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        cuts, size = [0], 0
        for i, x in enumerate(sets):
            if i - cuts[-1] >= TILE or size + len(x) > TILE_SHINGLES and i > cuts[-1]:
                cuts.append(i)
                size = 0
            size += len(x)
        tiles = list(zip(cuts, [*cuts[1:], len(sets)], strict=True))
        root, out = np.arange(len(sets)), []
        for k in range(len(tiles)):
            for (a, b), (c, d) in zip(tiles, tiles[k:], strict=False):
                close = (np.bitwise_count(fp[a:b, None] ^ fp[c:d]) <= distance) & (root[a:b, None] != root[c:d])
                x, y = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                if not len(x):
                    continue
                same = alike([sets[a + i] for i in x], [sets[c + j] for j in y], similarity) & close[np.ix_(x, y)]
                for i, j in np.argwhere(same):
                    p, q = a + x[i], c + y[j]
                    if root[p] != root[q]:
                        out.append((p, q))
                        root[root == max(root[p], root[q])] = min(root[p], root[q])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows, starts in _whole_groups(batches):
            fp, node, shingles = rows["fp"].to_numpy().view(np.uint64), rows["node"].combine_chunks(), rows["shingles"]
            links = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)], strict=True):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in shingles[s:e]]
                links += [(s + p, s + q) for p, q in linked(fp[s:e], sets)]
            a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([node.take(a), node.take(b)], names=["a", "b"])

    return run


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words_in_shingle: int = 5, feature_words: int = 2, distance: int = 8, seeds: tuple[int, ...] = (42, 7)) -> DataFrame:
    """One row per input row: `id_col` (of an orderable type, not null), component_id (the least id reachable over links, itself included).

    A link: two texts whose sets of word shingles have a Jaccard similarity of `similarity` or more. Candidates have fingerprints of `feature_words` words
    within `distance` bits for one of the `seeds`, found by the generalised pigeonhole; their shingles are then compared exactly, so no other text is
    linked. Texts of 0.8 have such fingerprints 199 times out of 200 on prose. Texts of the same words are one node, so copies cost nothing after they
    are counted. Null and blank texts are alike. Equal rows get a row each. Empty table: no rows. Other columns are not read.
    """
    named(id_col, "component_id")
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    names = [f"fp{k}" for k in range(len(seeds))]
    found = stored(rows.mapInArrow(_text_rows(feature_words, seeds), f"id {kind}, node binary, {', '.join(f'{n} long' for n in names)}"), "texts")
    nodes = stored(found.groupBy("node").agg(F.min("id").alias("least"), *[F.min(n).alias(n) for n in names]), "nodes")
    near: DataFrame | None = None
    for k, n in enumerate(names):
        own = nodes.select(F.col(n).alias("fp"), "node")
        dealt, probes = _dealt(own, _plan(own, distance), distance)
        # a probe's number is made unique among the seeds
        met = _grouped(dealt).mapInArrow(_candidates(distance, probes), "probe int, value long, cell long, fp long, node binary").withColumn("probe", F.col("probe") * len(names) + k)
        near = met if near is None else near.unionByName(met)
    near = stored(near, "candidates")
    wanted = near.select("node").distinct().join(nodes.select("node", "least"), "node").select("node", F.col("least").alias("id"))
    sets = stored(stored(wanted, "wanted").join(rows, "id").select("node", "text").mapInArrow(_shingle_rows(words_in_shingle), "node binary, shingles binary").dropDuplicates(["node"]), "shingles")
    edges = _grouped(near.join(sets, "node").select("probe", "value", "cell", "fp", "node", "shingles")).mapInArrow(_exact(distance, similarity), "a binary, b binary")
    roots = components(edges).withColumnRenamed("node", "linked")
    drop(near)
    drop(sets)
    rooted = nodes.join(roots, nodes["node"] == roots["linked"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    by = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return found.join(by, "node").select(F.col("id").alias(id_col), "component_id")
