"""Language of texts whose words may switch language, by a linear-chain conditional random field over words.

A word's score for each language is the sum of the learned weights of its features: the word itself if it is in the lexicon, its
affixes, its character n-grams and its script. Learned transitions join neighbouring words. Forward-backward gives each word's
probabilities; a text's language has the largest sum of them, each word weighted by its letters, and the share is the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

UND = "und"
#: Rows with a label that training reads at most; those of the smallest hash, so the same ones at any partitioning.
TRAIN_ROWS = 2_000
#: Words of a training row that are used at most, in spans of SPAN words that its hash draws from the whole text (training only; prediction reads whole texts).
TRAIN_WORDS, SPAN = 120, 20
BUCKETS = 1 << 17
#: Words that a task remembers at most.
MEMO = 150_000
#: Characters that are labelled at once.
PART = 500_000
#: Words between cuts of the recursion; see Model.posteriors.
BLOCK = 64

#: A word is a run of letters; CJK letters, kana and Thai, written without spaces, are words of one letter.
_SINGLE = "฀-๿぀-ヿ㐀-鿿豈-﫿"
_LONE = re.compile(f"[{_SINGLE}]")
_WORD = re.compile(rf"[{_SINGLE}]|(?:(?![{_SINGLE}])[^\W\d_])+")
#: The same words where no letter stands alone.
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (_WORD if not text.isascii() and _LONE.search(text) else _RUN).findall(text)


#: Multiplier of the grams' rolling hashes: odd, about 2^64 over the golden ratio.
_TURN = np.uint64(0x9E3779B97F4A7C15)


def features_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features one word after the other, their number for each word), for words that aren't empty.

    Prefixes and suffixes, n-grams of two and three letters with the word's ends marked, and the block of the first letter are hashed
    to BUCKETS; the lexicon's words have a feature of their own after those.
    """
    lowered = [w.lower() for w in words]
    cp = np.frombuffer("".join(f"^{w}$" for w in lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, lowered), np.int64, len(words)) + 2
    start = np.cumsum(n) - n
    own = np.fromiter((lexicon.get(w, -1) for w in lowered), np.int64, len(words))
    # grams[k][i]: the bucket of the k letters from i on
    padded = np.concatenate([cp, np.zeros(5, np.uint64)])
    rolled, grams = cp.copy(), {}
    for k in range(2, 6):
        rolled = rolled * _TURN + padded[k - 1 : k - 1 + len(cp)]
        grams[k] = _bucket(rolled)
    counts = 5 + (n - 1) + np.maximum(n - 4, 0) + (own >= 0)
    out = np.cumsum(counts) - counts
    flat = np.empty(counts.sum(), np.int64)
    # of words shorter than an affix the whole is taken
    whole = np.where(n >= 4, grams[4][start], grams[3][start])
    flat[out] = grams[3][start]
    flat[out + 1] = whole
    flat[out + 2] = np.where(n >= 4, grams[4][np.maximum(start + n - 4, 0)], whole)
    flat[out + 3] = np.where(n >= 5, grams[5][np.maximum(start + n - 5, 0)], whole)
    flat[out + 4] = _bucket((cp[start + 1] >> np.uint64(7)) + np.uint64(1 << 40))
    nth = np.arange(len(cp)) - np.repeat(start, n)
    left, to = np.repeat(n, n) - nth, np.repeat(out + 5, n) + nth
    two = left >= 2
    flat[to[two]] = grams[2][two]
    three = (nth >= 1) & (left >= 4)
    flat[(to + np.repeat(n - 2, n))[three]] = grams[3][three]
    known = own >= 0
    flat[(out + counts - 1)[known]] = BUCKETS + own[known]
    return flat, counts


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _TURN
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Model:
    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    _memo: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language. Each distinct word is scored once."""
        new = list(set(words).difference(self._memo))
        if new:
            if len(self._memo) + len(new) > MEMO:
                self._memo.clear()
                self._rows = None
                new = list(set(words))
            flat, counts = features_of(new, self.lexicon)
            rows = np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
            at = len(self._memo)
            self._memo.update(zip(new, range(at, at + len(new)), strict=True))
            self._rows = rows if self._rows is None else np.concatenate([self._rows, rows])
        return self._rows[np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))]

    def posteriors(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Forward-backward over all sequences at once: scores (words x languages), starts of the sequences.

        Words are cut into blocks of BLOCK. The recursion through a block is a matrix, made for all blocks in step; the blocks of a
        sequence are then chained, and the recursion within all blocks is done in step. The result is that of the plain recursion.
        """
        n, k = scores.shape
        move = np.exp(self.transitions - self.transitions.max())
        e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
        sizes = np.diff(np.r_[starts, n])
        blocks = -(-sizes // BLOCK)
        seq = np.repeat(np.arange(len(starts)), blocks)
        first = np.cumsum(blocks) - blocks
        nth = np.arange(len(seq)) - first[seq]
        base = starts[seq] + nth * BLOCK
        size = np.minimum(BLOCK, starts[seq] + sizes[seq] - base)
        # cells past a block's end take the identity
        at = base[:, None] + np.arange(BLOCK)
        inside = np.arange(BLOCK) < size[:, None]
        at = np.where(inside, at, 0)
        whole = np.broadcast_to(np.eye(k), (len(seq), k, k)).copy()
        for t in range(BLOCK):
            live = inside[:, t]
            if not live.any():
                break
            m = (whole[live].reshape(-1, k) @ move).reshape(-1, k, k) * e[at[live, t]][:, None, :]
            whole[live] = m / m.sum(axis=(1, 2), keepdims=True)
        # chain the blocks of each sequence: what comes in from the left, and from the right
        left, right = np.ones((len(seq), k)), np.ones((len(seq), k))
        for step in range(1, int(blocks.max(initial=1))):
            live = np.flatnonzero(blocks > step)
            i = first[live] + step
            v = np.einsum("ni,nij->nj", left[i - 1], whole[i - 1])
            left[i] = v / v.sum(axis=1, keepdims=True)
            j = first[live] + blocks[live] - 1 - step
            v = np.einsum("nij,nj->ni", whole[j + 1], right[j + 1])
            right[j] = v / v.sum(axis=1, keepdims=True)
        ahead, back = np.empty((n, k)), np.empty((n, k))
        a, b = left, right
        start = nth == 0
        for t in range(BLOCK):
            live = np.flatnonzero(inside[:, t])
            if not len(live):
                break
            v = a[live] @ move
            if t == 0:
                v[start[live]] = 1.0 / k  # no transition into a sequence's first word
            v = v * e[at[live, t]]
            a[live] = v / v.sum(axis=1, keepdims=True)
            ahead[at[live, t]] = a[live]
        for t in range(BLOCK - 1, -1, -1):
            live = np.flatnonzero(inside[:, t])
            if not len(live):
                continue
            back[at[live, t]] = b[live]
            v = (b[live] * e[at[live, t]]) @ move.T
            b[live] = v / v.sum(axis=1, keepdims=True)
        p = ahead * back
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, switches between words' languages) of each text; UND without letters."""
        out: list[tuple[str, float, int]] = [(UND, 0.0, 0)] * len(texts)
        lists = [words_of(t) for t in texts]
        kept = [i for i, own in enumerate(lists) if any(c.isalpha() for w in own for c in w)]  # a fraction or a superscript is no letter
        if not kept:
            return out
        words = [w for i in kept for w in lists[i]]
        sizes = np.array([len(lists[i]) for i in kept])
        starts = np.cumsum(sizes) - sizes
        p = self.posteriors(self.emissions(words), starts)
        letters = np.fromiter(map(len, words), np.float64, len(words))
        share = np.add.reduceat(p * letters[:, None], starts, axis=0) / np.add.reduceat(letters, starts)[:, None]
        tag = p.argmax(axis=1)
        turn = np.r_[False, tag[1:] != tag[:-1]]
        turn[starts] = False
        turns = np.add.reduceat(turn.astype(np.int64), starts)
        for i, row, t in zip(kept, share, turns, strict=True):
            best = int(row.argmax())
            out[i] = (self.langs[best], float(min(1.0, max(0.0, row[best]))), int(t))
        return out


def fit(rows: list[tuple[str, list[str]]], epochs: int = 5, seed: int = 7, lexicon_size: int = 20_000) -> Model:
    """A model from (language, words) rows, by AdaGrad on the conditional log-likelihood of code-switched sequences joined from them.

    A row's words all take its label. Sequences join spans of several rows, so that transitions between languages are learned too.
    """
    langs = sorted({lang for lang, _ in rows})
    of = {lang: i for i, lang in enumerate(langs)}
    seen: dict[str, Counter] = {}
    for lang, words in rows:
        for w in words:
            seen.setdefault(w.lower(), Counter())[lang] += 1
    frequent = sorted((w for w, c in seen.items() if c.total() > 2), key=lambda w: (-seen[w].total(), w))[:lexicon_size]
    lexicon = {w: i for i, w in enumerate(frequent)}
    k = len(langs)
    model = Model(langs, lexicon, np.zeros((BUCKETS + len(lexicon), k)), np.zeros((k, k)))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    distinct = sorted({w for _, words in rows for w in words})
    flat, counts = features_of(distinct, lexicon)
    cache = dict(zip(distinct, np.split(flat, np.cumsum(counts)[:-1]), strict=True))
    feats = [[cache[w] for w in words] for _, words in rows]
    w_sum, t_sum = np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        spans = []
        for r in rng.permutation(len(rows)):
            at, n = 0, len(feats[r])
            while at < n:
                size = int(rng.integers(4, 41))
                spans.append((of[rows[r][0]], feats[r][at : at + size]))
                at += size
        order = rng.permutation(len(spans))
        width = 4
        for b in range(0, len(order), 32 * width):
            # a batch of sequences, each of four spans
            group = order[b : b + 32 * width]
            f, y, starts = [], [], []
            for s in range(0, len(group), width):
                starts.append(len(f))
                for g in group[s : s + width]:
                    f += spans[g][1]
                    y += [spans[g][0]] * len(spans[g][1])
            counts = np.fromiter(map(len, f), np.int64, len(f))
            flat, y = np.concatenate(f), np.array(y)
            scale = 1 / np.sqrt(counts)
            e = np.add.reduceat(model.weights[flat], np.cumsum(counts) - counts, axis=0) * scale[:, None]
            d, dt = _gradient(model.transitions, e, y, np.array(starts))
            rows_at, back = np.unique(flat, return_inverse=True)
            g = np.zeros((len(rows_at), k))
            per = np.repeat(d * scale[:, None], counts, axis=0)
            for j in range(k):
                g[:, j] = np.bincount(back, per[:, j], len(rows_at))
            w_sum[rows_at] += g * g
            model.weights[rows_at] += 0.2 * g / np.sqrt(w_sum[rows_at])
            t_sum += dt * dt
            model.transitions += 0.1 * dt / np.sqrt(t_sum)
    return model


def _gradient(transitions: np.ndarray, e: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood in the words' scores and the transitions; the recursions run in step over the sequences, in logs."""
    n, k = e.shape
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alpha, beta = e.copy(), np.zeros((n, k))
    for t in range(1, int(sizes[0])):
        at = starts[: np.searchsorted(-sizes, -t)] + t
        alpha[at] += _log_sum(alpha[at - 1][:, :, None] + transitions, 1)
    for t in range(int(sizes[0]) - 2, -1, -1):
        at = starts[: np.searchsorted(-sizes, -(t + 1))] + t
        beta[at] = _log_sum(transitions + (e[at + 1] + beta[at + 1])[:, None, :], 2)
    z = np.empty(n)
    z[np.concatenate([np.arange(s, s + m) for s, m in zip(starts, sizes, strict=True)])] = np.repeat(_log_sum(alpha[starts + sizes - 1], 1), sizes)
    d = -np.exp(alpha + beta - z[:, None])
    d[np.arange(n), y] += 1
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + transitions + (e[at] + beta[at])[:, None, :] - z[at][:, None, None])
    dt = -pair.sum(axis=0)
    np.add.at(dt, (y[at - 1], y[at]), 1)
    return d, dt


def spans(words: list[str], seed: int, most: int | None = None) -> list[str]:
    """The words, or of more than `most` (TRAIN_WORDS) so many: spans of SPAN words that the seed draws from all over the text, in its order."""
    most = TRAIN_WORDS if most is None else most
    if len(words) <= most:
        return words
    whole = -(-len(words) // SPAN)
    drawn = np.sort(np.random.default_rng(seed).permutation(whole)[: -(-most // SPAN)])
    return [w for k in drawn.tolist() for w in words[k * SPAN : (k + 1) * SPAN]]


def _training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [spans(words_of(text.as_py()), h & 0xFFFFFFFF) for h, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["lang", "words"])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """A model of at most `rows` labelled texts that hold a letter (at least one of each language), equally many of each language if there are so many,
    chosen by their hash; None without a labelled word.

    Copies of a text count once in a language, however many there are. Every language that occurs is learned: the model has BUCKETS weights for each.
    """
    labelled = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = labelled.where(F.regexp_like("text", F.lit(r"\p{L}"))).withColumn("h", F.xxhash64("text"))
    counts = labelled.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("texts")).collect()  # one row a language
    if not counts:
        return None
    each = max(1, rows // len(counts))
    # a bar on the hash with room to spare, so that few texts are sorted; of those the `each` least hashes stay
    bars = df.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (2.0 * each + 20.0) / r["texts"]) * (1 << 20)) + 1) for r in counts], "lang string, bar int")
    few = labelled.join(F.broadcast(bars), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("bar")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= each)
    found = few.select("lang", "h", "text").mapInArrow(_training_words, "lang string, words array<string>").collect()  # at most `rows` of TRAIN_WORDS words
    found = sorted((r["lang"], r["words"]) for r in found if r["words"])
    return fit(found) if found else None


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and n_switches (neighbouring words of different languages); columns of df with these names are replaced.

    Null text, or text without a letter: UND with score 0. Without a model each text is UND. Whole texts are read. Repeated rows each get a row. Empty table: no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS + lexicon rows of a weight for each language
    names = ("lang_pred", "score", "n_switches")
    kept = df.select(*[F.col(c).cast("string").alias(c) if c == text_col and df.schema[c].dataType != T.StringType() else F.col(c) for c in df.columns if c not in names])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            first, held, size = 0, [], 0
            for i, x in enumerate(batch.column(at)):
                held.append(x.as_py())
                size += len(held[-1] or "")
                if size > PART or i == batch.num_rows - 1:
                    # rows go out as they are labelled, so that no whole batch is held twice
                    rows = m.predict(held) if m else [(UND, 0.0, 0)] * len(held)
                    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, *cols], names=[*batch.schema.names, *names])
                    first, held, size = i + 1, [], 0

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_switches", T.LongType())])
    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that training never reads: crc32 of the id as text is 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
