"""Token counts of texts under a unigram vocabulary, by dynamic programming shared along a trie of pre-tokens.

The distinct pre-tokens of what a task reads are inserted in a trie. The forward score of a node (the best sum of log-probabilities of
pieces that spell its prefix) is computed once, when the node is made, from those of the nodes above it; a pre-token's count is stored at
its terminal node. Texts then sum the terminal counts of their pre-tokens. A pre-token longer than MOST_CHARS shares nothing worth keeping:
its forward pass keeps the scores of the last characters that a piece can reach, and it stays out of the trie.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import named

#: Nodes that a task keeps at most before it starts a new trie.
MOST_NODES = 1_500_000
#: Characters of a pre-token that is inserted in the trie at most.
MOST_CHARS = 512
#: Characters of a text that is cut into pre-tokens at once; those of a longer one are taken one after another.
PART = 1 << 20
SPACE = "▁"
#: Log-probability of one byte of a character without a piece, below the rarest piece.
BYTE_PENALTY = 10.0


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with log-probabilities by Zipf's law of their rank (a BPE model's own scores are ranks). Control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (k + 2) for k in range(len(pieces))))
    return {p: -math.log(k + 2) - total for k, p in enumerate(pieces)}


class Trie(dict):
    """Pre-tokens with the pieces of their best segmentation (of equal scores the one of fewer pieces); a new one is inserted when it is looked up.

    Nodes are numbers: one table leads from a node and a character to the next node, and arrays hold each node's forward score and pieces.
    """

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.pieces = pieces
        self._longest = max(map(len, pieces), default=1)
        self._byte = min(pieces.values(), default=0.0) - BYTE_PENALTY
        self._ending = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self._ending.add_word(piece, (len(piece), score))
        self._ending.make_automaton()
        self._start()

    def _start(self) -> None:
        self.clear()
        self._next: dict[int, int] = {}
        self._score, self._count = array("d", [0.0]), array("q", [0])

    def __missing__(self, word: str) -> int:
        if len(word) > MOST_CHARS:
            return self._long(word)
        if len(self._score) > MOST_NODES:
            self._start()
        marked = SPACE + word
        follow, all_scores, all_counts = self._next, self._score, self._count
        # down the trie as far as it goes
        node, scores, counts = 0, [0.0], [0]
        for char in marked:
            below = follow.get(node << 21 | ord(char))
            if below is None:
                break
            node = below
            scores.append(all_scores[node])
            counts.append(all_counts[node])
        known, size = len(scores) - 1, len(marked)
        if known < size:
            found = self._ending.iter(marked, max(0, known + 1 - self._longest)) if self.pieces else ()
            for last, (n, piece) in found:
                if last < known:
                    continue
                while len(scores) < last + 2:
                    self._by_bytes(marked, scores, counts)
                score, count = scores[last + 1 - n] + piece, counts[last + 1 - n] + 1
                if score > scores[last + 1] or score == scores[last + 1] and count < counts[last + 1]:
                    scores[last + 1], counts[last + 1] = score, count
            while len(scores) <= size:
                self._by_bytes(marked, scores, counts)
            for k in range(known, size):
                follow[node << 21 | ord(marked[k])] = node = len(all_scores)
                all_scores.append(scores[k + 1])
                all_counts.append(counts[k + 1])
        self[word] = count = counts[size]
        return count

    def _long(self, word: str) -> int:
        """The pieces of a long word, by a forward pass in a ring of as many scores as the longest piece has characters."""
        size, marked = self._longest + 1, SPACE + word
        scores, counts, known = [0.0] * size, [0] * size, 0
        best: tuple[float, int] | None = None

        def step() -> None:
            nonlocal known, best
            if best is None:
                char = marked[known]
                n = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
                best = scores[known % size] + self._byte * n, counts[known % size] + n
            known += 1
            scores[known % size], counts[known % size] = best
            best = None

        for last, (n, piece) in self._ending.iter(marked) if self.pieces else ():
            while known < last:
                step()
            at = (last + 1 - n) % size
            found = scores[at] + piece, counts[at] + 1
            if best is None or found[0] > best[0] or found[0] == best[0] and found[1] < best[1]:
                best = found
        while known < len(marked):
            step()
        return counts[known % size]

    def _by_bytes(self, marked: str, scores: list[float], counts: list[int]) -> None:
        """The next prefix, its last character as bytes."""
        char = marked[len(scores) - 1]
        n = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
        scores.append(scores[-1] + self._byte * n)
        counts.append(counts[-1] + n)


def _pre_tokens(text: str) -> Iterator[str]:
    """The runs without white space; of a long text one at a time."""
    return iter(text.split()) if len(text) <= PART else (m.group() for m in re.finditer(r"\S+", text))


_trie: Trie | None = None


def _trie_of(pieces: dict[str, float]) -> Trie:
    """The process's trie, which later tasks go on with."""
    global _trie
    if _trie is None or _trie.pieces is not pieces:
        _trie = Trie(pieces)
    return _trie


def count_tokens(df: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, n_tokens, n_pretokens (runs without white space). Null or blank text: 0 and 0. A character without a piece counts its
    UTF-8 bytes. Rows are counted where they are read, without a shuffle; whole texts. Repeated rows and null ids each get a row. Empty table: no rows.
    Other columns are not read. An id column called like an output: ValueError."""
    named(id_col, "n_tokens", "n_pretokens")
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _trie_of(shared.value).__getitem__
        for batch in batches:
            tokens, words = [], []
            for text in batch.column(1):
                n_tokens = n_words = 0
                for n_words, word in enumerate(_pre_tokens(text.as_py() or ""), 1):  # noqa: B007
                    n_tokens += count(word)
                tokens.append(n_tokens)
                words.append(n_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], names=[id_col, "n_tokens", "n_pretokens"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, n_tokens long, n_pretokens long")
