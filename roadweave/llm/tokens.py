"""Exact encoding with a tokenizers file, one encoding for each distinct piece of text a task meets.

A text is cut only where the vocabulary's own splitting can't join what stands on both sides, so that the ids of
the pieces in a row are the ids of the text.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of pieces and ids that a task keeps at most before it starts anew.
MEMO_BYTES = 160_000_000
#: Characters of a text that are encoded at once.
PART = 1 << 20
#: The white space of Unicode, as the vocabulary's patterns understand it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word that the vocabularies' splitting leaves whole: letters that composing keeps and whose small form is one letter (a space may lead where spaces are kept).
_WORD = " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else one of those from U+0100 on, in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """ids(text): the ids that the library's encode(text, add_special_tokens=False) gives, as little-endian unsigned 32-bit integers in bytes.

    A special token's string in a text gets that token's id, as in the library's plain call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        #: What all special tokens' strings begin with; a text that holds it is encoded as it stands.
        self._special = os.path.commonprefix([x["content"] for x in made["added_tokens"] if x["special"]])
        self.vocab_size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        if made.get("normalizer"):
            # white space is dropped and letters lowered: a piece is what stands between spaces and line feeds
            self._pieces = lambda text: text.replace("\n", " ").split(" ")
            self._lowers = True
        else:
            # a word takes the one space before it; the last white space before a word is apart from what precedes it
            self._lowers = False
            self._pieces = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall
        # words of letters alone skip the library's normalizing and splitting and go to its model at once
        self._model, self._letters, self._word = self._tokenizer.model.tokenize, _byte_letters(), re.compile(_WORD).fullmatch
        self._cut = re.compile(f"[^{_WHITE}](?= [^{_WHITE}])").search
        self._memo: dict[str, bytes] = {}
        self._size = 0

    def direct(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, piece: str) -> tuple[str, str]:
        """A piece without a full stop or comma after its last letter, which the splitting always parts; in small ASCII letters if case is dropped."""
        mark = piece[-1:]
        # a capital whose small form ends in a combining mark is no such letter: the splitting joins that with the full stop
        if (mark == "." or mark == ",") and piece[-2:-1].isalpha() and piece[-2] < "\u0250" and len(piece[-2].lower()) == 1:
            piece = piece[:-1]
        else:
            mark = ""
        return (piece.lower() if self._lowers and piece.isascii() else piece), mark

    def _word_ids(self, word: str) -> bytes:
        if self._lowers:
            word = word.strip(" ").lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._letters)
        elif word[0] == " ":
            word = self._letters[32] + word[1:]
        return array("I", [x.id for x in self._model(word)]).tobytes()

    def _learn(self, new: list[str]) -> None:
        memo = self._memo
        stems = list(map(self._stem, new))
        unknown = list({x for x, _ in stems}.union({m for _, m in stems}).difference(memo))
        words = [x for x in unknown if self._word(x)]
        for x in words:
            memo[x] = self._word_ids(x)
            self._size += len(memo[x]) + len(x) + 140
        unknown = list(set(unknown).difference(words)) if words else unknown
        for i in range(0, len(unknown), 1000):
            part = unknown[i : i + 1000]
            e = self._tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, words = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids, np.int64)
            cuts = (np.searchsorted(words, np.arange(len(part) + 1)) * 4).tolist()
            for x, a, b in zip(part, cuts, cuts[1:], strict=False):
                memo[x] = ids[a:b]
            self._size += len(ids) + sum(map(len, part)) + 140 * len(part)
        for x, (stem, mark) in zip(new, stems, strict=True):
            if x not in memo:
                memo[x] = v = memo[stem] + memo[mark]
                self._size += len(x) + len(v) + 140

    def ids(self, text: str) -> bytes:
        if len(text) > 2 * PART:
            return b"".join(map(self._ids, self._parts(text)))
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        if self._special and self._special in text:
            return self.direct(text)
        pieces = self._pieces(text)
        new = list(set(pieces).difference(self._memo))
        if new:
            if self._size > MEMO_BYTES:
                self._memo.clear()
                self._size = 0
                new = list(set(pieces))
            self._learn(new)
        return b"".join(map(self._memo.__getitem__, pieces))

    def _parts(self, text: str) -> Iterator[str]:
        """The text cut before single spaces between words, so that a very long one needs little memory."""
        at = 0
        while found := self._cut(text, at + PART):
            yield text[at : found.start() + 1]
            at = found.start() + 1
        yield text[at:]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each process."""
    return Encoder(path)
