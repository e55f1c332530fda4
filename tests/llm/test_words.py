"""Collocations, periodic runs and byte-level BPE against brute force."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from roadweave.llm import byte_bpe, collocations, periodic_runs
from roadweave.llm.byte_bpe import Codec
from roadweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CLASHING = ("n", "f", "words", "runs", "ids", "_id", "_row", "_text", "_k", "phrase", "label", "places")


def frame(spark, rows, kind="doc_id long, text string, lang string"):
    """Documents with columns in the way of the operators' own."""
    return spark.createDataFrame(rows, kind).withColumns({n: F.lit(7) for n in CLASHING})


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- byte-level BPE ---------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


PARTS = ["a", "B", " ", "  ", "\t", "'s", "'ll", "'", "1", "٣", "é", "日", "\n", "\r\n", ".", "!", "''", "\x1c", "\x85", " ", "é", "😀", "<|endoftext|>", "x" * 9]


def test_ids_of_any_characters(reference):
    enc, r = Codec(RANKS, PATTERN), random.Random(1)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0):
            text = f"a{chr(c)}b 1{chr(c)}2 {chr(c)} ."
            assert np.frombuffer(enc.ids(enc.split(text)), "<u4").tolist() == reference(text), hex(c)
    for _ in range(5000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(enc.ids(enc.split(text)), "<u4").tolist() == reference(text), text


def test_letters_of_later_editions(reference):
    """Each character beside a letter, a number and neither, by ranks in which the two are one piece: split as the library's edition of Unicode says."""
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    enc = Codec(RANKS, PATTERN)
    for before in "a1.\n":
        ranks = {bytes([i]): i for i in range(256)}
        ranks |= {(before + c).encode(): i for i, c in enumerate(chars, 256)}
        ids = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        assert [c for c in chars if (len(ids(before + c)) == 1) != (len(enc.split(before + c)) == 1)] == []
    text = "\u01ab\U0003f35a\u9516 a\U00032408\u8a65 \u0558\u0561 1\U00011de02"
    assert np.frombuffer(enc.ids(enc.split(text)), "<u4").tolist() == reference(text)
    assert enc.split(text, 3) == enc.split(text[3:])


def test_a_long_piece(reference):
    text = "ab" * 30_000 + " " * 5000 + "x"
    enc = Codec(RANKS, PATTERN)
    assert np.frombuffer(enc.ids(enc.split(text)), "<u4").tolist() == reference(text)


def test_chunks_meet_at_boundaries_of_the_whole_text():
    """Whatever the chunks, the pieces are those of the text, or some seam is refused."""
    enc, r, held, refused = Codec(RANKS, PATTERN), random.Random(2), 0, 0
    for _ in range(20_000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(1, 60)))
        size, overlap = r.choice([(5, 3), (8, 4), (20, 6), (16, 16), (40, 12)])
        made = []
        for a in range(0, len(text), size):
            head = min(a, overlap)
            made.append(enc.chunk(text[a - head : a + size + overlap], head, min(size, len(text) - a), overlap, a + size >= len(text)))
        if None in made:
            refused += 1
        else:
            held += len(made) > 1
            assert [p for m in made for p in m] == enc.split(text)
    assert held > 1000 and refused > 1000


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 14, 256), (64, 16), (7, 2), (1, 1)])
def test_encoding_and_decoding(spark, documents, reference, chunk, overlap):
    long = " ".join(t for _, t in documents[:20])
    rows = documents[: 40 if chunk < 64 else None] + [(None, "a null id"), (None, None), (9001, ""), (9002, long), (9002, long), (9003, "a" * 3000), (9003, " " * 500 + "é" * 700), (9004, "".join(PARTS) * 20)]
    out = byte_bpe.encode_documents(frame(spark, [(i, t, "en") for i, t in rows]), RANKS, PATTERN, chunk=chunk, overlap=overlap)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    both = byte_bpe.decode_documents(out, RANKS, PATTERN).collect()
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in both)
    assert got == sorted((str(i), np.array(reference(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted(r.n_tokens for r in out.collect()) == sorted(len(reference(t or "")) for _, t in rows)


def test_decoding_any_ids(spark):
    """Bytes come back also where they are no text."""
    rank = Codec(RANKS, PATTERN)._rank
    ids = np.array([rank[bytes([b])] for b in (0xFF, 0xC3, 0x28)], "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids)), (2, None)], "doc_id long, ids binary")
    assert sorted((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode_documents(df, RANKS, PATTERN).collect()) == [(1, b"\xff\xc3\x28"), (2, b"")]


def test_bpe_of_no_rows_and_names_taken(spark):
    assert not byte_bpe.encode_documents(frame(spark, []), RANKS, PATTERN).collect()
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(frame(spark, []), RANKS, PATTERN, id_col="ids")
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(frame(spark, []), RANKS, PATTERN, overlap=0)


def test_registered_bpe(spark, reference):
    """Texts of several chunks among them."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    df = QUERIES["op13_byte_bpe"](spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    want = []
    for i, t in rows:
        ids = reference(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


# --- periodic runs ----------------------------------------------------------


def brute_runs(x, least_length, least_exponent):
    n, out = len(x), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least_length, least_exponent * p) and all(any(x[k] != x[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_any_words():
    r = random.Random(3)
    for _ in range(8000):
        x = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 40))]
        if x and r.random() < 0.6:
            p, s = r.randint(1, 6), r.randrange(len(x))
            for i in range(s, len(x)):
                x[i] = x[s + (i - s) % p]
            if r.random() < 0.5:
                x = x + x[::-1] + x
        for length, exponent in ((6, 4), (2, 2), (3, 3), (5, 2.5)):
            assert periodic_runs.find_runs(x, length, exponent) == brute_runs(x, length, exponent), x


class Counted(int):
    """A word that counts its comparisons."""

    seen = 0
    __hash__ = int.__hash__

    def __lt__(self, other):
        Counted.seen += 1
        return int(self) < int(other)

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def _nested(n):
    s, k = [0], 1
    while len(s) < n:
        s, k = s * 3 + [k], k + 1
    return s[:n]


@pytest.mark.parametrize("make", [
    lambda n: [0] * n, lambda n: [0, 1] * (n // 2), _fibonacci, _nested, lambda n: [-k for k in _nested(n)], lambda n: [bin(i).count("1") & 1 for i in range(n)],
    lambda n: [random.Random(i // 7).randrange(2) for i in range(n)], lambda n: [random.Random(i % (n // 5)).randrange(3) for i in range(n)],
])
def test_work_is_linear(make):
    per_word = []
    for n in (2000, 32_000):
        x = list(map(Counted, make(n)))
        Counted.seen = 0
        periodic_runs.lyndon_edges(x, 2)
        per_word.append(Counted.seen / len(x))
    assert per_word[1] < 7 and per_word[1] < 1.1 * per_word[0]


def brute_row(doc_id, text, plant):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 6, 4)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    text = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_run_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a a"), (None, None), (5, "x y " * 9), (5, "x y " * 9), (6, "a b a b a b a b c c c c c c c b a"), (7, "é\xa0é " * 8 + "é"), (8, "w " * 20_000), (9, "\x1c \x1c\x85 " * 7)]
    out = periodic_runs.runs(frame(spark, [(i, t, None) for i, t in rows]))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in out.collect())
    want = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = brute_runs(w, 6, 4) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for s, size, p in runs for k in range(s + p, s + size)}
        want.append((str(i), runs, " ".join(x for k, x in enumerate(w) if k not in gone).encode()))
    assert got == sorted(want)
    assert not periodic_runs.runs(frame(spark, [])).collect()
    with pytest.raises(ValueError):
        periodic_runs.runs(frame(spark, []), min_exponent=1)
    with pytest.raises(ValueError):
        periodic_runs.runs(frame(spark, []).withColumnRenamed("doc_id", "collapsed"), "collapsed")


def test_registered_runs(spark, documents):
    """Whole table; the brute force takes texts of up to 1,500 words."""
    df = QUERIES["op12_periodic_runs"](spark, SF)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(df.dtypes) == {n: "string" if "sha" in n else "bigint" for n in names}
    got = {r.doc_id: tuple(r) for r in df.select(*names).collect()}
    assert len(got) == len(documents)
    short = [(i, t) for i, t in documents if len((t or "").split()) < 1500]
    assert len(short) > 150 and sum(got[i][1] > 0 for i, _ in short) > 10
    for i, t in short:
        assert got[i] == brute_row(i, t, True)


# --- collocations -----------------------------------------------------------


def brute_collocations(rows, least, best=2000, cover=80, most=4):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for size in range(1, most + 1):
                count[lang].update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in count.items():
        f = {p: n for p, n in f.items() if n >= least}
        above = collections.Counter()
        for p, n in f.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    q = " ".join(w[i : i + size])
                    above[q] = max(above[q], n)
        rated = []
        for p, a in f.items():
            w = p.split(" ")
            if len(w) > 1 and 100 * above[p] < cover * a:
                cuts = [(2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                rated.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rated)[:best], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    words = ["of", "the", "The", "a", "é", "ÄB", "日本", "\x1c", "x\x00", "<|", "'s", "\xa0"]
    rows = [(" ".join(r.choices(words, [9, 9, 3, 5, 2, 1, 1, 1, 1, 1, 1, 1], k=r.randint(0, 60))).replace("a ", r.choice(["a. ", "a\t", "a\n", "a  ", "a,", "a "]), 3), r.choice(["en", "de", None, "und", "EN"])) for _ in range(400)]
    rows += [(None, "en"), ("", None), ("no end", "en"), ("new york city hall, " * 70, "en"), ("the " * 300, "de"), ("?!.", "xx")]
    return rows + rows[:50]


@pytest.mark.parametrize(("shard", "part", "rows_at_once"), [(1 << 20, 1 << 22, 1 << 18), (100, 64, 50), (7, 10, 3)])
def test_collocations(spark, texts, monkeypatch, shard, part, rows_at_once):
    """Shards, parts of texts and ranges of any size give the same rows."""
    if shard == 7:
        texts = texts[::4]
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "TEXT_BYTES", part)
    monkeypatch.setattr(collocations, "RANGE_ROWS", rows_at_once)
    least = 5
    df = frame(spark, [(k, t, c) for k, (t, c) in enumerate(texts)]).repartition(3)
    got = collocations.collocations(df, least=least).collect()
    assert sorted(map(tuple, got)) == brute_collocations(texts, least)


def test_best_only_and_other_sizes(spark, texts):
    df = frame(spark, [(k, t, c) for k, (t, c) in enumerate(texts)])
    assert sorted(map(tuple, collocations.collocations(df, least=3, best=4, cover=50, most_words=3).collect())) == brute_collocations(texts, 3, 4, 50, 3)
    assert not collocations.collocations(df, least=10**6).collect()
    assert not collocations.collocations(frame(spark, [])).collect()


def test_a_full_filter_loses_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    always = collocations.Filter(np.full(1, ~np.uint64(0)))
    monkeypatch.setattr(collocations.Filter, "of", classmethod(lambda cls, keys: always))
    df = frame(spark, [(k, t, c) for k, (t, c) in enumerate(texts)])
    assert sorted(map(tuple, collocations.collocations(df, least=4).collect())) == brute_collocations(texts, 4)


def test_bitmaps_of_dense_words():
    """All 64 places of a block, and both sides of a block's end."""
    ids = np.array([1] * 200 + [0] + [1, 2] * 100 + [0], np.int32)
    one, row_of = collocations.Bitmaps.of_words(ids)
    two = collocations.extend(one, one, row_of, ids, 3)
    count = {(int(ids[p - 1]), int(ids[p])): int(n) for p, n in zip(two.place, two.count, strict=True)}
    assert count == {(1, 1): 199, (1, 2): 100, (2, 1): 99}


def test_exact_arithmetic(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 3 * 10**15
    f = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "c", 1, big), ("en", "a b c", 3, big * 8 // 10 - 1), ("en", "b c", 2, big)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 5 * 10**15)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent", lambda *a: (totals, f, []))
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.collocations(None).collect()}
    def score(a, left, right):
        return 2_000_000 * a // (left + right)
    assert got["a b"] == (big - 1, big + 1, big, score(big - 1, big + 1, big))
    assert got["b c"] == (big, big, big, 1_000_000)
    a = big * 8 // 10 - 1
    assert got["a b c"] == min([(a, big + 1, big, score(a, big + 1, big)), (a, big - 1, big, score(a, big - 1, big))], key=lambda x: x[3])


def test_shards_are_read_a_few_at_once(spark, monkeypatch):
    """Readers hold a file's rows at once, so that a task's many shards lie in many files; and a worker gets few of them in a batch."""
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        df = frame(spark, [(i, "a b c d e f g h i j " * 5, "en") for i in range(40)]).coalesce(1)
        base = collocations.frequent(df, 3)[2][0]
        sizes = [x["count"] for x in base.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) >= 40 and max(sizes) <= collocations.FILE_SHARDS
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.set(name, before)


def test_registered_collocations(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    df = QUERIES["op11_collocations"](spark, SF)
    assert dict(df.dtypes) == {n: "string" if n in ("lang", "phrase") else "bigint" for n in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")}
    assert sorted(map(tuple, df.collect())) == brute_collocations(rows, 30)
