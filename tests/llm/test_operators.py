"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and clashing names."""

import collections
import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadweave.llm import components, decontamination, html_text, language_id, packing, progressive_jpeg, simhash, suffix_dedup, token_counts, token_files, warc
from roadweave.llm.common import scratch
from roadweave.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", " ", "\n\n a", "a  b\t\tc", "It's 's 'S. 5. ,. a., FOO. Foo, foo", "é é. İ., x\u0085y", "<|endoftext|> x<|startoftext|>", "\x1c! a\x1cb", "日本 語　x", "a" * 3000, "x.\r\n y,  z. ",
]


def docs(spark, rows):
    """Documents with columns in the way of the operators' own."""
    names = ("id", "k1", "anchor", "fp", "root", "key", "_text", "score", "lang_pred", "start", "file")
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return df.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(1)
    long = " ".join(rows[k % len(rows)][1] for k in range(30))
    extra = [(None, "a null id"), (9001, None), (9002, ""), (9003, "x"), (9004, long), (9005, long), (9006, rows[0][1]), (9006, rows[0][1]), (None, None), (9007, "é" * 500), (9008, "é" * 500 + "!")]
    extra += [(9100 + k, " ".join(w for w in rows[k][1].split() if r.random() > 0.02)) for k in range(10)]
    return rows + extra


# --- tokens -----------------------------------------------------------------


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_is_exact(path, corpus):
    e, t = Encoder(path), Tokenizer.from_file(path)
    for text in ODD + [x for _, x in corpus[:60] if x]:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_on_any_characters(path):
    """20,000 strings over all categories of Unicode, dense in marks, capitals of odd small forms and special tokens."""
    r, by = random.Random(5), collections.defaultdict(list)
    for c in map(chr, range(0x110000)):
        by[unicodedata.category(c)].append(c)
    kinds = [k for k in by if k not in ("Cs", "Cn", "Co")]
    often = [*"abcXYZ .,'\n\t019!-İıßé", ". ", ", ", "İ.", "İ,", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]
    e, t = Encoder(path), Tokenizer.from_file(path)
    for _ in range(20_000):
        text = "".join(r.choice(often) if r.random() < 0.65 else r.choice(by[r.choice(kinds)]) for _ in range(r.randint(1, 14)))
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_encoder_cuts_long_texts(monkeypatch, corpus):
    from roadweave.llm import tokens

    monkeypatch.setattr(tokens, "PART", 50)
    monkeypatch.setattr(tokens, "MEMO_BYTES", 5000)
    for path in (WORD, BYTE):
        e = Encoder(path)
        for text in ODD + [x for _, x in corpus[:40] if x]:
            assert e.ids(text) == e.direct(text)


def test_token_files(spark, corpus):
    df = docs(spark, corpus)
    index = token_files.write_tokens(df, scratch(spark, "t"), WORD, 2, parts=3)
    rows = token_files.read_tokens(index).collect()
    t = Tokenizer.from_file(WORD)
    want = collections.Counter((i, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, x in corpus)
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == want
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    file = token_files.TokenFile(index.first()["file"])
    first, mask = file.row(0)
    assert len(first) == file.width == len(mask) and mask.all() and not first.flags.owndata and not mask.flags.owndata
    with pytest.raises(ValueError):
        token_files.write_tokens(df.withColumnRenamed("file", "x").withColumnRenamed("doc_id", "file"), scratch(spark, "t"), WORD, 2, id_col="file")
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0), scratch(spark, "t"), WORD, 2)).count() == 0


def test_token_file_rows_in_any_order(tmp_path):
    w = token_files.TokenWriter(f"file://{tmp_path}/a/x.arrow", np.dtype("<u2"), 8, 3)
    ids = np.arange(1, 101)
    for part in np.split(ids, [1, 2, 50, 51]):
        w.append(part)
    w.close()
    f = token_files.TokenFile(f"file://{tmp_path}/a/x.arrow")
    for k in (12, 0, 7, 3, 11):
        row, mask = f.row(k)
        assert row[mask].tolist() == ids[8 * k : 8 * k + 8].tolist()
    assert f.span(13, 60).tolist() == ids[13:73].tolist()


def test_packing(spark, corpus):
    df = docs(spark, corpus)
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    rows = packing.pack_documents(df, BYTE).collect()
    docs_of, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs_of[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    want = collections.Counter((i, np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, x in corpus)
    for (i, ids), n in want.items():
        if n == 1 and i is not None:
            assert b"".join(bytes(r["ids"]) for r in sorted(docs_of[i], key=lambda r: r["start"])) == ids
            assert {r["doc_tokens"] for r in docs_of[i]} == {len(ids) // 4}
    assert sum(r["length"] for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [0, *np.cumsum([r["length"] for r in s])[:-1].tolist()]
    sizes = [sum(r["length"] for r in s) for s in seqs.values()]
    assert max(sizes) <= 1024 and sum(1024 - x for x in sizes) < 1024 * df.rdd.getNumPartitions()
    assert packing.pack_documents(df.limit(0), BYTE).count() == 0


def test_packing_balances_costs():
    r = random.Random(2)
    lengths = [r.randint(1, 700) for _ in range(400)]
    spent, room = collections.Counter(), collections.Counter()
    for d, start, n, s, offset in packing.pack(lengths, 1024):
        assert offset == room[s]
        room[s] += n
        spent[s] += packing.cost(n)
    assert sum(room.values()) == sum(lengths) and max(room.values()) <= 1024 and len(room) == -(-sum(lengths) // 1024)
    assert max(spent.values()) < 1.6 * sum(spent.values()) / len(spent)


def test_token_counts(spark, corpus):
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.Trie(pieces)

    def brute(word):
        w, best = token_counts.SPACE + word, [(0.0, 0)]
        for e in range(1, len(w) + 1):
            n = len(w[e - 1].encode())
            options = [(-(best[e - 1][0] + trie._byte * n), best[e - 1][1] + n)]
            options += [(-(best[s][0] + pieces[w[s:e]]), best[s][1] + 1) for s in range(e) if w[s:e] in pieces]
            m = min(options)
            best.append((-m[0], m[1]))
        return best[-1][1]

    rows = token_counts.count_tokens(docs(spark, corpus + list(enumerate(ODD, 20_000))), pieces).collect()
    known = {}
    want = collections.Counter()
    for i, x in corpus + list(enumerate(ODD, 20_000)):
        words = (x or "").split()
        want[i, sum(known[w] if w in known else known.setdefault(w, brute(w)) for w in words), len(words)] += 1
    assert collections.Counter(map(tuple, rows)) == want


def test_long_words(monkeypatch):
    """A word longer than MOST_CHARS has the pieces that the trie gives, and stays out of it."""
    r = random.Random(2)
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["".join(r.choice(["a", "the", "ing", "日", "€", "x", "ß", "ation", "zq"]) for _ in range(r.randint(1, 120))) for _ in range(200)]
    want = [token_counts.Trie(pieces)[w] for w in words]
    monkeypatch.setattr(token_counts, "MOST_CHARS", 0)
    trie = token_counts.Trie(pieces)
    assert [trie[w] for w in words] == want and not len(trie)
    assert list(token_counts._pre_tokens(" a\x1cbc\u3000d ")) == ["a", "bc", "d"]
    monkeypatch.setattr(token_counts, "PART", 0)
    assert list(token_counts._pre_tokens(" a\x1cbc\u3000d ")) == ["a", "bc", "d"]


def test_trie_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 20)
    small = token_counts.Trie({"▁": -1.0, "a": -1.0, "b": -2.0, "ab": -1.5, "▁a": -1.2})
    assert [small[w] for w in ("ab", "aab", "bbbbbbbbbbbbbbb", "ab", "zzzzzzzzzz", "ab")] == [2, 2, 16, 2, 11, 2]


# --- suffix arrays ----------------------------------------------------------


def test_suffix_array():
    r = np.random.default_rng(1)
    for k in range(150):
        t = np.tile(r.integers(1, 4, int(r.integers(1, 60))), 1 + k % 4).astype(np.int64)
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_remove_repeats(spark, corpus, monkeypatch, small):
    if small:  # hot anchors, several parts to a shard, deals too large to sort, texts in chunks
        for name, value in (("HOT", 3), ("SHARD_BYTES", 20_000), ("MOST", 9_000), ("CHUNK", 300), ("ROWS", 7)):
            monkeypatch.setattr(suffix_dedup, name, value)
    want = collections.Counter((i, *x) for (i, _), x in zip(corpus, repeats([(x or "").encode() for _, x in corpus], 200), strict=True))
    rows = suffix_dedup.remove_repeats(docs(spark, corpus)).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == want
    assert suffix_dedup.remove_repeats(docs(spark, corpus).limit(0)).count() == 0


def test_remove_repeats_within_one_text(spark):
    period = [(1, "abcdefg" * 100), (2, "z" * 199), (3, "q" * 201), (4, "".join(map(str, range(400))))]
    rows = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs(spark, period)).collect()}
    assert rows == {1: 700, 2: 0, 3: 201, 4: 0}


# --- near-duplicates --------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [4096, 3])
def test_near_duplicates(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [(i, t) for i, t in corpus if i != 9006] + [(9006, corpus[0][1])] * 2 + [(20_000 + k, "\x1c \t" if k % 2 else " ") for k in range(4)]
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    want = collections.Counter((i, fps[a] - (1 << 64) if fps[a] >> 63 else fps[a], least.get(find(a))) for a, (i, _) in enumerate(rows))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs(spark, rows)).select("doc_id", "fp", "component_id").collect())) == want
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("distance", [0, 1])
def test_near_duplicates_within_few_bits(spark, corpus, distance):
    rows = [(i, t) for i, t in corpus if i is not None][:120]
    got = {r["fp"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), distance=distance).collect()}
    fps = list(got)
    assert all((got[a] == got[b]) == (a == b) for a in fps for b in fps) if not distance else all(got[a] == got[b] for a in fps for b in fps if (a ^ b).bit_count() <= 1)


def test_crowded_probes(spark, monkeypatch):
    """Fingerprints that share most bits are probed again, and every link is found; a pair of candidates meets once."""
    r = random.Random(8)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = r.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in r.sample(range(40), r.choice([1, 2, 5, 9]))) for _ in range(400)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) * 2 for f in fps], "fp long, node long")
    dealt, probes = simhash._dealt(nodes, simhash._plan(nodes, 3), 3)
    assert any(p.within for p in probes)
    links = simhash._grouped(dealt).mapInArrow(simhash._spanning(3), "a long, b long")
    got = {x["node"]: x["root"] for x in components.components(links).collect()}
    edges = [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = {x["node"]: x["root"] for x in components.components(spark.createDataFrame([(signed(a), signed(b)) for a, b in edges], "a long, b long")).collect()}
    assert got == want
    met = simhash._grouped(dealt).mapInArrow(simhash._candidates(3, probes), "probe int, value long, cell long, fp long, node long").collect()
    groups = collections.defaultdict(set)
    for x in met:
        groups[x["probe"], x["value"], x["cell"] >> 1].add(x["fp"])
    assert all(any({signed(a), signed(b)} <= g for g in groups.values()) for a, b in edges)


def test_alike():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = simhash.alike(sets[:25], sets[25:], 0.6)
    assert all(got[i, j] == (len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b))) for i, a in enumerate(sets[:25]) for j, b in enumerate(sets[25:]))


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_probes_meet_every_pair(spark, parts):
    """Whatever thresholds are dealt, fingerprints within the distance share a probe."""
    r = random.Random(parts)
    groups = simhash.correlated_groups(np.diag([50.0] * 64), 100, parts)
    assert sorted(b for g in groups for b in g) == list(range(64))
    for _ in range(20):
        costs = [[0.0] + sorted(r.random() for _ in range(4)) for _ in groups]
        _, t = simhash.allocate(costs, 3 - parts + 1)
        assert sum(t) == 3 - parts + 1 and min(t) >= -1
        for _ in range(50):
            off = set(r.sample(range(64), 3))
            assert any(len(off & set(g)) <= k for g, k in zip(groups, t, strict=True))


def jaccard(a, b):
    words = (a or "").lower().split(), (b or "").lower().split()
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [4096, 5])
def test_similar_documents(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(9)
    rows = [(i, t) for i, t in corpus if i is not None]
    base = [t for _, t in rows if t and 80 < len(t.split()) < 600][:12]
    rows += [(50_000 + 10 * k + j, " ".join(w if r.random() > 0.012 else f"new{r.randrange(9999)}" for w in t.split())) for k, t in enumerate(base) for j in range(4)]
    got = dict(map(tuple, simhash.similar_documents(docs(spark, rows)).collect()))
    groups = collections.defaultdict(set)
    for i, c in got.items():
        groups[c].add(i)
    assert all(min(g) == c for c, g in groups.items())
    texts = dict(rows)
    pairs = [(a, b, jaccard(texts[a], texts[b])) for a in texts for b in texts if a < b and abs(len(texts[a] or "") - len(texts[b] or "")) < 0.5 * len(texts[a] or "x")]
    near = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(near) > 30 and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    linked = {(a, b) for a, b, j in pairs if j >= 0.8} | {(b, a) for a, b, j in pairs if j >= 0.8}
    for g in groups.values():
        for a in g:
            assert len(g) == 1 or any((a, b) in linked or (texts[a] or "").split() == (texts[b] or "").split() for b in g if b != a)
    assert simhash.similar_documents(docs(spark, rows).limit(0)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}}


# --- benchmark passages -----------------------------------------------------


def test_overlaps(spark, corpus):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    r = random.Random(4)
    planted = []
    for k, (i, x) in enumerate(items[:20]):
        w = x.split()
        for j in range(len(w) // 7):  # one word in seven is another one
            w[7 * j + r.randrange(7)] = f"other{r.randrange(1000)}"
        planted.append((30_000 + k, f"some words before {' '.join(w).upper()} and some after", i))
    rows = corpus + [(i, x) for i, x, _ in planted] + [(40_000, items[0][1]), (40_000, items[0][1]), (40_001, None), (40_002, " ")]
    tests = spark.createDataFrame([*items, (900, items[3][1]), (901, None), (902, "two words")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontamination.overlaps(docs(spark, rows), tests).collect()}
    assert {(i, k) for i, _, k in planted} <= set(got) and (40_000, items[0][0]) in got
    words = lambda x: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", x.lower()).split()
    for i, x in rows:
        if i is not None and i < 30_000:
            w, found = words(x or ""), {k for d, k in got if d == i}
            for k, y in items:
                u = words(y)
                same = max((sum(a == b for a, b in zip(u, w[s : s + len(u)], strict=False)) for s in range(len(w))), default=0)
                assert same < len(u) or k in found, (i, k)  # whole passages are found
                assert k not in found or same >= 0.8 * min(len(u), 13), (i, k)
    assert decontamination.overlaps(docs(spark, rows).limit(0), tests).count() == 0
    assert decontamination.overlaps(docs(spark, rows), tests.limit(0)).count() == 0


def test_overlaps_with_words_changed(spark):
    r = random.Random(6)
    items, rows = [], []
    for n in [1, 2, 3, 4] + [5, 6, 7, 9, 10, 11, 12] * 2 + [*range(13, 21)] * 3 + [40, 40]:
        w = [f"w{r.randrange(10**6)}" for _ in range(n)]
        items.append((len(items), w))
        for k in range(12):
            out = list(w)
            changes = n // 5 if k < 9 else n // 5 + 1  # the least similarity, and one word less
            places = [r.sample(range(n), changes), [x for x in (1, n - 2, 3, n - 4, 0, n - 1, *range(5, n - 5)) if 0 <= x < n][:changes], [*range(3, n, 4)][:changes]][min(k, 2) if k < 3 else 0]
            for x in places:
                out[x] = "other"
            before, after = (["so"] * r.randrange(4), ["on"] * r.randrange(4)) if k % 3 else ([], [])
            rows.append((len(rows), before + out + after))
    w = items[-1][1]
    rows += [(len(rows), w[:12] + ["x", "y"]), (len(rows) + 1, w[3:15] + ["x", "y", "z"]), (len(rows) + 2, items[20][1][:11]), (len(rows) + 3, items[0][1] * 50)]

    def alike(doc, item):
        least = min(13, len(item))
        for d in range(-len(item), len(doc)):
            same = [x == doc[i + d] if 0 <= i + d < len(doc) else None for i, x in enumerate(item)]
            if same.count(True) >= 0.8 * len(item):
                return True
            same = [x for x in same if x is not None]
            if any(sum(same[a:b]) >= 0.8 * (b - a) - 1e-9 for a in range(len(same)) for b in range(a + least, len(same) + 1)):
                return True
        return False

    want = {(i, k) for i, x in rows for k, y in items if set(x) & set(y) and alike(x, y)}
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    found = decontamination.overlaps(docs(spark, [(i, " ".join(x)) for i, x in rows]), tests).collect()
    got = {(x["doc_id"], x["item_id"]) for x in found}
    assert len(want) > 300 and (len(rows) - 3, len(items) - 1) in want
    assert got == want, (len(want), len(want - got), len(got - want))
    assert all(x["n_same"] >= 0.8 * x["n_words"] - 1e-9 and x["n_words"] >= min(13, x["item_words"]) or x["n_same"] >= 0.8 * x["item_words"] for x in found)


def test_overlap_segment():
    a = np.arange(100, dtype=np.int32)
    b = a[20:60].copy()
    b[[10, 30]] = -1
    assert decontamination.overlap(a, b, 20) == (0, 40, 38)
    assert decontamination.overlap(a, np.full(9, -5, np.int32), 3)[2] == 0
    assert decontamination.overlap(a[:10], b, 20) == (0, 0, 0)


# --- training sample of languages -------------------------------------------


def test_training_sample_of_copied_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda rows, *_: seen.append(rows))
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    many = spark.createDataFrame([("aa", f"hot {letters(k)}") for k in range(3)] * 1500 + [("bb", f"cold {letters(k)}") for k in range(30)], "lang string, text string")
    least = many.where("lang = 'bb'").orderBy(F.xxhash64("text")).first()["text"]
    copies = spark.createDataFrame([("bb", least)] * 50, "lang string, text string")
    language_id.train(many.unionByName(copies), rows=20)
    sample = {lang: [" ".join(w) for x, w in seen[0] if x == lang] for lang in ("aa", "bb")}
    assert sorted(sample["aa"]) == [f"hot {letters(k)}" for k in range(3)]
    assert len(sample["bb"]) == len(set(sample["bb"])) == 10 and least in sample["bb"]


# --- media ------------------------------------------------------------------


def test_jpeg_round_trip(spark, corpus):
    rows = progressive_jpeg.digests(docs(spark, corpus)).collect()
    want = collections.Counter()
    for i, x in corpus:
        b = (x or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    assert len({r["feature"] for r in rows if r["doc_id"] in (9001, 9002)}) == 1
    texts = {i: x for i, x in corpus if i is not None}
    for r in rows[:40]:
        if r["doc_id"] is not None:
            media = progressive_jpeg.store(*progressive_jpeg._with_size(texts[r["doc_id"]]))
            rgb = progressive_jpeg.rgb_tensor(media)
            h, w, _ = rgb.shape
            mean = [float(rgb[:, :, k].astype(np.float64).mean()) for k in range(3)]
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
            assert r["feature"] == f"{w}x{h} {mean[0]:.2f} {mean[1]:.2f} {mean[2]:.2f} {zlib.crc32(rgb.tobytes()):08x}"
    t = progressive_jpeg.tensors(progressive_jpeg.media_column(docs(spark, [(1, "x" * 100), (2, None)]))).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in t)
    assert progressive_jpeg.features(progressive_jpeg.tensors(spark.createDataFrame([(1, None)], "doc_id long, media binary"))).first()["feature"] is None
    assert progressive_jpeg.digests(docs(spark, corpus).limit(0)).count() == 0


def test_jpeg_symbol_by_symbol(monkeypatch):
    """The general decoder reads what the array form reads."""
    r = np.random.default_rng(3)
    for n in (1, 7, 30):
        p = r.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        media = progressive_jpeg.store(p)
        fast = progressive_jpeg.decode(media)
        with monkeypatch.context() as m:
            m.setattr(progressive_jpeg, "_uniform", lambda *a: False)
            slow = progressive_jpeg.decode(media)
        assert progressive_jpeg.restore(fast) == p == progressive_jpeg.restore(slow)
        assert all((a.blocks == b.blocks).all() for a, b in zip(fast.components, slow.components, strict=True))


def grey_jpeg(blocks):
    """A small encoder with variable codes: DC differences, runs of zeros, ends of bands over several blocks, and refinement with new coefficients."""
    J = progressive_jpeg
    symbols = sorted({*range(12), *(r << 4 | s for r in range(16) for s in range(11)), *(r << 4 for r in range(15))})
    code = {s: f"{k:08b}" for k, s in enumerate(symbols)}  # all of eight bits; the last code isn't all ones
    bits = lambda v: "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
    cut = lambda v: int(abs(v) // 2) * (1 if v > 0 else -1)
    table = lambda kind: J._segment(0xC4, bytes([kind, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    pack = lambda s: J._stuffed(np.array([int(c) for c in s], np.uint8))
    out = [b"\xff\xd8", J._segment(0xDB, bytes([0] + [3] * 64)), J._segment(0xC2, bytes([8, 0, 8, 0, 8 * len(blocks), 1, 1, 0x11, 0])), table(0), table(16)]
    dc, before = "", 0
    for b in blocks:
        d = (int(b[0]) >> 1) - before
        before += d
        dc += code[abs(d).bit_length()] + bits(d)
    out += [J._scan_header([(1, 0)], 0, 0, 0, 1), pack(dc), J._scan_header([(1, 0)], 0, 0, 1, 0), pack("".join(str(int(b[0]) & 1) for b in blocks))]
    ac, run = "", 0

    def flush():
        nonlocal ac, run
        while run:
            k = run.bit_length() - 1
            ac += code[k << 4] + (f"{run - (1 << k):0{k}b}" if k else "")
            run = 0

    for b in blocks:
        zeros, last = 0, max((k for k in range(1, 64) if cut(b[k])), default=0)
        for k in range(1, last + 1):
            v = cut(b[k])
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                ac += code[0xF0]
                zeros -= 16
            ac += code[zeros << 4 | abs(v).bit_length()] + bits(v)
            zeros = 0
        run += last < 63
    flush()
    out += [J._scan_header([(1, 0)], 1, 63, 0, 1), pack(ac)]
    ref = ""
    for b in blocks:
        zeros, held, last = 0, "", max((k for k in range(1, 64) if abs(int(b[k])) == 1), default=0)
        for k in range(1, 64):
            v = int(b[k])
            if k == last + 1:
                assert not held
                ref += code[0]
            if abs(v) > 1:
                held += str(abs(v) & 1)
                if k > last:
                    ref, held = ref + held, ""
            elif not v:
                zeros += k < last
                if zeros == 16 and k < last:
                    ref, held, zeros = ref + code[0xF0] + held, "", 0
            else:
                ref, held, zeros = ref + code[zeros << 4 | 1] + ("1" if v > 0 else "0") + held, "", 0
    out += [J._scan_header([(1, 0)], 1, 63, 1, 0), pack(ref), b"\xff\xd9"]
    return b"".join(out)


def test_jpeg_with_variable_codes():
    r = np.random.default_rng(5)
    blocks = np.where(r.random((9, 64)) < 0.25, r.integers(-60, 61, (9, 64)), 0)
    blocks[:, 5] = r.integers(-1, 2, 9)
    blocks[3, 1:] = 0
    blocks[4, 1:] = 0
    blocks[:, 0] = r.integers(-200, 200, 9)
    picture = progressive_jpeg.decode(grey_jpeg(blocks))
    assert (picture.components[0].blocks[0] == blocks).all()
    rgb = np.concatenate(list(progressive_jpeg.rgb_rows(picture)))
    zig = progressive_jpeg.ZIGZAG
    for n in range(9):
        f = np.zeros(64)
        f[zig] = blocks[n] * 3
        f = f.reshape(8, 8)
        c = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5 / np.sqrt(2)) for x in range(8)] for u in range(8)])
        want = np.clip(np.rint(c.T @ f @ c + 128), 0, 255)
        assert np.abs(rgb[:, 8 * n : 8 * n + 8, 0] - want).max() <= 1


# --- pages ------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>The  title</h1><p>First &amp; <b>bol</b>d para<br>graph.<p>Ok.</p><aside>Aside</aside><form><input> Search</form><ul><li>one<li>two</ul></article>
<section class="comments"><p>Nice article, a long comment with many words that reads like text does.</p></section><footer>&copy; x</footer></body></html>"""


def test_main_text_inside_an_article():
    prose = "".join(f"<p>Paragraph {k} tells at some length what has happened, to whom, and why it was so.</p>" for k in range(8))
    links = "".join(f"<li><a href=/{k}>Another story, number {k}</a></li>" for k in range(9))
    marks = "".join(f"<p><b>{k}</b> <i>up</i> <b>{k}</b> <i>down</i></p>" for k in range(9))
    want = ["Title", *(f"Paragraph {k}" for k in range(8)), "one two", "Short.", "The end, with"]
    page = f"<article><h1>Title</h1>{prose}<ul><li>one<li>two</ul><p>Short.</p><p>The end, with <a href=x>a link</a> in it.</p><ul>{links}</ul><div>{marks}</div><div>{links}</div></article>"
    text = html_text.main_text(page)[0]
    assert all(x in text for x in want) and "Another story" not in text and "down" not in text
    assert html_text.main_text("<article><a href=x>All of it is a link.</a></article>") == ("", 0)
    story = "<div>" + "".join(f"<p>Paragraph {k} {'tells at some length what has happened, to whom, and why it was so; ' * 3}</p>" for k in range(8)) + "</div>"
    for teaser in ("<article>A short teaser</article>", "<main><article>A short teaser</article></main>"):
        text = html_text.main_text(teaser + story)[0]
        assert text.startswith("Paragraph 0") and "teaser" not in text
    assert "Log in" not in html_text.main_text(f"<div><p>Log in</p><p>Register</p></div><article>{prose}</article>")[0]


def plain_main_text(page, sigma, threshold):
    """The choice of lines, one at a time."""
    lines = html_text.lines_of(page)
    ratio = [(2.0 if x.region else 1.0) * max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    smooth = []
    for i, x in enumerate(lines):
        near = []
        for step in (-1, 1):
            j = i if step > 0 else i - 1
            while 0 <= j < len(lines) and lines[j].region == x.region and abs(i - j) <= -(-3 * sigma // 1):
                near.append(j)
                j += step
        w = {j: np.exp(-0.5 * ((i - j) / sigma) ** 2) for j in near}
        smooth.append(sum(ratio[j] * v for j, v in w.items()) / sum(w.values()))
    mean = sum(smooth) / len(smooth) if smooth else 0
    kept = {x.section for x, s in zip(lines, smooth, strict=True) if s >= threshold * mean and len(x.text) > x.linked}
    own = collections.Counter()
    for x in lines:
        own[x.section] += len(x.text) - 2 * min(len(x.text), x.linked)
    return " ".join(x.text for x in lines if x.section in kept and own[x.section] >= 0)


def test_ratio_and_smoothing_decide(spark, monkeypatch):
    """Every page of the fixture and pages of random blocks, against the plain form; and the threshold matters on pages with an article."""
    r = random.Random(3)
    pages = [x["html"] for x in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    blocks = ["<p>{}</p>", "<div><p>{}</p></div>", "<a href=x>{}</a><br>", "<ul><li>{}</ul>", "<article>{}</article>", "<div>{}<b>x</b><i>y</i></div>", "<article><p>{}</p>", "</article>"]
    pages += ["".join(r.choice(blocks).format("word " * r.choice([1, 2, 5, 30, 60])) for _ in range(r.randint(1, 25))) for _ in range(300)]
    for threshold in (0.5, 1.2):
        monkeypatch.setattr(html_text, "THRESHOLD", threshold)
        for page in pages:
            assert html_text.main_text(page)[0] == plain_main_text(page, html_text.SIGMA, threshold)
    fixture = [p for p in pages if "<article>" in p and "<nav>" in p]
    strict = [html_text.main_text(p) for p in fixture]
    monkeypatch.setattr(html_text, "THRESHOLD", 0.5)
    assert sum(html_text.main_text(p) != x for p, x in zip(fixture, strict, strict=True)) > 10


def test_pages_in_linear_time():
    for page in ("<b>x" * 20_000 + "y", "<!--" * 300_000, "<a " * 300_000, "<script>" + "</x>" * 250_000, "<p><i>" * 20_000 + "</p>" * 20_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 2


def test_main_text():
    assert html_text.main_text(PAGE) == ("The title First & bold para graph. Ok. one two", 6)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ("", 0)
    body = "".join(f"<p>{'word ' * 40}{k}</p>" for k in range(5))
    plain = f"<html><body><div id=menu><a>a</a><a>b</a></div><div><div class=story>{body}<p>End.</p></div></div><div><a href=x>link one</a> <a>link two</a></div></body></html>"
    text = html_text.main_text(plain)[0]
    assert text.startswith("word") and text.endswith("4 End.") and "link" not in text
    assert html_text.main_text("<nav>menu<article><p>In an unclosed menu.</p>") == ("In an unclosed menu.", 1)


def test_extract_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_text.extract(pages.unionByName(spark.createDataFrame([(-1, None, None), (-2, "u", "")], pages.schema))).collect()
    assert len(rows) == pages.count() + 2
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split())
    assert html_text.extract(pages.limit(0)).count() == 0


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.a.org/x/?b=2&a=1#f", 10, "response", 200, h(etag='"1"', date="d1", content_type="html"), "p1"),
        (2, "https://A.org/x?a=1&b=2&utm_source=z", 20, "response", 200, h(etag='"2"', date="d2", content_type="html"), "p2"),
        (3, "https://a.org:443/x?a=1&b=2", 25, "revisit", 304, h(etag='W/"2"', date="d3", content_type="other"), None),
        (4, "a.org/x?a=1&b=2", 20, "revisit", 304, h(etag='"2"'), None),
        (5, "a.org/x?a=1&b=2", 20, "revisit", 304, h(etag='"1"'), None),
        (6, "a.org/none", 99, "revisit", 304, h(etag='"1"'), None),
        (7, "a.org/x?a=1&b=2", 30, "revisit", 304, h(date="d"), None),
        (8, None, 30, "revisit", 304, None, None), (9, "a.org/x?a=1&b=2", None, "revisit", 304, h(), None),
        (10, "a.org/x?a=1&b=2", 28, "response", 404, h(etag='"3"'), "p3"),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, status int, headers map<string,string>, digest string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r["verdict"], r["target_id"]) for k, r in got.items()} == {3: ("resolved", 2), 4: ("changed", 1), 5: ("resolved", 1), 6: ("no response", None), 7: ("no validator", 2), 8: ("no response", None), 9: ("no response", None)}
    assert got[3]["headers"] == {"etag": 'W/"2"', "date": "d3", "content-type": "html"} and got[3]["digest"] == "p2"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_as_of_against_brute_force(spark):
    r = random.Random(6)
    facts = [(r.choice("hhhhab"), r.randrange(300), k) for k in range(300)]
    asks = [(r.choice("hhhhabc"), r.randrange(310)) for _ in range(300)]
    got = {(x["key"], x["at"]): x["fact"] for x in warc.as_of(spark.createDataFrame(asks, "key string, at long"), spark.createDataFrame(facts, "key string, at long, fact long"), "key", "at", "fact", 16).collect()}
    for k, t in asks:
        before = [(a, f) for q, a, f in facts if q == k and a < t]
        assert got[k, t] == (max(before)[1] if before else None)


# --- language ---------------------------------------------------------------


def test_word_features_are_those_of_each_word_alone():
    turn, top = 0x9E3779B97F4A7C15, 1 << 64

    def bucket(h):
        h = (h ^ (h >> 29)) * turn % top
        return (h >> 40) % language_id.BUCKETS

    def gram(x):
        h = ord(x[0])
        for c in x[1:]:
            h = (h * turn + ord(c)) % top
        return bucket(h)

    words, lexicon = ["a", "Ab", "abc", "abcd", "Straße", "a", "漢", "\U00010400x", "İstanbul", "z" * 3000], {"ab": 0, "straße": 1}
    flat, counts = language_id.features_of(words, lexicon)
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    for word, own in zip(words, got, strict=True):
        w = word.lower()
        m = f"^{w}$"
        want = [gram(m[:3]), gram(m[:4]), gram(m[-4:]), gram(m[-5:]), bucket((ord(w[0]) >> 7) + (1 << 40))]
        want += [gram(m[i : i + 2]) for i in range(len(m) - 1)] + [gram(m[i : i + 3]) for i in range(1, len(m) - 3)]
        want += [language_id.BUCKETS + lexicon[w]] if w in lexicon else []
        assert own == want, word
    assert [len(x) for x in map(np.asarray, language_id.features_of([], lexicon))] == [0, 0]


def test_words_are_runs_of_letters_and_lone_letters():
    for text in ("plain words, 2x", "naïve café", "漢字かな mixed ไทย text", "a漢b", "", None):
        assert language_id.words_of(text) == (language_id._WORD.findall(text) if text else [])


def test_forward_backward_in_blocks():
    r = np.random.default_rng(0)
    model = language_id.Model(["a", "b", "c"], {}, np.zeros((1, 3)), r.normal(size=(3, 3)))
    e, starts = r.normal(size=(500, 3)) * 2, np.array([0, 1, 64, 129, 130, 330])
    got = model.posteriors(e, starts)
    for a, b in zip(starts, [*starts[1:], 500], strict=True):
        alpha, beta = e[a:b].copy(), np.zeros((b - a, 3))
        for t in range(1, b - a):
            alpha[t] += language_id._log_sum(alpha[t - 1][:, None] + model.transitions, 0)
        for t in range(b - a - 2, -1, -1):
            beta[t] = language_id._log_sum(model.transitions + (e[a + t + 1] + beta[t + 1])[None, :], 1)
        assert np.allclose(np.exp(alpha + beta - language_id._log_sum(alpha[-1], 0)), got[a:b], atol=1e-6)


def test_gradient():
    r = np.random.default_rng(1)
    e, y, starts, t = r.normal(size=(9, 3)), r.integers(0, 3, 9), np.array([0, 2, 6]), r.normal(size=(3, 3))

    def likelihood(e, t):
        total = 0.0
        for a, b in zip(starts, [*starts[1:], 9], strict=True):
            alpha = e[a].copy()
            for i in range(a + 1, b):
                alpha = e[i] + language_id._log_sum(alpha[:, None] + t, 0)
            total += sum(e[i, y[i]] for i in range(a, b)) + sum(t[y[i - 1], y[i]] for i in range(a + 1, b)) - language_id._log_sum(alpha, 0)
        return total

    d, dt = language_id._gradient(t, e, y, starts)
    step = 1e-5
    for i, j in ((0, 0), (4, 2), (8, 1)):
        e2 = e.copy()
        e2[i, j] += step
        assert abs((likelihood(e2, t) - likelihood(e, t)) / step - d[i, j]) < 1e-3
    for i, j in ((0, 0), (2, 1)):
        t2 = t.copy()
        t2[i, j] += step
        assert abs((likelihood(e, t2) - likelihood(e, t)) / step - dt[i, j]) < 1e-3


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language_id.held_out("doc_id"))
    model = language_id.train(df.where("NOT held_out"))
    out = language_id.predict(df.withColumn("score", F.lit("clash")), model)
    got = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()["a"]
    assert got > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 3"), (4, "Der " * 60_000), (5, "日本語"), (6, "½ ² Ⅷ"[:3])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3, 6)] == ["und"] * 4 and rows[4]["lang_pred"] == "de" and 0 <= rows[5]["score"] <= 1
    assert language_id.predict(odd.limit(0), model).count() == 0
    assert language_id.train(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    text = " ".join(r["text"][:300] for r in df.where("lang = 'de'").limit(1).collect() + df.where("lang = 'es'").limit(1).collect())
    assert language_id.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["n_switches"] >= 1
