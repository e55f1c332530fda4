"""The registered queries on the smallest tables: their columns, and their digests against the libraries and brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from roadweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def rows(spark, name, kinds):
    df = QUERIES[name](spark, SF)
    have = dict(df.dtypes)
    assert {c: have.get(c) for c in kinds} == kinds
    return df.collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, documents):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op1_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})}
    for i, text, _ in sorted(documents):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), crc(ids))
        start += len(ids)


def test_op3(spark, documents):
    seen = collections.Counter()
    data = {i: text.encode() for i, text, _ in documents}
    assert len(data) == len(documents)
    for b in data.values():
        seen.update(xxhash.xxh3_128_digest(b[k : k + 200]) for k in range(len(b) - 199))
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    for r in rows(spark, "op3_suffix_dedup", kinds):
        b = data[r.doc_id]
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[xxhash.xxh3_128_digest(b[k : k + 200])] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        out = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~out].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(out.sum()), int((np.diff(np.r_[0, out.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())


def test_op5(spark, documents):
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    data, same = {i: text.encode() for i, text, _ in documents}, {}
    for r in rows(spark, "op5_progressive_jpeg", kinds):
        b = data[r.doc_id]
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert same.setdefault(b, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature) and r.media_bytes > 0


def test_op6(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(spark, "op6_html_text", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})
    assert {r.page_id: r.url for r in got} == pages and len(got) == len(pages)
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in got) and sum(bool(r.text) for r in got) > 0.9 * len(got)


def test_op7(spark, documents):
    def fingerprint(text):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) if len(h) else np.zeros((1, 64), np.uint64)
        return sum(1 << k for k in range(64) if 2 * int(bits[:, k].sum()) > max(1, len(h)))

    fp = {i: fingerprint(t) for i, t, _ in documents}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op7_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_op9(spark, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    kinds = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    pieces = rows(spark, "op9_packing", kinds)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text, _ in documents:
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(r.length for r in pieces) > 0.97 * 1024 * len(by_sequence)


def test_op10(spark, documents):
    got = rows(spark, "op10_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert len(got) == len(documents)
    lang = {i: (text, known) for i, text, known in documents}
    right = []
    for r in got:
        text, known = lang[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(map(str.isalpha, text)):
            assert r.lang_pred == "und"
        elif r.held_out and known:
            right.append(r.lang_pred == known)
    assert sum(right) >= 0.9 * len(right)
