"""Malformed pages, class words, repeated records and equal benchmark items."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from roadweave.llm import decontamination, html_text, suffix_dedup, warc

BODY = "".join(f"<p>Paragraph {k} tells at some length what has happened, to whom, and why it was so.</p>" for k in range(8))
TEXT = " ".join(f"Paragraph {k} tells at some length what has happened, to whom, and why it was so." for k in range(8))


def test_any_fragments_of_markup():
    """60,000 strings of markup fragments: no exception, and no line without text."""
    parts = ["<![", "<![ endif ]>", "<![CDATA[", "]]>", "<!--", "-->", "<!", "<!doctype", "<p>", "</p>", "<", "&", "&#x", "&#1114112;", "&#55296;", "x", "<a href='", "'>", "<script>", "</script>", "<?php", "?>", "<textarea>", "</", '<div class="ad">', "\x00", ">", '"', "<title>", "<plaintext>", "<form>", "</form>", "<svg>"]
    r = random.Random(1)
    for _ in range(60_000):
        page = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        text, n = html_text.main_text(page)
        assert bool(text) == bool(n)


def test_marked_sections_in_a_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a <![ endif ]> b</p>"), (2, "u", "<![1]><p>c</p>"), (3, "u", "d <![")], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(df).orderBy("page_id").collect()] == ["a b", "c", "d <!["]


def test_words_that_say_what_a_page_has():
    for frame in ('<div class="post has-sidebar">{}</div>', '<div class="category-social post">{}</div>', '<div class="entry-content no-menu">{}</div>', '<form action=x><div class=nav>menu</div><div>{}</div><input> Send</form>'):
        text = html_text.main_text(f"<html><body>{frame.format(BODY)}</body></html>")[0]
        assert TEXT in text and "menu" not in text, frame
    for frame in ('<div class="post-comments">{}</div>', '<div class="sidebar">{}</div>', '<div class="sidebar-content">{}</div>', "<nav>{}</nav>"):
        assert html_text.main_text(f"<html><body>{frame.format(BODY)}</body></html>") == ("", 0), frame
    page = f"<body>{BODY}<form>Search this site, or write to us with what you think about it <input></form></body>"
    assert html_text.main_text(page)[0] == TEXT
    assert html_text.main_text("<body><form>Search <input></form></body>") == ("", 0)


def records(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, status int, headers map<string, string>, digest string")
    return df.withColumns({c: F.lit(7) for c in ("canonical", "fact", "target_id", "stored", "bucket")})


def test_one_row_for_each_revisit(spark):
    """Repeated responses, a record_id used twice, repeated revisits, nulls, and no rows."""
    full = [(1, "http://a.org/x", 10, "response", 200, {"etag": '"1"'}, "p1")] * 3 + [(2, "http://a.org/x", 20, "response", 200, {"etag": '"2"'}, "p2"), (2, "http://b.org/y", 20, "response", 200, {"etag": '"9"'}, "p9"), (2, "http://a.org/x", 20, "response", 200, {"etag": '"3"'}, "p3")]
    asks = [(5, "http://a.org/x", 15, "revisit", 304, {"etag": '"1"'}, None), (6, "http://a.org/x", 30, "revisit", 304, {"etag": '"2"'}, None), (6, "http://a.org/x", 30, "revisit", 304, {"etag": '"2"'}, None), (7, "http://b.org/y", 21, "revisit", 304, {"etag": '"9"'}, None), (8, None, 40, "revisit", 304, None, None), (9, "http://a.org/x", None, "revisit", 304, {}, None)]
    out = warc.resolve_revisits(records(spark, full + asks))
    got = sorted((r.record_id, r.verdict, r.target_id, r.digest) for r in out.collect())
    assert [g[:2] for g in got] == [(5, "resolved"), (6, "resolved"), (6, "resolved"), (7, "resolved"), (8, "no response"), (9, "no response")]
    assert [g[2:] for g in got[:4]] == [(1, "p1"), (2, "p2"), (2, "p2"), (2, "p9")]
    assert not warc.resolve_revisits(records(spark, asks[:0] + full)).collect()
    assert not warc.resolve_revisits(records(spark, [])).collect()


def test_every_equal_item_is_linked(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "nothing of it"), (3, words.upper())], "doc_id long, text string")
    tests = spark.createDataFrame([(10, words), (11, words), (12, words.replace("five", "5")), (11, words), (13, None), (None, words)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_same for r in decontamination.overlaps(docs, tests).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 10): 15, (1, 11): 15, (1, 12): 14}
    assert {k[1] for k in got if k[0] == 3} in ({10, 11, 12}, set())  # as the operator treats case
    assert len(decontamination.overlaps(docs, tests).collect()) == len(got)


def test_removed_bytes_of_a_whole_batch(monkeypatch):
    """Spans of random hits as byte by byte, next to each other across rows too; masks are unpacked once a slice of rows, not once a hit."""
    r, calls, unpack = random.Random(5), [], np.unpackbits
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 900)
    monkeypatch.setattr(np, "unpackbits", lambda *a: calls.append(1) or unpack(*a))
    rows, want = [], []
    for k in range(60):
        text = None if k % 9 == 4 else "".join(r.choice("ab\u00e9") for _ in range(r.choice((0, 3, 40, 90, 2000))))
        data = (text or "").encode()
        starts, hits, at = range(len(data) - 47), [], 0
        gone = bytearray(len(data))
        while at < len(starts):
            n = min(r.randint(1, 19), len(starts) - at)
            marks = np.array([r.random() < r.choice((0, 0.02, 1)) for _ in range(n)])
            if marks.any():
                hits.append({"first": at, "n": n, "mask": np.packbits(marks).tobytes()})
            for i in np.flatnonzero(marks).tolist():
                gone[at + i : at + i + 48] = b"\1" * 48
            at += n
        r.shuffle(hits)
        edges = [i for i in range(len(data) + 1) if (i > 0 and gone[i - 1]) != (i < len(data) and gone[i])]
        rows.append({"id": k, "text": text, "hits": hits or None})
        want.append((k, len(data), sum(gone), [list(x) for x in zip(edges[::2], edges[1::2], strict=True)], bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    kind = pa.schema([("id", pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int16()), ("mask", pa.binary())])))])
    out = [x for b in suffix_dedup._take_out(48, False)(iter([pa.RecordBatch.from_pylist(rows, kind)])) for x in b.to_pylist()]
    assert [(x["id"], x["n_bytes"], x["n_removed"], x["spans"], x["kept"]) for x in out] == want
    assert all(x["n_spans"] == len(x["spans"]) for x in out)
    assert len(calls) <= len(rows) < sum(len(x["hits"] or ()) for x in rows)
