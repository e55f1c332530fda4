"""The pipeline's stages against brute force, each on its own input, and the registered queries."""

import collections
from pathlib import Path

import corpus_pipeline as C
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from .test_operators import jaccard, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = C.table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (70_001, "", "en", "s", 0), (70_002, "1 2 3", "en", "s", 5), (None, "The and of with that from this is", None, None, None)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(5))
    out = [("", docs.collect())]
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, SF), "t")
        out.append((name, docs.collect()))
    return out


def test_language(stages):
    before, after = stages[0][1], stages[1][1]
    gone = collections.Counter(r["text"] for r in before) - collections.Counter(r["text"] for r in after)
    assert set(gone) == {None, "", "1 2 3"}
    assert all(r["lang"] for r in after)


def test_near_dedup(stages):
    before, after = stages[1][1], stages[2][1]
    kept = {r["text"] for r in after}
    assert len(kept) == len(after)
    texts = list({r["text"]: None for r in before})
    for a in texts:
        alike = [jaccard(a, b) for b in texts if b != a and abs(len(a) - len(b)) < 0.5 * len(a)]
        if a in kept:
            assert not any(jaccard(a, b) >= 0.8 for b in kept if b != a)
        else:
            assert max(alike, default=0) >= 0.8  # a document goes for the sake of one like it
    ids = {r["text"]: r["doc_id"] for r in before}
    assert len(after) > 0.8 * len(ids)


def test_repeat_dedup(stages):
    before, after = stages[2][1], stages[3][1]
    want = {r["doc_id"]: x[3].decode("utf-8", "ignore") for r, x in zip(before, repeats([r["text"].encode() for r in before], 200), strict=True)}
    assert {r["doc_id"]: r["text"] for r in after} == {i: t for i, t in want.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["n_chars"] is not None)


def test_decontamination(spark, stages):
    before, after = stages[3][1], stages[4][1]
    items = [r["text"] for r in C.table(spark, SF, "benchmark").collect()]
    gone = collections.Counter(r["doc_id"] for r in before) - collections.Counter(r["doc_id"] for r in after)
    assert set(gone) == {r["doc_id"] for r in before if any(x in r["text"] for x in items)}


def test_packing(stages):
    before, after = stages[4][1], stages[5][1]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    sums = collections.Counter()
    for r in after:
        sums[r["doc_id"]] += r["length"]
    assert all(sums[r["doc_id"]] == r["doc_tokens"] for r in after if r["doc_id"] is not None)


def test_columns_and_run(spark, stages):
    assert all(set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for _, rows in stages[:-1])
    assert C.run(spark, SF).count() > 0


def test_one_id_with_several_texts(spark):
    """Different texts of one doc_id, and of none, are different documents; one that goes takes no other with it."""
    docs = C.table(spark, SF, "documents")
    item = max((r["text"] for r in C.table(spark, SF, "benchmark").collect()), key=len)
    own = [r["text"] for r in docs.where("length(text) between 300 and 900").limit(3).collect()]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i in (5, None) for t in [*own, item + " and more", own[0]]], docs.schema)
    assert sorted(r["text"] for r in C.near_dedup(spark, rows, SF).collect()) == sorted({*own, item + " and more"})
    left = C.decontaminate(spark, rows, SF).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in left) == collections.Counter((r["doc_id"], r["text"]) for r in rows.collect() if r["text"] in own)


def test_empty_table(spark):
    docs = C.table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_queries(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert {x.split("_")[0] for x in q if x.startswith("op")} >= {f"op{n}" for n in range(1, 11)} and "pipeline" in q
    duck = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in (x for x in sql if x.startswith("op")):
        df = q[name](spark, SF)
        cols = sorted(df.columns)
        ours = [tuple(r) for r in df.select(*[F.col(c).cast("string") for c in cols]).collect()]
        casts = ", ".join(f'CAST("{c}" AS VARCHAR)' for c in cols)
        assert sorted(map(str, ours)) == sorted(map(str, duck.sql(f"SELECT {casts} FROM ({sql[name]})").fetchall()))
