"""Queries with an SQL twin against it; the others against plain readings."""

import hashlib
import zlib

import pytest

from compare import same, views
from netloom.llm import queries, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return views(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, tables, name):
    same(queries.QUERIES[name](spark, SF), tables, queries.ORACLES[name])


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark, tables):
    rows = queries.QUERIES["op2_sharding"](spark, SF).collect()
    texts = dict(tables.sql("select doc_id, text from documents").fetchall())
    slots = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25))
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_secrets(spark, tables):
    texts = dict(tables.sql("select doc_id, text from documents").fetchall())
    for r in queries.QUERIES["op9_secret_scan"](spark, SF).collect():
        assert r["base_sha256"] == secret_scan.brute_digest(texts[r["doc_id"]])


def test_quality_on_held_out_rows(spark, tables):
    labels = dict(tables.sql("select doc_id, quality from labels").fetchall())
    rows = [r for r in queries.QUERIES["op7_quality_classifier"](spark, SF).collect()]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_quality_on_more_held_out_rows(spark):
    more = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{more}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES["op7_quality_classifier"](spark, more).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 90 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_pipeline_keeps_what_it_should(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            docs = corpus_pipeline.written(docs, name)
    out = docs.collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < tables.sql("select count(*) from documents").fetchall()[0][0]
    bad = {d for (d,) in tables.sql("select doc_id from labels where quality = 0").fetchall()}
    assert len(bad & set(ids)) <= 0.1 * len(bad)


def test_digest_of_nothing():
    assert secret_scan.brute_digest(None) == hashlib.sha256(b"").hexdigest()
