"""Every stage of the pipeline on its own: empty tables, nulls, repeated rows and columns with names the operators use."""

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, component_id bigint, raw string, secrets string, sig int, n int"
ITEM = "Every Monday the baker from Oslo walks along the quiet river and feeds nine swans near Bergen"
KEY = "api_key=Zx81kQpLm90vBn27"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(("river", "stone", "window", "garden", "letter", "morning", "teacher", "bridge", "summer", "market", "village", "music")) + rng.choice(("", "s", ",")) for _ in range(n)) + "."


ROWS = [
    (1, prose(1)), (2, prose(2)), (3, prose(1)), (3, prose(1)), (4, None), (5, ""), (None, prose(3)), (None, None),
    (6, prose(4) + " " + ITEM), (7, prose(5) + " " + KEY + " end"), (8, prose(6, 9000)), (9, prose(2).replace("river", "lake", 1)), (10, " \n"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 8)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t or ""), 0.5, 1, 2, "r", "s", 3, 4) for d, t in rows], COLUMNS)


def ids(df):
    return sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, folder, name, stage):
    out = stage(spark, table(spark, []), folder)
    assert out.count() == 0 and (name == "sentencepiece" or out.columns == table(spark, []).columns)


def test_quality_without_labels_rejects_nothing(spark, folder, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, ROWS)
    assert ids(corpus_pipeline.good_quality(spark, docs, str(tmp_path))) == ids(docs)


def test_quality_on_odd_rows(spark, folder):
    docs = table(spark, ROWS)
    out = corpus_pipeline.good_quality(spark, docs, folder)
    kept = ids(out)
    assert out.columns == docs.columns and all(kept.count(i) <= ids(docs).count(i) for i in kept) and kept.count(3) in (0, 2)


def test_near_duplicates_on_odd_rows(spark, folder):
    docs = table(spark, ROWS)
    out = corpus_pipeline.one_of_each(spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == [-1, -1, 1, 2, 4, 5, 6, 7, 8, 10]


def test_leaks_on_odd_rows(spark, folder):
    docs = table(spark, ROWS)
    out = corpus_pipeline.no_leaks(spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == [i for i in ids(docs) if i != 6]


def test_secrets_on_odd_rows(spark, folder):
    docs = table(spark, ROWS)
    out = corpus_pipeline.no_secrets(spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    texts = {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"], r["n_chars"]))
    assert texts[7] == [(prose(5) + " [SECRET] end", len(prose(5)) + 13)] and texts[4] == [(None, 0)] and texts[3] == [(prose(1), len(prose(1)))] * 2


def test_ids_on_odd_rows(spark, folder):
    docs = table(spark, ROWS)
    out = corpus_pipeline.token_ids(spark, docs, folder)
    got = [(r["doc_id"], r["ids"]) for r in out.collect()]
    assert ids(out) == ids(docs) and {d for d, x in got if x is None} == {4, None} and [x for d, x in got if d == 5] == [[]]
