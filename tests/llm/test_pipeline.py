"""The pipeline's stages against brute force on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_classes, brute_contamination, brute_secrets, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    top = tmp_path_factory.mktemp("sf")
    items = [(k, prose(rng, 20)) for k in range(3)]
    texts = [prose(rng, 60) for _ in range(20)]
    texts += [texts[0], texts[1] + " more", "1 2 3", None, "", texts[2] + " " + items[1][1], texts[3] + " token = 'abcdefgh1234'"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    left = {i: t for i, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            left = {i: t for i, t in left.items() if t and any(map(str.isalpha, t))}
        elif name == "near_dedup":
            classes = brute_classes(list(left.items()))
            left = {i: t for i, t in left.items() if classes[i] == i}
        elif name == "decontamination":
            left = {i: t for i, t in left.items() if not brute_contamination(t, items)[1]}
        else:
            assert got.keys() == left.keys() and not any(brute_secrets(t) for t in got.values())
            assert all(got[i] == t for i, t in left.items() if not brute_secrets(t))
            continue
        assert got == left
    assert corpus_pipeline.run(spark, path).count() == len(left)


def test_near_dedup_keeps_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(18)
    texts = [prose(rng, 60) for _ in range(9)]
    rows = [(5, texts[0]), (None, texts[0] + " more"), (None, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[3] + " more"), (7, texts[4]), (7, texts[5]), (7, texts[6]), (7, texts[6]), (8, texts[4]), (9, texts[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()
    got = sorted(r.text for r in out)
    some = [texts[3], texts[3] + " more"]
    assert got in [sorted([*texts[:3], *texts[4:8], s]) for s in some]


def test_language_predicts_once_and_fills_null_languages(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    out = corpus_pipeline.language(spark, docs, path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    assert out.filter("lang IS NULL").count() == 0


def test_stages_pass_clashing_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(c) for c in ("spans", "blob", "a", "b", "v", "keys", "n_words", "items", "label", "h", "id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns[-11:] == ["spans", "blob", "a", "b", "v", "keys", "n_words", "items", "label", "h", "id"]
    assert docs.select("spans", "blob").distinct().collect() == [("spans", "blob")]


def test_scratch_tables_go(spark, folder):
    import os

    path, _, _ = folder
    top = spark.conf.get("spark.checkpoint.dir")
    tables = lambda: {d for _, ds, _ in os.walk(top) for d in ds if len(d) == 32}
    before = tables()
    assert corpus_pipeline.run(spark, path).count()
    assert len(tables() - before) == 4  # what each stage but the last kept
