"""The pipeline's stages against their operators."""

import public_tokenizers  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from siltbed.llm import minhash_dedup, quality_classifier, quality_rules, source_mixing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sizes = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        sizes.append(len(rows))
        if name != "packing":
            assert tuple(out.columns) == pipeline.COLUMNS
            out = spark.createDataFrame(rows, out.schema)
        if name == "quality classifier":
            model = quality_classifier.fit(docs, labels, ~quality_classifier.fold(F.col("doc_id")))
            assert len(rows) == quality_classifier.with_quality(docs.select("doc_id", "text"), model).where("predicted = 1").count()
        elif name == "quality rules":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in quality_rules.with_stats(docs.select("doc_id", "text")).select("doc_id", "base_failed").collect() if not r.base_failed}
        elif name == "minhash near-dedup":
            kept = {r.doc_id for r in minhash_dedup.near_duplicates(docs).where("kept").collect()}
            assert {r.doc_id for r in rows} == kept and len({r.doc_id for r in rows if r.doc_id is not None}) == sum(r.doc_id is not None for r in rows)
        elif name == "source mixing":
            got, cuts = source_mixing.fit(docs)
            assert len(rows) == source_mixing.with_copies(got, cuts, F.col("u"), F.col("size")).agg(F.sum("n_copies")).first()[0]
        docs = out
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[-1] > 0


def test_repeated_rows_are_one_document(spark, tmp_path):
    x, y = ("".join(f"{c}{i} " for i in range(60)) for c in "xy")
    rows = [(1, x), (1, x), (2, x), (3, y), (3, y + "z"), (None, x), (None, y), (4, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text[:1]) for r in out) == [(0, "x"), (0, "y"), (1, "x"), (3, "y"), (4, "a")]


def test_empty(spark, empty_dir):
    assert pipeline.run(spark, empty_dir).count() == 0
