"""The pipeline's stages keep what they should, and their decisions take effect."""

import corpus_pipeline
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "", "en", "src0", 0), (-3, "12 34", None, None, 5)], docs.schema)
    docs = docs.unionByName(extra)
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.where("doc_id >= 0").collect()}
    distinct = steps["near_dedup"](spark, kept, SF).cache()
    classes = brute.near_classes([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(set(classes.values()))
    redacted = steps["pii"](spark, distinct, SF).cache()
    assert redacted.columns == docs.columns and redacted.count() == distinct.count()
    assert all(not brute.base_spans(r.text)[1] for r in redacted.collect())
    mixed = steps["mixing"](spark, redacted, SF).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = steps["packing"](spark, mixed, SF)
    starts = packed.where("start = 0").groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in starts} == {(r.doc_id, r["count"]) for r in mixed.groupBy("doc_id").count().collect()}


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < -5")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13), (3, "quite another text here", "en", "s", 20)], schema)
    out = corpus_pipeline.keep_distinct(spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_run_applies_the_stages_to_all_documents(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, docs.select(key).collect())) and "sequence_id" in out.columns


def test_stages_with_nulls_repeats_and_extra_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(docs.limit(3)).unionByName(odd).withColumns({c: F.lit(i) for i, c in enumerate(["row", "h", "c", "kept", "_size", "rate", "n", "m", "less", "more", "target", "language"])})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns, name
        docs = out
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0
