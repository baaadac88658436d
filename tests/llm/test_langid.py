import zlib

import numpy as np

from emberlog.llm import langid


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in kept]) > 0.97
    assert not any(r.rejected for r in rows)


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    broken = docs.selectExpr("doc_id", "text", "source", "if(crc32(cast(doc_id as string)) % 5 = 0, 'xx', lang) as lang")
    rows = langid.identify(broken).collect()
    assert sorted(rows) == sorted(langid.identify(docs).collect()) and "xx" not in {r.lang_pred for r in rows}


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    odd = spark.createDataFrame([(10**6, "Съешь же ещё этих мягких французских булок да выпей чаю, господа товарищи"), (10**6 + 1, "东西南北中发白" * 5), (10**6 + 2, "12 34 !?"), (10**6 + 3, "½ ² —")], "doc_id long, text string")
    from pyspark.sql import functions as F

    both = docs.select("doc_id", "text", "lang").unionByName(odd.withColumn("lang", F.lit(None).cast("string")))
    found = {r.doc_id: r for r in langid.identify(both).collect()}
    assert all(found[10**6 + i].rejected for i in range(4))
    assert found[10**6 + 2].lang_pred == found[10**6 + 3].lang_pred == "und"
    kept = {r.doc_id for r in langid.keep_known(both).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_odd_rows(spark, odd, nothing):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 9)} == {"und"}
    assert {r.score for r in rows if r.lang_pred == "und"} == {0.0}
    assert langid.identify(nothing).collect() == []
    untaught = langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in untaught} == {"und"} and len(untaught) == odd.count()


def test_centroids_are_of_length_one():
    rng = np.random.default_rng(1)
    base = rng.random((3, langid.DIMENSIONS)).astype(np.float32)
    rows = np.repeat(base, 50, axis=0) + 0.05 * rng.random((150, langid.DIMENSIONS)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centroids = langid.clustered(rows, 3)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-5)
    assert len({int(np.argmax(rows[i] @ centroids.T)) for i in (0, 50, 100)}) == 3
