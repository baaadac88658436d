import numpy as np

from emberlog.llm import toxicity


def test_accuracy_on_documents_outside_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    taught = labels.where("doc_id % 2 = 0")
    rows = toxicity.score(docs, taught).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    told = np.array([r.is_toxic for r in rows])
    toxic = np.array([r.toxic == 1 for r in rows])
    assert (told & toxic).sum() / toxic.sum() > 0.9 and (told & toxic).sum() / told.sum() > 0.95
    low = np.array([r.p_low_quality for r in rows])
    bad = np.array([r.quality == 0 for r in rows])
    assert low[bad].mean() > 0.9 and low[~bad].mean() < 0.05


def test_later_models_see_earlier_probabilities_out_of_fold():
    rng = np.random.default_rng(3)
    n = 600
    first = rng.random(n) < 0.4
    noise = rng.random(n) < 0.1
    present = [np.unique(np.array([1 if (f ^ x) else 2, *rng.integers(10, 40, 3)], np.uint64)) for f, x in zip(first, noise, strict=True)]
    labels = np.stack([first, first], axis=1).astype(int)
    chain = toxicity.fit_chain(present, np.zeros((n, 1)), labels, np.arange(n) % 5)
    assert len(chain.models[1].centre) == len(chain.models[0].centre) + 1  # the earlier probability
    p1, p2 = chain.predict(present, np.zeros((n, 1)))
    assert np.corrcoef(p1, p2)[0, 1] > 0.95 and 0 < chain.threshold < 1


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (2, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    none = toxicity.score(odd, labels.where("false")).collect()
    assert {(r.p_toxic, r.is_toxic) for r in none} == {(0.0, False)}
    one_value = toxicity.score(odd, labels.where("doc_id = 1")).collect()
    assert {(r.p_toxic, r.is_toxic) for r in one_value} == {(0.0, False)}
    assert toxicity.score(nothing, labels).collect() == []
