"""Toxicity: one extreme row is worth one row, scores are what plain sums give, ids of any type."""

import numpy as np
from pyspark.sql import functions as F

from airgrid.llm import toxicity
from airgrid.llm.common import held_out
from tests.conftest import SF01


def _docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF01}/labels.parquet")


def test_one_junk_row_counts_as_one_row(spark):
    """Held-out results stay within two documents when a row repeats insults without end, and it is caught itself."""
    docs, labels = _docs(spark)
    junk = spark.createDataFrame([(90000, "idiot moron scum " * 20000)], "doc_id long, text string")
    truth = {r.doc_id: int(r.toxic) for r in labels.collect() if r.doc_id is not None}
    usable = lambda i: ~held_out(i)

    def caught(rows):
        got = {r.doc_id: r.predicted for r in toxicity.classify(rows, labels, usable).where(held_out(F.col("doc_id"))).collect()}
        return [sum(got[i] for i in got if truth.get(i) == y) for y in (1, 0)]

    a, b = caught(docs), caught(docs.unionByName(junk))
    assert a[0] >= 8 and b[0] >= a[0] - 2 and max(a[1], b[1]) <= 1, (a, b)
    every = toxicity.classify(docs.unionByName(junk), labels, usable).where("doc_id = 90000").collect()
    assert [r.predicted for r in every] == [1]


def test_a_score_is_a_plain_sum(spark):
    docs, labels = _docs(spark)
    model = toxicity.train(docs, labels, lambda i: ~held_out(i))
    some = docs.where("doc_id % 50 = 0").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "you idiot " * 9)], docs.schema))
    for r in toxicity.score(some, model).collect():
        words = [w for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()]
        z = model.bias
        for w in set(words):
            value = min(words.count(w) * 50 / (len(words) + 60), 0.3)
            z += value * sum(model.weights[i] for i in toxicity.word_features(w, 18))
        assert np.isclose(r.score, 1 / (1 + np.exp(-(z * model.slope + model.shift))), atol=1e-9)


def test_ids_of_text(spark):
    docs, labels = _docs(spark)
    named = F.concat(F.lit("d"), F.col("doc_id"))
    got = toxicity.classify(docs.withColumn("doc_id", named), labels.withColumn("doc_id", named), lambda i: i.isNotNull())
    assert got.count() == 1000 and got.where("predicted = 1").count() > 10
