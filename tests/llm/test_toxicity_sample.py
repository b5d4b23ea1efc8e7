"""Toxicity: the training sample is bounded in rows, also where an id repeats."""

from airgrid.llm import toxicity


def test_a_repeated_id_counts_once(spark, monkeypatch):
    rows = [(1, f"word number {i}") for i in range(500)] + [(i, f"text {i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(1, 12)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_nnpu

    def spy(pos, unl, *rest):
        seen.append((len(pos), len(unl), [i.tobytes() for i, _ in unl]))
        return fit(pos, unl, *rest)
    monkeypatch.setattr(toxicity, "fit_nnpu", spy)
    for d in (docs, docs.repartition(7)):
        toxicity.train(d, labels, lambda i: i.isNotNull())
    assert seen[0][0] <= 5 and seen[0][1] == 11
    assert seen[0] == seen[1]
