"""Personal data beyond the patterns: planted examples in real text, look-alikes, clean documents."""

import time

import numpy as np
import pytest

from airgrid.llm import pii
from tests.conftest import SF01


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    return pii.train(docs), texts


def _planted(texts, n, seed=10 ** 6):
    out = []
    for k in range(n):
        rng = np.random.default_rng(seed + k)
        kind, shown = pii.example(rng)
        words = texts[k % len(texts)].split(" ")
        at = int(rng.integers(0, len(words)))
        head = " ".join(words[:at])
        lo = len(head) + 1 if head else 0
        out.append((kind, lo, lo + len(shown), (head + " " if head else "") + shown + " " + " ".join(words[at:])))
    return out


def test_held_out_examples_are_found_and_look_alikes_are_not(trained):
    model, texts = trained
    cases = _planted(texts, 400)
    found = pii.decode(model, [t for *_, t in cases])
    real = [(c, f) for c, f in zip(cases, found, strict=True) if c[0]]
    hit = sum(any(k == c[0] and a < c[2] and c[1] < b for k, a, b in f) for c, f in real)
    exact = sum((c[0], c[1], c[2]) in f for c, f in real)
    false = sum(any(a < c[2] and c[1] < b for _, a, b in f) for c, f in zip(cases, found, strict=True) if c[0] is None)
    none = sum(c[0] is None for c in cases)
    assert hit >= 0.9 * len(real) and exact >= 0.7 * len(real) and false <= 0.05 * none, (hit, exact, len(real), false, none)


def test_spans_go_beyond_the_base_and_clean_documents_stay(spark, trained):
    model, texts = trained
    cases = [c for c in _planted(texts, 120, seed=77) if c[0]]
    df = spark.createDataFrame([(i, c[3]) for i, c in enumerate(cases)], "doc_id long, text string")
    rows = pii.find(df, model).collect()
    assert sum(r.spans != r.base_spans for r in rows) >= 0.85 * len(rows)
    clean = [t for t in texts if not pii.base_spans(t)]
    added = sum(bool(f) for f in pii.decode(model, clean))
    assert added <= 0.005 * len(clean), added


def test_merging_is_linear_and_keeps_base_spans():
    base = [("email", 10 * i, 10 * i + 4) for i in range(40000)]
    more = [("phone", 10 * i + 3, 10 * i + 6) for i in range(40000)] + [("phone", 10 * i + 5, 10 * i + 8) for i in range(40000)]
    start = time.time()
    got = pii.merged(base, more)
    assert time.time() - start < 2 and len(got) == 80000 and got[:40000] == base
    assert pii.merged([], [("ip", 1, 3)]) == [("ip", 1, 3)] and pii.merged([("ip", 0, 9), ("card", 2, 3)], [("phone", 8, 12)]) == [("ip", 0, 9), ("card", 2, 3)]
