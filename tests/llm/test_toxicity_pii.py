"""Toxicity on held-out rows, personal data against the plain patterns."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airgrid.llm import pii, tagger, toxicity
from airgrid.llm.common import held_out
from tests.conftest import SF01

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(v if k % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v) for k, v in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-1+ 4(é)2%", max_size=40))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_known_texts():
    t = "né é@x.y a.b@c.de. 4111 1111-1111 1111; +1 (555) 010-9999, 10.0.0.255 and 1.2.3.256; 4111111111111112"
    assert pii.base_spans(t) == plain_spans(t)
    assert [k for k, _, _ in pii.base_spans(t)] == ["email", "ip", "card", "phone"]
    assert pii.base_spans(None) == pii.base_spans("") == []
    assert pii.base_spans("7" * 200000 + "a" * 200000) == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in tagger.new_model(embed=4, hidden=5).items()}
    x, y = rng.integers(0, 6, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 0, 7, 8, 8]])
    _, g = tagger.gradients(m, x, y)
    for k, v in m.items():
        for _ in range(4):
            i = tuple(rng.integers(0, min(s, 6)) for s in v.shape)
            old = v[i]
            v[i] = old + 1e-3
            up, _ = tagger.gradients(m, x, y)
            v[i] = old - 1e-3
            down, _ = tagger.gradients(m, x, y)
            v[i] = old
            assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3, (k, i)


def test_viterbi_equals_exhaustive_search():
    from itertools import product
    rng = np.random.default_rng(1)
    em, a, s = rng.standard_normal((2, 3, tagger.TAGS)), rng.standard_normal((tagger.TAGS,) * 2), rng.standard_normal(tagger.TAGS)
    got = tagger.viterbi(em, a, s)
    step, start = a + tagger.BAR_STEP, s + tagger.BAR_START
    for b in range(2):
        best = max(product(range(tagger.TAGS), repeat=3),
                   key=lambda p: start[p[0]] + em[b, 0, p[0]] + sum(step[p[t - 1], p[t]] + em[b, t, p[t]] for t in (1, 2)))  # noqa: B023
        assert tuple(got[b]) == best


def test_windows_cover_every_trigger_and_tags_match():
    t = "x" * 50 + " a@b.cc " + "y" * 200 + " 10.0.0.1 " + "z" * 90
    starts = pii.windows(t)
    assert set(range(50, 59)) <= {i for s in starts for i in range(s, s + tagger.WINDOW)}
    assert not any(s <= 150 < s + tagger.WINDOW for s in starts)
    tags = pii.window_tags(t, starts)
    spans = {(k, a, b) for k, a, b in pii.base_spans(t)}
    for s, row in zip(starts, tags, strict=True):
        for k, a, b in spans:
            if s <= a and b <= s + tagger.WINDOW:
                assert row[a - s] == 1 + 2 * pii.KINDS.index(k) and (row[a - s + 1:b - s] == 2 + 2 * pii.KINDS.index(k)).all()


def test_masking_and_merging():
    base = [("email", 0, 5), ("phone", 3, 9), ("ip", 20, 22)]
    assert pii.masked("a" * 25, base) == "[EMAIL]" + "a" * 11 + "[IP]" + "aaa"
    assert pii.merged(base, [("card", 21, 30), ("card", 10, 12)]) == [("email", 0, 5), ("ip", 20, 22), ("card", 10, 12), ("phone", 3, 9)]


def test_find_and_scrub_whole_table(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", F.lit(1).alias("spans_"), F.lit(2).alias("_x"))
    extra = spark.createDataFrame([(None, None, 1, 2), (7001, "", 1, 2), (7002, "z " * 60000 + "q@mail.example.com", 1, 2),
                                   (7002, "1" * 3000, 1, 2)], df.schema)
    df = df.unionByName(extra)
    model = pii.train(df, max_docs=300, max_windows=1500)
    rows = pii.find(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        want = plain_spans(r.text or "") if len(r.text or "") != 3000 else []
        assert r.base_spans == pii.joined(want)
        every = [s.split(":") for s in r.spans.split(",") if s]
        assert set(r.base_spans.split(",")) <= set(r.spans.split(","))
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in every]
        assert order == sorted(order) and all(0 <= int(a) < int(b) <= len(r.text) for _, a, b in every)
    # The tagger alone, on documents it was not trained on, finds most of what the patterns define.
    texts = [r.text for r in rows if r.base_spans][-40:]
    found = pii.decode(model, texts)
    hit = sum(any(x < b and a < y for _, x, y in f) for t, f in zip(texts, found, strict=True) for _, a, b in pii.base_spans(t))
    assert hit >= 0.5 * sum(len(pii.base_spans(t)) for t in texts)
    clean = {r.text: r.c for r in df.select("text", pii.scrub(df, model).alias("c")).collect()}
    assert clean[None] is None and clean[""] == "" and clean["z " * 60000 + "q@mail.example.com"].endswith("[EMAIL]")
    assert not any(s for t, c in clean.items() if t and len(t) != 3000 for s in plain_spans(c) if s[0] in ("email", "ip"))
    empty = df.limit(0)
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    extra = spark.createDataFrame([(None, None), (90001, ""), (90002, "pathetic loser scum " * 20000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text", "score").unionByName(extra.withColumn("score", F.lit("x")))
    got = toxicity.classify(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)),
                            lambda i: ~held_out(i)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = {r.doc_id for r in labels.where(held_out(F.col("doc_id"))).collect()}
    p = {r.doc_id: r.predicted for r in got if r.doc_id in held}
    # About 30 toxic examples to learn from here, and some labels are noise.
    assert sum(p[i] for i in p if not truth[i]) <= 0.02 * len(p)
    assert sum(p[i] for i in p if truth[i]) >= 0.3 * sum(truth[i] for i in p)


def test_toxicity_of_a_text_of_nothing_but_insults(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(90002, "pathetic loser scum " * 20000)], "doc_id long, text string"))
    got = toxicity.classify(docs, spark.read.parquet(f"{SF01}/labels.parquet"), lambda i: ~held_out(i))
    assert [r.predicted for r in got.where("doc_id = 90002").collect()] == [1]


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs, none, lambda i: i.isNotNull()).collect()
    assert len(got) == 2 and all(r.predicted == 0 for r in got) is (got[0].score < 0.7)
    assert toxicity.classify(docs.limit(0), none, lambda i: i.isNotNull()).count() == 0


def test_nnpu_risk_is_non_negative_learning():
    rng = np.random.default_rng(0)
    row = lambda tox: (np.array(sorted({int(x) for x in rng.integers(10, 60, 12)} | ({1, 2} if tox else set())), np.int32),)
    rows = lambda n, rate: [(i, np.ones(len(i), np.float32)) for (i,) in (row(rng.random() < rate) for _ in range(n))]
    w, b = toxicity.fit_nnpu(rows(80, 1.0), rows(600, 0.1), prior=0.1, bits=7)
    assert w[1] > 0 and w[2] > 0 and np.abs(w[10:]).max() < w[1]
    w, b = toxicity.fit_nnpu([], rows(10, 0.1), prior=0.1, bits=7)
    assert not w.any()
