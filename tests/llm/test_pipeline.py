"""The corpus pipeline stage by stage against plain versions of each decision."""

import importlib
import pkgutil

import corpus_pipeline
from airgrid.llm import decontam, omh, pii, toxicity
from airgrid.llm.common import table
from tests.conftest import SF001
from tests.llm.test_near_duplicates import classes
from tests.llm.test_scans_archives import plain_hits


def test_stages_take_effect_and_fit_together(spark):
    docs = table(spark, SF001, "documents").select(*corpus_pipeline.COLUMNS)
    items = [(r.item_id, r.text) for r in table(spark, SF001, "benchmark").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near-duplicates", "decontamination", "personal-data", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    clean = steps["toxicity"](spark, docs, SF001).cache()
    score = toxicity.make_scorer(toxicity.train(docs, table(spark, SF001, "labels"), lambda i: i.isNotNull()))
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows.items() if score(t) < 0.7}

    one = steps["near-duplicates"](spark, docs, SF001).cache()
    s = {i: omh.shingles(t) for i, t in rows.items()}
    ids = sorted(rows)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if (omh.similar(s[a], s[b]) if len(s[a]) or len(s[b]) else rows[a] == rows[b])]
    assert {r.doc_id for r in one.collect()} == set(classes(ids, links).values())

    far = steps["decontamination"](spark, docs, SF001).cache()
    hits = {i: plain_hits(t, items) for i, t in rows.items()}
    assert {r.doc_id for r in far.collect()} == {i for i, (n, h, _) in hits.items() if not (h > 0 and 20 * h >= n)}

    masked = steps["personal-data"](spark, docs, SF001).collect()
    assert len(masked) == len(rows)
    for r in masked:
        spans = pii.base_spans(rows[r.doc_id])
        assert r.n_chars == len(r.text) and not [k for k, _, _ in pii.base_spans(r.text) if k in ("email", "ip")]
        if not spans and not any(c.isdigit() or c == "@" for c in rows[r.doc_id]):
            assert r.text == rows[r.doc_id]
    for frame in (clean, one, far):
        assert frame.columns == corpus_pipeline.COLUMNS
    assert decontam.WINDOW == 13


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF001).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) > 100
    assert len({(r.bucket, r.batch, r.slot) for r in out}) == len(out)
    assert corpus_pipeline.ORACLE_SQL is None


def test_subpackage_stands_alone():
    import airgrid
    for m in pkgutil.walk_packages(airgrid.__path__, "airgrid."):
        if not m.name.startswith("airgrid.llm"):
            text = open(importlib.util.find_spec(m.name).origin, encoding="utf-8").read()
            assert "airgrid.llm" not in text, m.name
