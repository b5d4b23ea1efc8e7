"""Licences: the canonical form does not depend on line wraps; ownership lines go, licence text stays."""

import textwrap

from pyspark.sql import functions as F

from airgrid.llm import licenses


def wrapped(text, width):
    """Every paragraph at ``width``; None: the whole text as one line."""
    if width is None:
        return " ".join(text.split())
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)
                       for p in text.split("\n\n"))


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(df, licenses.known_licenses(spark)).collect()
    return [r.license_id for r in sorted(rows, key=lambda r: r.doc_id)]


def test_known_texts_at_any_width(spark):
    heads = ["", "Copyright (c) 2020 Some Body, Inc.\n\n", "# (c) Other\n# All rights reserved.\n\n", "Copyright 2019-2021 The Authors. All rights reserved.\n\n"]
    cases = [(i, head + wrapped(t, w)) for i, t in licenses.KNOWN for w in (20, 60, 72, 79, 100, None) for head in heads]
    cases += [(i, wrapped(head + t, None)) for i, t in licenses.KNOWN for head in heads if not head.startswith("#")]
    got = found(spark, [t for _, t in cases])
    assert [(w, g, t[:60]) for (w, t), g in zip(cases, got, strict=True) if w != g] == []


def test_title_then_ownership(spark):
    mit = licenses.KNOWN[0][1]
    for sep in ("\n\n", " "):
        assert found(spark, [f"MIT License{sep}Copyright (c) 2020 J. R. Doe <j@example.com>{sep}" + wrapped(mit, 70)]) == ["MIT"]


def test_only_ownership_goes(spark):
    texts = ["copyright holders be liable", "some words\ncopyright holders be liable", "some words\n(c) you must keep this",
             "Copyright (c) 2020 Some Body. You must pay for this software.", "intro\nall rights reserved by law to others"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.c for r in df.select(licenses.canonical(F.col("text")).alias("c")).collect()]
    assert got == ["copyright holders be liable", "some words copyright holders be liable", "some words c you must keep this",
                   "you must pay for this software", "intro all rights reserved by law to others"]
    gone = ["Copyright (c) 2020 X", "some words\n * Copyright 2020 X, Inc.\nmore", "some words\nAll rights reserved.", "(c) Other"]
    df = spark.createDataFrame([(t,) for t in gone], "text string")
    got = [r.c for r in df.select(licenses.canonical(F.col("text")).alias("c")).collect()]
    assert got == ["", "some words more", "some words", ""]
    assert found(spark, ["Copyright law is hard. Released under the MIT License.",
                         "Copyright (c) 2020 Some Body. You must pay. Released under the MIT License."]) == [None, None]
