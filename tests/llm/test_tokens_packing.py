"""Token attribution and packing against plain computations."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from airgrid.llm import packing, tokens
from tests.conftest import SF001

TEXTS = ["", "Hello world", "  two  spaces \n\n next\r\nline\tend ", "né à Zürich — 東京 🎉🎉\nx", "a" * 300, "1234567890 \x1c \x85 x y",
         "don't stop\n", "\n\n\n", "tail  "]


def encoding():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.encoder(f.read())


def plain(text, sections, rule):
    """Tokens per section by decoding token after token."""
    enc, _ = encoding()
    raw = text.encode()
    char = []
    for k, c in enumerate(text):
        char += [k] * len(c.encode())
    out, at = [[0, 0] for _ in sections], 0
    for t in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(t))
        first, last = char[at], char[at + n - 1]
        at += n
        a = {"first": first, "last": last, "middle": (first + last) // 2}[rule]
        for s, (lo, hi) in zip(out, sections, strict=True):
            if lo <= a < hi:
                s[0] += 1
                s[1] += first < lo or last >= hi
    assert at == len(raw)
    return [tuple(s) for s in out]


def test_pieces_and_chunks_encode_as_the_whole(spark):
    enc, lengths = encoding()
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(60).collect()]
    counts = tokens._Counts(enc)
    for t in texts:
        whole = enc.encode_ordinary(t)
        assert [i for p in tokens.pieces(t, 40) for i in enc.encode_ordinary(p)] == whole
        assert sum(counts[c] for c in tokens._CHUNK.findall(t)) == len(whole)


def test_lines_equal_plain_attribution(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "x y"), (50, None), (1, "Hello world")], "doc_id long, text string")
    df = df.withColumn("section", F.lit("clash"))
    got = defaultdict(list)
    for r in tokens.attribute(df).collect():
        got[r.doc_id].append((r.section, r.begin, r.until, r.n_tokens, r.crossing))
    for i, t in enumerate(TEXTS):
        begin, until = tokens.line_sections(t)
        want = [(k, b, u, *c) for k, (b, u, c) in enumerate(zip(begin, until, plain(t, list(zip(begin, until)), "first")))]
        assert sorted(got[i]) == sorted(want * (2 if i == 1 else 1)), repr(t)
        assert begin[0] == 0 and until[-1] == len(t) and (begin[1:] == until[:-1]).all()
    assert got[50] == [(0, 0, 0, 0, 0)] and len(got[None]) == 1
    assert tokens.attribute(df.limit(0)).count() == 0


def test_given_sections_and_rules(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, t in enumerate(TEXTS * 3):
        ends = np.sort(rng.integers(0, len(t) + 3, (4, 2)), axis=1)
        rows.append((i, t, [{"begin": int(a), "until": int(b)} for a, b in ends]))
    rows.append((900, "no list", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<begin:long,until:long>>")
    for rule in tokens.RULES:
        got = {(r.doc_id, r.section): (r.n_tokens, r.crossing) for r in tokens.attribute(df, sections_col="s", rule=rule).collect()}
        for i, t, s in rows[:-1]:
            want = plain(t, [(x["begin"], x["until"]) for x in s], rule)
            assert [got[i, k] for k in range(4)] == want, (repr(t), s, rule)
        assert not any(i == 900 for i, _ in got)


def test_boundaries_equal_exhaustive_search():
    from itertools import combinations
    rng = np.random.default_rng(4)
    for _ in range(120):
        n = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(np.arange(0, 60), n, replace=False))
        counts = rng.integers(1, 50, n)

        def padding(ends):
            e = np.array(ends)
            return int(((e[np.searchsorted(e, lengths)] - lengths) * counts).sum())  # noqa: B023
        for k in (1, 2, 3, 5):
            best = min(padding([*c, lengths[-1]]) for r in range(min(k, n)) for c in combinations(lengths[:-1].tolist(), r))
            got = packing.optimal_boundaries(lengths, counts, k)
            assert len(got) <= k and got[-1] == lengths[-1] and padding(got) == best


def test_packing_places_every_row_once_within_budget(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("bucket", F.lit("clash"))
    df = df.unionByName(df.limit(3)).unionByName(df.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    enc, _ = encoding()
    want = Counter((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in df.collect())
    got = packing.pack_texts(df, buckets=5, budget=4096).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got) and len({r.bucket for r in got}) <= 5
    rows = Counter((r.bucket, r.batch) for r in got)
    for r in got:
        assert r.n_tokens <= r.padded_length
        assert rows[r.bucket, r.batch] * r.padded_length <= 4096 or rows[r.bucket, r.batch] == 1
    for b in {r.bucket for r in got}:                              # all batches but the last are full
        sizes = [n for (k, i), n in sorted(rows.items()) if k == b]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]
    assert packing.pack_texts(df.limit(0)).count() == 0


def test_length_classes_are_tight(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 4096, 4097, 5000, 8191, 8192, 8193, 100001, 10**9 + 7]], "n long")
    for r in df.select("n", packing.length_class(F.col("n")).alias("c")).collect():
        assert r.n <= r.c <= r.n * (1 + 1 / 2047) + 1 and (r.n > 4096 or r.c == r.n)
