"""Tokenizer alignment against whole-text encoding and plain counting."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np

from airgrid.llm import align, pieces
from airgrid.llm.queries import op13_alignment
from tests.conftest import SF001
from tests.llm.test_pieces import ODD


def byte_table():
    """GPT-style byte alphabet, written out independently of the operator."""
    table, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return table


def plain(ids, texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(align.BYTE_MODEL)
    a.encode_special_tokens = True
    table = byte_table()
    a_bytes = {i: bytes(table.get(c, 0) for c in t) for t, i in json.load(open(align.BYTE_MODEL))["model"]["vocab"].items()}
    sp = SentencePieceProcessor(model_file=pieces.MODEL)

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
    docs, count = [], Counter()
    for t in texts:
        parts, links, xs, ys = [], [], [], []
        if t:
            xs, ys = a.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            xb, yb = [a_bytes[i] for i in xs], [b_bytes(i) for i in ys]
            if not (b"".join(xb) == b"".join(yb) == (" " + t).encode()):
                xs, ys = [], []
            else:
                xe, ye = np.cumsum([len(x) for x in xb]), np.cumsum([len(y) for y in yb])
                xi, yi = {int(e): i for i, e in enumerate(xe)}, {int(e): i for i, e in enumerate(ye)}
                i0 = j0 = 0
                for e in sorted(xi.keys() & yi.keys()):
                    i, j = xi[e], yi[e]
                    parts.append(",".join(map(str, xs[i0:i + 1])) + "|" + ",".join(map(str, ys[j0:j + 1])))
                    links.append((xs[i], ys[j]))
                    i0, j0 = i + 1, j + 1
        count.update(links)
        docs.append((xs, ys, parts, links))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(i, len(xs), len(ys), len(parts), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(parts).encode()).hexdigest() if xs else "")
            for i, (xs, ys, parts, links) in zip(ids, docs, strict=True)]


def test_units_join_to_the_text():
    for t in ODD:
        assert " ".join(align.units(t)) == (t or "")
    assert align.units("a b  c\td e") == ["a", "b  c\td", "e"]


def test_equals_plain_on_odd_and_random_texts(spark):
    rng = random.Random(5)
    words = [" the", " of", "ing", " 1234", "'s", "\n", "  ", " é", "中文", " <|endoftext|>", " don't", " re-partition", " ", " ", " x"]
    texts = ODD + ["".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(500)] + [" the" * 3000] * 4
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, ids, ids)), "doc_id long, text string, slot long, a long").repartition(3)
    assert sorted(map(str, map(tuple, align.align(df).collect()))) == sorted(map(str, plain(ids, texts)))
    assert align.align(df.limit(0)).count() == 0


def test_dense_bitmaps_and_counts(spark):
    texts = ["the cat and the cat"] * 700 + ["a dog"] * 40 + ["the end"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    indexed = align.index(df)
    assert indexed.where("dense").count() > 0 and indexed.where("NOT dense").count() > 0 and indexed.where("plane > 0").count() > 0
    assert sorted(map(tuple, align.align(df).collect())) == plain(range(len(texts)), texts)
    scores = {(r.a, r.b): (r.n_docs, r.n_links) for r in align.pair_scores(indexed).collect()}
    assert (700, 1400) in scores.values() and (703, 1403) in scores.values()


def test_slices_of_links_add_up():
    start, count, links = np.array([0, 2]), np.array([2, 1]), np.array([0, 1, 1])
    unit, slot = np.array([0, 1, 0, 0, 1]), np.array([0, 0, 1, 1, 1])
    whole = align._multiplicities(start, count, links, unit, slot, 10)
    old, align._LINKS = align._LINKS, 2
    try:
        cut = align._multiplicities(start, count, links, unit, slot, 10)
    finally:
        align._LINKS = old
    assert whole[0].tolist() == [0, 1, 10, 11] and whole[1].tolist() == [1, 2, 2, 3]
    assert [x.tolist() for x in cut] == [x.tolist() for x in whole]


def test_query_over_documents(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op13_alignment(spark, SF001).collect()))
    assert got == sorted(plain([r.doc_id for r in rows], [r.text for r in rows]))
