"""Piece ids against the library on whole texts."""

import hashlib
import random

import pytest

from airgrid.llm import pieces
from airgrid.llm.queries import op11_pieces
from tests.conftest import SF001

ODD = ["", None, " ", "  ", "a", " a", "a ", "  a  b   c ", "▁x ▁", "a▁b ▁▁ c", "<s> </s> <unk> <0x0A>", "tab\there\r\nand\n\n there",
       "ﬁ Ⅳ é é　　x", "東京 は 日本の首都です", "a\x00b \x00", "emoji 🧪🧪 👩‍👩‍👧", "x" * 5000, "ab " * 4000, " " * 3000, "\n" * 1000,
       "١٢٣ ٤٥٦", "é " * 50, "﻿bom", "𝔘𝔫𝔦 ", "zero​width"]


def plain(texts):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    out = []
    for t in texts:
        ids = sp.encode(t or "", add_eos=True)
        out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out


def test_chunks_are_the_marked_text():
    for t in ODD:
        assert "".join(pieces.chunks(t)) == ("▁" + t.replace(" ", "▁") if t else "")


def test_equals_library_on_odd_and_random_texts(spark):
    rng = random.Random(3)
    alphabet = [" ", " ", "▁", "a", "b", "the", "ing", "é", "中", "\n", "\t", "1", "'s", ".", "🧪", "  "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    ids = [None if i == 7 else i // 2 for i in range(len(texts))]              # repeated and null ids
    df = spark.createDataFrame(list(zip(ids, texts, ids, texts)), "doc_id long, text string, code long, chunk string").repartition(3)
    got = sorted(map(str, map(tuple, pieces.digests(df).collect())))
    assert got == sorted(str((i, *r)) for i, r in zip(ids, plain(texts), strict=True))


def test_ids_and_text_come_back(spark):
    df = spark.createDataFrame([(1, "a b  c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encoded(df, end_id=False).collect()}
    assert got[1].decoded == "a b  c" and got[2].ids == [] and got[2].decoded == ""
    assert pieces.digests(df.limit(0)).count() == 0


def test_blocks_end_by_bytes_and_rows():
    import pyarrow as pa

    from airgrid.llm import blocks

    class Here:
        partitionId = staticmethod(lambda: 2)
    old, blocks.TaskContext = blocks.TaskContext, type("T", (), {"get": staticmethod(lambda: Here)})
    try:
        batch = pa.record_batch({"i": pa.array([1, 2, 3, None, 5]), "t": pa.array(["aa", None, "b" * 50, "c", ""])})
        got = list(blocks.text_blocks(iter([batch, batch]), size=40, most=3))
    finally:
        blocks.TaskContext = old
    assert [b - (2 << 32) for b, _, _ in got] == [0, 1, 2, 3]
    assert [len(i) for _, i, _ in got] == [3, 3, 2, 2] and sum((t for _, _, t in got), [])[1] == ""


def test_a_model_whose_pieces_cross_markers_is_refused(monkeypatch):
    class Crossing:
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")
    monkeypatch.setattr(pieces, "processor", lambda raw: Crossing)
    with pytest.raises(ValueError):
        pieces.require_separable(b"")


def test_query_over_documents(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = op11_pieces(spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True))


def test_packed_numbers_come_back():
    import numpy as np
    for v in ([], [0], [1, 127, 128, 16383, 16384, 2 ** 21, 2 ** 28, 2 ** 32 - 1, 0, 5], list(range(70000))):
        assert pieces.unpack(pieces.pack(np.array(v, np.int64))).tolist() == v


def test_many_small_blocks_share_chunks(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 200)
    monkeypatch.setattr(pieces, "BUCKET_DOCS", 20)
    texts = [f"the cat {i % 7} sat  on {'x' * (i % 5)} the mat" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, pieces.digests(df).collect())) == [(i, *p) for i, p in enumerate(plain(texts))]
