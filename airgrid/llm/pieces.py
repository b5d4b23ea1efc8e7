"""SentencePiece encoding through a table of distinct chunks, and decoding.

Where no piece crosses a white-space marker, a text's pieces are those of its chunks
(a run of markers and the characters up to the next one).  Tasks cut blocks of
documents into chunks, keep every document as codes of its block's distinct chunks and
deal those chunks into buckets by hash.  A bucket holds every block's share of it, so
each distinct chunk is segmented once; the ids go back by block and code and stand at
each document's positions again.  Lists travel packed, one row a block and bucket.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.blocks import text_blocks
from airgrid.llm.common import stored_by, widest

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
BLOCK_BYTES = 24 << 20
BUCKET_DOCS = 8_192          # documents a bucket of chunks on average
_CUT = "block long, bucket int, codes binary, lengths binary, body binary"
_CUT_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary()), ("lengths", pa.binary()),
                        ("body", pa.binary())])
_IDS = "_block long, codes binary, lengths binary, body binary"


def processor(raw: bytes):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_proto=raw)


def require_separable(raw: bytes) -> None:
    """Raise unless chunks of a text encode on their own under this model.

    No piece may hold a marker behind another character, the bare marker must be a
    piece, and texts must be normalised by markers for spaces and one marker in front only.
    """
    sp = processor(raw)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("a piece of this model crosses a white-space marker")
    probe = "  A  b\téﬁ Ⅳ "
    if sp.is_unknown(sp.piece_to_id(MARK)) or sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("this model normalises texts; their chunks do not encode on their own")


def share_model(spark: SparkSession, path: str = MODEL):
    """Broadcast of the model file's bytes (half a megabyte); the path is read on the driver only."""
    with open(path, "rb") as f:
        raw = f.read()
    require_separable(raw)
    return spark.sparkContext.broadcast(raw)


def chunks(text: str) -> list[str]:
    """Chunks of a text in order; joined they are the marked text.  An empty text has none."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def pack(values: np.ndarray) -> bytes:
    """Compressed numbers below 2**32: seven bits a byte, the high bit on all but the last byte of a number."""
    v = np.asarray(values, dtype=np.uint64)
    size = np.ones(len(v), np.int64)
    for k in (7, 14, 21, 28):
        size += v >= np.uint64(1 << k)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(v) else 0, np.uint8)
    for k in range(5):
        some = size > k
        more = np.where(size[some] > k + 1, 128, 0)
        out[end[some] - size[some] + k] = (v[some] >> np.uint64(7 * k)).astype(np.uint64) & np.uint64(127) | more.astype(np.uint64)
    return zstandard.compress(out.tobytes(), 3)


def unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.decompress(raw), np.uint8)
    last = b < 128
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if last.any() else np.empty(0, np.int64)
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    part = (b & 127).astype(np.int64) << (7 * place)
    return np.add.reduceat(part, start) if len(start) else np.empty(0, np.int64)


def _cut(buckets: int):
    """One row per block (its documents as codes, bucket null), one per block and bucket of its distinct chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in text_blocks(batches, BLOCK_BYTES):
            local: dict[str, int] = {}
            first = [np.array([local.setdefault(c, len(local)) for c in chunks(t)], dtype=np.int64) for t in texts]
            size = np.array([len(c) for c in first], np.int64)
            codes = np.concatenate(first)
            # Frequent chunks get small codes.
            order = np.argsort(-np.bincount(codes, minlength=len(local)), kind="stable")
            rank = np.empty(len(local), np.int64)
            rank[order] = np.arange(len(local))
            known = np.array([i is not None for i in ids])
            about = np.array([0 if i is None else i for i in ids], "<i8")
            yield pa.record_batch([pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.array([pack(rank[codes])], pa.binary()),
                                   pa.array([pack(size)], pa.binary()), pa.array([known.tobytes() + about.tobytes()], pa.binary())],
                                  schema=_CUT_ARROW)
            words = list(local)
            del local, first, codes
            dealt: dict[int, list[int]] = {}
            for code, i in enumerate(order.tolist()):
                dealt.setdefault(zlib.crc32(words[i].encode("utf-8", "replace")) % buckets, []).append(code)
            held = []
            for k, c in dealt.items():
                own = [words[order[x]] for x in c]
                held.append((block, k, pack(np.diff(c, prepend=0)), pack([len(w) for w in own]),
                             zstandard.compress("".join(own).encode("utf-8", "replace"), 3)))
            if held:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), _CUT_ARROW, strict=True)], schema=_CUT_ARROW)
    return run


def _segmenter(raw):
    """Ids of the chunks of each row; a task holds the distinct chunks of its buckets and segments each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(raw.value)
        known: dict[str, list[int]] = {MARK: [sp.piece_to_id(MARK)]}
        at = None
        for b in batches:
            rows = []
            for block, bucket, codes, lengths, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at:                                   # rows come bucket by bucket
                    known, at = {MARK: known[MARK]}, bucket
                joined, ends = zstandard.decompress(body).decode("utf-8"), np.cumsum(unpack(lengths)).tolist()
                words = [joined[i:j] for i, j in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                # The library puts the first marker in front itself.
                known.update(zip(new, sp.encode([w[1:] for w in new], num_threads=1), strict=True))
                ids = [known[w] for w in words]
                rows.append((block, codes, pack([len(i) for i in ids]), pack(list(chain.from_iterable(ids)))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()),
                                                                  strict=True)], names=["_block", "codes", "lengths", "body"])
    return run


def encode(docs: DataFrame, finish, schema: str, model: str = MODEL, id_col: str = "doc_id",
           text_col: str = "text", end_id: bool = True) -> DataFrame:
    """Apply ``finish`` to every document's ids, as the library encodes its whole text.

    ``finish(processor, doc_id, ids, joined)`` gets the ids (a list, with the end id
    when ``end_id``) and the same as decimal numbers joined by spaces, inside the task
    that holds the document's block, and returns the values of ``schema``.

    One row per row of ``docs``; null texts count as empty (end id only), repeated and
    null ids stay rows of their own, other columns are not read, an empty table gives
    an empty table.  A text without spaces is one chunk, however long.
    """
    raw = share_model(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(widest(docs), -(-rows.count() // BUCKET_DOCS))
    # Bucketed by block, so that the documents' codes do not move again.
    cut = stored_by(rows.mapInArrow(_cut(buckets), _CUT), "pieces", "block", widest(docs))
    words = cut.where(F.col("bucket").isNotNull()).select("block", "bucket", "codes", "lengths", "body")
    found = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_segmenter(raw), _IDS)
    texts = cut.where(F.col("bucket").isNull()).drop("bucket")
    names = [part.split()[0] for part in schema.split(",")]

    def join_back(held: pa.Table, known: pa.Table) -> pa.Table:
        sp = processor(raw.value)
        given = [(np.cumsum(unpack(c)), unpack(n), unpack(b)) for c, n, b in
                 zip(*(known[c].to_pylist() for c in ("codes", "lengths", "body")), strict=True)]
        table: list[list[int]] = [[]] * sum(len(c) for c, _, _ in given)
        for codes, size, flat in given:
            ends, flat = np.cumsum(size), flat.tolist()
            for code, lo, hi in zip(codes.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
                table[code] = flat[lo:hi]
        del given
        text = [" ".join(map(str, one)) for one in table]
        last, tail = ([sp.eos_id()], [str(sp.eos_id())]) if end_id else ([], [])
        out = []
        for raw_codes, raw_size, about in zip(*(held[c].to_pylist() for c in ("codes", "lengths", "body")), strict=True):
            codes, size = unpack(raw_codes), unpack(raw_size)
            is_known = np.frombuffer(about, bool, len(size))
            ids, at = np.frombuffer(about, "<i8", len(size), len(size)), 0
            for i, ok, n in zip(ids.tolist(), is_known.tolist(), size.tolist(), strict=True):
                own = codes[at:at + n].tolist()
                at += n
                out.append(finish(sp, i if ok else None, [*chain.from_iterable(map(table.__getitem__, own)), *last],
                                  " ".join([*map(text.__getitem__, own), *tail])))
        return pa.Table.from_pandas(pd.DataFrame(out, columns=names), preserve_index=False)

    return texts.groupBy("block").cogroup(found.groupBy("_block")).applyInArrow(_typed(join_back, schema), schema)


def _typed(fn, schema: str):
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    target = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in schema.split(",")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right).cast(target)
    return run


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    def finish(sp, i, ids: list[int], joined: str):
        return i, len(ids), sha256(joined), sha256(sp.decode(ids))
    return encode(docs, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", model)


def encoded(docs: DataFrame, model: str = MODEL, end_id: bool = True) -> DataFrame:
    """doc_id, ids and the decoded text of every document."""
    def finish(sp, i, ids: list[int], joined: str):
        return i, ids, sp.decode(ids)
    return encode(docs, finish, "doc_id long, ids array<int>, decoded string", model, end_id=end_id)
