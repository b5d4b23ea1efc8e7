"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Tasks cut blocks of documents into units that both tokenizers encode on their own
(a space between two other characters starts a token of either), encode each distinct
unit of a block once and link the tokens that end together.  Per block every linked id
pair gets a compressed document bitmap (sorted 16-bit places, or plain bits where that
is smaller): one of the documents that hold it, and one per binary digit of what its
multiplicity exceeds one by.  Popcounts add up over blocks, whose documents are
disjoint, to document and link counts of the corpus; the scores of a pair then join
its bitmaps and return to the documents named there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.blocks import text_blocks
from airgrid.llm.common import stored
from airgrid.llm.pieces import MARK, MODEL, processor, require_separable

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
# What any of the libraries may take for white space, format characters included.
_WHITE = ("\x00-\x20\x7f-\xa0­ ᠎ -‏ -  -⁤　﻿")
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_EDGES = re.compile(f"[^{_WHITE}](?:.*[^{_WHITE}])?", re.DOTALL)
BLOCK_BYTES = 16 << 20
_RUN = 1 << 16                       # characters of units that are encoded as one text
_LINKS = 1 << 22                     # links counted in one array operation
_COLUMNS = [("block", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
            ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("plane", pa.int32()),
            ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()), ("dense", pa.bool_()), ("bits", pa.binary())]
_SCHEMA = ("block long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "plane int, a int, b int, docs long, dense boolean, bits binary")


def units(text: str) -> list[str]:
    """A text cut at every single space between two other characters; each unit stands for itself behind a space."""
    return _CUT.split(text) if text else []


def _byte_alphabet() -> dict[str, int]:
    """Character of the byte-level vocabulary -> byte: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_model.decode("utf-8"))
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in json.loads(byte_model)["model"]["vocab"].items()
                        if all(c in alphabet for c in t)}
        self.sp = processor(piece_model)
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode("utf-8")
                        for i, p in enumerate(map(self.sp.id_to_piece, range(self.sp.get_piece_size())))]
        self.b_size = np.array([len(t) for t in self.b_bytes])

    def _texts(self, words: list[str]) -> Iterator[list[int]]:
        """Places of the units that are encoded as one text: runs of units whose ends are no white space, others alone."""
        run, held = [], 0
        for i, w in enumerate(words):
            if not _EDGES.fullmatch(w):
                yield [i]
                continue
            run.append(i)
            held += len(w)
            if held >= _RUN:
                yield run
                run, held = [], 0
        if run:
            yield run

    def encode(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: places of its units, ids of either tokenizer and the byte offsets behind them.

        Both encode a unit behind a space on its own, so units joined by spaces give
        the ids of each; a unit ends where the bytes of its tokens end.
        """
        for places in self._texts(words):
            text = " ".join([words[i] for i in places])
            a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
            b = np.array(self.sp.encode(text), np.int64)                     # the library adds the space
            raw = (" " + text).encode("utf-8", "replace")
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw:
                yield places, a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            elif len(places) > 1:
                for i in places:                         # one of them is not given back: tell which
                    for _, *one in self.encode([words[i]]):
                        yield [i], *one
            else:
                yield places, a[:0], b[:0], a[:0], b[:0]


def _shown(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
    """``a1,a2|b1`` of every group, from ids and the places of the groups' last tokens."""
    text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
        out.append((text_a[i] if x == i + 1 else ",".join(text_a[i:x])) + "|" + (text_b[j] if y == j + 1 else ",".join(text_b[j:y])))
        i, j = x, y
    return out


def link_units(both: Pair, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[np.ndarray]]:
    """Per unit: tokens of either kind, groups (none: not given back), the groups as text and links as a * 2**32 + b.

    Tokens are never empty, so exactly the last two tokens of a group end together.
    """
    n_a, n_b, n_groups = (np.zeros(len(words), np.int64) for _ in range(3))
    text, links = [""] * len(words), [np.empty(0, np.int64)] * len(words)
    for places, a, b, end_a, end_b in both.encode(words):
        if not len(a):
            continue
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        linked, shown = (a[last_a] << 32) | b[last_b], _shown(a, b, last_a, last_b)
        ends = np.cumsum([len(words[i].encode("utf-8", "replace")) + 1 for i in places])
        cut = np.searchsorted(common, ends) + 1                             # groups up to each unit's end
        n_a[places] = np.diff(np.searchsorted(end_a, ends) + 1, prepend=0)
        n_b[places] = np.diff(np.searchsorted(end_b, ends) + 1, prepend=0)
        n_groups[places] = np.diff(cut, prepend=0)
        for i, lo, hi in zip(places, [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
            text[i], links[i] = ";".join(shown[lo:hi]), linked[lo:hi]
    return n_a, n_b, n_groups, text, links


def _gather(start: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of all elements of the runs ``at``, in order."""
    n = count[at]
    return np.repeat(start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _multiplicities(start, count, links, unit, slot, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (pair * width + slot) keys and how often each occurs, in slices of bounded size."""
    ends = np.cumsum(count[unit])
    keys, times, lo = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while lo < len(unit):
        done = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, done + _LINKS, side="right")), lo + 1)
        u = unit[lo:hi]
        key = links[_gather(start, count, u)] * width + np.repeat(slot[lo:hi], count[u])
        k, n = np.unique(key, return_counts=True)
        if len(keys):
            k, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([times, n])).astype(np.int64)
        keys, times, lo = k, n, hi
    return keys, times


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.record_batch([columns.get(c, pa.nulls(n, t)) if not isinstance(columns.get(c), np.ndarray)
                            else pa.array(columns[c], t) for c, t in _COLUMNS], names=[c for c, _ in _COLUMNS])


def _bitmaps(block: int, plane: int, pair: np.ndarray, slot: np.ndarray, ids: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """One bitmap per pair, from (pair, slot) sorted by both."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    size = np.diff(np.concatenate([first, [len(pair)]]))
    dense = 2 * size > -(-width // 8)
    for is_dense in (False, True):
        rows = np.flatnonzero(dense == is_dense)
        if not len(rows):
            continue
        if is_dense:
            bits = np.zeros((len(rows), -(-width // 8) * 8), dtype=np.uint8)
            bits[np.repeat(np.arange(len(rows)), size[rows]), slot[_gather(first, size, rows)]] = 1
            data = np.packbits(bits, axis=1)
            offsets = np.arange(len(rows) + 1) * data.shape[1]
        else:
            data = slot[_gather(first, size, rows)].astype("<u2")
            offsets = np.concatenate([[0], np.cumsum(2 * size[rows])])
        held = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        key, n = ids[pair[first[rows]]], len(rows)
        yield _batch({"block": np.full(n, block), "plane": np.full(n, plane, np.int32), "a": (key >> 32).astype(np.int32),
                      "b": (key & 0xFFFFFFFF).astype(np.int32), "docs": size[rows], "dense": np.full(n, is_dense), "bits": held}, n)


def _index(byte_model, piece_model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(byte_model.value, piece_model.value)
        for block, ids, texts in text_blocks(batches, BLOCK_BYTES):
            yield from _block(both, block, ids, texts)
    return run


def _block(both: Pair, block: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of documents and of pair bitmaps of one block."""
    local: dict[str, int] = {}
    held = [np.array([local.setdefault(u, len(local)) for u in units(t)], dtype=np.int64) for t in texts]
    n_a, n_b, count, text, links = link_units(both, list(local))
    local.clear()
    valid = count > 0
    pairs, linked = np.unique(np.concatenate([np.empty(0, np.int64), *links]), return_inverse=True)
    del links
    start = np.cumsum(count) - count
    ok = [bool(len(u)) and bool(valid[u].all()) for u in held]
    totals = [[int(v[u].sum()) if k else 0 for u, k in zip(held, ok, strict=True)] for v in (n_a, n_b, count)]
    shown = [hashlib.sha256(";".join([text[i] for i in u.tolist()]).encode()).hexdigest() if k else ""
             for u, k in zip(held, ok, strict=True)]
    n = len(ids)
    yield _batch({"block": np.full(n, block), "slot": np.arange(n, dtype=np.int32), "doc_id": pa.array(ids, pa.int64()),
                  "n_a": np.array(totals[0], np.int64), "n_b": np.array(totals[1], np.int64),
                  "n_groups": np.array(totals[2], np.int64), "n_links": np.array(totals[2], np.int64),
                  "groups_sha256": pa.array(shown)}, n)
    good = [i for i, k in enumerate(ok) if k]
    if not good:
        return
    unit = np.concatenate([held[i] for i in good])
    slot = np.repeat(np.array(good, np.int64), [len(held[i]) for i in good])
    keys, times = _multiplicities(start, count, linked, unit, slot, n)
    pair, slot, extra = keys // n, keys % n, times - 1
    yield from _bitmaps(block, 0, pair, slot, pairs, n)
    for digit in range(int(extra.max()).bit_length()):
        has = (extra >> digit & 1).astype(bool)
        if has.any():
            yield from _bitmaps(block, digit + 1, pair[has], slot[has], pairs, n)


def weight(plane):
    """Links that one bit of a plane stands for: the document plane one, digit planes 1, 2, 4, ..."""
    return F.when(plane == 0, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), plane - 1))


def share(spark: SparkSession, byte_model: str, piece_model: str):
    """Broadcasts of both model files (two megabytes); the paths are read on the driver only."""
    with open(byte_model, "rb") as f, open(piece_model, "rb") as g:
        left, right = f.read(), g.read()
    require_separable(right)
    return spark.sparkContext.broadcast(left), spark.sparkContext.broadcast(right)


def index(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = MODEL,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table of documents (plane null) and of the bitmaps of each block's linked id pairs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_index(*share(docs.sparkSession, byte_model, piece_model)), _SCHEMA), "pairs")


def pair_scores(indexed: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links and best (no other a has more links with this b) of every linked pair."""
    planes = indexed.where(F.col("plane").isNotNull())
    counted = planes.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("docs")).otherwise(0)).alias("n_docs"),
        F.sum(F.col("docs") * weight(F.col("plane"))).alias("n_links"))
    # One row per id of the second vocabulary: its size bounds the broadcast.
    top = counted.groupBy("b").agg(F.max("n_links").alias("_top"))
    return counted.join(F.broadcast(top), "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_top")).alias("best"))


_OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _return(held: pa.Table, found: pa.Table) -> pa.Table:
    """Add the scores of a block's bitmaps to the documents whose bits are set."""
    held = held.sort_by("slot")
    n = held.num_rows
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for batch in found.to_batches(max_chunksize=65_536):
        plane = batch["plane"].to_numpy(zero_copy_only=False).astype(np.int64)
        links = batch["links"].to_numpy(zero_copy_only=False).astype(np.int64)
        is_best = batch["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        dense = batch["dense"].to_numpy(zero_copy_only=False).astype(bool)
        times = np.left_shift(1, np.maximum(plane - 1, 0))
        sparse = np.flatnonzero(~dense)
        if len(sparse):
            bits = batch["bits"].take(pa.array(sparse))
            raw = b"".join(bits.to_pylist())
            slot = np.frombuffer(raw, dtype="<u2")
            size = batch["docs"].to_numpy(zero_copy_only=False).astype(np.int64)[sparse]
            np.add.at(best, slot, np.repeat((times * is_best)[sparse], size))
            np.add.at(total, slot, np.repeat((times * links)[sparse], size))
        for r in np.flatnonzero(dense):
            on = np.unpackbits(np.frombuffer(batch["bits"][r].as_py(), dtype=np.uint8), count=n).astype(bool)
            best[on] += times[r] * is_best[r]
            total[on] += times[r] * links[r]
    cols = {c: held[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**cols, "n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": held["groups_sha256"]})


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = MODEL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The first tokenizer encodes a space and the text, the second the text with the
    space it adds.  Texts that are null, empty or not given back by both (a U+2581 in
    the text) have no tokens: zeros and an empty groups_sha256; they link nothing.
    Ties share the highest count.  Repeated and null ids stay rows of their own, other
    columns are not read, and an empty table gives an empty table.
    """
    indexed = index(docs, byte_model, piece_model)
    planes = indexed.where(F.col("plane").isNotNull())
    scores = pair_scores(indexed).select("a", "b", F.col("n_links").alias("links"), "best")
    # A pair has one short row per block and plane; AQE splits the rows of a frequent one.
    found = planes.select(F.col("block").alias("_block"), "a", "b", "plane", "docs", "dense", "bits").join(scores, ["a", "b"]).drop("a", "b")
    held = indexed.where(F.col("plane").isNull()).select("block", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return held.groupBy("block").cogroup(found.groupBy("_block")).applyInArrow(_return, _OUT)
