"""Benchmark decontamination by winnowed word fingerprints.

Of every ``w`` consecutive ``k``-gram hashes the minimum is kept, in documents and
in benchmark items alike, so every shared span of ``k + w - 1`` words (the window
length, 13) leaves the same fingerprint in both.  A document's fingerprints that occur
in the benchmark are extended to the windows around them: each such window is looked
up once among the benchmark's distinct windows and compared word by word, so the work
is linear in the document however often words repeat on either side.  An item shorter than a window
is one window of its own length ``n`` and is winnowed with ``k = n, w = 1``.

The benchmark is the query set: it is cut into pieces of bounded length, the
pieces are dealt into blocks of about ``BLOCK_WORDS`` words, and each block is
broadcast to one scan of the documents.  Documents are never shuffled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import stored
from airgrid.llm.words import gram_hashes, word_hashes

WINDOW, GRAM = 13, 5
PIECE_WINDOWS, BLOCK_WORDS = 4096, 1_000_000
_STARTS = 50_000             # windows compared in one array operation


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of at least one run of ``w`` grams (all ties).

    Fewer than ``w`` grams count as one run; none give none.
    """
    n = len(grams)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    w = min(w, n)
    low = np.lib.stride_tricks.sliding_window_view(grams, w).min(axis=1)
    pad = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    best = np.lib.stride_tricks.sliding_window_view(pad, w).max(axis=1)
    return np.flatnonzero(best == grams)


@dataclass(frozen=True)
class Block:
    """Fingerprints of some benchmark pieces: sorted hashes with their piece word position."""

    words: np.ndarray            # word hashes of all pieces, one after the other
    hashes: np.ndarray           # sorted distinct fingerprints of full windows
    windows: np.ndarray          # sorted distinct hashes of full windows
    places: np.ndarray           # word position of one window of each hash
    first: np.ndarray            # where the items of each hash begin in ``items``, and the end
    items: np.ndarray            # distinct item numbers of each hash
    short: dict                  # length -> (sorted gram hashes, item numbers) of short items
    ids: list                    # item number -> item id


def make_block(pieces: list[tuple[object, np.ndarray]], window: int = WINDOW, k: int = GRAM) -> Block:
    ids = list(dict.fromkeys(i for i, _ in pieces))
    number = {i: n for n, i in enumerate(ids)}
    words, hashes, full, places, owner, short, at = [], [], [], [], [], {}, 0
    for i, w in pieces:
        if 0 < len(w) < window:
            g, m = short.setdefault(len(w), ([], []))
            g.append(gram_hashes(w, len(w))[0])
            m.append(number[i])
        elif len(w):
            g = gram_hashes(w, k)
            hashes.append(np.unique(g[winnow(g, window - k + 1)]))
            full.append(gram_hashes(w, window))
            places.append(np.arange(at, at + len(full[-1])))
            owner.append(np.full(len(full[-1]), number[i]))
            words.append(w)
            at += len(w)
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
    for n, (g, m) in short.items():
        g, m = np.array(g, np.uint64), np.array(m)
        s = np.argsort(g, kind="stable")
        short[n] = (g[s], m[s])
    full, places, owner = cat(full, np.uint64), cat(places, np.int64), cat(owner, np.int64)
    o = np.lexsort((owner, full))
    new = np.ones(len(o), bool)
    new[1:] = (full[o][1:] != full[o][:-1]) | (owner[o][1:] != owner[o][:-1])          # each item once a window
    o = o[new]
    windows, first = np.unique(full[o], return_index=True)
    return Block(cat(words, np.uint64), np.unique(cat(hashes, np.uint64)), windows, places[o][first],
                 np.append(first, len(o)), owner[o], short, ids)


def _in(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and where."""
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def find_hits(w: np.ndarray, b: Block, window: int = WINDOW, k: int = GRAM) -> tuple[np.ndarray, set]:
    """Mask of hit words of a document and the numbers of the items that occur in it."""
    edge, items = np.zeros(len(w) + 1, dtype=np.int64), set()
    if len(w) >= window and len(b.hashes):
        g = gram_hashes(w, k)
        mine = winnow(g, window - k + 1)
        mine = mine[_in(b.hashes, g[mine])[0]]
        near = np.zeros(len(w) + 1, dtype=np.int64)         # starts of windows that hold such a gram
        np.add.at(near, np.maximum(mine - (window - k), 0), 1)
        np.add.at(near, mine + 1, -1)
        start = np.flatnonzero(np.cumsum(near[:len(w) - window + 1]) > 0)
        found, at = _in(b.windows, gram_hashes(w, window)[start])
        start, at = start[found], at[found]
        span = np.arange(window)
        for s in range(0, len(start), _STARTS):
            p, q = start[s:s + _STARTS], at[s:s + _STARTS]
            same = (w[p[:, None] + span] == b.words[b.places[q][:, None] + span]).all(axis=1)
            np.add.at(edge, p[same], 1)
            np.add.at(edge, p[same] + window, -1)
            q = np.unique(q[same])
            for lo, hi in zip(b.first[q].tolist(), b.first[q + 1].tolist(), strict=True):
                items.update(b.items[lo:hi].tolist())
    for n, (h, m) in b.short.items():
        if len(w) >= n:
            own = gram_hashes(w, n)
            at = np.flatnonzero(_in(h, own)[0])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            items.update(m[_in(np.unique(own), h)[0]].tolist())
    return np.cumsum(edge[:-1]) > 0, items


def ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Word hashes of every item, long items as overlapping pieces."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t in zip(f["item_id"], f["text"], strict=True):
                w = word_hashes(t)
                for s in range(0, max(1, len(w) - window + 1), PIECE_WINDOWS):
                    out.append((i, s, w[s:s + PIECE_WINDOWS + window - 1].tobytes()))
            yield pd.DataFrame(out, columns=["item_id", "piece", "words"])
    return (benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
            .mapInPandas(cut, "item_id string, piece long, words binary").where(F.length("words") > 0))


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW, k: int = GRAM,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` plus n_words, hit_ranges (word positions, end exclusive) and hit_items (ids as strings).

    Null and wordless texts have no words and no hits; items without words match
    nothing; a null item id still marks words but is not listed; repeated rows are
    judged each on its own; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    pieces = stored(_pieces(benchmark, item_col, item_text, window), "benchmark-pieces")
    total = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // (8 * block_words)))
    schema = "n_words long, hit_ranges array<struct<begin:long,until:long>>, hit_items array<string>"

    def block(number: int):
        rows = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(n_blocks)) == number).collect()
        made = make_block(sorted(((r["item_id"], np.frombuffer(bytes(r["words"]), np.uint64)) for r in rows),
                                 key=lambda r: (r[0] is None, r[0] or "")), window, k)
        return spark.sparkContext.broadcast(made)          # about block_words words by construction

    def hits_of(shared):
        @F.pandas_udf(schema)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            b = shared.value
            for s in batches:
                n_words, spans, items = [], [], []
                for t in s:
                    w = word_hashes(t)
                    mask, found = find_hits(w, b, window, k)
                    n_words.append(len(w))
                    spans.append([{"begin": a, "until": z} for a, z in ranges(mask)])
                    items.append([b.ids[i] for i in found if b.ids[i] is not None])
                yield pd.DataFrame({"n_words": n_words, "hit_ranges": spans, "hit_items": items})
        return run

    if n_blocks == 1:
        return docs.withColumn("_hit", hits_of(block(0))(F.col(text_col))).select(*docs.columns, "_hit.*")
    # Several blocks: texts that are hit meet again by digest, and only those.
    by_text = docs.select(F.col(text_col).alias("text"))
    parts = None
    for number in range(n_blocks):
        one = (by_text.withColumn("_hit", hits_of(block(number))(F.col("text")))
               .where(F.size("_hit.hit_ranges") > 0)
               .select(F.sha2(F.col("text"), 256).alias("_digest"), "_hit.hit_ranges", "_hit.hit_items").distinct())
        one = stored(one, "benchmark-hits")
        parts = one if parts is None else parts.unionByName(one)

    @F.pandas_udf("array<struct<begin:long,until:long>>")
    def merge(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            done: list[list[int]] = []
            for a, z in sorted((r["begin"], r["until"]) for r in g):
                if done and a <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], z)
                else:
                    done.append([a, z])
            out.append([{"begin": a, "until": z} for a, z in done])
        return pd.Series(out)

    merged = (parts.groupBy("_digest").agg(F.flatten(F.collect_list("hit_ranges")).alias("r"),
                                           F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("hit_items"))
              .select("_digest", merge("r").alias("hit_ranges"), "hit_items"))

    @F.pandas_udf("long")
    def count_words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(word_hashes(t)) for t in texts], dtype="int64")

    nothing = F.from_json(F.lit("[]"), "array<struct<begin:long,until:long>>")
    return (docs.withColumns({"_digest": F.sha2(F.col(text_col), 256), "n_words": count_words(text_col)})
            .join(merged, "_digest", "left")
            .select(*docs.columns, "n_words", F.coalesce("hit_ranges", nothing).alias("hit_ranges"),
                    F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items")))


def n_hit() -> Column:
    return F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda a, r: a + r["until"] - r["begin"])


def is_contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (n_hit() > 0) & (F.lit(20) * n_hit() >= F.col("n_words"))
