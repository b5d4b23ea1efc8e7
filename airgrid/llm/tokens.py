"""Token counts of whole documents and their attribution to sections.

The vocabulary file is read once on the driver and broadcast (about a megabyte).
Documents are encoded whole; token character spans meet section spans in one sorted
pass per document, so tokens never leave the task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm.common import giving_back

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "middle", "last")
# The vocabulary's splitting pattern, and the white space it means by \s.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PIECE = 1 << 20
_CACHE = 50_000


def share_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """Broadcast of the rank file's bytes; the path is only read on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(raw: bytes, pattern: str = PATTERN):
    """(tiktoken encoding, byte length of each token id)."""
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """A text in pieces that encode as the whole does.

    A single space between two other characters always starts a token, so a very
    long text is cut there; a run without such a space stays in one piece.
    """
    at = 0
    while len(text) - at > size:
        m = _BREAK.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def token_spans(text: str, enc, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (code point) of every token of a whole text.

    A token that holds part of a character's bytes counts as touching it.
    """
    ids = np.concatenate([np.array(enc.encode_ordinary(p), dtype=np.int64) for p in pieces(text)])
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1                  # character of each byte
    end = np.cumsum(lengths[ids])
    return char[end - lengths[ids]], char[end - 1]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with the line feed that ends them; an empty text is one empty line."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return np.array([0, *ends[:-1]], dtype=np.int64), np.array(ends, dtype=np.int64)


def anchors(first: np.ndarray, last: np.ndarray, rule: str) -> np.ndarray:
    """The character that decides where a token counts."""
    if rule == "first":
        return first
    return last if rule == "last" else (first + last) // 2


def attribute(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
              sections_col: str | None = None, rule: str = "first") -> DataFrame:
    """doc_id, section, begin, until, n_tokens and crossing per section of each document.

    Sections are the lines, or ``sections_col``: array<struct<begin,until>> of
    character offsets, which may overlap or leave gaps.  A token counts in every
    section that holds its ``rule`` character (first, middle or last), so sections
    that partition the text share out exactly its tokens; ``crossing`` counts those
    among them that reach over the section's ends.  Null and empty texts have no
    tokens; a null section list gives no rows; offsets beyond the text hold nothing.
    Lone surrogates, which have no UTF-8 form, are read as replacement characters.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    raw = share_vocabulary(docs.sparkSession, vocabulary)
    has_list = sections_col is not None
    given = [F.col(sections_col).alias("sections")] if has_list else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, lengths = encoder(raw.value)
        for f in frames:
            out = []
            lists = f["sections"] if has_list else [None] * len(f)
            for i, t, own in zip(f["doc_id"], f["text"], lists, strict=True):
                t = (t or "").encode("utf-8", "replace").decode("utf-8")
                if not has_list:
                    begin, until = line_sections(t)
                elif own is None:
                    continue
                else:
                    begin = np.array([r["begin"] for r in own], dtype=np.int64)
                    until = np.array([r["until"] for r in own], dtype=np.int64)
                n, crossing = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
                if t:
                    first, last = token_spans(t, enc, lengths)
                    at = anchors(first, last, rule)
                    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, np.maximum(until, begin))
                    n = hi - lo
                    # Tokens are in text order: those that start before or end behind stand at the edges.
                    before = np.minimum(np.maximum(np.searchsorted(first, begin) - lo, 0), n)
                    behind = np.minimum(np.maximum(hi - np.searchsorted(last, until), 0), n)
                    crossing = np.minimum(before + behind, n)
                out.append((np.full(len(begin), -1 if pd.isna(i) else i), np.full(len(begin), pd.isna(i)),
                            np.arange(len(begin)), begin, until, n, crossing))
            cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else [[]] * 7)]
            yield pd.DataFrame({"doc_id": pd.array(cols[0], "Int64").copy() if not len(cols[1]) or not cols[1].any()
                                else pd.array(np.where(cols[1], None, cols[0]), "Int64"),
                                "section": cols[2], "begin": cols[3], "until": cols[4], "n_tokens": cols[5],
                                "crossing": cols[6]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *given)
    return rows.mapInPandas(giving_back(run), "doc_id long, section long, begin long, until long, n_tokens long, crossing long")


class _Counts(dict):
    """Token count of a chunk; short chunks are remembered, in a bounded table."""

    def __init__(self, enc):
        super().__init__()
        self.enc = enc

    def __missing__(self, chunk: str) -> int:
        n = len(self.enc.encode_ordinary(chunk))
        if len(chunk) <= 40:
            if len(self) >= _CACHE:
                self.clear()
            self[chunk] = n
        return n


def count_tokens(raw):
    """UDF: tokens of a whole text, from the broadcast vocabulary.

    Words with their leading space encode on their own, so their counts are kept
    and added; this equals encoding the text at once.  Null has no tokens.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = _Counts(encoder(raw.value)[0])
        for s in batches:
            yield pd.Series([sum(map(counts.__getitem__, _CHUNK.findall(t.encode("utf-8", "replace").decode("utf-8"))))
                             if t else 0 for t in s], dtype="int64")
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(giving_back(run), "long")
