"""Personal data: fixed patterns plus a character BiLSTM-CRF.

The patterns give the base spans.  A bidirectional LSTM with CRF transitions is
trained in numpy on windows of a bounded sample of documents, labelled with base
spans, and on the same number of windows with planted examples that no pattern
covers: local phone forms, IPv6 addresses, cards with other separators, written-out
mail addresses, and look-alikes that are none of these (dates, versions, order
numbers, prices).  It reads every window that holds a digit, an at sign or the words
of a written-out address.  Scores of overlapping windows are averaged, weighted
towards window centres, and each run of windows is decoded as one sequence.  Spans
found that way are added where no base span lies and their kind's least content is there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm import tagger
from airgrid.llm.common import give_back, giving_back
from airgrid.llm.tagger import KINDS, STRIDE, WINDOW

MAX_DOCS, MAX_WINDOWS, MAX_PLANTED = 3000, 6000, 6000
_RUN = 512
_CELLS = 1 << 16             # places decoded in one block, unless one run is longer

# The patterns.  Runs are possessive where giving characters back could not help.
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|\b[dD]ot\b|[(\[{] ?[aA]t ?[)\]}]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each at sign: all local characters before it and a dotted domain behind it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL_END.match(text, start - 1, at):
            start -= 1
        end = at + 1
        if start < at:
            m = _DOMAIN.match(text, at + 1)
            if m:
                out.append((start, m.end()))
                free = end = m.end()
        # Characters before this sign belong to no later address: the sign is not a local character.
        free = max(free, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start; null is empty."""
    if not text or not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- windows -------------------------------------------------------------------

def windows(text: str) -> np.ndarray:
    """Starts (multiples of STRIDE) of the windows that a trigger begins in."""
    at = np.fromiter((m.start() for m in _TRIGGER.finditer(text)), dtype=np.int64)
    last = at // STRIDE
    return np.unique(np.concatenate([last, last - 1]).clip(0)) * STRIDE


def window_codes(text: str, starts: np.ndarray) -> np.ndarray:
    c = np.concatenate([tagger.codes(text), np.zeros(WINDOW, np.int64)])
    return c[starts[:, None] + np.arange(WINDOW)]


def window_tags(text: str, starts: np.ndarray) -> np.ndarray:
    """Tags from the base spans; where kinds overlap the earlier listed one holds."""
    y = np.zeros(len(text) + WINDOW, np.int64)
    for kind, a, b in reversed(base_spans(text)):
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    # A span that a later one overwrote in part may lack its begin.
    inside = (y > 0) & (y % 2 == 0)
    before = np.concatenate([[0], y[:-1]])
    y[inside & (before != y) & (before != y - 1)] -= 1
    tags = y[starts[:, None] + np.arange(WINDOW)]
    cut = (tags[:, 0] > 0) & (tags[:, 0] % 2 == 0)
    tags[cut, 0] -= 1                                     # a window may begin inside a span
    return tags


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS,
          max_windows: int = MAX_WINDOWS, max_planted: int = MAX_PLANTED, epochs: int = 6) -> dict[str, np.ndarray]:
    """Fit the tagger on at most ``max_windows`` windows of at most ``max_docs`` documents
    and at most ``max_planted`` of these windows with a planted example.

    Documents that hold a digit or an at sign are drawn by a hash of id and text, their
    windows by a hash as well, so the draw does not depend on partitioning.
    """
    spark = docs.sparkSession
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64(F.lit("pii"), "id", "text")))
    hashes = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(max_docs).collect()]
    if not hashes:
        return tagger.fit(np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), np.int64))
    chosen = spark.createDataFrame([(h,) for h in hashes], "h long")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, t in zip(f["h"], f["text"], strict=True):
                s = windows(t)
                x, y = window_codes(t, s).astype(np.uint8), window_tags(t, s).astype(np.uint8)
                rank = np.random.default_rng(int(h) & (2**63 - 1)).integers(0, 2**62, len(s))
                out += [(int(k), int(a), x[j].tobytes(), y[j].tobytes()) for j, (k, a) in enumerate(zip(rank, s, strict=True))]
            yield pd.DataFrame(out, columns=["k", "at", "x", "y"])

    drawn = (rows.join(F.broadcast(chosen), "h").select("h", "text")            # size bound: max_docs longs
             .mapInPandas(cut, "k long, at long, x binary, y binary").distinct()
             .orderBy("k", "at", "x").limit(max_windows).collect())
    x = np.array([np.frombuffer(bytes(r["x"]), np.uint8) for r in drawn], dtype=np.int64)
    y = np.array([np.frombuffer(bytes(r["y"]), np.uint8) for r in drawn], dtype=np.int64)
    if len(x):
        more = [plant(x[k % len(x)], y[k % len(x)], np.random.default_rng(k)) for k in range(max_planted)]
        x, y = np.concatenate([x, [a for a, _ in more]]), np.concatenate([y, [b for _, b in more]])
    model = tagger.fit(x, y, epochs=epochs)
    give_back()
    return model


# ---- planted examples ------------------------------------------------------------

def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _name(rng) -> str:
    return "".join(rng.choice(list("bcdfghklmnprstvw")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 4)))


def _card(rng, sep: str) -> str:
    body = "4" + _digits(rng, 14)
    whole = next(body + str(d) for d in range(10) if luhn(body + str(d)))
    return sep.join(whole[i:i + 4] for i in range(0, 16, 4))


def example(rng: np.random.Generator) -> tuple[str | None, str]:
    """(kind, text): an example beyond the patterns, or a look-alike of kind None."""
    d, pick = (lambda n: _digits(rng, n)), (lambda *xs: xs[rng.integers(0, len(xs))])
    form = rng.integers(0, 8)
    if form == 0:
        return "phone", pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}")
    if form == 1:
        who = pick(_name(rng), f"{_name(rng)} dot {_name(rng)}")
        return "email", pick(f"{who} at {_name(rng)} dot {pick('com', 'org', 'net')}", f"{_name(rng)}(at){_name(rng)}.{pick('com', 'org')}",
                             f"{_name(rng)} [at] {_name(rng)} [dot] {pick('com', 'net', 'de')}")
    if form == 2:
        part = [f"{rng.integers(0, 65536):x}" for _ in range(rng.integers(4, 8))]
        return "ip", pick(":".join(part + ["1"] * (8 - len(part))), "2001:" + ":".join(part[:3]) + "::" + part[3])
    if form == 3:
        return "card", _card(rng, pick(".", "/", "  ", "_"))
    year = f"{rng.integers(1900, 2030)}"
    return None, pick(f"{year}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{year}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", f"No. {d(8)}",
                      f"order {d(6)}-{d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"${d(1)},{d(3)}.{d(2)}", f"{year}-{year}", f"{d(1)}.{d(1)}.{d(2)}",
                      f"{d(3)} x {d(3)}", f"{d(5)}", "the dot on the map", f"{d(2)} dot {d(2)}", f"{d(1)}.{d(4)}e-{d(1)}", f"#{d(6)}")


def plant(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A window with an example put between two of its characters outside spans; what is behind moves on."""
    kind, text = example(rng)
    c = tagger.codes(f" {text} ")[:WINDOW]
    t = np.zeros(len(c), np.int64)
    if kind:
        t[1:-1], t[1] = 2 + 2 * KINDS.index(kind), 1 + 2 * KINDS.index(kind)
    free = np.flatnonzero((y == 0) & (np.append(0, y[:-1]) == 0) & (np.arange(len(y)) <= WINDOW - min(len(c), 48)))
    at = int(rng.choice(free)) if len(free) else 0
    if not len(free):
        x, y = np.zeros_like(x), np.zeros_like(y)
    return np.concatenate([x[:at], c, x[at:]])[:WINDOW], np.concatenate([y[:at], t, y[at:]])[:WINDOW]


# The least content of an added span.
_LEAST = {"email": re.compile(r"(?:@|\bat\b).*(?:\.|\bdot\b)", re.IGNORECASE | re.DOTALL),
          "ip": re.compile(r"[0-9a-fA-F]+(?:::?[0-9a-fA-F]+){3,7}|[0-9]+(?:\.[0-9]+){3}"),
          "card": re.compile(r"(?:[0-9][^0-9]{0,2}){12,18}[0-9]"), "phone": re.compile(r"\+?(?:[0-9][^0-9]{0,3}){7,14}[0-9]")}


def plausible(kind: str, text: str) -> bool:
    """Whether a span of the tagger holds what its kind needs; cards pass Luhn's check."""
    if not _LEAST[kind].search(text):
        return False
    return kind != "card" or luhn("".join(ch for ch in text if ch in "0123456789"))


# ---- decoding ------------------------------------------------------------------

_WEIGHT = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)


def decode(model: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds in each text; window scores are merged before decoding."""
    where, codes = [], []
    for n, t in enumerate(texts):
        s = windows(t) if t and _TRIGGER.search(t) else np.empty(0, np.int64)
        where.append(s)
        if len(s):
            codes.append(window_codes(t, s))
    if not codes:
        return [[] for _ in texts]
    x = np.concatenate(codes)
    em = np.concatenate([tagger.emissions(model, x[k:k + _RUN]) for k in range(0, len(x), _RUN)])
    runs, at = [], 0
    for n, s in enumerate(where):
        for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s) > STRIDE) + 1) if len(s) else []:
            begin, length = int(s[part[0]]), int(s[part[-1]] - s[part[0]]) + WINDOW
            score, weight = np.zeros((length, tagger.TAGS), np.float32), np.zeros((length, 1), np.float32)
            for j in part:
                o = int(s[j]) - begin
                score[o:o + WINDOW] += em[at + j] * _WEIGHT[:, None]
                weight[o:o + WINDOW, 0] += _WEIGHT
            runs.append((n, begin, score / weight))
        at += len(s)
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    runs.sort(key=lambda r: len(r[2]))
    k = 0
    while k < len(runs):
        top = k
        while top < len(runs) and (top - k + 1) * len(runs[top][2]) <= max(_CELLS, len(runs[k][2])):
            top += 1
        length = len(runs[top - 1][2])
        block = np.full((top - k, length, tagger.TAGS), tagger._BARRED, np.float32)
        block[:, :, 0] = 0.0                                   # behind the run: outside
        for j, (_, _, score) in enumerate(runs[k:top]):
            block[j, :len(score)] = score
        for (n, begin, _), path in zip(runs[k:top], tagger.viterbi(block, model["A"], model["s"]), strict=True):
            for a in np.flatnonzero(path % 2 == 1):
                tag, b = int(path[a]), int(a) + 1
                while b < length and path[b] == tag + 1:
                    b += 1
                lo, hi = begin + int(a), min(begin + b, len(texts[n]))
                if plausible(KINDS[tag // 2], texts[n][lo:hi]):
                    found[n].append((KINDS[tag // 2], lo, hi))
        k = top
    return found


def merged(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those of ``more`` that touch none of them, by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    starts = [a for a, _ in taken]
    out = list(base)
    for kind, a, b in more:
        k = bisect_left(starts, b)                       # base spans that begin before this one ends
        if k == 0 or reach[k - 1] <= a:
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _udf(docs: DataFrame, model: dict[str, np.ndarray], make, schema: str):
    shared = docs.sparkSession.sparkContext.broadcast(model)           # some ten thousand weights

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            parts = []
            for k in range(0, len(s), 256):
                texts = [t if isinstance(t, str) else "" for t in s.iloc[k:k + 256]]
                found = decode(shared.value, texts)
                parts += [make(t, base_spans(t), more) for t, more in zip(texts, found, strict=True)]
            yield pd.DataFrame(parts, columns=[c.split()[0] for c in schema.split(", ")])
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(giving_back(run), schema)


def find(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` plus ``base_spans`` and ``spans``, each as joined kind:start:end.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans;
    repeated rows are read each on its own.
    """
    udf = _udf(docs, model, lambda t, base, more: (joined(base), joined(merged(base, more))), "base string, spans string")
    return (docs.withColumn("_found", udf(F.col(text_col)))
            .select(*docs.columns, F.col("_found.base").alias("base_spans"), F.col("_found.spans").alias("spans")))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind in brackets."""
    out, at, rest = [], 0, sorted(spans, key=lambda s: (s[1], s[2]))
    k = 0
    while k < len(rest):
        kind, a, b = rest[k]
        k += 1
        while k < len(rest) and rest[k][1] < b:
            b = max(b, rest[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def scrub(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> Column:
    """Column of whole texts with personal data masked; null stays null."""
    udf = _udf(docs, model, lambda t, base, more: (masked(t, merged(base, more)),), "text string")
    return F.when(F.col(text_col).isNotNull(), udf(F.col(text_col))["text"])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(F.split(spans, ","), lambda s: s.startswith(kind + ":"))).cast("long")
