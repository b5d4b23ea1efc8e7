"""Toxicity scoring by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled texts (U) train an ensemble of
linear classifiers in numpy on the non-negative, class-prior-corrected risk

    pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))

with the logistic loss and an L1 proximal step.  The training sample is bounded
by documented parameters and gathered with a scan filtered by a bounded,
broadcast id list; scoring runs inside tasks over whole texts, with no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import give_back, giving_back, stored, widest

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7)
MAX_POSITIVE, MAX_UNLABELLED, MAX_CALIBRATION = 3000, 5000, 3000
_CACHE_WORDS = 50_000
SMOOTHING = 60.0
MAX_RATE = 0.3               # of one word; a value of a feature, not a limit of the text that is read


@dataclass(frozen=True)
class PuModel:
    """Hashed feature weights, bias and calibration; plain arrays, a few MB at most."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float


def word_features(word: str, bits: int) -> list[int]:
    """Hashed ids of a word and of its leading character runs."""
    mask = (1 << bits) - 1
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & mask]
    out += [zlib.crc32(b"p" + word[:k].encode("utf-8", "surrogatepass")) & mask for k in PREFIXES if len(word) >= k]
    return out


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def rate_scale(n_words: int) -> float:
    """Turns a count into a smoothed rate: 1.0 is one occurrence in fifty words.

    A word counts up to ``MAX_RATE``, so that a text which repeats a few words without
    end is worth no more in the fit than any other."""
    return 50.0 / (n_words + SMOOTHING)


def doc_features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature ids of a whole text and the sums of their words' bounded rates."""
    rates: Counter = Counter()
    words = word_counts(text)
    scale = rate_scale(sum(words.values()))
    for w, c in words.items():
        for i in word_features(w, bits):
            rates[i] += min(c * scale, MAX_RATE)
    ids = np.array(sorted(rates), dtype=np.int32)
    return ids, np.array([rates[i] for i in ids.tolist()], dtype=np.float32)


# ---- training (bounded sample) ------------------------------------------------

Rows = list[tuple[np.ndarray, np.ndarray]]


def _csr(rows: Rows, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, values and row starts over the kept features; ``keep`` maps id -> column or -1."""
    cols = [keep[i] for i, _ in rows]
    vals = [v[c >= 0] for (_, v), c in zip(rows, cols, strict=True)]
    cols = [c[c >= 0] for c in cols]
    return (np.concatenate(cols), np.concatenate(vals).astype(float), np.cumsum([0, *map(len, cols)]))


def _logits(x: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    cols, vals, starts = x
    total = np.concatenate([[0.0], np.cumsum(w[cols] * vals)])
    return total[starts[1:]] - total[starts[:-1]] + b


def _gradient(x: tuple[np.ndarray, np.ndarray, np.ndarray], d: np.ndarray, size: int) -> np.ndarray:
    cols, vals, starts = x
    return np.bincount(cols, np.repeat(d, np.diff(starts)) * vals, minlength=size)


def _rows_with(rows: Rows, size: int) -> np.ndarray:
    """Per feature: the number of rows that have it (a row names a feature once)."""
    out = np.zeros(size)
    for ids, _ in rows:
        out[ids] += 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(pos: Rows, unl: Rows, prior: float, bits: int = 18, members: int = 3,
             epochs: int = 30, batch: int = 512, rate: float = 0.05, l1: float = 2e-4,
             min_rows: int = 3, min_z: float = 4.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Mean weights of ``members`` classifiers, each trained on its own bootstrap of U.

    Only features whose shares of rows in P and U differ by ``min_z`` standard
    errors take part: a linear model over every hashed feature would learn the
    positives by heart.  No positive example gives zero weights and the prior's
    log odds as bias.
    """
    weights, bias = np.zeros(1 << bits), float(np.log(prior / (1 - prior)))
    if not pos or not unl:
        return weights, bias
    in_p, in_u, n_p, n_u = _rows_with(pos, 1 << bits), _rows_with(unl, 1 << bits), len(pos), len(unl)
    share = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    ids = np.flatnonzero((in_p + in_u >= min(min_rows, len(pos))) & (np.abs(z) >= min_z))
    keep = np.full(1 << bits, -1, dtype=np.int64)
    keep[ids] = np.arange(len(ids))
    pos, unl = ([(i[keep[i] >= 0], v[keep[i] >= 0]) for i, v in rows] for rows in (pos, unl))
    total_w, total_b = np.zeros(len(ids)), 0.0
    for m in range(members):
        rng = np.random.default_rng(seed + m)
        own_u = [unl[i] for i in rng.integers(0, len(unl), len(unl))] if members > 1 else unl
        w, b = np.zeros(len(ids)), bias
        mom, var, step = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1), 0
        n_batches = max(1, -(-len(own_u) // batch))
        for _ in range(epochs):
            pu, pp = rng.permutation(len(own_u)), rng.permutation(len(pos))
            for k in range(n_batches):
                xu = _csr([own_u[i] for i in pu[k::n_batches]], keep)
                part = pp[k::n_batches] if len(pos) >= n_batches else pp
                xp = _csr([pos[i] for i in part], keep)
                zu, zp = _logits(xu, w, b), _logits(xp, w, b)
                neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                gu, gp = _sigmoid(zu) / len(zu), _sigmoid(zp) / len(zp)
                up = prior * (_sigmoid(zp) - 1) / len(zp)
                if neg >= 0:
                    du, dp = gu, up - prior * gp
                else:                               # undo the over-fitted negative part
                    du, dp = -gu, prior * gp
                g = np.zeros(len(ids) + 1)
                g[:-1] += _gradient(xu, du, len(ids)) + _gradient(xp, dp, len(ids))
                g[-1] = du.sum() + dp.sum()
                step += 1
                mom = 0.9 * mom + 0.1 * g
                var = 0.999 * var + 0.001 * g * g
                move = rate * (mom / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-6)
                w = w - move[:-1]
                w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
                b -= move[-1]
        total_w += w / members
        total_b += b / members
    weights[ids] = total_w
    return weights, total_b


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt scaling with smoothed targets (Newton steps); identity when a class is missing."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, float(np.std(z)))
    x = np.stack([z / scale, np.ones_like(z)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, x.T @ (p - t))
        theta -= np.clip(d, -1, 1)
        if np.abs(d).max() < 1e-8:
            break
    return float(max(theta[0], 1e-6) / scale), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", bits: int = 18, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED, max_calibration: int = MAX_CALIBRATION) -> PuModel:
    """Fit on a bounded sample: at most ``max_positive`` confirmed toxic documents,
    ``max_unlabelled`` documents drawn from all (their labels are not looked at) and
    ``max_calibration`` labelled documents that fit only the prior and the score scale.

    ``usable``: Column condition on the id that says which rows may be learnt from.
    Draws are ordered by a hash of the id, so they do not depend on partitioning.
    Null ids or labels are not used; no labels at all give a constant score.  Ids may
    be of any type that orders; of rows that repeat an id one is learnt from.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit("toxicity"), F.col("id"))
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
           .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & usable(F.col("id"))))
    shares = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    prior = min(0.9, max(0.005, (n1 + 0.5) / (n1 + n0 + 1)))

    def draw(df: DataFrame, limit: int) -> list:
        return [r["id"] for r in df.orderBy(key, "id").limit(limit).collect()]

    in_calibration = F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(4)) == 0
    p_ids = draw(lab.where((F.col("y") == 1) & ~in_calibration).select("id").distinct(), max_positive)
    c_rows = (lab.where(in_calibration).groupBy("id").agg(F.max("y").alias("y"))
              .orderBy(key, "id").limit(max_calibration).collect())
    u_ids = draw(docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & usable(F.col("id")))
                 .distinct(), max_unlabelled)
    roles: dict = {}
    for i in u_ids:
        roles.setdefault(i, [0, 0, None])[0] = 1
    for i in p_ids:
        roles.setdefault(i, [0, 0, None])[1] = 1
    for r in c_rows:
        roles.setdefault(r["id"], [0, 0, None])[2] = r["y"]
    if not roles:
        return PuModel(np.zeros(1 << bits), float(np.log(prior / (1 - prior))), 1.0, 0.0, prior)
    chosen = spark.createDataFrame(pd.DataFrame({"id": list(roles)}))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [doc_features(t, bits) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "ids": [i.tobytes() for i, _ in made],
                                "rates": [v.tobytes() for _, v in made]})

    made = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "id")          # size bound: the three limits above
            .groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("id", "text"), F.col("text"))).alias("text"))
            .repartition(widest(docs))                # one row per drawn id, however often it is repeated
            .mapInPandas(extract, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, rates binary"))
    # Stored first, so that the driver reads it partition by partition and not at once.
    rows = [(r["id"], bytes(r["ids"]), bytes(r["rates"])) for r in stored(made, "toxicity-sample").toLocalIterator()]
    pos, unl, cal, y = [], [], [], []
    for i, held, rates in sorted(rows):
        ids = (np.frombuffer(held, dtype=np.int32), np.frombuffer(rates, dtype=np.float32))
        is_u, is_p, label = roles[i]
        if is_u:
            unl.append(ids)
        if is_p:
            pos.append(ids)
        if label is not None:
            cal.append(ids)
            y.append(label)
    del rows
    w, b = fit_nnpu(pos, unl, prior, bits)
    z = np.array([(w[i] * v).sum() + b for i, v in cal])
    slope, shift = calibrate(z, np.array(y))
    del pos, unl, cal
    give_back()
    return PuModel(w, b, slope, shift, prior)


# ---- scoring ------------------------------------------------------------------

def make_scorer(model: PuModel):
    """``text -> score`` over whole texts; word weights are kept in a bounded table."""
    bits = int(len(model.weights)).bit_length() - 1
    w, cache = model.weights, {}

    def score(text: str | None) -> float:
        words, total = word_counts(text), 0.0
        scale = rate_scale(sum(words.values()))
        for word, n in words.items():
            s = cache.get(word)
            if s is None:
                if len(cache) > _CACHE_WORDS:
                    cache.clear()
                s = cache[word] = float(sum(w[i] for i in word_features(word, bits)))
            total += min(n * scale, MAX_RATE) * s
        z = (total + model.bias) * model.slope + model.shift
        return float(1.0 / (1.0 + np.exp(-min(40.0, max(-40.0, z)))))
    return score


def score(docs: DataFrame, model: PuModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus a score in [0, 1] of each whole text; null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)       # a few MB, fixed by ``bits``

    @giving_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make_scorer(shared.value)
        for s in batches:
            yield pd.Series([f(t) for t in s], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(run, "double")(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, usable, threshold: float = 0.7) -> DataFrame:
    """Train on the usable rows and add ``score`` and ``predicted`` (1 from the threshold on)."""
    base = docs.select("doc_id", "text")
    model = train(base, labels, usable)
    return score(base, model).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
