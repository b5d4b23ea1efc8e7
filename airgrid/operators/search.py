"""Model-based search (M12): a tree-structured Parzen estimator over named parameters.

Finished trials are parted by loss into a good and a bad group.  Each parameter gets a
density of either group (a mixture of truncated normals around the group's values and a
wide prior; smoothed frequencies for choices), candidates are drawn from the good density
and the one with the largest ratio of good to bad density is suggested.  The state is the
list of trials, a few numbers each.
"""

from __future__ import annotations

import math

import numpy as np


class _Numeric:
    """An int, float or log-uniform parameter, modelled on an interval (of logarithms for "log")."""

    def __init__(self, kind: str, low: float, high: float):
        self.kind, self.low_given, self.high_given = kind, low, high
        if kind == "log":
            self.low, self.high = math.log(low), math.log(high)
        elif kind == "int":
            self.low, self.high = low - 0.5, high + 0.5
        else:
            self.low, self.high = low, high

    def inside(self, v) -> float:
        return math.log(v) if self.kind == "log" else float(v)

    def value(self, u: float):
        if self.kind == "int":
            return int(min(max(round(u), self.low_given), self.high_given))
        v = math.exp(u) if self.kind == "log" else u
        return float(min(max(v, self.low_given), self.high_given))

    def uniform(self, rng) -> float:
        return float(rng.uniform(self.low, self.high))

    def mixture(self, seen: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Centres and widths: a point's width is its larger gap to a neighbour, within bounds."""
        span = self.high - self.low
        mu = np.append(np.sort(np.array(seen)), (self.low + self.high) / 2)
        order = np.argsort(mu, kind="stable")
        along = np.concatenate([[self.low], mu[order], [self.high]])
        gap = np.maximum(along[1:-1] - along[:-2], along[2:] - along[1:-1])
        width = np.empty(len(mu))
        width[order] = np.clip(gap, span / min(100, len(mu) + 1), span)
        width[-1] = span                                       # the prior
        return mu, width

    def draw(self, seen: list[float], n: int, rng) -> np.ndarray:
        mu, width = self.mixture(seen)
        pick = rng.integers(0, len(mu), n)
        out = rng.normal(mu[pick], width[pick])
        for _ in range(64):
            off = (out < self.low) | (out > self.high)
            if not off.any():
                break
            out[off] = rng.normal(mu[pick[off]], width[pick[off]])
        return np.clip(out, self.low, self.high)

    def log_density(self, seen: list[float], at: np.ndarray) -> np.ndarray:
        mu, width = self.mixture(seen)
        z = (at[:, None] - mu) / width
        mass = np.array([_phi((self.high - m) / w) - _phi((self.low - m) / w) for m, w in zip(mu, width, strict=True)])
        return np.log(np.mean(np.exp(-0.5 * z * z) / (width * math.sqrt(2 * math.pi) * mass), axis=1) + 1e-300)


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class _Choice:
    def __init__(self, choices: list):
        self.choices = list(choices)

    def inside(self, v) -> int:
        return self.choices.index(v)

    def value(self, u):
        return self.choices[int(u)]

    def uniform(self, rng) -> int:
        return int(rng.integers(0, len(self.choices)))

    def shares(self, seen: list[int]) -> np.ndarray:
        n = np.bincount(np.array(seen, int), minlength=len(self.choices)) + 1.0
        return n / n.sum()

    def draw(self, seen: list[int], n: int, rng) -> np.ndarray:
        return rng.choice(len(self.choices), n, p=self.shares(seen))

    def log_density(self, seen: list[int], at: np.ndarray) -> np.ndarray:
        return np.log(self.shares(seen)[at.astype(int)])


class Study:
    """Ask for parameter sets, tell their losses (smaller is better); the same seed asks the same way.

    The first ``startup`` sets are uniform.  In a batch the sets asked before but not
    told yet count as bad ones, so that a batch spreads out.
    """

    def __init__(self, space: dict, seed: int = 42, startup: int = 10, candidates: int = 24):
        self.space = {k: _Choice(v[1]) if v[0] == "cat" else _Numeric(*v) for k, v in space.items()}
        self.rng = np.random.default_rng(seed)
        self.startup, self.candidates = startup, candidates
        self.trials: list[tuple[float, dict]] = []
        self.asked = 0

    def ask(self, n: int = 1) -> list[dict]:
        out: list[dict] = []
        for _ in range(n):
            out.append(self._suggest(out) if self.asked >= self.startup and self.trials
                       else {k: p.value(p.uniform(self.rng)) for k, p in self.space.items()})
            self.asked += 1
        return out

    def tell(self, params: dict, loss: float) -> None:
        self.trials.append((loss if math.isfinite(loss) else math.inf, params))

    def _suggest(self, waiting: list[dict]) -> dict:
        ranked = [t for _, t in sorted(self.trials, key=lambda x: x[0])]
        n_good = min(25, max(1, math.ceil(0.1 * len(ranked))))
        good, bad = ranked[:n_good], ranked[n_good:] + waiting
        out = {}
        for k, p in self.space.items():
            near, far = [p.inside(t[k]) for t in good], [p.inside(t[k]) for t in bad]
            at = p.draw(near, self.candidates, self.rng)
            out[k] = p.value(at[int(np.argmax(p.log_density(near, at) - p.log_density(far, at)))])
        return out

    @property
    def best(self) -> dict:
        return min(self.trials, key=lambda x: x[0])[1]
