"""Character tagger: bidirectional LSTM with CRF transitions, in numpy.

Small helper of the personal-data operator: it sees fixed-length windows of
character classes and returns tag scores; all batching over documents is Spark's.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 64, 32
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)                    # outside, then begin and inside of each kind
_BARRED = -1e4
_CODES = 131                                 # pad, ASCII, other letter, other


def codes(text: str) -> np.ndarray:
    """Class of each code point: ASCII as it is, other letters and the rest as one class each."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where(p < 128, p + 1, 130).astype(np.int64)
    out[(p >= 0xC0) & (p < 0x2000)] = 129
    return out


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Barred transitions: inside of a kind only after its begin or inside."""
    step, start = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        step[:, inside] = _BARRED
        step[[inside - 1, inside], inside] = 0
        start[inside] = _BARRED
    return step, start


BAR_STEP, BAR_START = _allowed()


def new_model(seed: int = 3, embed: int = 16, hidden: int = 24) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    bias = np.zeros((2, 4 * hidden), np.float32)
    bias[:, hidden:2 * hidden] = 1.0                                            # forget gates start open
    return {"E": (0.3 * r.standard_normal((_CODES, embed))).astype(np.float32), "X": n(2, embed, 4 * hidden),
            "H": n(2, hidden, 4 * hidden), "b": bias, "U": n(2 * hidden, TAGS), "c": np.zeros(TAGS, np.float32),
            "A": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1.0)


def emissions(m: dict[str, np.ndarray], x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(batch, length, tags) scores of windows of codes; ``keep`` collects what training needs."""
    batch, length = x.shape
    hid = m["H"].shape[1]
    both = np.stack([x, x[:, ::-1]])                                            # second direction reads backwards
    table = np.matmul(m["E"][None], m["X"]) + m["b"][:, None]                   # input part of each code's gates
    h = np.zeros((2, batch, hid), np.float32)
    c = np.zeros((2, batch, hid), np.float32)
    hs = np.empty((length, 2, batch, hid), np.float32)
    steps = []
    for t in range(length):
        g = np.stack([table[0][both[0, :, t]], table[1][both[1, :, t]]]) + np.matmul(h, m["H"])
        gate = _sigmoid(g[..., :3 * hid])
        i, f, o, u = gate[..., :hid], gate[..., hid:2 * hid], gate[..., 2 * hid:], np.tanh(g[..., 3 * hid:])
        old_c, old_h = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep is not None:
            steps.append((i, f, o, u, tc, old_c, old_h))
    out = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2).transpose(1, 0, 2)    # (batch, length, 2 hid)
    if keep is not None:
        keep.update(both=both, steps=steps, out=out)
    return out @ m["U"] + m["c"]


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))


def crf_gradient(em: np.ndarray, y: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log likelihood and its gradients for emissions, steps and starts."""
    batch, length, tags = em.shape
    a, s = a + BAR_STEP, s + BAR_START
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[:, 0] = s + em[:, 0]
    for t in range(1, length):
        alpha[:, t] = _lse(alpha[:, t - 1, :, None] + a, 1) + em[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = _lse(a + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    d_em = np.exp(alpha + beta - z[:, None, None])
    b = np.arange(batch)
    gold = s[y[:, 0]] + em[b[:, None], np.arange(length), y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
    d_a = np.zeros((tags, tags))
    for t in range(1, length):
        d_a += np.exp(alpha[:, t - 1, :, None] + a + (em[:, t] + beta[:, t] - z[:, None])[:, None, :]).sum(0)
    np.add.at(d_a, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
    d_s = d_em[:, 0].sum(0)
    np.add.at(d_s, y[:, 0], -1.0)
    d_em[b[:, None], np.arange(length), y] -= 1.0
    return float((z - gold).mean()), d_em / batch, (d_a / batch).astype(np.float32), d_s / batch


def gradients(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss of a batch and the gradient of every parameter (back-propagation through time)."""
    keep: dict = {}
    em = emissions(m, x, keep)
    loss, d_em, d_a, d_s = crf_gradient(em, y, m["A"], m["s"])
    batch, length = x.shape
    hid = m["H"].shape[1]
    out, both = keep["out"], keep["both"]
    g = {"A": d_a, "s": d_s.astype(np.float32), "c": d_em.sum((0, 1)),
         "U": out.reshape(-1, 2 * hid).T @ d_em.reshape(-1, TAGS), "H": np.zeros_like(m["H"])}
    d_out = (d_em @ m["U"].T).transpose(1, 0, 2)                                # (length, batch, 2 hid)
    d_hs = np.stack([d_out[:, :, :hid], d_out[::-1, :, hid:]], axis=1)
    d_table = np.zeros((2, _CODES, 4 * hid), np.float32)
    dh = np.zeros((2, batch, hid), np.float32)
    dc = np.zeros((2, batch, hid), np.float32)
    back = m["H"].transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        i, f, o, u, tc, old_c, old_h = keep["steps"][t]
        dh = dh + d_hs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * u * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 2)
        g["H"] += np.matmul(old_h.transpose(0, 2, 1), dg)
        for d in (0, 1):
            np.add.at(d_table[d], both[d, :, t], dg[d])
        dh, dc = np.matmul(dg, back), dc * f
    g["b"] = d_table.sum(1)
    g["X"] = np.matmul(m["E"].T[None], d_table)
    g["E"] = sum(d_table[d] @ m["X"][d].T for d in (0, 1))
    return loss, g


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01,
        least_steps: int = 300, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam on the CRF likelihood; no window gives the untrained model, which tags nothing."""
    m = new_model(seed)
    if not len(x):
        m["c"][0] = 100.0
        return m
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    per_epoch = -(-len(x) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))           # few windows are read more often
    step, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            part = order[at:at + batch]
            _, g = gradients(m, x[part], y[part])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            step += 1
            lr = rate * (1 - step / (total + 1))
            for k, v in g.items():
                v = v * scale
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] = (m[k] - lr * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return m


def viterbi(em: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Best tag paths of (batch, length, tags) emissions."""
    batch, length, tags = em.shape
    a, best = a + BAR_STEP, s + BAR_START + em[:, 0]
    back = np.empty((length, batch, tags), np.int8)
    for t in range(1, length):
        z = best[:, :, None] + a
        back[t] = z.argmax(1)
        best = z.max(1) + em[:, t]
    path = np.empty((batch, length), np.int64)
    path[:, -1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[t][rows, path[:, t]]
    return path
