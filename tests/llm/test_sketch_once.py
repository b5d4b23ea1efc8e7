"""op5_minhash: a text is split once, and its words, sketch and signature are those of plain Python."""

import numpy as np
import pytest

from airgrid.llm import omh, words

TEXTS = [None, "", " . ", "a", " a", "a ", "One two; THREE four five six", "élő 中文 x9 \ud800", "..the the the the the the..",
         " ".join(f"w{i % 700}" for i in range(2000)), "z" * 5000 + " end"]
MOD = 1 << 64


def plain_words(text):
    out, run = [], []
    for b in [*(text or "").encode("utf-8", "surrogatepass"), 0x20]:
        b += 32 if 0x41 <= b <= 0x5A else 0
        if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80:
            run.append(b)
        elif run:
            total = sum((c + 1) * pow(int(words._BASE), k, MOD) for k, c in enumerate(run)) % MOD
            out.append(total ^ (len(run) * 0xD6E8FEB86659FD93 % MOD))
            run = []
    return words.mix(np.array(out, np.uint64)).tolist() if out else []


@pytest.mark.parametrize("text", TEXTS)
def test_words_equal_plain_python(text):
    assert words.word_hashes(text).tolist() == plain_words(text)


def test_a_text_is_split_once(monkeypatch):
    calls, split = [], words.word_hashes
    monkeypatch.setattr(omh, "word_hashes", lambda t: calls.append(t) or split(t))
    for t in TEXTS:
        calls.clear()
        digest, n, keys, sig, small = omh._facts(t)
        assert calls == [t]
        s = omh.shingles(t)
        assert digest == omh.digest(t) and n == len(s) and len(keys) == (omh.SKETCHES if n else 0)


@pytest.mark.parametrize("chunk", [1 << 14, 50, 3, 1])
def test_sketches_take_the_smallest_hashes_in_text_order(monkeypatch, chunk):
    monkeypatch.setattr(omh, "_CHUNK", chunk)
    for t in TEXTS:
        s = omh.shingles(t)
        if not len(s):
            continue
        keys, sig, small = omh.sketch(s)
        for b, seed in enumerate(omh._SEEDS):
            h = s * seed
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(28)
            key = np.array([(b + 1) * 0xC2B2AE3D27D4EB4F % MOD], np.uint64)
            for i in sorted(np.argsort(h, kind="stable")[:omh.PICK]):
                key = words.mix(key ^ s[i])
            assert keys[b] == key[0]
        assert np.frombuffer(small, np.uint16).tolist() == sorted({int(v) >> 24 & 0xFFFF for v in s.tolist()})
        low = {}
        for v in words.mix(s ^ np.uint64(0x5851F42D4C957F2D)).tolist():
            low[v >> 56] = min(v, low.get(v >> 56, MOD))
        want = [1 + (low[k] >> 20) % 254 if k in low else 0 for k in range(omh.SLOTS)]
        assert list(sig) == want
