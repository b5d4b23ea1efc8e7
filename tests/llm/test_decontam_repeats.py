"""Decontamination of words that repeat without end: linear work, plain results."""

import time

import numpy as np

from airgrid.llm import decontam
from airgrid.llm.words import word_hashes
from tests.llm.test_scans_archives import plain_hits


def check(text, items):
    block = decontam.make_block([(i, word_hashes(t)) for i, t in items])
    mask, found = decontam.find_hits(word_hashes(text), block)
    return len(mask), int(mask.sum()), sorted(block.ids[i] for i in found)


def test_equal_words_and_cycles_equal_the_plain_scan():
    rng = np.random.default_rng(4)
    for _ in range(60):
        word = lambda: rng.choice(["a", "b", "c"], p=[0.8, 0.1, 0.1])
        text = " ".join(word() for _ in range(rng.integers(0, 120)))
        items = [(f"i{k}", " ".join(word() for _ in range(rng.integers(0, 40)))) for k in range(6)]
        assert check(text, items) == plain_hits(text, items)


def test_long_repeats_take_linear_time():
    items = [(f"i{k}", "same " * 20000) for k in range(3)] + [("cycle", "one two three " * 7000)]
    block = decontam.make_block([(i, word_hashes(t)) for i, t in items])
    start = time.time()
    mask, found = decontam.find_hits(word_hashes("same " * 20000), block)
    assert mask.all() and len(mask) == 20000 and sorted(block.ids[i] for i in found) == ["i0", "i1", "i2"]
    mask, found = decontam.find_hits(word_hashes("x " + "one two three " * 9000), block)
    assert mask.sum() == 27000 and [block.ids[i] for i in found] == ["cycle"]
    assert time.time() - start < 5
