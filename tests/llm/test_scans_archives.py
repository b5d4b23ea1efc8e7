"""Decontamination, archive, chats and licences: plain versions and edge cases."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from airgrid.llm import chat, decontam, licenses, warc
from airgrid.llm.words import gram_hashes, occurrence, word_hashes
from airgrid.session import scratch_path
from tests.conftest import SF001, SF01

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_word_hashes_follow_the_words():
    texts = ["", None, "  ", "Aa aA, b", "éÀ 東京x-9 ", "a" * 5000 + " " + "a" * 4999, "x\x00y", "end"]
    seen = {}
    for t in texts:
        w, h = words(t), word_hashes(t).tolist()
        assert len(w) == len(h)
        for a, b in zip(w, h, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    assert occurrence(np.array([5, 3, 5, 5, 3])).tolist() == [0, 0, 1, 2, 1]


def test_winnowing_keeps_a_minimum_of_every_run():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 9, 40):
        g = rng.integers(0, 12, n).astype(np.uint64)
        got = set(decontam.winnow(g, 9).tolist())
        runs = [range(i, i + min(9, n)) for i in range(max(0, n - 9) + 1)] if n else []
        assert got == {j for r in runs for j in r if g[j] == min(g[i] for i in r)}


def plain_hits(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        if n:
            wins = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in wins:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found - {"None"})


def test_decontamination_equals_plain_scan_in_one_and_many_blocks(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    items += [(900, "short one"), (901, None), (902, " ,. "), (None, "very rare words here"), (900, "another short item text"),
              (903, items[0][1] + " " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("clash"))
    some = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(80).collect()]
    w = words(items[2][1])
    some += [None, "", "!!", "A short ONE, a short-one", "x " + " ".join(w[:13]) + " y", " ".join(w[:12]) + " z", " ".join(w) * 3,
             "very rare words here", (items[0][1] + " filler ") * 300]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(some)] + [(3, some[3], 0), (None, some[-2], 0)],
                                 "doc_id long, text string, hit_items_ int")
    rows = docs.collect()
    for size in (2_000_000, 300):
        got = decontam.scan(docs, bench, block_words=size).withColumn("n_hit", decontam.n_hit()).collect()
        have = Counter((r.doc_id, r.text, r.n_words, r.n_hit, tuple(sorted(r.hit_items))) for r in got)
        want = Counter((r.doc_id, r.text, *plain_hits(r.text, items)[:2], tuple(plain_hits(r.text, items)[2])) for r in rows)
        assert have == want
    nothing = decontam.scan(docs, bench.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r.hit_ranges or r.hit_items for r in nothing)
    assert decontam.scan(docs.limit(0), bench).count() == 0


def test_long_items_are_cut_without_losing_windows(spark):
    rng = np.random.default_rng(1)
    w = [f"t{i}" for i in rng.integers(0, 5000, 9000)]
    at = decontam.PIECE_WINDOWS - 5
    docs = spark.createDataFrame([(1, " ".join(w[at:at + 13])), (2, " ".join(w))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: r.h for r in decontam.scan(docs, bench).select("doc_id", decontam.n_hit().alias("h")).collect()}
    assert got == {1: 13, 2: 9000}


def test_gram_hash_of_equal_runs():
    w = word_hashes("a b c a b c d")
    g = gram_hashes(w, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4 and len(gram_hashes(w, 8)) == 0


def test_archive_round_trip(spark):
    rows = [(1, "http://a/é\r\nx", "<p>one</p>"), (5, "http://b", "<p>one</p>"), (3, None, "<p>one</p>"), (2, "http://c", None),
            (7, "http://d", ""), (5, "http://b", "<p>one</p>"), (9, "http://e", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\nbody\r\n\r\n"),
            (None, "http://f", "alone"), (11, "http://g", "x" * 300000), (None, "http://h", "<p>one</p>"), (-4, "http://i", "neg")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})
    got = warc.read_records(spark, path, with_payload=True).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    have = Counter((r.page_id, bytes(r.payload), r.payload_bytes, r.payload_digest) for r in got)
    assert have == Counter((i, (h or "").encode(), len((h or "").encode()),
                            base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(1, "revisit", 5), (5, "response", None), (5, "revisit", 5), (3, "revisit", 5), (2, "revisit", 7),
                             (7, "response", None), (9, "response", None), (None, "response", None), (11, "response", None),
                             (None, "revisit", 5), (-4, "response", None)])
    for r in got:
        head, record = bytes(r.header), bytes(r.record)
        assert head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n") and head.count(b"\r\n\r\n") == 1
        size = int(re.search(rb"Content-Length: (\d+)\r\n", head)[1])
        assert record == head + (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert size == len(record) - len(head) - 4
    # Small payloads are all responses, their bytes still kept once.
    warc.write_archive(df, path + "-min", min_bytes=11)
    assert {r.record_type for r in warc.read_records(spark, path + "-min").collect()} == {"response"}
    warc.write_archive(df.limit(0), path + "-none")
    assert warc.read_records(spark, path + "-none").count() == 0


def test_archive_notices_changed_bytes(spark):
    path = scratch_path(spark, "warc-bad")
    warc.write_archive(spark.createDataFrame([(1, "u", "right")], "page_id long, url string, html string"), path)
    store = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("wrong").cast("binary")).collect()
    spark.createDataFrame(store, "sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    assert [r.verified for r in warc.read_records(spark, path).collect()] == [False]


def test_chat_collapse_equals_plain_prefixes(spark):
    rng = np.random.default_rng(3)
    chats = {}
    for i in range(60):
        chats[i] = [("user" if k % 2 == 0 else "assistant", f"t{rng.integers(0, 2)}") for k in range(rng.integers(1, 6))]
    chats[100], chats[101] = [("user", None)], [("user", "")]
    chats[102], chats[103] = [("user", "a"), (None, "b")], [("user", "a")]
    rows = [(i, k, r, t, "x") for i, c in chats.items() for k, (r, t) in enumerate(c)]
    rows += rows[:7] + [(None, 0, "user", "no id", "x"), (None, None, "user", "no turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)
    chats[None] = [("user", "no turn"), ("user", "no id")]
    bodies = {i: tuple(c) for i, c in chats.items()}
    proper = {b[:k] for b in bodies.values() for k in range(1, len(b))}
    want = {}
    for i, b in sorted(bodies.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        if b not in proper and b not in want:
            want[b] = i
    shown = {i: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in b) for b, i in want.items()}
    got = chat.format_chats(df).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
        assert r.n_turns == len(bodies[r.conv_id])
    assert text == shown
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chat_comes_in_parts_and_absorbs_its_snapshots(spark):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                     F.concat(F.lit("m"), "id").alias("text"))
    early = turns.where("turn < 1500").withColumn("conv_id", F.lit(0).cast("long"))
    got = chat.format_chats(turns.unionByName(early), part_turns=500).collect()
    assert {(r.conv_id, r.part, r.part_turns, r.n_turns) for r in got} == {(1, p, 500, 3000) for p in range(6)}
    assert "".join(r.rendered for r in sorted(got, key=lambda r: r.part)).count("<|im_end|>") == 3000


def test_licences_by_canonical_text(spark):
    mit = dict(licenses.KNOWN[2:3])["MIT"]
    variant = "Copyright (c) 2020 Somebody\n# (c) Other\n" + mit.upper().replace("SUBLICENSE", "sublicence").replace(",", " ;").replace("\n", "\r\n")
    rows = [(1, mit), (2, variant), (3, mit + " extra"), (4, None), (5, ""), (6, "..."), (7, "licensed under CC BY-NC 4.0"),
            (8, "word " * 100000), (1, mit), (None, "Released under the MIT Licence!")]
    rows[9] = (None, "Released under the MIT License!")
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license_id string")
    got = Counter((r.doc_id, r.license_id) for r in licenses.scan(df, licenses.known_licenses(spark)).collect())
    assert got == Counter([(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "CC-BY-NC-4.0"),
                           (8, None), (None, "MIT")])
    same = {r.digest for r in licenses.scan(df.where("doc_id in (4, 5, 6)"), licenses.known_licenses(spark)).collect()}
    assert len(same) == 1
    plan = licenses.scan(df, licenses.known_licenses(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(df.limit(0), licenses.known_licenses(spark)).count() == 0


def test_queries_equal_their_sql(spark):
    import duckdb

    from airgrid.llm.queries import QUERIES
    from airgrid.llm.sql import ORACLE
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF01}/{t}.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF01)
        rel = con.execute(sql)
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == sorted(got.columns)
        assert Counter(map(tuple, got.select(*cols).collect())) == Counter(rel.fetchall()), name
