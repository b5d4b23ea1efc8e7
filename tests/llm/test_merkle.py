"""Merkle manifest against a plain recursive build, with ties, nulls and uneven runs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from airgrid.llm import merkle
from airgrid.llm.queries import op12_merkle
from tests.conftest import SF001

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """Root, and per node the siblings before and after on its way up."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8:a // 8 * 8 + 8]
            paths[i].append(("".join(run[:a % 8]), "".join(run[a % 8 + 1:])))
        level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return (level[0] if level else None), paths


def plain(rows):
    def leaf(r, text):
        return h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    rows = [dict(r, leaf=leaf(r, r["text"])) for r in rows]
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang),
                     key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        trees.append((own, *plain_tree([r["leaf"] for r in own])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            lower = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            node = leaf(r, lower) if hit else r["leaf"]
            for a, b in path + top:
                node = h(a, node, b)
            out.append((r["doc_id"], r["leaf"], subroot, root, h(*[a + b for a, b in path + top]), node, node == root))
    return sorted(map(str, out))


def digest_rows(docs):
    found = merkle.manifest(docs)
    return sorted(map(str, found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")),
        merkle.fold(F.col("tampered_leaf"), F.col("path")).alias("f"), F.expr("f = root")).rdd.map(tuple).collect()))


def made(sizes):
    rows, i = [], 0
    for lang, n in sizes:
        for k in range(n):
            rows.append(dict(doc_id=i * 3 % 1000, text=[None, "", f"Text {i} É ß", "SAME"][k % 4], lang=lang,
                             source=None if i % 5 == 0 else "src", n_chars=None if i % 7 == 0 else i))
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [[("en", 1)], [("en", 9)], [("en", 1), (None, 1)], [("en", 65), ("de", 8), ("", 7), (None, 3)],
                                   [("en", 1100), ("fr", 513), ("é", 512)], [(f"l{i:02d}", 2) for i in range(70)]])
def test_equals_plain_tree(spark, sizes):
    rows = made(sizes)
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], DOCS)
    assert digest_rows(df.repartition(5)) == plain(rows)


def test_ties_nulls_and_repeats(spark):
    rows = ([dict(doc_id=5, text="T", lang="en", source="s", n_chars=1)] * 700
            + [dict(doc_id=5, text=f"U{i % 9}", lang="en", source="s", n_chars=1) for i in range(40)]
            + [dict(doc_id=None, text="N", lang="en", source=None, n_chars=None)] * 3)
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], DOCS)
    assert digest_rows(df.repartition(7)) == plain(rows)


def test_fields_do_not_run_together(spark):
    a, b = spark.createDataFrame([("1", "23", None), ("12", "3", "-")], "a string, b string, c string").select(
        merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()
    assert a.h == h("1:12:23-") and a.h != b.h


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty).count() == 0
    rows = spark.createDataFrame([(i, "x", "y", h(str(i)), i) for i in range(20)], "_pos long, path string, root string, leaf string, _key long")
    got = merkle.prove(rows.withColumn("g", F.lit("g")), "g", ["_pos"], "leaf")
    want, _ = plain_tree([h(str(i)) for i in range(20)])
    assert {r.root for r in got.collect()} == {h_ for h_ in [want]} and sorted(r._key for r in got.collect()) == list(range(20))
    assert got.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_query_over_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = op12_merkle(spark, SF001)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == plain(rows)
