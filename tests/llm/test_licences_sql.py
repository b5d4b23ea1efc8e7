"""Licences of whole-licence documents: the lookup against its SQL."""

from airgrid.llm import licenses
from airgrid.llm.sql import ORACLE


def test_whole_licence_documents_equal_the_sql(spark):
    import duckdb
    texts = [t for _, t in licenses.KNOWN]
    texts += ["Copyright (c) 2020 Some Body\n\n" + t.upper() for t in texts] + [t + " more" for t in texts] + ["", None]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    # Only the licence: the digests of the SQL leave out every line that begins with "copyright".
    want = dict(con.execute(f"select doc_id, license_id from ({ORACLE['op10_licenses']})").fetchall())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert got == want
    n = len(licenses.KNOWN)
    assert [got[i] for i in range(2 * n)] == [i for i, _ in licenses.KNOWN] * 2
