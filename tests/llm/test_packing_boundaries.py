"""Packing: every padded length is a real length, also over 4,096 tokens."""

from pyspark.sql import functions as F

from airgrid.llm import packing


def test_boundaries_are_real_lengths(spark):
    lengths = [3, 50, 4096, 4097, 5001, 8191, 8193, 20001, 20002, 100001, 1000003]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    for buckets in (1, 3, 16):
        got = packing.pack(df, F.col("n"), buckets=buckets).collect()
        assert len(got) == len(lengths)
        for r in got:
            assert r.padded_length == max(x.n_tokens for x in got if x.bucket == r.bucket) >= r.n_tokens
    assert max(r.padded_length for r in got) == 1000003
