"""Content-addressed WARC archive.

A payload is stored once under its SHA-256; exact record headers are stored
separately; the original records come back through a join of the two.  Of the
records with equal payloads of at least ``min_bytes`` bytes the one with the
largest page id is the ``response`` and the others are ``revisit`` records that
refer to it; smaller payloads are always responses (their bytes are still kept once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base32 alphabet, the record layout and the revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex SHA-1 (160 bits: 32 groups of five bits)."""
    letters = []
    for block in range(4):                                   # ten hex digits hold 40 bits
        number = F.conv(F.substring(hex_digest, 10 * block + 1, 10), 16, 10).cast("long")
        for j in range(8):
            five = F.shiftright(number, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(BASE32), five + 1, F.lit(1)))
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _header(date: str) -> Column:
    revisit = F.col("record_type") == "revisit"
    # A line break inside a URL would end the header line.
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "%0A")
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), own, F.lit(">"))),
        _line("WARC-Target-URI", uri), _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            _line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
            _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``path/headers`` and ``path/payloads``.

    A null payload is empty, a null url is an empty target.  Equal ids: each row is
    a record; of several rows that tie as the response one is, the others revisit it.
    A class whose ids are all null keeps its records as responses.  No rows give an
    archive without records.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    facts = rows.select("page_id", "url", "sha256", base32(F.sha1("payload")).alias("sha1"),
                        F.octet_length("payload").cast("long").alias("n_bytes"))
    # One row per different record, with the number of times it was given.
    facts = facts.groupBy("page_id", "url", "sha256", "sha1", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    winner = (facts.groupBy("sha256")
              .agg(F.max(F.struct("page_id", "url")).alias("w"))
              .select("sha256", F.col("w.page_id").alias("best_id"), F.col("w.url").alias("best_url")))
    linked = facts.join(winner, "sha256")
    first = F.col("page_id").eqNullSafe(F.col("best_id")) & F.col("url").eqNullSafe(F.col("best_url"))
    alone = (F.col("n_bytes") < min_bytes) | F.col("best_id").isNull()
    records = (linked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
               .withColumn("record_type", F.when(alone | (first & (F.col("copy") == 1)), "response").otherwise("revisit"))
               .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("best_id"))))
    records.select(_header(date).cast("binary").alias("header"), "sha256").write.parquet(f"{path}/headers")
    # Equal rows are combined before the one exchange that moves payloads; the join reuses it.
    named = F.concat_ws("|", "sha256", F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
                        F.coalesce(F.concat(F.lit("="), "url"), F.lit("null")))
    wanted = winner.select("sha256", F.col("best_id").alias("page_id"), F.col("best_url").alias("url")).select(named.alias("row"))
    once = rows.withColumn("row", named).groupBy("row").agg(F.first("sha256").alias("sha256"), F.first("payload").alias("payload"))
    kept = once.join(wanted, "row", "left_semi")
    (kept.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads"))


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of an archive: parsed header fields, the full payload's size and digests.

    ``verified`` tells whether the stored bytes still have the SHA-256 they are filed
    under and the SHA-1 that the header names.  With ``with_payload`` the payload and
    the exact original record (header, body, two line ends) are rebuilt as well.
    """
    headers = spark.read.schema("header binary, sha256 string").parquet(f"{path}/headers")
    store = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    body = store.select(F.col("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                        base32(F.sha1("payload")).alias("payload_digest"),
                        (F.sha2("payload", 256) == F.col("sha256")).alias("intact"),
                        *([F.col("payload")] if with_payload else []))
    text = F.col("header").cast("string")

    def field(name: str, inner: str = "[^\r\n]*") -> Column:
        got = F.regexp_extract(text, f"(?m)^{name}: ({inner})$", 1)
        return F.when(got != "", got)

    number = lambda name: F.regexp_extract(field(name), f"<{_ID}(-?[0-9]+)>", 1)
    as_long = lambda c: F.when(c != "", c).cast("long")
    out = headers.join(body, "sha256", "left").select(
        as_long(number("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"), as_long(number("WARC-Refers-To")).alias("refers_to"),
        "payload_bytes", "payload_digest",
        F.coalesce(F.col("intact") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")),
                   F.lit(False)).alias("verified"), "sha256", "header",
        *([F.col("payload")] if with_payload else []))
    if with_payload:
        end = F.lit("\r\n\r\n").cast("binary")
        out = out.withColumn("record", F.when(F.col("record_type") == "revisit", F.concat("header", end))
                             .otherwise(F.concat("header", "payload", end)))
    return out
