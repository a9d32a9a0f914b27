"""A content-addressed WARC archive.

Two tables: `payloads` holds each distinct payload once, under its SHA-256; `records`
holds the exact header bytes of every record with the digest of its payload. The
digest is verified whenever a payload is read. Original records come back by joining
the two; `as_files` writes them as WARC files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import shared_folder, written

LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:pagestrata:page:"


def _escaped(value: Column) -> Column:
    """Control characters as percent escapes, so that a header stays one line and loses nothing."""
    plain = value
    for code in (*range(0x20), 0x7F):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(value.rlike(r"[\x00-\x1f\x7f]"), plain).otherwise(value)


def _header(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Archives a record per row of `pages` (page_id: long, url, html) under `folder`.

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at
    least `least` bytes the one with the largest page_id is a response and the others are
    revisits of it; smaller ones are all responses. Rows that tie for the largest are all
    responses; where no record of a group has a page_id, all are. Record ids hold the page_id
    and a random part, so that they are unique where page_ids are null or repeat. Control
    characters of a url are written as percent escapes. Other columns are ignored; an empty
    table makes an empty archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    named = F.format_string(f"<{_ID}%s:%s>", F.col("page_id").cast("string"), F.uuid())
    facts = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"), named.alias("name"))
    # written before names are used twice: a random part must not be drawn again
    facts = written(facts, "facts")
    leaders = facts.where(F.col("n") >= least).where("page_id is not null").groupBy("digest")
    leaders = leaders.agg(F.max("page_id").alias("leader"), F.max_by("name", "page_id").alias("refers"))
    # small payloads, of which one may be most of the table, meet no leader
    known = facts.where(F.col("n") >= least).join(leaders, "digest", "left")
    none = {"leader": F.lit(None).cast("long"), "refers": F.lit(None).cast("string")}
    facts = known.unionByName(facts.where(F.col("n") < least).withColumns(none))
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("leader")) & F.col("leader").isNotNull(), F.lit(False))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.col("name")),
        _header("WARC-Target-URI", _escaped(F.col("url"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _header("WARC-Refers-To", F.when(revisit, F.col("refers"))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    facts.select(header.cast("binary").alias("header"), "digest").write.parquet(f"{folder}/records")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload) of an archive; reading fails where a payload differs from its digest."""
    found = spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
    return found.select("digest", F.coalesce(sound, F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest"))).alias("payload"))


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """(record: binary, start: int, payload: binary) of an archive: the exact original records,
    where their bodies start, and the full payloads that they are about. A revisit's record
    has no body of its own."""
    heads = spark.read.parquet(f"{folder}/records").join(payloads(spark, folder), "digest")
    own = F.contains(F.col("header").cast("string"), F.lit("\r\nWARC-Type: revisit\r\n"))
    body = F.when(own, F.lit(b"")).otherwise(F.col("payload"))
    return heads.select(F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"), F.octet_length("header").alias("start"), "payload")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(record: binary) of an archive: the exact original records."""
    return rebuilt(spark, folder).select("record")


def field(name: str) -> Column:
    """A field of `head`, the header as a string; null where it has none."""
    return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def as_files(found: DataFrame, path: str) -> None:
    """Writes `records` as WARC files, a record after another; bytes that are not UTF-8 don't occur."""
    body = F.col("record").cast("string")
    found.select(F.substring(body, 1, F.length(body) - 4)).write.option("lineSep", "\r\n\r\n").text(path)


def described(spark: SparkSession, folder: str) -> DataFrame:
    """What the rebuilt records of an archive say, each parsed from its bytes.

    Fails where a body's length or digest is not what the record's header says.
    """
    found = rebuilt(spark, folder).withColumn("head", F.substring("record", F.lit(1), F.col("start")).cast("string"))
    found = found.withColumns({"kind": field("WARC-Type"), "length": field("Content-Length").cast("long")})
    # after the header the body, then four bytes that end the record
    body = F.substring("record", F.col("start") + 1, F.octet_length("record") - F.col("start") - 4)
    found = found.withColumn("body", body).withColumn("full", F.when(F.col("kind") == "revisit", F.col("payload")).otherwise(F.col("body")))
    found = found.withColumn("sha1", F.sha1("full"))
    sound = (F.octet_length("body") == F.col("length")) & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "sha1"))
    digest = F.coalesce(F.when(sound, F.col("sha1")), F.raise_error(F.lit("a record's header and body disagree")))

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(field(name), f"<{_ID}(-?[0-9]+):", 1), F.lit("")).cast("long")

    return found.select(
        page("WARC-Record-ID").alias("page_id"),
        F.octet_length("full").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of
    `pages`: they are archived in the shared folder (see `write_archive`), their records are
    rebuilt by joins, and the columns are read from the rebuilt bytes.

    Null htmls are empty payloads; null and repeated page_ids keep a record each; an empty
    table gives no rows; columns beyond page_id, url and html are ignored.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    return described(pages.sparkSession, folder)
