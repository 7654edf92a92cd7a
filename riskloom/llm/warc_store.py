"""A content-addressed archive of WARC records.

An archive is two Parquet tables in one folder. `payloads` keeps the bytes of every distinct payload once,
under its SHA-256 digest. `headers` keeps, for each record, its exact header block, the digest of its
payload, its record type, whom it refers to and the digest of the whole record. Reading joins the two, rebuilds
each record byte for byte, and works out sizes and digests from the rebuilt bytes.

The first record of a payload (smallest page_id) is a `response`; later ones are `revisit` records
without a body of their own. Payloads below `least` bytes are always responses. Header blocks give the bare
base32 SHA-1 as WARC-Payload-Digest, as readers of such archives expect.

Everything is DataFrame functions. Writing exchanges payload bytes once, folded inside each task before,
so a payload that very many records share moves once from each; records are typed on digests alone.

Cases: a null html is an empty payload; equal empty payloads are revisits like others; rows that repeat
the page_id of the response are responses too, the bytes still stored once; a row without a page_id is a
revisit unless all rows of its payload have none; a null url is an empty target; other columns are ignored;
an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

LEAST = 0
DATE = "1970-01-01T00:00:00Z"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAYLOADS = "digest string, payload binary"
HEADERS = "page_id long, record_type string, refers_to long, digest string, payload_bytes long, sha1 string, header string, record_digest binary"
END = b"\r\n\r\n"


def base32(digest: Column) -> Column:
    """Base32 of a SHA-1 given in hex: twenty bits, so four letters, from every five digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _RFC32)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header_block(date: str = DATE) -> Column:
    """The WARC and HTTP header lines of a record, up to its payload."""
    end, revisit = F.lit("\r\n"), F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    # A line break inside a URL would end the header line.
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    profile = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                       _record_id(F.col("refers_to")), end)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), end,
        F.when(revisit, profile).otherwise(""), F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        body.cast("string"), F.lit("\r\n\r\n"), http)


def _record(header: Column, body: Column) -> Column:
    return F.concat(F.encode(header, "utf-8"), body, F.lit(END))


def _digest(record: Column) -> Column:
    return F.unhex(F.sha2(record, 256))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Write pages(page_id, url, html) as an archive in the folder `path`."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    facts = rows.select(
        "page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("sha1"), "payload")
    # The record as a response needs nothing from other rows, so its digest is taken beside the payload.
    facts = facts.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    facts = facts.withColumn("_response", _digest(_record(header_block(date), F.col("payload")))).drop("payload", "record_type", "refers_to")
    first = facts.groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = facts.join(first, "digest")
    response = (F.col("payload_bytes") < least) | F.col("page_id").eqNullSafe(F.col("first"))
    typed = joined.select("*", F.when(response, "response").otherwise("revisit").alias("record_type"),
                          F.when(~response, F.col("first")).alias("refers_to"))
    headed = typed.withColumn("header", header_block(date))
    whole = F.when(response, F.col("_response")).otherwise(_digest(_record(F.col("header"), F.lit(b""))))
    headed.select("page_id", "record_type", "refers_to", "digest", "payload_bytes", "sha1", "header", whole.alias("record_digest")) \
        .write.option("compression", "zstd").parquet(f"{path}/headers")
    # Equal digests are equal bytes, so any row may be the one that is stored; tasks fold theirs before the exchange.
    stored = rows.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(HEADERS if name == "headers" else PAYLOADS).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: its header facts, payload, `record`, and whether all digests hold.

    `record` is the record as bytes; a revisit has no body, its payload comes from the record it refers to.
    payload_bytes, sha1 and record_digest are those of the rebuilt bytes; `verified` says that they, and the
    SHA-256 of the payload, are the ones that were written.
    """
    rows = _read(spark, path, "headers").withColumnsRenamed({"payload_bytes": "_bytes", "sha1": "_sha1", "record_digest": "_record_digest"})
    rows = rows.join(_read(spark, path, "payloads"), "digest")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    rows = rows.withColumn("record", _record(F.col("header"), body))
    rows = rows.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "sha1": base32(F.sha1("payload")), "record_digest": _digest(F.col("record"))})
    holds = (F.sha2("payload", 256) == F.col("digest")) & (F.col("sha1") == F.col("_sha1")) & (F.col("payload_bytes") == F.col("_bytes"))
    holds = holds & (F.col("record_digest") == F.col("_record_digest"))
    return rows.select(*(f.split()[0] for f in HEADERS.split(", ")), "payload", holds.alias("verified"), "record")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages to a fresh archive and read its records back."""
    path = scratch_path(pages.sparkSession, "archive")
    write(pages, path, least)
    return read(pages.sparkSession, path)
