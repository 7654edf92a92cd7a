import base64
import hashlib

from riskloom.llm import warc_store as A

PAGES = [(3, "http://a", "<p>one</p>"), (1, "http://b\r\nX: y", "<p>one</p>"), (2, None, None), (5, "u", ""), (4, "v", "é\r\n\r\nWARC/1.1"),
         (4, "v", "é\r\n\r\nWARC/1.1"), (None, "w", "<p>one</p>"), (None, "w", "alone"), (9, "long", "x" * 300_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = A.round_trip(pages).collect()
    assert len(rows) == len(PAGES) and all(r["verified"] for r in rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == sorted([("3", "revisit", 1), ("1", "response", None), ("2", "response", None), ("5", "revisit", 2), ("4", "response", None),
                            ("4", "response", None), ("None", "revisit", 1), ("None", "response", None), ("9", "response", None)])
    for r in rows:
        payload, record = bytes(r["payload"]), bytes(r["record"])
        html = next(h or "" for i, _, h in PAGES if i == r["page_id"] and (i is not None or h.encode() == payload))
        assert payload == html.encode() and r["payload_bytes"] == len(payload)
        assert r["sha1"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head, rest = record.split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + r["sha1"].encode() and b"X" not in fields
        body = rest[: int(fields[b"Content-Length"])]
        assert rest[len(body) :] == b"\r\n\r\n"
        http, inner = body.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK") and inner == (b"" if r["record_type"] == "revisit" else payload)


def test_payloads_are_stored_once(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    A.write(pages, f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads").collect()
    assert len(stored) == len({h or "" for _, _, h in PAGES})
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["digest"] for r in stored)


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    A.write(pages, f"{tmp_path}/b")
    from pyspark.sql import functions as F

    spark.read.parquet(f"{tmp_path}/b/payloads").withColumn("payload", F.lit(b"other")).coalesce(1).write.parquet(f"{tmp_path}/c/payloads")
    spark.read.parquet(f"{tmp_path}/b/headers").write.parquet(f"{tmp_path}/c/headers")
    assert [r["verified"] for r in A.read(spark, f"{tmp_path}/c").collect()] == [False]


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in A.round_trip(pages, least=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_and_further_columns(spark):
    pages = spark.createDataFrame([(1, "u", "ab", "z")], "page_id long, url string, html string, digest string")
    assert A.round_trip(pages.limit(0)).count() == 0
    assert A.round_trip(pages).count() == 1


def test_records_are_rebuilt_and_judged(spark, tmp_path):
    """Sizes and digests are those of the bytes read back, and a changed header is noticed."""
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "cd")], "page_id long, url string, html string")
    A.write(pages, f"{tmp_path}/d")
    good = A.read(spark, f"{tmp_path}/d").collect()
    assert all(r["verified"] and hashlib.sha256(bytes(r["record"])).digest() == bytes(r["record_digest"]) for r in good)
    spark.read.parquet(f"{tmp_path}/d/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{tmp_path}/e/payloads")
    header = F.when(F.col("page_id") == 2, F.lit("HTTP")).otherwise(F.col("header"))
    spark.read.parquet(f"{tmp_path}/d/headers").write.parquet(f"{tmp_path}/e/headers")
    spark.read.parquet(f"{tmp_path}/d/headers").withColumn("header", header).write.parquet(f"{tmp_path}/f/headers")
    spark.read.parquet(f"{tmp_path}/d/payloads").write.parquet(f"{tmp_path}/f/payloads")
    other = base64.b32encode(hashlib.sha1(b"other").digest()).decode()
    assert {(r["payload_bytes"], r["sha1"], r["verified"]) for r in A.read(spark, f"{tmp_path}/e").collect()} == {(5, other, False)}
    assert {r["page_id"]: r["verified"] for r in A.read(spark, f"{tmp_path}/f").collect()} == {1: True, 2: False, 3: True}
    plan = A.read(spark, f"{tmp_path}/d").select("payload_bytes", "sha1", "verified")._jdf.queryExecution().optimizedPlan().toString()
    assert "payload#" in plan.split("Join")[0]
