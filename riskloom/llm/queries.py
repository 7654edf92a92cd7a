"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontaminate, external_shuffle, fingerprint, language_id, packing, periodic_runs, secret_owners, simhash_groups, spelling_variants, substring_dedup,
    surrogates, toxicity, warc_store,
)
from .common import checksum, remainder, table, text_of


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_entities", F.length("text").cast("long").alias("n_chars"), "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.items(table(spark, sf_dir, "documents")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) == 2
    model = language_id.learned(docs, ~held_out)
    out = language_id.predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_owners.secrets(table(spark, sf_dir, "documents"))
    spans, base = F.col("spans"), len(secret_owners.BASE)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["ord"] == secret_owners.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secret_owners.BASE),
        F.sha2(secret_owners.listed(F.filter(spans, lambda s: s["ord"] < base)), 256).alias("base_sha256"),
        secret_owners.listed(spans).alias("spans"),
        secret_owners.listed(F.filter(spans, lambda s: F.array_contains(F.col("live"), s["value"]))).alias("live_spans"),
        F.size("live").cast("long").alias("n_live"), F.size("example").cast("long").alias("n_example"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_store.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "verified")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage, with the items; clean ones have no row."""
    return decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.near_duplicates(table(spark, sf_dir, "documents"))


def _with_letters_lost(runs: DataFrame) -> DataFrame:
    """The edit that the query makes: of one run in 97, by document and run, a code point is deleted."""
    h, at = checksum(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word")), F.col("_at")
    runs = runs.withColumn("_h", h).withColumn("_at", F.when(F.col("_h") % 97 == 0, (F.col("_h") % F.length("word")).cast("int")))
    lost = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return runs.select(F.when(at.isNull(), F.col("word")).otherwise(lost).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling_variants.words_of(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return spelling_variants.grouped(spelling_variants.vocabulary(_with_letters_lost(runs)))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The edit that the query makes: one document in ten, by its id, goes round in its words from some word on."""
    h, text = checksum(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), text_of()
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = docs.select("doc_id", text.alias("text"), h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    docs = docs.withColumn("_n", F.size("_w")).withColumn("_g", F.floor(F.col("_h") / 10))
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    docs = docs.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1)
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    turned = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", place(i)))
    return docs.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(_with_periods(table(spark, sf_dir, "documents")))
    best = F.col("best")
    return found.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal numbers of documents, in a random order."""
    out = external_shuffle.shuffled(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), checksum(text_of()).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


def _windows_sql(window: int) -> str:
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - {window - 2})) AS i FROM w)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {window})) AS p FROM win JOIN again USING (k)) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS ks
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, n - len(ks) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept"""


def _secrets_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    S = secret_owners
    kinds, number = S.BASE | S.ADDED, S.KINDS.index
    body = f"coalesce(nullif(regexp_extract(g[i + 1], {quoted(S.KEY_END)}, 1), ''), regexp_extract(g[i + 1], {quoted(S.KEY_LINES)}, 1))"
    found = " UNION ALL ".join(f"""
SELECT doc_id, source, {i} AS o, unnest(range(1, len(m) + 1)) AS i, g, m, v, {least} AS least FROM (
  SELECT doc_id, source, string_split_regex(t, {quoted(p)}) AS g, regexp_extract_all(t, {quoted(p)}, 0) AS m, regexp_extract_all(t, {quoted(p)}, {group}) AS v
  FROM d WHERE regexp_matches(t, {quoted(p)}))""" for i, (p, group, least) in enumerate(kinds.values()))
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    listed = lambda where: f"coalesce(string_agg({names}[o + 1] || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (o = {i}) AS n_{k}" for i, k in enumerate(S.BASE))
    letters = lambda v: f"len(list_distinct(string_split({v}, '')))"
    by_place = lambda v: f"(NOT regexp_matches({v}, {quoted(S.PLACEHOLDER)}) AND {letters(f'lower({v})')} >= 5)"
    bare = f"regexp_replace(v, {quoted(f'-----(?:BEGIN|END) {S._KEY}|[[:space:]]')}, '', 'g')"
    word = "regexp_extract(v, ':([^:@]*)@$', 1)"
    looks = f"""(length(v) >= 16 AND (starts_with(v, 'AKIA') OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND {letters('v')} >= 8)))
    OR o IN ({number('jwt')}, {number('vendor')}) OR (o = {number('key')} AND {bare} <> '') OR (o = {number('assign')} AND {by_place('v')})
    OR (o = {number('address')} AND {by_place(word)})"""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), e AS ({found}),
sp AS (SELECT doc_id, source, o, w AS v, a, a + length(m[i]) + length(w) - length(v[i]) AS b FROM (
  SELECT *, CASE WHEN o = {number('key')} THEN v[i] || {body} ELSE v[i] END AS w,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e)
  WHERE length(v[i]) >= least),
own AS (SELECT v, CASE WHEN count(DISTINCT coalesce('s' || source, '')) > {S.MOST_OWNERS} THEN 'example' WHEN bool_or({looks}) THEN 'live' ELSE 'weak' END AS c FROM sp GROUP BY v)
SELECT d.doc_id, {counts}, sha256({listed(f'o < {len(S.BASE)}')}) AS base_sha256, {listed('o IS NOT NULL')} AS spans, {listed("c = 'live'")} AS live_spans,
  count(DISTINCT v) FILTER (c = 'live') AS n_live, count(DISTINCT v) FILTER (c = 'example') AS n_example
FROM d LEFT JOIN (SELECT * FROM sp JOIN own USING (v)) s USING (doc_id) GROUP BY d.doc_id"""


def _warc_sql() -> str:
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT) + 1, 1)"
        for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), q AS (SELECT *, sha1(x) AS h, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, {letters} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified FROM q"""


#: Where SQL can say the same. The others hash with XXH64 or a key, are trained, or iterate; tests hold them against plain Python.
SQL: dict[str, str] = {"op5_substring_dedup": _windows_sql(substring_dedup.WINDOW), "op7_secrets": _secrets_sql(), "op8_warc": _warc_sql()}
