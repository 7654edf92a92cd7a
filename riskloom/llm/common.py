"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# Scripts that put no spaces between words, as the inside of a character class.
UNSPACED = "".join(rf"\p{{Is{script}}}" for script in "Han Hiragana Katakana Thai Lao Khmer Myanmar".split())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checksum(text: Column) -> Column:
    """crc32 of the UTF-8 bytes, unsigned."""
    return F.crc32(text.cast("binary"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def uniform(*columns: Column) -> Column:
    """A repeatable number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sheltered(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns, and all others inside one column `_rest`, where their names meet no other."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*(rest or [F.lit(0).alias("none")])).alias("_rest"))


def restored(rows: DataFrame, docs: DataFrame, needed: list[str]) -> DataFrame:
    """Columns of `docs`, in their order, out of what `sheltered` made."""
    return rows.select(*(F.col(c) if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns))
