"""A corpus made ready for training, in stages that each call one operator of riskloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of documents. `run` writes each stage's result to the shared folder and reads it back.

Cases: nulls, empty texts, repeated rows, empty tables and further columns are handled as each operator says;
labels and benchmark may be empty, their stages then keep every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, packing, secret_owners, simhash_groups, toxicity
from riskloom.llm.common import table
from riskloom.session import settle


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labels, does not reject."""
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "_toxicity").filter("_toxicity < 0.5").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_groups.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials blanked out."""
    return secret_owners.covered(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.packed(packing.items(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and packing have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None
