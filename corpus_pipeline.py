"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) to a DataFrame; run() writes
every stage's result as Parquet to the shared folder and rereads it as the next
stage's docs. All stages but the last return the columns of documents, whatever
further columns docs has and whatever their names.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and an empty table, which gives an empty result; what it does with them is in
its own docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, neardup, packing, pii, toxicity
from tessella.llm.shared import cut, discard


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it has that column, of its text as it is now; 0 for null."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return docs.select(*[n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null and empty texts have the score of the model's bias; equal texts share
    one fate; null ids are never labelled. Without toxic labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.clean_rows(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.

    Shingles have five words and the similarity is 0.8. Null and empty texts are
    in no group and all stay; a null doc_id is the greatest; of rows with one
    doc_id in a group that with the least hash of its columns stays."""
    return neardup.one_of_each(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, and n_chars of the new text.

    Null and empty texts stay as they are; equal texts are treated alike."""
    return counted(pii.redact(docs, count=None))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the source weights ask for.

    A null source is one of its own; documents without words are never taken;
    repeated rows are separate documents."""
    return counted(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in their sequences.

    Null and empty texts are one end token; rows with null or equal ids are
    packed like any others."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("neardup", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the model of the first stage nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
