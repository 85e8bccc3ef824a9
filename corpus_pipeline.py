"""A training corpus from documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railspan.llm import near_dup, packing, pii, substring_dedup, toxicity
from railspan.llm.common import any_names, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not reject.

    Null and empty texts, null and repeated ids are judged row by row; an empty table stays empty; all columns stay,
    whatever their names. The model is fitted to labelled rows of the tables in sf_dir; without labels nothing is rejected.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Of rows that repeat an id one stays, that with the least text (a null text counts as empty). Rows with a null id
    and rows without words are linked with nothing and stay. All columns stay, whatever their names.
    """
    return _one_of_each(docs)


@any_names
def _one_of_each(docs: DataFrame) -> DataFrame:
    gone = near_dup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 and doc_id is not null").select("doc_id")
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = stay.join(again, "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    one = rows.groupBy("doc_id").agg(F.min_by("row", "text").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return stay.join(again, "doc_id", "left_anti").select(*docs.columns).union(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of twenty words and more that an earlier document, or the same one before, has.

    All rows and columns stay. Null and empty texts, and rows with a null id, are left as they are.
    """
    return substring_dedup.remove_repeats(docs)


def hide_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, under the session's key (spark.railspan.pseudonymKey).

    All rows and columns stay; null and empty texts are left as they are.
    """
    return pii.pseudonymise_table(docs, pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences along the curve. A null or empty text is its separator alone; an empty table has no piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("substrings", cut_repeats),
    ("personal_data", hide_people),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return materialize(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
