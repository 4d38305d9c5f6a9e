"""A training corpus from raw documents: five stages, each a table of its own.

Null and empty texts have too few words and go in the first stage, as does what has
no words. Rows of equal texts, also rows of one doc_id, are copies: the first by
doc_id stays with its own repeated rows. A null doc_id is never matched with a test
item; such rows stay. An empty table gives an empty one. Further columns go along up
to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm.decontaminate import keep_clean
from emberlog.llm.jaccard_join import one_of_each
from emberlog.llm.queries import PIECE_MODEL
from emberlog.llm.repetition import keep_varied
from emberlog.llm.secret_spans import mask_secrets
from emberlog.llm.sentence_pieces import encode_texts
from emberlog.llm.shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are too short or repeat themselves go."""
    return keep_varied(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles (Jaccard of 0.8 or more) the first stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a copy of a test item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts stay; their secrets are replaced."""
    return mask_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, their number and checksum, and whether they give the text back."""
    coded = encode_texts(docs, PIECE_MODEL)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("token_ids", token_ids),
]

# Repeats, alignments and merges by rank are not for SQL; tests hold run() against
# plain code for each stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each from the table that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
