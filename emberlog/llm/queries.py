"""The numbered queries over the given tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm import (
    decontaminate, hard_negatives, html_text, jaccard_join, language, neighbours, quality, repeated_spans,
    repetition, secret_spans, sentence_pieces, token_files, token_pairs,
)
from emberlog.llm.shared import stored, table
from emberlog.session import scratch_dir

# Vocabulary files are parameters of the operators; these are the public ones.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_text.train(html_text.training_sample(pages))
    return html_text.extract(pages, model).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = language.remainder("doc_id", 3)
    model = language.learn(docs.where(rest != 1).where("text is not null and lang is not null"))
    return language.predict(docs, model).select(
        "doc_id", (rest == 1).alias("held_out"), "lang_pred", "score"
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return token_files.read_tokens(spark, folder)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_spans.BASE_KINDS))

    def text(column):
        return F.array_join(
            F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *[count(kind) for kind in secret_spans.BASE_KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(quality.describe(table(spark, sf_dir, "documents")), "stats")
    rest = language.remainder("doc_id", 5)
    known = quality.labelled(described.where(rest != 0), table(spark, sf_dir, "labels"), "quality")
    return quality.scored(described, quality.fit(known)).select(
        "doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode_texts(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "round_trip")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine_negatives(
        rows.select("vec_id", noisy.alias("label"), F.col("embedding").alias("vector"),
                    (F.col("vec_id") % 50 == 0).alias("anchor"))
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(
        rows.select("vec_id", F.col("embedding").alias("vector"), (F.col("vec_id") % 100 == 0).alias("query"))
    ).withColumn("rank", F.col("rank").cast("int"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_pairs.align_texts(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL)
    digest = F.when(F.col("groups").isNotNull(), F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return aligned.withColumn("groups_sha256", digest).drop("groups")


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_html_text": op2_html_text,
    "op3_language": op3_language,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secrets": op6_secrets,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_neighbours": op12_neighbours,
    "op13_token_alignment": op13_token_alignment,
}
# Words of a text, as the operators take them.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op5_substring_dedup": f"""
WITH texts AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 49), ' ')) AS edge
  FROM texts, unnest(range(1, len(words) - 48)) AS places(pos)),
sources AS (SELECT edge, min(doc_id) AS source FROM windows GROUP BY edge),
gone AS (
  SELECT DISTINCT doc_id, pos + step AS place
  FROM windows JOIN sources USING (edge), range(50) AS steps(step) WHERE source < doc_id),
lost AS (SELECT doc_id, list(place) AS places, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(words[pos], ' ' ORDER BY pos) AS kept
  FROM texts, unnest(range(1, len(words) + 1)) AS places(pos)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = texts.doc_id AND place = pos)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_jaccard_join": f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                               "'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
members AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, pos, pos + 2), ' ') AS shingle
  FROM texts, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS places(pos) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
}
