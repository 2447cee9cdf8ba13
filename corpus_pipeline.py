"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents.  1: documents that language identification
rejects go.  2: of equal texts the largest doc_id stays.  3: of near duplicates the smallest doc_id
stays.  4: personal data in texts is replaced by its kind.  5: what is left is tokenised and packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm import exact_dedup, language_id, packing, pii, simhash
from propgraph.llm.common import prepare, stored, table

#: Share of a text's n-grams that its best language must contain, corrected for false positives.
LEAST_SCORE = 0.2


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ...: what an operator adds clashes with none of them."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without letters (undetermined) and of no learned language go."""
    prepare(spark)
    filters = language_id.learn(docs.where(~language_id.held_out()))
    seen = language_id.predict(_numbered(docs), filters, f"c{docs.columns.index('text')}")
    return _named(seen.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    prepare(spark)
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id (nulls first), of each component of near duplicates."""
    prepare(spark)
    return simhash.without_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with [KIND] in place of personal data; n_chars is that of the new text."""
    prepare(spark)
    text = f"c{docs.columns.index('text')}"
    found = pii.find(_numbered(docs), pii.fit(docs), text, redacted=True)
    return _named(found, docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most 2048 tokens."""
    prepare(spark)
    cut = packing.pieces(packing.tokenise(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))
    narrow = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    narrow = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "pieces")  # repeated rows differ by it
    return packing.pack(narrow, ["doc_id", "start", "ids_crc32", "row"], packing.group_count(narrow.count())).drop("row")


STAGES = [("language", identify), ("exact", drop_copies), ("near", drop_near_copies), ("personal", redact), ("pack", pack)]

#: Hashes, filters, a trained tagger and a tokenizer: no stage can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
