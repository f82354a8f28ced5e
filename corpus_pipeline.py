"""The training-data pipeline: five stages over ``documents``, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import exact_dedup, near_dedup, packing, pii, toxicity
from textloom.llm.common import store
from textloom.llm.queries import SEQUENCE, held_out, table

ORACLE_SQL = None  # SQL cannot express the classifiers, the tagger and the tokenizer; tests hold them against brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. A document without text is clean."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.fitting_sample(docs, labels, "toxic", ~held_out("doc_id")))
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.REJECT).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest identifier."""
    return near_dedup.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets; ``n_chars`` follows."""
    found = pii.mask(docs, pii.train(pii.sample_texts(docs)))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, SEQUENCE, with_tokens=False)
    return packing.pack(cut, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
