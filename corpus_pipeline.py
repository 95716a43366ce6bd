"""A training-corpus pipeline of five stages over the table documents.

Each stage gets what the stage before it kept and applies one operator of
jisfold.llm: quality classifier, language identification, near-duplicates,
mixing, BPE.  All stages but the last return the columns of documents; mixing
returns a document as often as the mix takes it.

Models are trained from the whole tables' labelled rows (of the input folder),
so that a stage's decisions don't depend on what the stages before it left.
Nulls, empty texts, repeated rows and empty tables have the results that the
operators define: a null text is empty, is scored as such by the classifier,
and goes with the texts without letters at the language stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jisfold.llm import bpe, langid, mixing, quality, simhash
from jisfold.llm.common import fold_of, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    machine = quality.fit(table(spark, sf_dir, "documents", "doc_id", "text"), labels, fold_of("doc_id", 4) != 2)
    return quality.keep(docs, machine)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, at least half of their words in it."""
    model = langid.fit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), fold_of("doc_id", 3) != 1)
    return langid.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of five-word shingles)."""
    return simhash.dedup(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of their sources takes them."""
    return mixing.mixed_documents(docs, F.array("source"), weights=(5, 2, 1), most_copies=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and a digest of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.bpe_round_trip(docs.select("doc_id", "source", "lang", "text"), path)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return coded.select("doc_id", "source", "lang", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), decoded)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained models, fingerprints and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
