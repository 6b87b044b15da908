"""A training-data pipeline over ``documents``: each stage reads what the one before it kept.

Toxic documents go, repeated three-line passages are cut out, one document of
each group of near-duplicates stays, the rest is sampled to tempered shares of
source, language and topic, and what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colectivo.llm import line_dedup, minhash, mixing, pieces, toxicity
from colectivo.llm.queries import tokenizer
from colectivo.session import snapshot


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones among them, doesn't find toxic."""
    chain = toxicity.fit(docs, toxicity.label_columns(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.predict(docs, chain).where("NOT is_toxic").select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of three lines and more that came before; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of source, language and topic."""
    return mixing.mix(docs).where("kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    out = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model"), keep_text=False)
    return out.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]
#: Classifiers and piece encoding have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = snapshot(stage(spark, docs, sf_dir))
    return docs
