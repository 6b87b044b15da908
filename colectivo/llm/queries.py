"""Queries of the corpus operators over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, manifest, minhash, mixing, periodic, pieces, substrings, token_counts, topk, toxicity, vectors


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), budget=None)  # the form its SQL states
    return out.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("keep_probability", 6).alias("keep_probability"), "kept"
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxicity.label_columns(_table(spark, sf_dir, "labels")))
    out = toxicity.predict(docs, chain)
    return out.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"), keep_text=False)
    digest = F.sha2(F.array_join("piece_ids", ","), 256)
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), "round_trip")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = language_id.learn(docs.where(~language_id.held_out()), "doc_id", "text", "lang")
    return language_id.identify(docs.withColumn("key", F.struct("doc_id", language_id.held_out().alias("held_out"))), samples, "key").select(
        "key.doc_id", "key.held_out", "lang_pred", "score"
    )


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether its copy without line feeds (one document in two) still leads to the root."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    sent = F.when(hit, manifest.leaf_of(*(F.col(f) for f in fields[:-1]), F.replace("text", F.lit("\n"), F.lit(""))))
    made = manifest.manifest(_table(spark, sf_dir, "documents"), fields, carry={"sent": sent})
    root = manifest.folded(F.coalesce("sent", "leaf"), F.col("proof"))
    return made.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"), root.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; those of one document in ten are made periodic first, as the contract asks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    looped = """
      element_at(transform(array(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w ->
        if(size(w) = 0, text, element_at(transform(array(struct(int(g % size(w)) as a)), at ->
          element_at(transform(array(struct(at.a as a, int(1 + (size(w) - at.a) div (3 + g % 8)) as p)), m ->
            array_join(concat(slice(w, 1, m.a), transform(sequence(0, size(w) - m.a - 1), i -> w[m.a + i % m.p])), ' ')), 1)), 1))), 1)"""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.withColumn("h", h).withColumn("g", F.expr("h div 10")).withColumn("text", F.when(F.col("h") % 10 == 0, F.expr(looped)).otherwise(F.col("text")))
    out = periodic.collapse_runs(planted.select("doc_id", "text")).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = "reduce(runs, cast(null as struct<start: long, length: long, period: long>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return out.withColumn("best", F.expr(best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_nearest": op3_nearest,
    "op4_near_vectors": op4_near_vectors,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_substrings": op7_substrings,
    "op8_token_counts": op8_token_counts,
    "op9_pieces": op9_pieces,
    "op10_language_id": op10_language_id,
    "op11_topk": op11_topk,
    "op12_manifest": op12_manifest,
    "op13_runs": op13_runs,
}
ORACLE: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op2_mixing": mixing.SQL, "op4_near_vectors": vectors.SQL_NEAR, "op5_minhash": minhash.SQL, "op7_substrings": substrings.SQL, "op11_topk": topk.SQL, "op12_manifest": manifest.SQL}
