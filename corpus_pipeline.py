"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstream.llm import langid, minhash, mixing, pii
from lagstream.llm.common import Stages, collected, read_table
from lagstream.llm.decontam import contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language, with the identified one as lang; the source is the host, lang the declared language.
    Rejected are texts without letters, those that every language explains worse than evenly drawn trigrams, and
    those whose language has a fused posterior of one half or less. Rows are told apart by 64-bit hashes."""
    profiles = langid.train(docs)
    key = F.xxhash64("doc_id", "text", "source", "lang")
    found = langid.identify(docs.select(key.alias("id"), "text", F.col("source").alias("host"), F.col("lang").alias("declared")), profiles)
    keep = F.col("accepted") & (F.col("posterior") > 0.5)
    # few rows: those rejected, and those of another language than declared
    changed = found.where(~keep | ~F.col("lang").eqNullSafe(F.col("declared"))).select(F.col("id").alias("_changed"), F.when(keep, F.col("lang")).alias("_lang")).dropDuplicates(["_changed"])
    known = docs.withColumn("_key", key).join(changed, F.col("_key") == F.col("_changed"), "left").where("_changed is null or _lang is not null")
    return known.withColumn("lang", F.coalesce("_lang", "lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each near-duplicate group at 0.8 of five-word shingles; rows of one
    id are one document, rows of null id stay."""
    gone = minhash.near_duplicates(docs, 80, 5).where("not kept").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out; a document that was nothing else goes."""
    clean = contamination(docs, read_table(spark, sf_dir, "benchmark"), clean=True, carry=("lang", "source", "n_chars"))
    hit = F.col("n_hit") > 0
    words = F.coalesce(F.col("clean_text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    n_chars = F.when(hit, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return clean.where(~hit | words).select(F.col("id").alias("doc_id"), F.col("clean_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    done = pii.pseudonymise(docs, pii.QUERY_KEY)
    return done.select("doc_id", "text", "lang", "source", F.when(F.col("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in order of position: the columns of documents with copy, words (taken of that copy) and position."""
    mixed = mixing.mix(docs, carry=("text", "lang", "source", "n_chars"))
    return mixing.training_order(mixed).select(*COLUMNS, "copy", "words", "position")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

#: Likelihoods, hashed buckets and keyed digests are not for SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Once a stage's rows are written, those of the stage before and the tables that
    its operator staged are deleted, so the shared folder holds two stages' rows at most."""
    stages = Stages(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        earlier = set(stages.live)
        with collected() as made:
            docs = stages.put(stage(spark, docs, sf_dir), name)
        for own in made:
            own.clear()
        stages.delete(earlier)
    return docs
