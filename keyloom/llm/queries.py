"""Queries of the text corpus, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import abuse, mixing, tokens
from keyloom.session import load


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(load(spark, sf_dir, "documents"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and ids per source and language, as they are spelled."""
    counted = tokens.count_tokens(load(spark, sf_dir, "documents"), keep=("doc_id", "source", "lang"))
    return counted.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")).rows()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")).shares()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = abuse.train(abuse.labelled_texts(docs, load(spark, sf_dir, "review_labels")))
    return abuse.score(docs, model, ("doc_id", "source"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score > 0").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p6_ids, p6_counts, p7_mix, p7_shares, p8_found, p8_rates)}

ORACLES: dict[str, str] = {}
