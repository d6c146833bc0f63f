"""Training-data pipeline over ``documents``: quality, near-duplicates, personal data, mixture, token ids.

Each stage takes and returns the columns of documents, the last one gives the ids of the texts that are left.
Stages are written as Parquet in between, so each starts from a table and not from its history. Null texts
count as empty; an empty table stays empty; models are learned from the labelled rows of the whole tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.llm import mixing, pieces, pii, quality, similar
from prefmine.llm.queries import domain_model, quality_ranker
from prefmine.llm.tables import documents, written

#: Shares of the tokens by domain. The clean documents stay whole, the others are taken out down to their shares.
WEIGHTS = {"clean": 0.97, "poor": 0.01, "toxic": 0.02}
MARGIN = 0.2


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ranker = quality_ranker(spark, sf_dir)
    return quality.score(docs, ranker, out="__score").filter(F.col("__score") >= ranker.threshold).drop("__score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near-duplicates."""
    return similar.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets put as their kinds."""
    found = pii.with_spans(docs, pii.learn(docs), base="__base", spans="__spans")
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("__spans")))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their rates for the target weights."""
    return mixing.resampled(docs, domain_model(spark, sf_dir), WEIGHTS, anchor="clean", margin=MARGIN)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left."""
    return pieces.with_ids(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), digests=True).drop("text")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram jaccard join", keep_one_of_each),
    ("personal data", redact),
    ("mixing to target weights", mix),
    ("sentencepiece encoding", encode),
]
#: learned models decide what is kept, which SQL can't express; the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
