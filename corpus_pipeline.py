"""From raw documents to token ids: quality rules, a quality classifier, near duplicates, mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetwatch.llm import co_training, host_rules, mixing, ngram_join, pieces
from fleetwatch.plans.cut import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source isn't blocked."""
    return host_rules.keep_good(docs).select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that two co-trained views hold to be good.

    The views learn from all documents, those too that the rules rejected: they are most of the known bad ones.
    """
    raw, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    views = co_training.fit(raw, labels)
    return co_training.score(docs, COLUMNS, views, only_kept=True).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix over sources says, dealt out at random."""
    return mixing.poisson_mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the scores of its best segmentations."""
    return pieces.encode(docs, ["doc_id"], pieces.Vocabulary.load(pieces.default_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("pieces", tokens),
]

#: Trained models and an A-star search are among the stages: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
