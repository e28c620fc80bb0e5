"""The operators of this package over their whole tables, with the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.llm import alignment, co_training, divergence, host_rules, language_model, licenses, mixing, ngram_join, pieces, projected_search, sharding, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op3_host_rules(spark, sf_dir):
    """Rules and host verdicts on every document; its source is its host."""
    out = host_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "failed_rules", "shrunk_rate")


@query(mixing.mix_sql())
def op5_poisson_mix(spark, sf_dir):
    """Documents mixed to shares that go as the square root of their sources' counts."""
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


@query()
def op8_shuffle_shards(spark, sf_dir):
    """All documents written to 16 shards of equal counts in random order, and read back."""
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_warc_index(spark, sf_dir):
    """Every page written to WARC archives and read back by the index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query()
def op10_url_rules(spark, sf_dir):
    """A verdict on every page's URL; rules are mined from the labels of documents with the pages' ids."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled = pages.join(bad, pages["page_id"] == bad["doc_id"]).select("url", "bad")
    return url_rules.judge_urls(pages, labelled)


@query()
def op4_ngram_join(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_nbest_pieces(spark, sf_dir):
    """The four best segmentations of every document's text; the best one's ids."""
    return pieces.encode(table(spark, sf_dir, "documents"), ["doc_id"], pieces.Vocabulary.load(pieces.default_path()))


@query()
def op7_kneser_ney(spark, sf_dir):
    """Every document scored by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language_model.held_out(F.col("doc_id")).alias("held_out"))
    trained = language_model.train(docs.where("NOT held_out"))
    out = language_model.score(docs, ["doc_id", "held_out"], trained)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trained[0].tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


@query()
def op2_co_training(spark, sf_dir):
    """Every document scored by two co-trained views."""
    docs = table(spark, sf_dir, "documents")
    return co_training.score(docs, ["doc_id"], co_training.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op1_projected_search(spark, sf_dir):
    """The 20 largest inner products of every twentieth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return projected_search.search(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def op13_alignment(spark, sf_dir):
    """Every document's tokens under two tokenizers, aligned; links weighed by the pairs' document counts."""
    pair = alignment.Pair.load(*alignment.default_paths())
    out = alignment.score(alignment.align(table(spark, sf_dir, "documents"), ["doc_id"], pair))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(divergence.audit_sql())
def op11_source_divergence(spark, sf_dir):
    """How far each source is from the others of its language, and the terms that set it apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(licenses.labels_sql())
def op12_license_scan(spark, sf_dir):
    """Licence labels of every document, from phrases and from blocks that hold a notice's words."""
    return licenses.labelled(licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"]))
