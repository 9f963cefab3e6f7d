"""The registered queries of the corpus operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import language_id, mixing, quality_rules, sentencepiece, toxicity
from gatehouse.llm.centroid_clustering import clusters
from gatehouse.llm.chat_format import calls_of_turns, linked_messages
from gatehouse.llm.embedding_dedup import near_duplicates
from gatehouse.llm.filter_audit import filter_audit
from gatehouse.llm.jaccard_join import similar_classes, similar_links
from gatehouse.llm.oracles import ORACLES as ORACLES
from gatehouse.llm.sharding import shuffled_shards
from gatehouse.llm.suffix_dedup import remove_repeats
from gatehouse.llm.tables import bounded_batches, finished
from gatehouse.llm.url_filters import url_verdicts

#: Weights of the domains in the mixed corpus.
TARGETS = {"clean": 0.9, "low_quality": 0.08, "toxic": 0.02}
#: The vocabulary that is installed with the public tokenizers.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Whether a document is held out from learning languages."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~held_out()))
    judged = language_id.language_of(spark, F.col("text"), model)
    return docs.select("doc_id", held_out().alias("held_out"), judged.alias("p")).select("doc_id", "held_out", "p.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = mixing.learn(docs, labels)
    members = finished(
        docs.select("doc_id", mixing.membership_of(spark, F.col("text"), model).alias("m")).select("doc_id", "m.*"), "members"
    )
    steps = mixing.fit_rates(members, [TARGETS[n] for n in model.names])
    rated = members.withColumn("rate", mixing.rates_column(F.col("posterior"), steps))
    shares = [F.element_at("posterior", k + 1).alias(f"p_{n}") for k, n in enumerate(model.names)]
    return rated.select("doc_id", "tokens", *shares, "rate", mixing.copies_of(F.col("rate"), "doc_id").alias("copies"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled_shards(_table(spark, sf_dir, "documents"), shards=24).drop("row")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 with the number of links of each row."""
    return similar_links(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), depth=50)
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    chain = toxicity.learn(docs, labels)
    scores = docs.select("doc_id", toxicity.toxicity_of(spark, F.col("text"), chain).alias("p"))
    named = [F.col(f"p.{n}").alias(f"p_{n}") for n in chain.names]
    return scores.select("doc_id", *named, (F.col("p.toxic") >= 0.5).alias("toxic"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = sentencepiece.load(VOCABULARY)
    coded = docs.select("doc_id", "text", sentencepiece.encoded(spark, F.col("text"), model).alias("ids"))
    same = sentencepiece.decoded(spark, F.col("ids"), model).eqNullSafe(F.col("text"))
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", same.alias("restored"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    kept = quality_rules.passes(quality_rules.BASE)
    return rows.withColumns({"base_failed": ~kept, "kept": kept & quality_rules.passes(quality_rules.CURRENT)})


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked_messages(*calls_of_turns(_table(spark, sf_dir, "conversations")))
    return rows.withColumn("problems", F.array_join("problems", ","))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(_table(spark, sf_dir, "embeddings"), count=16, rounds=3, dims=64)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "ngram_jaccard_links": ngram_jaccard_links,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filters": op13_url_filters,
}
