"""From raw documents to token ids: five stages, each a job over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. `run` writes each result to the shared folder and reads it again, so a
lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import language_id, mixing, sentencepiece
from gatehouse.llm.jaccard_join import few, repeated_rows
from gatehouse.llm.queries import TARGETS, VOCABULARY, held_out
from gatehouse.llm.suffix_dedup import remove_repeats
from gatehouse.llm.tables import bounded_batches, finished

#: Shingles of the near-duplicate stage: words, and similarity in per cent.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Bytes from which on a passage that stands in an earlier document is taken out: 51 words and the
#: spaces between them have no fewer, so no repeated passage of over fifty words stays.
PASSAGE_BYTES = 101


def _row(docs: DataFrame, but: str = "") -> Column:
    """A whole row as one value, so that no column of a stage can clash with one of `docs`."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != but)).alias("row")


def _back(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Exactly the columns of `docs`, from the column `row`."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: a null text, or one without a letter.

    Rows are judged one by one, repeated ones alike. Columns of any name and type are carried; an
    empty table gives an empty one.
    """
    bounded_batches(spark)
    model = language_id.learn(docs.filter(~held_out()))
    found = docs.select(_row(docs), language_id.language_of(spark, F.col("text"), model).alias("found"))
    return _back(docs, found.filter(F.col("found.lang_pred") != language_id.UNDETERMINED))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar ones: the smallest by doc_id, then by hash of the text.

    Rows are told apart by doc_id and text; of rows equal in both, the first by its JSON stays. Rows without
    identifier, and those whose text is null or has no word, are similar to nothing. Columns of any name and
    type are carried; an empty table gives an empty one.
    """
    bounded_batches(spark)
    key = ["doc_id", "rid"]
    keyed = docs.select(_row(docs), "doc_id", F.xxhash64("text").alias("rid"))
    gone = repeated_rows(docs.select("doc_id", "text"), size=SHINGLE_WORDS, percent=SIMILARITY).select(*key)
    counts = keyed.filter(F.col("doc_id").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = finished(counts.select(key).join(gone, key, "left_anti"), "repeated-rows")
    # Texts are shuffled only if there are more of these keys than can be broadcast.
    single = keyed.join(few(gone.union(several)), key, "left_anti").select("row")
    if several.isEmpty():
        return _back(docs, single)
    least = keyed.join(several, key, "left_semi").groupBy(key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return _back(docs, single.union(least.select("row")))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that stand in an earlier document too; n_chars follows the text.

    A null text stays null, and one that goes as a whole becomes empty. Rows without identifier, and rows
    with the same one, cut nothing from each other. Columns of any name and type are carried; an empty
    table gives an empty one.
    """
    bounded_batches(spark)
    texts = docs.select("doc_id", "text", _row(docs, but="text"), F.col("text").isNull().alias("missing"))
    cut = remove_repeats(texts, depth=PASSAGE_BYTES, whole_characters=True)
    row, missing, kept = F.col("others.row"), F.col("others.missing"), F.col("kept").cast("string")
    length = F.when(missing, row.getField("n_chars")).otherwise(F.char_length(kept)).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.when(~missing, kept), "n_chars": length}
    return cut.select(*((new[c] if c in new else row.getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the domains to their share of the tokens, without loss of clean documents.

    The clean domain is to hold what it does at least; no other is to hold more than it does. Rows
    with a null or empty text have no tokens, and go by the posterior of an empty text. Rows that are
    equal in doc_id and text are used alike. Columns of any name and type are carried; an empty table
    gives an empty one.
    """
    bounded_batches(spark)
    model = mixing.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    members = docs.select(_row(docs), mixing.membership_of(spark, F.col("text"), model).alias("member"))
    judged = finished(members.select("member.tokens", "member.posterior"), "members")
    steps = mixing.fit_rates(judged, [TARGETS[n] for n in model.names], whole=model.names.index("clean"))
    rated = members.withColumn("rate", mixing.rates_column(F.col("member.posterior"), steps))
    used = rated.withColumn("copies", mixing.copies_of(F.col("rate"), "row.doc_id", "row.text")).filter("copies > 0")
    return _back(docs, used.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the whole text (null for a null text), and their number."""
    bounded_batches(spark)
    model = sentencepiece.load(VOCABULARY)
    return docs.select("doc_id", sentencepiece.encoded(spark, F.col("text"), model).alias("ids")).withColumn("n_pieces", F.size("ids"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Automata, classifiers and segmentation cannot be written in SQL; tests compare the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = finished(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
