"""Documents and tool outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files below a folder as (`path`, `text`); paths are relative to the folder."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index(F.col("_metadata.file_path"), f"/{name}/", -1)
    return files.select(F.url_decode(inside).alias("path"), F.col("value").alias("text"))


def join_blocks(blocks: Column) -> Column:
    """One text from the text blocks of a tool output; null and empty blocks are left out."""
    return F.array_join(F.filter(blocks, lambda b: F.coalesce(b != "", F.lit(False))), "")
