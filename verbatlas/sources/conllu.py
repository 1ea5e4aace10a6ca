"""CoNLL-U files as token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse(texts: DataFrame, prefix: str = "ud") -> DataFrame:
    """Tokens of ``texts(path, text)``, a row per file; sentences are numbered through a file and tokens by their place in it.

    Blank lines end sentences; comments, multiword ranges and empty nodes are passed over; features
    and heads that are ``_`` become empty and 0. With several files the file's number comes into the
    utterance id, so ids stay unique.
    """
    files = texts.select("path").distinct().withColumn("f", F.row_number().over(Window.orderBy("path"))).withColumn("several", F.count("*").over(Window.partitionBy()) > 1)
    lines = texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    in_file = Window.partitionBy("path").orderBy("n")
    p = F.split("line", "\t")
    word = (F.col("line") != "") & ~F.col("line").startswith("#") & ~F.get(p, F.lit(0)).rlike("[-.]")
    x = lines.withColumn("gap", F.sum((F.col("line") == "").cast("int")).over(in_file)).where(word)
    x = x.withColumns({"sentence": F.dense_rank().over(Window.partitionBy("path").orderBy("gap")), "k": F.row_number().over(in_file)}).join(F.broadcast(files), "path")
    at = lambda k: F.get(p, F.lit(k))
    name = F.when(F.col("several"), F.format_string(f"{prefix}-%d-%d", "f", "sentence")).otherwise(F.format_string(f"{prefix}-%d", "sentence"))
    return x.select(
        F.col("k").cast("long").alias("id"), at(0).cast("long").alias("token_order"), at(1).alias("gloss"), at(2).alias("stem"), at(3).alias("part_of_speech"),
        F.when(at(5) != "_", at(5)).otherwise("").alias("suffix"), at(0).cast("long").alias("gra_index"), F.when(at(6) != "_", at(6).try_cast("long")).otherwise(F.lit(0)).alias("gra_head"),
        at(7).alias("gra_relation"), F.lit("ud_english_childes").alias("parse_source"), F.lit("Target_Child").alias("speaker_role"), F.lit("declarative").alias("utterance_type"), name.alias("utterance_id"))


def read(spark: SparkSession, path: str, prefix: str = "ud") -> DataFrame:
    """CoNLL-U files, each read whole by one task: a treebank's files are small, and their order numbers the sentences."""
    return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")), prefix)
