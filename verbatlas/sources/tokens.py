"""Token scans: pushed-down filters, unit fallbacks, partitions by corpus, diagnostics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import columns as c
from ..operators.fill import annotate_existing_parses

ROLES = tuple(sorted(lx.CHILD_ROLES + lx.PARENT_ROLES))
COLUMNS = (
    "id", "utterance_id", "transcript_id", "token_order", "gloss", "part_of_speech", "stem", "suffix", "clitic", "gra_index", "gra_head",
    "gra_relation", "collection_name", "corpus_name", "speaker_role", "utterance_type", "target_child_age", "target_child_id", "target_child_name",
)


def try_read(spark: SparkSession, path: str, status: str | None = None) -> DataFrame | None:
    """A table, or None and the reason in ``status`` if it cannot be read."""
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if status:
            with open(status, "w", encoding="utf-8") as f:
                f.write(str(e))
        return None


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, CSV (with a header), JSON lines, or a table of the catalog, by the name's ending; ``options`` may pin a version."""
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    if path.endswith((".csv", ".csv.gz")):
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    if "/" in path or path.endswith(".parquet"):
        return reader.parquet(path)
    return reader.table(path)


def load_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def age_filter(age, unit: str):
    scale = {"days": lx.DAYS_PER_MONTH, "months": 1.0}
    return F.lit(True) if unit == "none" else (age >= lx.AGE_MIN * scale[unit]) & (age < lx.AGE_MAX * scale[unit])


def scan(tokens: DataFrame, transcripts: DataFrame, corpora: Sequence[str] | None = None, roles: Sequence[str] | None = None, unit: str = "days") -> DataFrame:
    """Tokens of the English collections with their transcript's file; all filters stand before the join and reach the scan."""
    t = tokens.where(F.col("collection_name").isin(*lx.ENGLISH_COLLECTIONS) & F.col("speaker_role").isin(*(roles or ROLES)) & age_filter(F.col("target_child_age"), unit))
    t = t.where(F.col("corpus_name").isin(*corpora)) if corpora else t
    tr = transcripts.select(F.col("id").alias("_transcript"), "filename")
    return t.join(tr, t["transcript_id"] == tr["_transcript"], "left").select(*COLUMNS, "filename")


def annotate(tokens: DataFrame) -> DataFrame:
    """Study membership, ages in months (once), files left out by role, and the source of parses that are there."""
    x = tokens.withColumn("in_s7_2", c.in_study("corpus_name"))
    if "target_child_age" in x.columns and "target_child_age_days" not in x.columns:
        x = x.withColumns({"target_child_age_days": F.col("target_child_age"), "target_child_age": c.age_in_months("target_child_age")})
    if "filename" in x.columns:
        gone = (c.is_child("speaker_role") & c.excluded_file("filename", "child")) | (c.is_parent("speaker_role") & c.excluded_file("filename", "parent_all"))
        x = x.where(~gone)
    return annotate_existing_parses(x)


def load(tokens: DataFrame, transcripts: DataFrame, corpora: Sequence[str] | None = None, roles: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Annotated tokens; if the corpora named have none at ages in days, ages in months are tried, then no ages."""
    for unit in ("days", "months", "none") if corpora else ("days",):
        x = scan(tokens, transcripts, corpora, roles, unit)
        if not corpora or unit == "none" or not x.isEmpty():
            break
    x = annotate(x.limit(limit) if limit is not None else x)
    return x.where("target_child_age is null or " + f"(target_child_age >= {lx.AGE_MIN} and target_child_age < {lx.AGE_MAX})") if unit == "none" else x


def load_file(spark: SparkSession, path: str) -> DataFrame:
    return annotate(read_table(spark, path))


def corpora_written(tokens: DataFrame, path: str) -> None:
    """One dataset with a partition per corpus; only corpora in ``tokens`` are replaced."""
    tokens.repartition("corpus_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_name").parquet(path)


def corpora_read(spark: SparkSession, path: str, corpora: Sequence[str] | None = None) -> DataFrame:
    x = spark.read.parquet(path)
    return x.where(F.col("corpus_name").isin(*corpora)) if corpora else x


def missing_corpora(tokens: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Tokens of the corpora that the dataset at ``path`` does not have yet; with ``force`` all."""
    done = None if force else try_read(tokens.sparkSession, path + "/")
    return tokens if done is None else tokens.join(done.select("corpus_name").distinct(), "corpus_name", "left_anti")


def append_missing(tokens: DataFrame, path: str, force: bool = False) -> None:
    """Add the corpora that the dataset does not have yet, or with ``force`` replace them."""
    corpora_written(missing_corpora(tokens, path, force), path)


def corpora_by_size(coverage: DataFrame) -> DataFrame:
    """Corpora with their tokens, the smallest first."""
    return coverage.groupBy("corpus_name").agg(F.sum("n_tokens").alias("n_tokens")).orderBy("n_tokens", "corpus_name")


def corpora_of(tokens: DataFrame) -> DataFrame:
    """How many corpora each collection has, and their names in order."""
    return tokens.groupBy("collection_name").agg(F.countDistinct("corpus_name").alias("n_corpora"), F.array_sort(F.collect_set("corpus_name")).alias("corpora"))


def corpus_names(coverage: DataFrame) -> DataFrame:
    return coverage.select("corpus_name").distinct()


def diagnostics(tokens: DataFrame, corpora: Sequence[str]) -> DataFrame:
    """Rows, null ages, the range of ages and rows in the roles of interest of some corpora."""
    x = tokens.where(F.col("collection_name").isin(*lx.ENGLISH_COLLECTIONS) & F.col("corpus_name").isin(*corpora))
    age = F.col("target_child_age")
    return x.agg(F.count("*").alias("n"), F.count_if(age.isNull()).alias("n_null_age"), F.min(age).alias("min_age"), F.max(age).alias("max_age"), F.count_if(F.col("speaker_role").isin(*ROLES)).alias("n_cds_roles"))
