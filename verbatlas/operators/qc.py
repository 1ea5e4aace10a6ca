"""Quality control: lead verbs against expectation, and a sample for checking by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import columns as c
from ..schemas import with_defaults


def expected_leads(spark: SparkSession) -> DataFrame:
    rows = [(k, k, None, None, v) for k, vs in lx.LEADS.items() for v in vs]
    for k, vs in lx.PREP_LEADS.items():
        vac, _, side = k.partition("_")
        cons, _, prep = vac.partition("-")
        rows += [(k, cons, prep, {"parents": "Parent", "children": "Child"}.get(side), v) for v in vs]
    return spark.createDataFrame(rows, "key string, construction string, preposition string, side string, expected string")


def qualitative_leads(occ: DataFrame, stratum: str | None = None, k: int = 3) -> DataFrame:
    """``key, recovered, missing``: the k most frequent verbs, and the expected ones not among them."""
    want = expected_leads(occ.sparkSession)
    x = occ.where(F.col("stratum") == stratum) if stratum else occ
    keys = F.broadcast(want.select("key", "construction", "preposition", "side").distinct().withColumnsRenamed({"construction": "_c", "preposition": "_p"}))
    fits = (F.col("construction") == F.col("_c")) & (F.col("_p").isNull() | (F.col("preposition") == F.col("_p"))) & (F.col("side").isNull() | F.col("stratum").startswith(F.col("side")))
    x = x.join(keys, fits).groupBy("key", F.lower("verb").alias("verb")).agg(F.sum("vac_freq").alias("n"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), "verb"))).where(F.col("r") <= k)
    top = x.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "verb"))), lambda s: s["verb"]).alias("recovered"))
    goal = want.groupBy("key").agg(F.array_sort(F.collect_list("expected")).alias("expected"))
    got = F.coalesce("recovered", F.array().cast("array<string>"))
    return goal.join(top, "key", "left").select("key", got.alias("recovered"), F.array_except("expected", got).alias("missing"))


def handcheck_sample(hits: DataFrame, n_per: int = 50, seed: int = 0) -> DataFrame:
    """Up to n hits of each construction of parents and of children, in the order of a digest of seed and hit."""
    x = with_defaults(hits, extra="boolean", preposition="string").where(c.is_schematic("construction", "extra"))
    x = x.withColumn("side", F.when(c.is_child("speaker_role"), "child").when(c.is_parent("speaker_role"), "parent").otherwise("other")).where("side <> 'other'")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("utterance_id").cast("string"), "verb", "construction", F.coalesce("preposition", F.lit(""))))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("construction", "side").orderBy(key, "utterance_id"))).where(F.col("_n") <= n_per)
    return x.drop("_n").withColumns({"form_ok": F.lit(None).cast("boolean"), "function_ok": F.lit(None).cast("boolean")})
