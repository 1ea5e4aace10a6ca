"""Tables behind the report: share vectors, first uses, formatted medians, swarm positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .acquisition import frequent_schematic, min_rank


def verb_series(order: DataFrame, curves: DataFrame) -> DataFrame:
    """The most used verbs of each schematic construction, each with its cumulative shares by age."""
    shares = curves.groupBy("vac", "verb").agg(F.transform(F.array_sort(F.collect_list(F.struct("age_months", "cumulative_share"))), lambda s: F.round(s["cumulative_share"], 4)).alias("shares"))
    top = frequent_schematic(order).select("vac", "verb", "n_tokens", "n_children", finite("median_first_age", 2).alias("median_first_age"), "aoa_rank")
    return top.join(shares, ["vac", "verb"], "left")


def first_production(summary: DataFrame, times: DataFrame) -> DataFrame:
    """Each verb's median with a place for those without one, and its first-use ages as (age, times)."""
    ages = times.where("event = 1").groupBy("vac", "verb", F.round("time", 2).alias("age")).agg(F.count("*").alias("n"))
    ages = ages.groupBy("vac", "verb").agg(F.array_sort(F.collect_list(F.struct("age", "n"))).alias("ages"))
    return summary.withColumn("place", min_rank("km_median", "vac", nulls_last=True)).join(ages, ["vac", "verb"], "left")


def km_table(summary: DataFrame, order: DataFrame) -> DataFrame:
    """Medians with intervals as text: ``a–b``, an open end, or none; verbs with their counts of tokens."""
    one = lambda n: F.when(F.col(n).isNotNull(), F.format_string("%.1f", n))
    interval = F.when(F.col("km_ci_low").isNull(), "—").when(F.col("km_ci_high").isNull(), F.concat(F.lit("≥ "), one("km_ci_low"))).otherwise(F.concat(one("km_ci_low"), F.lit("–"), one("km_ci_high")))
    tokens = order.select("vac", "verb", "n_tokens")
    return summary.join(tokens, ["vac", "verb"]).select("vac", "verb", F.format_number("n_tokens", 0).alias("tokens"), F.coalesce(one("km_median"), F.lit("not reached")).alias("median"), interval.alias("interval"), "n_event", "n_risk")


def swarm(times: DataFrame, step: float = 1.0) -> DataFrame:
    """Points of equal rounded age side by side around the middle."""
    bin_ = F.round(F.col("time") / step) * step
    w = Window.partitionBy("vac", "verb", "bin")
    x = times.where("event = 1").withColumn("bin", bin_)
    return x.select("vac", "verb", "time", "bin", (F.row_number().over(w.orderBy("time", "child_id")) - (F.count("*").over(w) + 1) / 2).alias("offset"))


def extremes(exposure: DataFrame) -> DataFrame:
    """The age bins with most and least tokens, of equal ones the first, and all tokens."""
    most, least = F.struct("exposure_tokens", -F.col("age_months")), F.struct("exposure_tokens", "age_months")
    return exposure.agg(F.max_by("age_months", most).alias("most_at"), F.min_by("age_months", least).alias("least_at"), F.sum("exposure_tokens").alias("tokens"))


def source_histogram(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(F.coalesce("parse_source", F.lit("unparsed")).alias("parse_source")).agg(F.count("*").alias("n_tokens"))
