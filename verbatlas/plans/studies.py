"""The study's two chains of statistics, and what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import acquisition as aq
from ..operators import contingency as ct
from ..operators import probing, survival
from ..operators.extract import explode_strata, extract
from ..sources import conllu
from ..sources.sinks import write_status, write_tables


def chapter_statistics(hits: DataFrame, totals: DataFrame | None = None, tokens: DataFrame | None = None, similarity: DataFrame | None = None) -> dict[str, DataFrame]:
    """Occupancy, Zipf fits, selectivity, parent and child models, leads and types over utterance length."""
    exploded = explode_strata(hits)
    occ = ct.occupancy(exploded, totals)
    out = {"zipf": ct.zipf(occ, ["stratum", "vac", "parse_source"])}
    if totals is not None:
        out["selectivity"] = ct.selectivity(occ, totals)
    if similarity is not None:
        nodes = occ.select(F.lower("verb").alias("verb")).where("verb <> ''").distinct()
        occ = occ.join(ct.betweenness(ct.similar_verbs(similarity), nodes), "verb", "left")
    else:
        occ = occ.withColumn("betweenness", F.lit(None).cast("double"))
    out |= {"occupancy": occ, "parent_child": ct.parent_child(occ), "leads": ct.lead_verbs(occ)}
    if tokens is not None:
        out["cumulative_mlu"] = ct.cumulative_types(exploded, ct.mlu_by_utterance(tokens))
    return out


def acquisition(hits: DataFrame, ranking: DataFrame | None = None, spans: DataFrame | None = None, width: float = lx.BIN_MONTHS, n_boot: int = 1000, exposure: DataFrame | None = None) -> dict[str, DataFrame]:
    """First ages, order, curves, input order, and with spans and scores also survival and the models' order."""
    first = aq.first_ages(hits)
    order = aq.acquisition_order(first)
    out = {"child_first_ages": first, "child_order": order, "child_age_curves": aq.age_curves(hits, width, order=order, exposure=exposure), "parent_order": aq.parent_order(hits)}
    if spans is not None:
        times = survival.censored_times(first, spans, aq.earliest_schematic(order))
        out |= {"censored_times": times, "censored_aoa": survival.aoa_summary(times, n_boot)}
    if ranking is not None:
        curves = aq.model_curves(ranking)
        models = aq.model_order(curves)
        out |= {"model_curves": curves, "model_order": models, "order_correlation": probing.compare_orders(order, models)}
    return out


def treebank_hits(spark: SparkSession, path: str, extractor: str = "ud") -> DataFrame:
    """Constructions of the CoNLL-U files at ``path``."""
    return extract(conllu.read(spark, path), extractor)


def saved(tables: dict[str, DataFrame], folder: str, prefix: str) -> dict[str, int]:
    """Write tables and a status file of their counts."""
    counts = write_tables(tables, folder, prefix)
    write_status({"rows": counts}, folder, f"{prefix}_status")
    return counts
