"""Frequency and contingency statistics of verbs in constructions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import columns as c
from ..functions import stats
from ..schemas import with_defaults


def verb_token_totals(tokens: DataFrame) -> DataFrame:
    """``stratum, verb, n_verb_tokens``; only a null stem gives way to the gloss here."""
    x = tokens.where(c.norm_pos("part_of_speech").isin(*lx.VERB_POS))
    x = x.select(F.explode(c.strata("speaker_role", "target_child_age")).alias("stratum"), F.lower(F.coalesce("stem", "gloss")).alias("verb"))
    return x.groupBy("stratum", "verb").agg(F.count("*").alias("n_verb_tokens"))


def occupancy(hits: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Verb frequencies per construction and source, with how much the construction attracts the verb.

    p(verb | vac) is over all sources of the construction, and p(verb | not vac) over the verbs of
    the stratum outside it. A verb without a total counts as often as it was found here. The joins
    are on small aggregates; the counts per construction are a window over them.
    """
    x = with_defaults(hits, extra="boolean", stratum="string", parse_source="string", preposition="string")
    x = x.where(~F.coalesce("extra", F.lit(False))).withColumn("vac", c.construction_key("construction", "preposition"))
    x = x.groupBy("stratum", "vac", "construction", "preposition", "verb", "parse_source").agg(F.count("*").alias("vac_freq"))
    if totals is None:
        return x.withColumns({p: F.lit(None).cast("double") for p in ("p_verb_vac", "p_verb_not_vac", "delta_p_cw")})
    x = x.withColumn("n_vac", F.when(F.col("stratum").isNotNull(), F.sum("vac_freq").over(Window.partitionBy("stratum", "vac"))))
    every = totals.groupBy("stratum").agg(F.sum("n_verb_tokens").alias("n_stratum"))
    x = x.join(totals.withColumnRenamed("n_verb_tokens", "n_verb"), ["stratum", "verb"], "left").join(every, "stratum", "left")
    x = x.withColumn("n_verb", F.coalesce("n_verb", "vac_freq"))
    inside = F.col("vac_freq") / F.greatest(F.col("n_vac"), F.lit(1))
    outside = F.greatest(F.col("n_verb") - F.col("vac_freq"), F.lit(0)) / F.greatest(F.col("n_stratum") - F.col("n_vac"), F.lit(1))
    known = F.col("n_stratum").isNotNull()
    x = x.withColumns({"p_verb_vac": F.when(F.col("n_vac").isNotNull(), inside), "p_verb_not_vac": F.when(known & F.col("n_vac").isNotNull(), outside)})
    return x.withColumn("delta_p_cw", F.col("p_verb_vac") - F.col("p_verb_not_vac"))


def zipf(freqs: DataFrame, keys: list[str], freq: str = "vac_freq") -> DataFrame:
    """Slope, fit and intercept of log frequency over log rank per group; null for fewer than two types."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(freq).desc()))
    x = freqs.where(F.col(freq) > 0).withColumns({"_x": F.log10(rank.cast("double")), "_y": F.log10(F.col(freq).cast("double"))})
    few = F.count("*") < 2
    out = lambda f: F.when(~few, f)
    return x.groupBy(*keys).agg(out(F.regr_r2("_y", "_x")).alias("r2"), out(F.regr_slope("_y", "_x")).alias("gamma"), out(F.regr_intercept("_y", "_x")).alias("intercept"), F.count("*").alias("n_types"))


def selectivity(occ: DataFrame, totals: DataFrame) -> DataFrame:
    """1 - tau squared between a verb's rank in a construction and in its stratum, absent verbs counting as zero."""
    keys = ["stratum", "vac", "parse_source"]
    own = occ.groupBy(*keys, "verb").agg(F.sum("vac_freq").alias("a"))
    groups = own.select(*keys).distinct()
    grid = groups.join(totals.select("stratum", "verb", F.col("n_verb_tokens").alias("b")), "stratum")
    own, grid = own.alias("o"), grid.alias("t")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, "verb")]
    x = own.join(grid, same, "full_outer").select(*[F.coalesce(f"o.{k}", f"t.{k}").alias(k) for k in keys], *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in ("a", "b")])

    def tau(f: pd.DataFrame) -> pd.DataFrame:
        n = len(f)
        t = stats.kendall_tau_b(f["a"].to_numpy(), f["b"].to_numpy()) if n >= 3 else np.nan
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in keys}, "tau": [t], "one_minus_tau2": [1 - t * t], "n": [n]})

    return x.groupBy(*keys).applyInPandas(tau, "stratum string, vac string, parse_source string, tau double, one_minus_tau2 double, n long")


def lead_verbs(occ: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent verbs of each construction in each stratum; equal ones by name."""
    w = Window.partitionBy("stratum", "vac").orderBy(F.col("vac_freq").desc(), "verb", "parse_source")
    return occ.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def mlu_by_utterance(tokens: DataFrame) -> DataFrame:
    """Words of an utterance: ``num_tokens`` of its first token where that column is there, else a count."""
    g = tokens.groupBy("utterance_id")
    if "num_tokens" in tokens.columns:
        return g.agg(F.min_by("num_tokens", "token_order").cast("double").alias("mlu_w"))
    return g.agg(F.count("*").cast("double").alias("mlu_w"))


def cumulative_types(hits: DataFrame, mlu: DataFrame, stratum: str = "Child I") -> DataFrame:
    """Verb types met so far in each construction, from short to long utterances.

    A type counts at its first hit in that order; ties go by utterance and verb.
    """
    x = hits.drop("mlu_w").where(F.col("stratum") == stratum).join(mlu.select("utterance_id", "mlu_w"), "utterance_id", "left").withColumn("vac", c.construction_key("construction", "preposition"))
    order = [F.col("mlu_w").asc_nulls_last(), F.col("utterance_id"), F.col("verb")]
    x = x.withColumn("_new", (F.row_number().over(Window.partitionBy("vac", "verb").orderBy(*order)) == 1).cast("int"))
    running = Window.partitionBy("vac").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.select("vac", "mlu_w", F.sum("_new").over(running).alias("n_types"))


def parent_child(occ: DataFrame) -> DataFrame:
    """Correlation of log counts of verbs in parents and children, and a model of the children's by three predictors."""
    pairs = F.array(*[F.struct(F.lit(a).alias("child_stratum"), F.lit(b).alias("parent_stratum")) for a, b in (("Child I", "Parent Young"), ("Child II", "Parent All"))])
    occ = with_defaults(occ, betweenness="double", delta_p_cw="double")
    side = lambda s: occ.withColumn("pair", F.explode(pairs)).where(F.col("stratum") == F.col(f"pair.{s}_stratum")).select("pair", "vac", "verb", F.col("vac_freq").alias(f"{s}_freq"), F.col("delta_p_cw").alias(f"{s}_dp"), F.col("betweenness").alias(f"{s}_bc"))
    x = side("parent").join(side("child"), ["pair", "vac", "verb"])
    log = lambda n, low: F.log10(F.greatest(F.col(n).cast("double"), F.lit(low)))
    x = x.select("pair.child_stratum", "pair.parent_stratum", "vac", log("parent_freq", 1.0).alias("x"), log("child_freq", 1.0).alias("y"), F.coalesce("parent_dp", F.lit(0.0)).alias("dp"), F.coalesce(F.when(F.col("parent_bc").isNotNull(), log("parent_bc", 1e-12)), F.lit(0.0)).alias("bc"))

    def model(f: pd.DataFrame) -> pd.DataFrame:
        x, y, n = f[["x", "dp", "bc"]].to_numpy(), f["y"].to_numpy(), len(f)
        r = stats.pearson(x[:, 0], y) if n >= 3 else np.nan
        coef, r2 = stats.least_squares(x, y) if n >= 4 and x.var(0).min() > 0 else (np.full(4, np.nan), np.nan)
        return pd.DataFrame([(*f[["child_stratum", "parent_stratum", "vac"]].iloc[0], n, r, stats.correlation_p(r, n), r2, *coef[1:])])

    return x.groupBy("child_stratum", "parent_stratum", "vac").applyInPandas(model, "child_stratum string, parent_stratum string, vac string, n long, pearson_r double, pearson_p double, lm_r2 double, coef_log10_parent double, coef_delta_p double, coef_log10_bc double")


def betweenness(edges: DataFrame, nodes: DataFrame | None = None, graph: str | None = None) -> DataFrame:
    """``verb, betweenness`` of a similarity graph ``edges(src, dst)``; a grouped map per ``graph`` column if there are several."""
    key = [graph] if graph else []
    every = edges.select(*key, "src", "dst")
    if nodes is not None:
        every = every.union(nodes.select(*key, F.col("verb"), F.col("verb").alias("dst")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        found = stats.betweenness(sorted({*f["src"], *f["dst"]}), list(zip(f["src"], f["dst"], strict=True)))
        return pd.DataFrame({**{k: f[k].iloc[0] for k in key}, "verb": list(found), "betweenness": list(found.values())})

    kinds = dict(edges.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in key) + f"verb {kinds['src']}, betweenness double"
    return every.groupBy(*key).applyInPandas(run, schema)


def similar_verbs(similarity: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges between verbs whose most similar pair of senses is over the threshold, from ``(verb_a, verb_b, similarity)`` per pair of senses."""
    a, b = F.lower("verb_a"), F.lower("verb_b")
    x = similarity.where(a != b).groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.max("similarity").alias("s"))
    return x.where(F.col("s") > threshold).select("src", "dst")
