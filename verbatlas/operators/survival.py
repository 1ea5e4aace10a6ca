"""Age of acquisition with delayed entry and censoring: Kaplan-Meier over windows, bootstrap in grouped maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .acquisition import min_rank


def censored_times(first: DataFrame, spans: DataFrame, items: DataFrame) -> DataFrame:
    """A row per child and item: an event at first use, else censored at the last observation.

    A first use in the first session is left-censored and counts at entry. The grid of items and
    children is the product asked for; items are a short list, so it is dealt by child.
    """
    catalog = items.select(*[k for k in ("vac", "verb", "item", "construction", "grain") if k in items.columns]).distinct()
    children = spans.where("last_obs is not null").groupBy("child_id").agg(F.first("first_obs").alias("first_obs"), F.first("last_obs").alias("last_obs"))
    events = first.groupBy("child_id", "item").agg(F.min("first_age").alias("first_age"))
    grid = children.crossJoin(F.broadcast(catalog))
    x = grid.join(events, [grid["child_id"].eqNullSafe(events["child_id"]), grid["item"] == events["item"]], "left").select(grid["*"], "first_age")
    used = F.col("first_age").isNotNull()
    x = x.withColumns({"entry": F.coalesce("first_obs", F.lit(0.0)), "event": used.cast("int"), "time": F.when(used, F.col("first_age")).otherwise(F.col("last_obs"))})
    left = used & (F.col("time") <= F.col("entry"))
    x = x.withColumns({"left_censored": left.cast("int"), "time": F.when(left, F.col("entry")).otherwise(F.col("time"))})
    return x.where("time >= entry")


def km_curve(times: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, t, deaths, n_risk, survival`` at the event times of each group, down to where survival is zero.

    Who is at risk at t entered by t and was not gone before: as nobody goes before entering, that
    is a running count of entries less one of exits, over times counted before they are ordered.
    """
    ok = times.where("time is not null and entry is not null and time >= entry")
    out = ok.groupBy(*keys, F.col("time").alias("t")).agg(F.sum("event").alias("deaths"), F.count("*").alias("gone"), F.lit(0).cast("long").alias("came"))
    into = ok.groupBy(*keys, F.col("entry").alias("t")).agg(F.lit(0).cast("long").alias("deaths"), F.lit(0).cast("long").alias("gone"), F.count("*").alias("came"))
    x = out.union(into).groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in ("deaths", "gone", "came")])
    w = Window.partitionBy(*keys).orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("n_risk", F.sum("came").over(upto) - F.coalesce(F.sum("gone").over(before), F.lit(0))).where("deaths > 0 and n_risk > 0")
    x = x.withColumn("_f", 1 - F.col("deaths") / F.col("n_risk"))
    x = x.withColumns({"survival": F.product("_f").over(upto), "_over": F.coalesce(F.min("_f").over(before), F.lit(1.0))})
    return x.where("_over > 0").select(*keys, "t", "deaths", "n_risk", "survival")


def km_median(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The first time with survival of a half or less (null if none), and survival at the end."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("km_median"), F.min("survival").alias("km_s_end"))


def median_interval(times: DataFrame, keys: list[str], n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Bootstrap interval of the median of each group; rows are sorted before they are drawn, so runs agree."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["entry", "time", "event"], kind="stable")
        low, high = stats.survival_median_ci(f["time"].to_numpy(), f["event"].to_numpy(), f["entry"].to_numpy(), n_boot, seed)
        return pd.DataFrame([(*f[keys].iloc[0], low, high)])

    kinds = dict(times.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "km_ci_low double, km_ci_high double"
    return times.select(*keys, "entry", "time", "event").groupBy(*keys).applyInPandas(run, schema)


def aoa_summary(times: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Counts, naive and Kaplan-Meier medians with interval per item, ranked within the construction."""
    keys = ["vac", "verb", "item"]
    counts = times.groupBy(*keys).agg(
        F.count("*").alias("n_risk"), F.sum("event").alias("n_event"), F.count_if(F.col("event") == 0).alias("n_censored"),
        F.sum("left_censored").alias("n_left_censored"), F.median(F.when(F.col("event") == 1, F.col("time"))).alias("naive_median"))
    nan = lambda n: F.when(~F.isnan(n), F.col(n)).alias(n)
    x = counts.join(km_median(km_curve(times, keys), keys), keys, "left").join(median_interval(times, keys, n_boot, seed).select(*keys, nan("km_ci_low"), nan("km_ci_high")), keys, "left")
    x = x.withColumns({"km_s_end": F.coalesce("km_s_end", F.lit(1.0)), "median_reached": F.col("km_median").isNotNull()})
    return x.withColumn("aoa_rank", min_rank("km_median", "vac"))
