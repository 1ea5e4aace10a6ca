"""Ages and order of acquisition: first uses, input order, exposure and cumulative curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import columns as c
from ..schemas import with_defaults


def min_rank(value, *by: str, descending: bool = False, nulls_last: bool = False):
    """Rank by value within ``by``, equal values sharing the least; a null has no rank unless nulls go last."""
    v = c.col(value)
    r = F.rank().over(Window.partitionBy(*by).orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last()))
    return r if nulls_last else F.when(v.isNotNull(), r)


def grains(hits: DataFrame) -> DataFrame:
    """Each schematic hit, and for locatives with a preposition a second row at the grain of that preposition."""
    x = with_defaults(hits, extra="boolean", preposition="string").where(c.is_schematic("construction", "extra")).withColumn("verb", F.lower("verb"))
    locative = F.col("construction").isin(*lx.LOCATIVE)
    fine = F.concat("construction", F.lit("-"), F.lower("preposition"))
    row = lambda vac, grain, prep: F.struct(vac.alias("vac"), F.lit(grain).alias("grain"), F.concat(vac, F.lit("|"), "verb").alias("item"), prep.cast("string").alias("prep"))
    coarse = row(F.col("construction"), "schematic", F.when(~locative, F.col("preposition")))
    x = x.withColumn("g", F.explode(F.array_compact(F.array(coarse, F.when(locative & c.has_preposition("preposition"), row(fine, "prep", F.col("preposition")))))))
    return x.withColumns({"vac": F.col("g.vac"), "grain": F.col("g.grain"), "item": F.col("g.item"), "preposition": F.col("g.prep")}).drop("g")


def child_hits(hits: DataFrame) -> DataFrame:
    return grains(hits).where(c.is_child("speaker_role") & F.col("target_child_age").isNotNull())


def child_key(df: DataFrame) -> str:
    return "target_child_id" if "target_child_id" in df.columns else "target_child_name"


KEYS = ["vac", "verb", "item", "construction", "preposition", "grain"]


def first_ages(hits: DataFrame) -> DataFrame:
    """First age and number of uses of each item by each child."""
    return child_hits(hits).groupBy(F.col(child_key(hits)).alias("child_id"), *KEYS).agg(F.min("target_child_age").alias("first_age"), F.count("*").alias("n"))


def acquisition_order(first: DataFrame, min_children: int | None = None) -> DataFrame:
    """Median first age of each item, ranked within its construction.

    Items need enough children; a construction in which none has enough keeps its eight most used.
    """
    keys = [k for k in KEYS if k in first.columns]
    x = first.groupBy(*keys).agg(
        F.countDistinct("child_id").alias("n_children"), F.sum("n").alias("n_tokens"), F.median("first_age").alias("median_first_age"),
        F.avg("first_age").alias("mean_first_age"), F.min("first_age").alias("pooled_first_age"))
    enough = F.col("n_children") >= c.min_children("vac", min_children)
    by_use = F.row_number().over(Window.partitionBy("vac").orderBy(F.col("n_tokens").desc(), "item"))
    x = x.where("vac is not null").withColumns({"_any": F.max(enough).over(Window.partitionBy("vac")), "_use": by_use})
    x = x.where(F.when(F.col("_any"), enough).otherwise(F.col("_use") <= lx.TOP_ITEMS)).drop("_any", "_use")
    return x.withColumn("aoa_rank", min_rank("median_first_age", "vac"))


def adult_frame_share(hits: DataFrame, min_tokens: int = lx.MIN_TOKENS) -> DataFrame:
    """What share of a verb's schematic uses by others than children each construction has."""
    x = with_defaults(hits, extra="boolean").where(c.is_schematic("construction", "extra"))
    x = x.where(~c.is_child("speaker_role")) if "speaker_role" in hits.columns else x
    x = x.groupBy(F.lower("verb").alias("verb"), "construction").agg(F.count("*").alias("n_frame"))
    x = x.withColumn("n_verb", F.sum("n_frame").over(Window.partitionBy("verb")))
    return x.where(F.col("n_verb") >= min_tokens).withColumn("share", F.col("n_frame") / F.col("n_verb"))


def parent_order(hits: DataFrame, min_tokens: int = lx.MIN_TOKENS) -> DataFrame:
    """Items of the parents' speech, ranked by how often they are used."""
    x = grains(hits).where(c.is_parent("speaker_role")).groupBy(*KEYS).agg(F.count("*").alias("n_tokens"), F.median("target_child_age").alias("median_age"))
    return x.where(F.col("n_tokens") >= min_tokens).withColumn("input_rank", min_rank("n_tokens", "vac", descending=True))


def token_exposure(tokens: DataFrame, width: float = lx.BIN_MONTHS) -> DataFrame:
    """All child tokens per age bin."""
    x = tokens.where(c.is_child("speaker_role")) if "speaker_role" in tokens.columns else tokens
    return x.where("target_child_age is not null").groupBy(c.age_bin("target_child_age", width).alias("age_months")).agg(F.count("*").alias("exposure_tokens"))


def curve_items(kids: DataFrame, order: DataFrame | None, top_n: int) -> DataFrame:
    """Items to draw: the earliest of each construction, or the most frequent where a schematic one has none."""
    frequent = kids.where(F.col("vac").isin(*lx.SCHEMATIC)).groupBy("vac", "item").agg(F.count("*").alias("n"))
    frequent = frequent.withColumn("_n", F.row_number().over(Window.partitionBy("vac").orderBy(F.col("n").desc(), "item"))).where(F.col("_n") <= top_n)
    if order is None:
        return frequent.select("item")
    early = order.withColumn("_n", F.row_number().over(Window.partitionBy("vac").orderBy(F.col("aoa_rank").asc_nulls_last(), "item"))).where(F.col("_n") <= top_n)
    return early.select("item").union(frequent.join(early.select("vac").distinct(), "vac", "left_anti").select("item")).distinct()


def age_curves(hits: DataFrame, width: float = lx.BIN_MONTHS, top_n: int = lx.TOP_ITEMS, order: DataFrame | None = None, exposure: DataFrame | None = None) -> DataFrame:
    """Cumulative share of an item's tokens by age bin, empty bins included.

    With ``exposure`` a bin's tokens are taken per token of the children's speech at that age.
    """
    kids = child_hits(hits)
    kids = kids.join(curve_items(kids, order, top_n), "item", "left_semi")
    return cumulative_curves(kids.groupBy("vac", "verb", "item", "grain", c.age_bin("target_child_age", width).alias("age_months")).agg(F.count("*").alias("bin_tokens")), width, exposure)


def cumulative_curves(counts: DataFrame, width: float = lx.BIN_MONTHS, exposure: DataFrame | None = None) -> DataFrame:
    keys = ["vac", "verb", "item", "grain"]
    grid = counts.select(*keys).distinct().withColumn("age_months", F.explode(F.array(*[F.lit(b) for b in c.bins(width)])))
    left = grid.alias("g").join(counts.alias("n"), [F.col(f"g.{k}").eqNullSafe(F.col(f"n.{k}")) for k in (*keys, "age_months")], "left")
    x = left.select(*[F.col(f"g.{k}").alias(k) for k in (*keys, "age_months")], F.coalesce("n.bin_tokens", F.lit(0)).alias("bin_tokens"))
    if exposure is None:
        x = x.withColumn("bin_weight", F.col("bin_tokens").cast("double"))
    else:
        x = x.join(exposure.select("age_months", "exposure_tokens"), "age_months", "left")
        x = x.withColumns({"exposure_tokens": F.coalesce("exposure_tokens", F.lit(0)), "bin_weight": F.coalesce(F.try_divide(F.col("bin_tokens").cast("double"), F.col("exposure_tokens").cast("double")), F.lit(0.0))})
    w = Window.partitionBy(*keys)
    total = F.sum("bin_weight").over(w)
    running = F.sum("bin_weight").over(w.orderBy("age_months").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumns({"n_tokens": F.sum("bin_tokens").over(w), "cumulative_share": running / F.when(total == 0, F.lit(1.0)).otherwise(total)})


def schematic_curves(hits: DataFrame, items: DataFrame, exposure: DataFrame | None = None) -> DataFrame:
    """Curves of given schematic ``items(vac, verb)`` over three-month bins, whatever is marked extra."""
    kids = hits.where(c.is_child("speaker_role") & F.col("target_child_age").isNotNull()).withColumn("verb", F.lower("verb"))
    kids = kids.join(items.select(F.col("vac").alias("construction"), F.lower("verb").alias("verb")).distinct(), ["construction", "verb"], "left_semi")
    item = F.concat("construction", F.lit("|"), "verb")
    counts = kids.groupBy(F.col("construction").alias("vac"), "verb", item.alias("item"), F.lit("schematic").alias("grain"), c.age_bin("target_child_age").alias("age_months"))
    return cumulative_curves(counts.agg(F.count("*").alias("bin_tokens")), exposure=exposure)


def frequent_schematic(order: DataFrame, top_n: int = lx.TOP_ITEMS) -> DataFrame:
    """The most used schematic items of each construction, ranked anew by median first age."""
    x = order.where((F.col("grain") == "schematic") & F.col("vac").isin(*lx.SCHEMATIC))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("vac").orderBy(F.col("n_tokens").desc(), "item"))).where(F.col("_n") <= top_n).drop("_n")
    return x.withColumn("aoa_rank", min_rank("median_first_age", "vac"))


def earliest_schematic(order: DataFrame, top_n: int = lx.TOP_ITEMS) -> DataFrame:
    x = order.where(F.col("vac").isin(*lx.SCHEMATIC)).withColumn("_n", F.row_number().over(Window.partitionBy("vac").orderBy(F.col("aoa_rank").asc_nulls_last(), "item")))
    return x.where(F.col("_n") <= top_n).select("vac", "verb", "item").distinct()


def observation_spans(tokens: DataFrame) -> DataFrame:
    """First and last age at which each child speaks, and a name if there is one."""
    x = tokens.where(c.is_child("speaker_role") & F.col("target_child_age").isNotNull())
    name = [F.coalesce(F.first("target_child_name", ignorenulls=True), F.lit("")).alias("child_name")] if "target_child_name" in tokens.columns else []
    return x.groupBy(F.col(child_key(tokens)).alias("child_id")).agg(F.min("target_child_age").alias("first_obs"), F.max("target_child_age").alias("last_obs"), *name)


def merged_spans(spans: DataFrame) -> DataFrame:
    return spans.groupBy("child_id").agg(F.min("first_obs").alias("first_obs"), F.max("last_obs").alias("last_obs"), *([F.first("child_name", ignorenulls=True).alias("child_name")] if "child_name" in spans.columns else []))


def model_curves(ranking: DataFrame, pooled: bool = True) -> DataFrame:
    """Mean score per epoch and verb, at the schematic grain (prepositions ``pooled``, or each apart) and per preposition."""
    x = ranking.withColumn("verb", F.lower("verb"))
    vac = c.construction_key("construction", F.lower("preposition"))
    coarse = x.withColumns({"vac": F.col("construction"), "grain": F.lit("schematic"), "preposition": F.when(~F.col("construction").isin(*lx.LOCATIVE), F.col("preposition")) if pooled else F.col("preposition")})
    fine = x.withColumns({"vac": vac, "grain": F.lit("prep")}).where("vac <> construction")
    both = coarse.unionByName(fine).withColumn("item", F.concat("vac", F.lit("|"), "verb"))
    return both.groupBy("track", "epoch", "vac", "verb", "item", "kind", "construction", "preposition", "grain").agg(F.avg("score").alias("score"))


def model_order(curves: DataFrame) -> DataFrame:
    """The first epoch in which a verb that belongs scores over the mean of those that do not, ranked per construction."""
    others = curves.where("kind = 'distractor'").groupBy("track", "vac", "epoch").agg(F.avg("score").alias("distractor_mean"))
    x = curves.where("kind = 'occupant'").join(others, ["track", "vac", "epoch"], "left")
    last = lambda n, at=None: F.max_by(n, "epoch").alias(at or n)
    x = x.groupBy("track", "vac", "verb").agg(
        last("item"), last("grain"), last("construction"), last("preposition"), F.min(F.when(F.col("score") > F.col("distractor_mean"), F.col("epoch"))).alias("acquire_epoch"),
        last("score", "final_score"), last("distractor_mean", "final_distractor_mean"))
    return x.withColumn("epoch_rank", min_rank("acquire_epoch", "track", "vac"))
