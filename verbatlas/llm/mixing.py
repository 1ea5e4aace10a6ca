"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, n_words, unfolded


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes(source_key, source, source_size, n)``, one row a source, with ``target``.

    Sources in code point order (null last) take ``weights`` in turn. ``share`` of all sizes is
    dealt by weight; a source stops at ``most`` times its size and what is over is dealt again.
    That fixed point is min(most * size, level * weight), its level found with prefix sums over
    the sources in the order in which they fill up.
    """
    by_name, fills = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", "source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("full_at", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    x = x.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / rest)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    return x.withColumn("target", F.least("limit", F.coalesce(level, F.lit(0.0)) * F.col("weight")))


def offset(seed: str, key: Column) -> Column:
    """One number in [0, 1) for each source, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


NEW = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    Within a source each document expects target / source_size copies. Prefix sums of that run
    over the documents ordered by size class, then by a digest of the id, so a sample keeps the
    spread of sizes; with one offset a source a document is taken once for each integer that its
    step crosses. As the step is the same for a source's documents, its prefix sum is a rank: the
    rank is made from three short windows (size classes of a source, 256 digest cells of a class,
    documents of a cell), so no window holds a source.

    A null text has size 0, and a null source is a source. Rows that repeat a doc_id are mixed as
    rows of their own. An empty table gives no rows. Columns of docs that have the names of the
    new columns are replaced.
    """
    kept = [c for c in docs.columns if c not in NEW]
    x = _mixed(folded(docs, "doc_id", "text", "source"), weights, share, most, seed)
    return x.select(*[F.col(c) if c in ("doc_id", "text", "source") else F.col("_row").getField(c).alias(c) for c in kept], *NEW)


def _mixed(x: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """``mix`` of folded rows."""
    x = x.withColumn("size", n_words(F.col("text")))
    x = x.withColumns({
        "_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
        "_class": F.floor(F.sqrt(F.col("size").cast("double"))),
        "_cell": F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), F.lit("")),
    })
    cells = x.groupBy("_key", "_class", "_cell").agg(F.count("*").alias("n"), F.sum("size").alias("sum"), F.min("source").alias("source"))
    before = (Window.unboundedPreceding, -1)
    cells = cells.withColumn("_cells_before", F.coalesce(F.sum("n").over(Window.partitionBy("_key", "_class").orderBy("_cell").rowsBetween(*before)), F.lit(0)))
    classes = cells.groupBy("_key", "_class").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("source").alias("source"))
    classes = classes.withColumn("_classes_before", F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("_class").rowsBetween(*before)), F.lit(0)))
    sizes = classes.groupBy(F.col("_key").alias("source_key")).agg(F.min("source").alias("source"), F.sum("sum").alias("source_size"))
    aims = targets(sizes, weights, share, most).select(F.col("source_key").alias("_key"), "source_size", "target")
    steps = (
        cells.join(classes.select("_key", "_class", "_classes_before"), ["_key", "_class"])
        .join(aims, "_key")
        .select("_key", "_class", "_cell", "source_size", "target", (F.col("_cells_before") + F.col("_classes_before")).alias("_before"))
    )
    rank = F.row_number().over(Window.partitionBy("_key", "_class", "_cell").orderBy("doc_id", "size"))
    x = x.withColumn("_rank", rank).join(steps, ["_key", "_class", "_cell"])
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    x = x.withColumns({"_step": step, "_at": (F.col("_before") + F.col("_rank")).cast("double"), "_u": offset(seed, F.col("_key"))})
    x = x.withColumn("copies", F.floor(F.col("_at") * F.col("_step") + F.col("_u")) - F.floor((F.col("_at") - 1) * F.col("_step") + F.col("_u")))
    return x.withColumn("taken", (F.col("size") * F.col("copies")).cast("long")).select("doc_id", "text", "source", "_row", *NEW)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken (none to ``most`` times, rounded up)."""
    x = _mixed(folded(docs, "doc_id", "text", "source"), weights, share, most, seed)
    x = x.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return unfolded(x, docs.columns, "doc_id", "text", "source")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         coalesce('s' || source, 'n') as k, coalesce(substr(md5(cast(doc_id as varchar)), 1, 2), '') as cell
  from documents),
s as (select k, min(source) as source, sum(size)::bigint as source_size from d group by k),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
             2.0::double * source_size as lim from s),
f as (select *, lim / weight as full_at from w),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(lim) over (order by full_at, k rows between unbounded preceding and 1 preceding), 0::double))
               / (sum(weight) over () - coalesce(sum(weight) over (order by full_at, k rows between unbounded preceding and 1 preceding), 0::double)) as lev from f),
t as (select k, source_size, least(lim, coalesce(max(case when lev <= full_at then lev end) over (), 0::double) * weight) as target,
             cast('0x' || substr(md5('mix' || k), 1, 8) as bigint)::double / 4294967296.0::double as u from l),
r as (select d.doc_id, d.size, t.source_size, t.target, t.u,
             case when t.source_size > 0 then t.target / t.source_size else 0::double end as step,
             row_number() over (partition by d.k order by floor(sqrt(d.size::double)), d.cell, d.doc_id, d.size)::double as pos
      from d join t using (k))
select doc_id, size::bigint as size, source_size, target,
       (size * (floor(pos * step + u) - floor((pos - 1) * step + u)))::bigint as taken
from r
"""
