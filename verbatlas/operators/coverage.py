"""How much of each corpus is parsed, and keeping the corpora that are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.columns import in_study


def audit(tokens: DataFrame) -> DataFrame:
    """Tokens, tagged tokens and rates per corpus of the English collections."""
    there = lambda n: F.coalesce(F.col(n) != "", F.lit(False))
    pos, gra = there("part_of_speech"), there("gra_relation")
    x = tokens.where(F.col("collection_name").isin(*lx.ENGLISH_COLLECTIONS)).groupBy("collection_name", "corpus_name")
    x = x.agg(F.count("*").alias("n_tokens"), F.count_if(pos).alias("n_pos"), F.count_if(gra).alias("n_gra"), F.count_if(pos & gra).alias("n_parsed"))
    rate = lambda n: F.col(n) / F.greatest(F.col("n_tokens"), F.lit(1))
    return x.withColumns({"pos_rate": rate("n_pos"), "gra_rate": rate("n_gra"), "parsed_rate": rate("n_parsed"), "in_s7_2": in_study("corpus_name")})


def summary(coverage: DataFrame) -> dict:
    """Counts and lists of corpora: a row per corpus, so it comes to the driver."""
    rows = coverage.orderBy("collection_name", "corpus_name").collect()
    found = {r["corpus_name"].lower() for r in rows if r["corpus_name"]}
    missing = {n.lower() for n in lx.STUDY_CORPORA} - found
    for alias, names in lx.CORPUS_ALIASES.items():
        missing -= {n.lower() for n in names} if alias.lower() in found else set()
    return {
        "n_corpora": len(rows), "n_s7_2": sum(r["in_s7_2"] for r in rows), "n_new": sum(not r["in_s7_2"] for r in rows),
        "mean_parsed_rate": sum(r["parsed_rate"] for r in rows) / len(rows) if rows else None, "missing": sorted(missing),
        "zero_parse_corpora": [r["corpus_name"] for r in rows if r["parsed_rate"] == 0],
        "parsed_rate_below_half": [(r["collection_name"], r["corpus_name"], r["parsed_rate"]) for r in rows if r["parsed_rate"] < 0.5],
    }


def drop_unparsed(frame: DataFrame, coverage: DataFrame | None, min_rate: float = 0.0) -> DataFrame:
    """Rows of corpora parsed to more than ``min_rate``; all rows where nothing was audited."""
    if coverage is None or "corpus_name" not in frame.columns:
        return frame
    return frame.join(coverage.where(F.col("parsed_rate") > min_rate).select("corpus_name"), "corpus_name", "left_semi")
