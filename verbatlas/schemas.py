"""Tables by their columns, and how missing columns and missing values are made alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = """
id long, utterance_id string, transcript_id long, token_order long, gloss string, part_of_speech string, stem string,
suffix string, clitic string, gra_index long, gra_head long, gra_relation string, collection_name string,
corpus_name string, speaker_role string, utterance_type string, target_child_age double, target_child_id string,
target_child_name string, filename string
"""
#: What a hit carries on from its utterance, where the tokens have it.
META = ("corpus_name", "collection_name", "speaker_role", "stratum", "in_s7_2", "target_child_age", "target_child_id", "target_child_name", "filename", "num_tokens")
HITS = "utterance_id string, verb string, construction string, preposition string, parse_source string, extractor string, extra boolean"


def with_defaults(df: DataFrame, **kinds: str) -> DataFrame:
    """Add the columns named that df lacks, as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in df.columns})


def tagged(c: Column | str) -> Column:
    """Whether a tag is there: null, blank and the word nan all mean that it is not."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c) != "") & (F.lower(c) != "nan")


def number(c: Column | str) -> Column:
    """A double, null for what is none and for NaN, which Spark would sort above all numbers."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)
