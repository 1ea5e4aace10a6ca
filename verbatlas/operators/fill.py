"""Parses: what is there, which utterances lack one, and filling those without touching the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.columns import is_nonword
from ..schemas import tagged, with_defaults

#: A parser takes a text and returns its words as (text, part of speech, index, head, relation, lemma).
Word = tuple[str, str, int, int, str, str]
Parser = Callable[[str], Sequence[Word]]


def annotate_existing_parses(tokens: DataFrame) -> DataFrame:
    """Tokens with both tags and no source named come from the database."""
    x = with_defaults(tokens, parse_source="string")
    parsed = tagged("part_of_speech") & tagged("gra_relation")
    unnamed = F.coalesce(F.trim("parse_source"), F.lit("")) == ""
    return x.withColumn("parse_source", F.when(parsed & unnamed, F.lit("childesdb")).otherwise(F.col("parse_source")))


def keep_parsed_utterances(tokens: DataFrame) -> DataFrame:
    """Utterances in which a word has both tags."""
    ok = ~is_nonword("gloss") & tagged("part_of_speech") & tagged("gra_relation")
    return tokens.withColumn("_ok", F.max(ok).over(Window.partitionBy("utterance_id"))).where(F.col("_ok") & F.col("utterance_id").isNotNull()).drop("_ok")


def utterance_state(tokens: DataFrame) -> DataFrame:
    """Each utterance as ``unparsed`` (words, none of them tagged), ``partial`` (else with a tag missing) or ``parsed``."""
    word, has = ~is_nonword("gloss"), tagged("part_of_speech")
    x = tokens.where("utterance_id is not null").groupBy("utterance_id").agg((F.max(word) & ~F.max(word & has)).alias("un"), F.min(has).alias("all"))
    return x.select("utterance_id", F.when(F.col("un"), "unparsed").when(~F.col("all"), "partial").otherwise("parsed").alias("state"))


def aligned(glosses: Sequence[str | None], words: Sequence[Word]) -> list[Word | None]:
    """Parsed words for an utterance's glosses, taken in order as long as they agree.

    Words agree if they are equal or begin with the gloss's first three letters. A punctuation word
    in the way is passed over once, for an equal word behind it. Where they disagree the gloss stays
    without a word and the next gloss meets the same word.
    """
    out: list[Word | None] = []
    k = 0
    for raw in glosses:
        g, found = (raw or "").lower().strip(), None
        if g and g not in lx.NONWORDS and not g.startswith("&") and k < len(words):
            w = words[k][0].lower().strip()
            if w.startswith(g[:3]):
                found, k = words[k], k + 1
            elif words[k][1] == "PUNCT":
                k += 1
                if k < len(words) and words[k][0].lower().strip() == g:
                    found, k = words[k], k + 1
        out.append(found)
    return out


SILVER = "silver_pos string, silver_gra_index long, silver_gra_head long, silver_gra_relation string, silver_lemma string"


def silver_tags(tokens: DataFrame, parser: Parser) -> DataFrame:
    """``utterance_id, id`` and the tags that the parser gives; utterances are parsed by the batch, a list of tokens each."""
    kind = dict(tokens.dtypes)["utterance_id"]
    utts = tokens.groupBy("utterance_id").agg(F.array_sort(F.collect_list(F.struct("token_order", "id", "gloss"))).alias("ts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for uid, ts in zip(f["utterance_id"], f["ts"], strict=True):
                glosses = [t["gloss"] for t in ts]
                words = parser(" ".join("" if g is None else g for g in glosses))
                rows += [(uid, t["id"], *((w[1], w[2], w[3], w[4], w[5]) if w else (None,) * 5)) for t, w in zip(ts, aligned(glosses, words), strict=True)]
            yield pd.DataFrame(rows, columns=["utterance_id", "id", "silver_pos", "silver_gra_index", "silver_gra_head", "silver_gra_relation", "silver_lemma"], dtype=object)

    return utts.mapInPandas(run, f"utterance_id {kind}, id long, {SILVER}")


def merge_silver(tokens: DataFrame, silver: DataFrame, source: str) -> DataFrame:
    """Silver tags where a token has none; what is tagged stays."""
    x = with_defaults(tokens, parse_source="string", stem="string", gra_index="long", gra_head="long", gra_relation="string")
    names = x.columns
    x = x.join(silver, ["utterance_id", "id"], "left")
    there = lambda n: F.coalesce(F.col(n) != "", F.lit(False))
    pos = ~tagged("part_of_speech") & there("silver_pos")
    rel = ~tagged("gra_relation") & there("silver_gra_relation")
    stem = ~tagged("stem") & there("silver_lemma")
    take = lambda when, new, old: F.when(when, F.col(new)).otherwise(F.col(old))
    return x.withColumns({
        "part_of_speech": take(pos, "silver_pos", "part_of_speech"), "gra_index": take(rel, "silver_gra_index", "gra_index"), "gra_head": take(rel, "silver_gra_head", "gra_head"),
        "gra_relation": take(rel, "silver_gra_relation", "gra_relation"), "stem": take(stem, "silver_lemma", "stem"), "parse_source": F.when(pos | rel, F.lit(source)).otherwise(F.col("parse_source")),
    }).select(*names)


def fill_unparsed(tokens: DataFrame, parser: Parser | None = None, source: str = "stanza_gloss") -> DataFrame:
    """Parse the utterances that have no tags at all; partly tagged ones are left as they are."""
    x = annotate_existing_parses(tokens)
    if parser is None:
        return x
    bare = x.join(utterance_state(x).where("state = 'unparsed'"), "utterance_id", "left_semi")
    return merge_silver(x, silver_tags(bare, parser), source)


def fill_status(tokens: DataFrame) -> DataFrame:
    return utterance_state(tokens).groupBy("state").agg(F.count("*").alias("n_utterances"))


def pos_agreement(pairs: DataFrame, gold: str, pred: str, *keys: str) -> DataFrame:
    """The share of equal tags where both are there."""
    return pairs.where(tagged(gold) & tagged(pred)).groupBy(*keys).agg(F.avg((F.col(gold) == F.col(pred)).cast("int")).alias("pos_agreement"))


def parser_agreement(tokens: DataFrame, parser: Parser, n: int = 50) -> DataFrame:
    """How the parser's tags agree with those stored, over the first n tagged utterances: on the parser's own tags, not on merged ones."""
    some = tokens.where(tagged("part_of_speech")).groupBy("utterance_id").agg(F.min("id").alias("first")).orderBy("first").limit(n)
    x = tokens.join(some, "utterance_id", "left_semi")
    x = x.join(silver_tags(x, parser), ["utterance_id", "id"])
    return pos_agreement(x, "part_of_speech", "silver_pos", "utterance_id").agg(F.count("*").alias("n"), F.avg("pos_agreement").alias("pos_agreement"))
