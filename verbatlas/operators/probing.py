"""Probing language models: item banks, scores by injected models, and their relation to usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import stats

#: Given a model's name and architecture, how to score (sentence, verb): (mean of all tokens, mean from the verb on or of the verb).
Scorer = Callable[[str, str], tuple[float, float]]
Loader = Callable[[str, str], Scorer]


def item_bank(spark: SparkSession) -> DataFrame:
    """Every frame with each verb that belongs in its construction and each that does not."""
    frames = spark.createDataFrame(list(lx.FRAMES), "item_id string, construction string, preposition string, template string")
    verbs = [(k, v, kind) for kind, sets in (("occupant", lx.OCCUPANTS), ("distractor", lx.DISTRACTORS)) for k, vs in sets.items() for v in vs]
    x = frames.join(F.broadcast(spark.createDataFrame(verbs, "construction string, verb string, kind string")), "construction")
    return x.select("item_id", "construction", "preposition", "verb", "kind", F.replace("template", F.lit("{verb}"), F.col("verb")).alias("sentence"))


def affinity_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(lx.AFFINITY), "item_id string, construction string, verb string, grammatical string, control string")


def checkpoints(spark: SparkSession, track: str, epochs: Sequence[int] | None = None) -> DataFrame:
    architecture, pattern, n = lx.TRACKS[track]
    return spark.createDataFrame([(track, e, pattern.format(epoch=e), architecture) for e in epochs or range(1, n + 1)], "track string, epoch int, model_id string, architecture string")


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def causal_scores(logits: np.ndarray, ids: Sequence[int], prefix_length: int | None) -> tuple[float, float]:
    """Mean log-probability of each next token, and of those from the verb to the end (all, if the verb is not found)."""
    lp = log_softmax(logits[:-1])[np.arange(len(ids) - 1), np.array(ids[1:])]
    every = float(lp.mean()) if len(lp) else float("nan")
    span = lp[max(prefix_length - 1, 0) :] if prefix_length is not None else lp[:0]
    return every, float(span.mean()) if len(span) else every


def subsequence_start(ids: Sequence[int], part: Sequence[int]) -> int | None:
    """Where the tokens of a verb first stand in a sentence."""
    n = len(part)
    return next((k for k in range(len(ids) - n + 1) if list(ids[k : k + n]) == list(part)), None)


def verb_place(sentence: str, verb: str) -> int:
    return sentence.lower().find(verb.lower())


def masked_score(logits: np.ndarray, start: int, verb_ids: Sequence[int]) -> float:
    """Mean log-probability of a verb's pieces where they are masked."""
    return float(np.mean([log_softmax(logits[start + k])[v] for k, v in enumerate(verb_ids)])) if len(verb_ids) else float("nan")


def masked_scorer(encode: Callable[[str], Sequence[int]], predict: Callable[[list[int]], np.ndarray], mask: int) -> Scorer:
    """A scorer for models that fill masks: ``encode`` gives ids, ``predict`` the logits of each place of a sentence of ids.

    All pieces of the verb are masked together. A verb whose pieces are not found in the sentence is
    scored by one mask at the place of its first piece, or where the word begins if not even that is there.
    """

    def score(sentence: str, verb: str) -> tuple[float, float]:
        ids, own = list(encode(sentence)), list(encode(verb))
        start = subsequence_start(ids, own) if own else None
        if start is None:
            before = len(encode(sentence[: max(verb_place(sentence, verb), 0)]))
            own = own[:1]
            start = ids.index(own[0]) if own and own[0] in ids else min(before, len(ids) - 1)
        masked = ids[:start] + [mask] * len(own) + ids[start + len(own) :]
        found = masked_score(predict(masked), start, own)
        return found, found

    return score


def score_items(items: DataFrame, models: DataFrame, load: Loader) -> DataFrame:
    """harmony, verb span and score of every item under every model; a model's items go together, so that it is loaded once a task."""
    x = items.crossJoin(F.broadcast(models)).repartition("model_id").sortWithinPartitions("model_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str | None, Scorer | None] = (None, None)
        for f in frames:
            out = []
            for r in f.itertuples():
                if held[0] != r.model_id:
                    held = r.model_id, load(r.model_id, r.architecture)
                out.append(held[1](r.sentence, r.verb))
            f["harmony"], f["verb_span_logprob"] = [h if a == "gpt2" else s for (h, s), a in zip(out, f["architecture"], strict=True)], [s for _, s in out]
            f["score"] = f["harmony"]
            yield f

    schema = ", ".join(f"{n} {k}" for n, k in x.dtypes) + ", harmony double, verb_span_logprob double, score double"
    return x.mapInPandas(run, schema)


def score_affinity(items: DataFrame, models: DataFrame, load: Loader) -> DataFrame:
    """How much better the grammatical sentence of a pair does than its control."""
    long = items.select("item_id", "construction", "verb", F.explode(F.create_map(F.lit("g"), F.col("grammatical"), F.lit("c"), F.col("control"))).alias("side", "sentence"))
    x = score_items(long, models, load).groupBy("track", "epoch", "model_id", "item_id", "construction", "verb")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("score")))
    return x.agg(side("g").alias("grammatical_score"), side("c").alias("control_score")).withColumn("affinity", F.col("grammatical_score") - F.col("control_score"))


def spearman_groups(x: DataFrame, keys: list[str], a: str, b: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Rank correlation with bootstrap interval of each group; rows are sorted before they are drawn."""
    kinds = dict(x.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([a, b], kind="stable")
        s = stats.spearman_ci(f[a].to_numpy(float), f[b].to_numpy(float), n_boot, seed)
        return pd.DataFrame([(*f[keys].iloc[0], *s.values(), len(f))])

    return x.select(*keys, a, b).groupBy(*keys).applyInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "rho double, p double, ci_low double, ci_high double, n long")


def ranking_correlations(scores: DataFrame, occupancy: DataFrame, n_boot: int = 1000) -> DataFrame:
    """Mean score of a verb in a construction against its frequency and attraction there, per track and epoch."""
    own = ["track", "epoch"]
    ranks = scores.groupBy(*own, "construction", "verb").agg(F.avg("score").alias("score"))
    occ = occupancy.groupBy("construction", F.lower("verb").alias("verb")).agg(F.sum("vac_freq").cast("double").alias("frequency"), F.avg("delta_p_cw").alias("delta_p"))
    x = ranks.join(occ, ["construction", "verb"])
    x = x.select(*own, "construction", "score", F.explode(F.create_map(F.lit("frequency"), F.col("frequency"), F.lit("delta_p"), F.col("delta_p"))).alias("predictor", "usage")).where("usage is not null")
    return spearman_groups(x, [*own, "construction", "predictor"], "score", "usage", n_boot)


def acquired(correlations: DataFrame, affinity: DataFrame) -> DataFrame:
    """A construction is acquired if scores follow frequency for sure and grammatical sentences do better on the whole."""
    keys = ["track", "epoch", "construction"]
    mean = affinity.groupBy(*keys).agg(F.avg("affinity").alias("mean_affinity"), (F.stddev_samp("affinity") / F.sqrt(F.count("affinity"))).alias("sem_affinity"), F.count("affinity").alias("n_affinity"))
    there = ~F.isnan("ci_low") & F.col("ci_low").isNotNull()
    follows = F.when(there, F.col("ci_low") > 0).otherwise((F.col("rho") > 0) & (F.col("p") < 0.05))
    x = correlations.where("predictor = 'frequency'").join(mean, keys, "left")
    return x.select(*keys, F.col("rho").alias("rho_frequency"), F.col("ci_low").alias("rho_ci_low"), "mean_affinity", "sem_affinity", "n_affinity", (F.coalesce(follows, F.lit(False)) & F.coalesce(F.col("mean_affinity") > 0, F.lit(False))).alias("acquired"))


def compare_orders(child_order: DataFrame, model_order: DataFrame) -> DataFrame:
    """Rank correlation of the children's order with a model's, where both rank three verbs or more."""
    child = child_order.select("vac", F.lower("verb").alias("verb"), F.col("aoa_rank").cast("double").alias("aoa_rank"))
    x = model_order.select("track", "vac", "verb", F.col("epoch_rank").cast("double").alias("epoch_rank")).join(child, ["vac", "verb"]).where("aoa_rank is not null and epoch_rank is not null")
    x = spearman_groups(x, ["track", "vac"], "aoa_rank", "epoch_rank", 0).where("n >= 3")
    return x.select("track", "vac", F.col("n").alias("n_verbs"), F.col("rho").alias("spearman_rho"), "p")
