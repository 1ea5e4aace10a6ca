"""Statistics against small cases with known results."""

import math

import numpy as np
import pytest

from verbatlas.functions import stats
from verbatlas.operators import acquisition as aq
from verbatlas.operators import contingency as ct
from verbatlas.operators import probing, qc, reports, survival
from verbatlas.plans import studies

HIT = "utterance_id string, verb string, construction string, preposition string, extra boolean, speaker_role string, target_child_age double, target_child_id string"


def hits(spark, rows):
    return spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], HIT)


def child_rows(verb, cons, ages, prep=None):
    return [(verb, cons, prep, False, "Target_Child", float(a), f"c{k}") for k, a in enumerate(ages)]


GO_COME = child_rows("go", "VL", (20, 22, 21, 24, 19), "to") + child_rows("come", "VL", (30, 33, 28, 36, 31), "to")


def test_zipf(spark):
    df = spark.createDataFrame([("a", 1000.0 / r) for r in range(1, 21)] + [("b", 3.0)], "vac string, vac_freq double")
    got = {r.vac: r for r in ct.zipf(df, ["vac"]).collect()}
    assert got["a"].r2 > 0.999 and got["a"].gamma == pytest.approx(-1) and got["b"].r2 is None and got["b"].n_types == 1


def test_rank_correlations():
    x = np.arange(10.0)
    s = stats.spearman_ci(x, x)
    assert s["rho"] == pytest.approx(1) and s["ci_low"] > 0.5 and s["p"] == 0
    assert math.isnan(stats.spearman_ci(x[:2], x[:2])["rho"])
    assert stats.correlation_p(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 5, 30).astype(float), rng.integers(0, 5, 30).astype(float)
        sa, sb = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        assert stats.kendall_tau_b(a, b) == pytest.approx((sa * sb).sum() / math.sqrt((sa**2).sum() * (sb**2).sum()))


def test_least_squares_and_betweenness():
    x = np.random.default_rng(0).normal(size=(30, 3))
    c, r2 = stats.least_squares(x, 1 + x @ [1.0, 2.0, -3.0])
    assert c == pytest.approx([1, 1, 2, -3]) and r2 == pytest.approx(1)
    assert stats.betweenness(list("abc"), [("a", "b"), ("b", "c")]) == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert stats.betweenness(list("abcd"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]) == pytest.approx(dict.fromkeys("abcd", 1 / 6))


def test_contingency(spark):
    h = spark.createDataFrame([("Child I", "go", "VL", "to", "x")] * 3 + [("Child I", "sit", "VL", "to", "x")], "stratum string, verb string, construction string, preposition string, parse_source string")
    totals = spark.createDataFrame([("Child I", "go", 5), ("Child I", "see", 5)], "stratum string, verb string, n_verb_tokens long")
    got = {r.verb: r for r in ct.occupancy(h, totals).collect()}
    assert (got["go"].n_vac, got["go"].n_verb, got["sit"].n_verb) == (4, 5, 1)
    assert got["go"].delta_p_cw == pytest.approx(3 / 4 - 2 / 6) and got["sit"].delta_p_cw == pytest.approx(1 / 4 - 0)
    assert ct.occupancy(h).first().delta_p_cw is None


def test_verb_totals(spark):
    t = spark.createDataFrame([("VERB", "Go", "went", "Mother", 24.0), ("verb", None, "Ran", "Child", 24.0), ("noun", "x", "x", "Child", 24.0), ("verb", "x", "x", "Child", None)], "part_of_speech string, stem string, gloss string, speaker_role string, target_child_age double")
    assert {(r.stratum, r.verb, r.n_verb_tokens) for r in ct.verb_token_totals(t).collect()} == {("Parent Young", "go", 1), ("Parent All", "go", 1), ("Child I", "ran", 1)}


def test_order_and_curves(spark):
    h = hits(spark, GO_COME)
    order = aq.acquisition_order(aq.first_ages(h))
    assert [(r.verb, r.median_first_age, r.aoa_rank) for r in order.where("vac = 'VL-to'").orderBy("aoa_rank").collect()] == [("go", 21.0, 1), ("come", 31.0, 2)]
    at24 = {r.verb: r.cumulative_share for r in aq.age_curves(h, order=order).where("vac = 'VL' and age_months = 24").collect()}
    assert at24["go"] == 1.0 and at24["come"] == 0.0
    assert aq.age_curves(h, order=order).where("item = 'VL|go'").count() == 20


def test_pooled_prepositions(spark):
    h = hits(spark, [("run", "VL", "to", False, "Child", 24.0, "a"), ("run", "VL", "off", False, "Child", 30.0, "a"), ("run", "VL", " ", False, "Child", 40.0, "a"), ("run", "VL", "to", True, "Child", 1.0, "a")])
    got = {(r.vac, r.first_age, r.n) for r in aq.first_ages(h).collect()}
    assert got == {("VL", 24.0, 3), ("VL-to", 24.0, 1), ("VL-off", 30.0, 1)}


def test_adult_share_and_parent_order(spark):
    row = lambda v, cons, n, role="Mother": [(v, cons, None, False, role, 24.0, "a")] * n
    h = hits(spark, row("go", "VL", 20) + row("go", "VO", 5) + row("put", "VOL", 8) + row("put", "VO", 12) + row("go", "VO", 99, "Child"))
    share = {(r.verb, r.construction): r.share for r in aq.adult_frame_share(h).collect()}
    assert share["go", "VL"] == 0.8 and share["put", "VOL"] == 0.4
    assert {(r.item, r.input_rank) for r in aq.parent_order(h).collect()} == {("VL|go", 1), ("VO|put", 1)}


def test_weighted_curve(spark):
    counts = spark.createDataFrame([("VO", "v", "VO|v", "schematic", 18, 1), ("VO", "v", "VO|v", "schematic", 36, 1)], "vac string, verb string, item string, grain string, age_months int, bin_tokens long")
    exposure = spark.createDataFrame([(b, 10 if b == 36 else 100) for b in range(12, 72, 3)], "age_months int, exposure_tokens long")
    assert aq.cumulative_curves(counts).where("age_months = 18").first().cumulative_share == 0.5
    assert aq.cumulative_curves(counts, exposure=exposure).where("age_months = 18").first().cumulative_share == pytest.approx(0.01 / 0.11)


def test_survival_medians():
    assert stats.survival_median([10, 20, 40, 50], [1, 0, 1, 0]) == 40.0
    time, event, entry = [24, 24, 30, 30], [1, 1, 0, 0], [12, 12, 26, 26]
    assert stats.survival_median(time, event, entry) == 24.0 and math.isnan(stats.survival_median(time, [1, 0, 0, 0]))
    assert all(math.isnan(v) for v in stats.survival_median_ci([], []))


def test_survival_over_windows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for item in "abcd":
        for _ in range(25):
            entry = float(rng.integers(10, 20))
            rows.append((item, entry, entry + float(rng.integers(0, 12)), 1 if item == "d" else int(rng.integers(0, 2))))
    curve = survival.km_curve(spark.createDataFrame(rows, "item string, entry double, time double, event int"), ["item"])
    for item in "abcd":
        own = np.array([r[1:] for r in rows if r[0] == item])
        t, s = stats.survival_curve(own[:, 1], own[:, 2].astype(int), own[:, 0])
        got = curve.where(f"item = '{item}'").orderBy("t").collect()
        assert [r.t for r in got] == list(t) and [r.survival for r in got] == pytest.approx(list(s))


def test_censoring(spark):
    first = spark.createDataFrame([("a", "VL|go", 24.0), ("b", "VL|go", 48.0)], "child_id string, item string, first_age double")
    spans = spark.createDataFrame([("a", 18.0, 48.0), ("b", 48.0, 60.0), ("c", 18.0, 48.0), ("d", None, 30.0)], "child_id string, first_obs double, last_obs double")
    items = spark.createDataFrame([("VL", "go", "VL|go")], "vac string, verb string, item string")
    times = survival.censored_times(first, spans, items)
    got = {r.child_id: (r.event, r.time, r.entry, r.left_censored) for r in times.collect()}
    assert got == {"a": (1, 24.0, 18.0, 0), "b": (1, 48.0, 48.0, 1), "c": (0, 48.0, 18.0, 0), "d": (0, 30.0, 0.0, 0)}
    s = survival.aoa_summary(times, n_boot=50).first()
    assert (s.n_risk, s.n_event, s.n_censored, s.n_left_censored) == (4, 2, 2, 1)


def test_model_epochs(spark):
    rows = [("t", e, "VOO", None, v, k, s) for v, k, first in (("give", "occupant", 6), ("tell", "occupant", 3), ("sleep", "distractor", 99)) for e in range(1, 9) for s in [0.0 if k == "distractor" else 1.0 if e >= first else -1.0]]
    got = {r.verb: (r.acquire_epoch, r.epoch_rank) for r in aq.model_order(aq.model_curves(spark.createDataFrame(rows, "track string, epoch int, construction string, preposition string, verb string, kind string, score double"))).collect()}
    assert got == {"tell": (3, 1), "give": (6, 2)}


def test_item_bank_and_scores(spark):
    items = probing.item_bank(spark)
    assert items.count() == 314 and items.select("construction").distinct().count() == 4 and items.where("sentence like '%{%'").count() == 0
    models = probing.checkpoints(spark, "gpt2_100m", [1, 2])
    load = lambda name, kind: lambda s, v: (-float(len(s)), -float(len(v)))
    ranked = probing.score_items(items, models, load)
    assert ranked.count() == 628 and ranked.where("score <> -length(sentence)").count() == 0
    aff = probing.score_affinity(probing.affinity_items(spark), models, load)
    assert aff.count() == 32
    occ = items.select("construction", "verb").distinct().selectExpr("construction", "verb", "length(verb) as vac_freq", "0.1 as delta_p_cw")
    corr = probing.ranking_correlations(ranked, occ, 50)
    assert probing.acquired(corr, aff).count() == 8


def test_scoring_parts():
    lp = probing.log_softmax(np.zeros((3, 4)))
    assert lp[0, 0] == pytest.approx(-math.log(4))
    assert probing.causal_scores(np.zeros((3, 4)), [0, 1, 2], None) == pytest.approx((-math.log(4), -math.log(4)))
    assert probing.subsequence_start([5, 6, 7, 6, 7], [6, 7]) == 1 and probing.subsequence_start([1], [2]) is None
    assert probing.verb_place("She Put it", "put") == 4


def test_leads_sample_and_reports(spark):
    occ = spark.createDataFrame([("Child I", "VL-down", "VL", "down", "fall", 9), ("Parent All", "VL-down", "VL", "down", "sit", 7), ("Child I", "VO", "VO", None, "get", 3)], "stratum string, vac string, construction string, preposition string, verb string, vac_freq long")
    got = {r.key: (r.recovered, r.missing) for r in qc.qualitative_leads(occ).collect()}
    assert got["VL-down_children"] == (["fall"], []) and got["VL-down_parents"] == (["sit"], []) and got["VOL"] == ([], ["put"]) and got["VO"] == (["get"], [])
    h = hits(spark, GO_COME)
    assert qc.handcheck_sample(h, n_per=3).count() == 3
    out = studies.acquisition(h, spans=aq.observation_spans(h), n_boot=20)
    assert reports.km_table(out["censored_aoa"], out["child_order"]).count() == 2
    assert reports.verb_series(out["child_order"], out["child_age_curves"]).where("size(shares) = 20").count() == 2
    assert reports.first_production(out["censored_aoa"], out["censored_times"]).where("size(ages) = 5").count() == 2


def test_chapter_chain(spark, tmp_path):
    h = hits(spark, GO_COME + [("go", "VL", "to", False, "Mother", 24.0, "m")] * 4 + [("come", "VL", "to", False, "Mother", 24.0, "m")] * 3)
    totals = spark.createDataFrame([(s, v, 50) for s in ("Child I", "Parent Young", "Parent All") for v in ("go", "come", "see")], "stratum string, verb string, n_verb_tokens long")
    sim = spark.createDataFrame([("go", "come", 0.6), ("go", "see", 0.2)], "verb_a string, verb_b string, similarity double")
    out = studies.chapter_statistics(h, totals, h.selectExpr("utterance_id", "1 as token_order"), sim)
    assert set(out) == {"zipf", "selectivity", "occupancy", "parent_child", "leads", "cumulative_mlu"}
    counts = studies.saved({k: out[k] for k in ("zipf", "leads")}, str(tmp_path), "stats")
    assert counts["zipf"] == 4 and (tmp_path / "stats_status.json").exists()
