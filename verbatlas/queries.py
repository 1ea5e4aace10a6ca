"""Queries that apply the operators to the star-schema tables, and the same in SQL.

No linguistic tables are at hand, so rows of those tables are read as tokens, hits and scores:
customers are children or parents, their orders are hits, event types are items, and the lines of
documents are utterances whose tags follow from places and lengths of words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicon as lx
from .functions import columns as c
from .operators import acquisition as aq
from .operators import contingency as ct
from .operators import coverage, extract, fill, probing, qc, reports, survival
from .sources import tokens as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return named


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# What the rows are read as, in both languages.

HITS = """
select cast(o_orderkey as string) as utterance_id, 'v' || cast(o_custkey % 47 as string) as verb,
       case o_orderkey % 4 when 0 then 'VL' when 1 then 'VOL' when 2 then 'VO' else 'VOO' end as construction,
       case when o_orderkey % 4 > 1 then null when o_custkey % 3 = 0 then 'to' when o_custkey % 3 = 1 then 'on' else 'near' end as preposition,
       case when o_totalprice > 200000 then 'childesdb' else 'stanza_gloss' end as parse_source, o_orderstatus = 'P' as extra,
       case o_custkey % 5 when 0 then 'Target_Child' when 1 then 'Child' when 2 then 'Mother' when 3 then 'Father' else 'Visitor' end as speaker_role,
       12 + cast(o_orderkey % 600 as double) / 10 as target_child_age, cast(o_custkey % 40 as string) as target_child_id
from orders
"""
HITS_SQL = HITS.replace("as string", "as varchar")

EVENTS = """
select cast(user_id as string) as target_child_id, event_type as verb, 'VO' as construction, 'Child' as speaker_role, value,
       12 + cast(day(ts) as double) + cast(hour(ts) as double) / 24 as target_child_age
from events
"""
EVENTS_SQL = EVENTS.replace("as string", "as varchar").replace("day(ts)", "extract(day from ts)").replace("hour(ts)", "extract(hour from ts)")

GRAINS_SQL = f"""
h as ({HITS_SQL}), s as (select * from h where not coalesce(extra, false)),
g as (select utterance_id, lower(verb) as verb, construction, case when construction in ('VL', 'VOL') then null else preposition end as preposition, speaker_role, target_child_age, target_child_id,
             construction as vac, 'schematic' as grain, construction || '|' || lower(verb) as item from s
      union all
      select utterance_id, lower(verb), construction, preposition, speaker_role, target_child_age, target_child_id,
             construction || '-' || lower(preposition), 'prep', construction || '-' || lower(preposition) || '|' || lower(verb) from s
      where construction in ('VL', 'VOL') and trim(coalesce(preposition, '')) <> '')
"""
CHILD = "speaker_role in ('Target_Child', 'Child')"
FIRST_SQL = f"""{GRAINS_SQL}, f as (select target_child_id as child_id, vac, verb, item, construction, preposition, grain, min(target_child_age) as first_age, count(*) as n
  from g where {CHILD} group by all)"""
ORDER_SQL = f"""{FIRST_SQL},
o0 as (select vac, verb, item, construction, preposition, grain, count(distinct child_id) as n_children, sum(n)::bigint as n_tokens, median(first_age) as median_first_age,
       avg(first_age) as mean_first_age, min(first_age) as pooled_first_age from f group by all),
o1 as (select *, n_children >= case when vac like 'VOO%' then 3 else 5 end as enough, row_number() over (partition by vac order by n_tokens desc, item) as u from o0),
o2 as (select *, bool_or(enough) over (partition by vac) as has_enough from o1),
o as (select vac, verb, item, construction, preposition, grain, n_children, n_tokens, median_first_age, mean_first_age, pooled_first_age,
      rank() over (partition by vac order by median_first_age)::int as aoa_rank from o2 where case when has_enough then enough else u <= 8 end)"""


def rows_as(spark: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {name}", "from {t}"), t=table(spark, d, name))


def hits(spark: SparkSession, d: str) -> DataFrame:
    return rows_as(spark, d, HITS, "orders")


def event_hits(spark: SparkSession, d: str) -> DataFrame:
    return rows_as(spark, d, EVENTS, "events")


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""
select c_mktsegment as stratum, o_orderpriority as vac, 'b' || cast(o_custkey % 97 as varchar) as verb, count(*) as vac_freq,
  sum(count(*)) over (partition by c_mktsegment, o_orderpriority)::bigint as n_vac,
  sum(count(*)) over (partition by c_mktsegment, 'b' || cast(o_custkey % 97 as varchar))::bigint as n_verb,
  round(count(*)::double / sum(count(*)) over (partition by c_mktsegment, o_orderpriority)
    - (sum(count(*)) over (partition by c_mktsegment, 'b' || cast(o_custkey % 97 as varchar)) - count(*))::double
      / greatest(sum(count(*)) over (partition by c_mktsegment) - sum(count(*)) over (partition by c_mktsegment, o_orderpriority), 1), 9) as delta_p_cw
from orders join customer on o_custkey = c_custkey group by c_mktsegment, o_orderpriority, 'b' || cast(o_custkey % 97 as varchar)
""")
def occupancy_delta_p(spark: SparkSession, d: str) -> DataFrame:
    o, cu = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(cu, o["o_custkey"] == cu["c_custkey"]).select(F.col("c_mktsegment").alias("stratum"), F.col("o_orderpriority").alias("construction"), F.concat(F.lit("b"), (F.col("o_custkey") % 97).cast("string")).alias("verb"))
    totals = x.groupBy("stratum", "verb").agg(F.count("*").alias("n_verb_tokens"))
    return rounded(ct.occupancy(x, totals).select("stratum", "vac", "verb", "vac_freq", "n_vac", "n_verb", "delta_p_cw"), "delta_p_cw")


@query(f"""
with h as ({HITS_SQL}), e as (select *, unnest(list_filter([
    case when {CHILD} and target_child_age < 36 then 'Child I' end, case when {CHILD} and target_child_age >= 36 and target_child_age < 72 then 'Child II' end,
    case when speaker_role in ('Mother', 'Father') and target_child_age < 37 then 'Parent Young' end, case when speaker_role in ('Mother', 'Father') and target_child_age < 72 then 'Parent All' end], lambda x: x is not null)) as stratum from h
  union all select *, null from h where speaker_role = 'Visitor')
select stratum, construction, preposition, count(*) as n from e
where not (coalesce(stratum in ('Child I', 'Parent Young'), false) and coalesce(preposition in ('near', 'onto'), false)) group by all
""")
def strata_explode_counts(spark: SparkSession, d: str) -> DataFrame:
    return extract.explode_strata(hits(spark, d)).groupBy("stratum", "construction", "preposition").agg(F.count("*").alias("n"))


@query("select lang as collection_name, source as corpus_name, count(*) as n_tokens, count(*) filter (n_chars > 500) as n_pos, count(*) filter (n_chars % 2 = 0) as n_gra, count(*) filter (n_chars > 500 and n_chars % 2 = 0) as n_parsed, "
       "round(count(*) filter (n_chars > 500)::double / count(*), 9) as pos_rate, round(count(*) filter (n_chars % 2 = 0)::double / count(*), 9) as gra_rate, round(count(*) filter (n_chars > 500 and n_chars % 2 = 0)::double / count(*), 9) as parsed_rate, false as in_s7_2 from documents where lang in ('en', 'fr', 'de', 'es') group by all")  # fmt: skip
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.lit("Eng-NA").alias("collection_name"), F.concat_ws("/", "lang", "source").alias("corpus_name"), F.when(F.col("n_chars") > 500, "verb").alias("part_of_speech"), F.when(F.col("n_chars") % 2 == 0, "obj").otherwise("").alias("gra_relation"))
    x = coverage.audit(x).withColumns({"collection_name": F.split("corpus_name", "/")[0], "corpus_name": F.split("corpus_name", "/")[1]})
    return rounded(x, "pos_rate", "gra_rate", "parsed_rate")


@query(f"""
with h as ({HITS_SQL}), v as (select case when {CHILD} and target_child_age < 36 then ['Child I'] when {CHILD} and target_child_age < 72 then ['Child II']
  when speaker_role in ('Mother', 'Father') and target_child_age < 37 then ['Parent Young', 'Parent All'] when speaker_role in ('Mother', 'Father') and target_child_age < 72 then ['Parent All'] end as s, coalesce(preposition, verb) as verb from h where construction in ('VL', 'VO'))
select stratum, verb, count(*) as n_verb_tokens from (select unnest(s) as stratum, verb from v) group by all
""")
def verb_token_totals(spark: SparkSession, d: str) -> DataFrame:
    x = hits(spark, d).withColumns({"part_of_speech": F.when(F.col("construction").isin("VL", "VO"), " Verb "), "stem": F.col("preposition"), "gloss": F.col("verb")})
    return ct.verb_token_totals(x)


@query(f"""
with h as ({HITS_SQL}) select case when {CHILD} and target_child_age < 36 then 'Child I' when {CHILD} and target_child_age < 72 then 'Child II' when speaker_role in ('Mother', 'Father') and target_child_age < 37 then 'Parent Young'
  when speaker_role in ('Mother', 'Father') and target_child_age < 72 then 'Parent All' end as stratum, count(*) as n from h group by 1
""")
def narrowest_strata(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy(c.narrowest_stratum("speaker_role", "target_child_age").alias("stratum")).agg(F.count("*").alias("n"))


@query("""
with t as (select o_custkey as u, case when o_totalprice > 300000 then 'verb' end as p, o_orderpriority <> '5-LOW' as word from orders)
select state, count(*) as n_utterances from (select case when count(*) filter (word) > 0 and count(*) filter (word and p is not null) = 0 then 'unparsed' when count(*) > count(p) then 'partial' else 'parsed' end as state from t group by u) group by 1
""")
def utterance_states(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("utterance_id"), F.when(F.col("o_totalprice") > 300000, "verb").alias("part_of_speech"), F.when(F.col("o_orderpriority") == "5-LOW", "&um").otherwise("word").alias("gloss"))
    return fill.fill_status(o)


@query("""
with a as (select case when l_quantity * 30 > 120 then l_quantity * 30 / (365.25::double / 12) else l_quantity * 30 end as age from lineitem)
select cast(least(greatest(floor((age - 12) / 3) * 3 + 12, 12), 69) as int) as age_months, count(*) as exposure_tokens from a group by 1
""")
def age_conversion_bins(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.lit("Child").alias("speaker_role"), c.age_in_months(F.col("l_quantity") * 30).alias("target_child_age"))
    return aq.token_exposure(x)


@query("""
with p as (select url, page_id % 2 = 0 as child from pages)
select url, child from p where not (case when child then contains(lower(url), 'blog') or contains(lower(url), '/en/1') else contains(lower(url), 'blog') or contains(lower(url), '/en/1') or contains(lower(url), 'example.org/fr') end)
""")
def path_exclusion(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pages").select("url", (F.col("page_id") % 2 == 0).alias("child"))
    few = ("Blog", "\\en\\1")
    return x.where(~F.when(F.col("child"), c.path_matches("url", few)).otherwise(c.path_matches("url", (*few, "example.org/fr/"))))


@query("""
select o.* exclude (o_orderdate) from orders o where o_custkey in (select o_custkey from orders where lower(trim(o_orderpriority)) not in ('5-low') and o_orderstatus = 'F' and o_totalprice > 250000)
""")
def keep_parsed_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").drop("o_orderdate")
    x = o.withColumns({"utterance_id": F.col("o_custkey"), "gloss": F.when(F.lower("o_orderpriority") == "5-low", "xxx").otherwise(F.col("o_orderpriority")), "part_of_speech": F.when(F.col("o_orderstatus") == "F", "verb"), "gra_relation": F.when(F.col("o_totalprice") > 250000, "root").otherwise("nan")})
    return fill.keep_parsed_utterances(x).select(*o.columns)


@query("""
with cov as (select p_brand as corpus_name, avg(case when p_size > 25 then 1.0::double else 0.0::double end) as r from part group by 1)
select p_partkey, p_brand as corpus_name from part where p_brand in (select corpus_name from cov where r > 0.5)
""")
def drop_unparsed_corpora(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("corpus_name"), "p_size")
    cov = p.groupBy("corpus_name").agg(F.avg((F.col("p_size") > 25).cast("double")).alias("parsed_rate"))
    return coverage.drop_unparsed(p, cov, 0.5).select("p_partkey", "corpus_name")


@query("select count(*) as n, count(*) filter (value is null) as n_null_age, min(value) as min_age, max(value) as max_age, count(*) filter (event_type in (select min(event_type) from events)) as n_cds_roles from events")
def corpus_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("m"))
    x = e.join(F.broadcast(first)).select(F.lit("Eng-UK").alias("collection_name"), F.lit("all").alias("corpus_name"), F.col("value").alias("target_child_age"), F.when(F.col("event_type") == F.col("m"), "Mother").otherwise("Visitor").alias("speaker_role"))
    return src.diagnostics(x, ["all"])


@query(f"with {GRAINS_SQL} select vac, grain, item, preposition, count(*) as n from g group by all")
def grain_expansion(spark: SparkSession, d: str) -> DataFrame:
    return aq.grains(hits(spark, d)).groupBy("vac", "grain", "item", "preposition").agg(F.count("*").alias("n"))


@query("""
with n as (select event_type, user_id, count(*) as f from events group by 1, 2), r as (select *, log10(f::double) as y, log10((row_number() over (partition by event_type order by f desc))::double) as x from n)
select event_type as vac, round(regr_r2(y, x), 9) as r2, round(regr_slope(y, x), 9) as gamma, round(regr_intercept(y, x), 9) as intercept, count(*) as n_types from r group by 1
""")
def zipf_fit(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").groupBy(F.col("event_type").alias("vac"), "user_id").agg(F.count("*").alias("vac_freq"))
    return rounded(ct.zipf(x, ["vac"]), "r2", "gamma", "intercept")


@query("""
with v as (select distinct user_id as verb from events), b as (select user_id as verb, count(*)::double as b from events group by 1),
a as (select event_type as vac, user_id as verb, count(*)::double as a from events group by 1, 2), k as (select distinct vac from a),
g as (select k.vac, v.verb, coalesce(a, 0) as a, b from k cross join v join b using (verb) left join a on a.vac = k.vac and a.verb = v.verb),
p as (select x.vac, sum(sign(x.a - y.a) * sign(x.b - y.b)) as num, sum(abs(sign(x.a - y.a))) as dx, sum(abs(sign(x.b - y.b))) as dy from g x join g y on x.vac = y.vac and x.verb < y.verb group by 1)
select p.vac, round(num / sqrt(dx * dy), 9) as tau, round(1 - num * num / (dx * dy), 9) as one_minus_tau2, (select count(*) from v) as n from p
""")
def selectivity_tau(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("all").alias("stratum"), F.col("event_type").alias("vac"), F.col("user_id").cast("string").alias("verb"), F.lit("x").alias("parse_source"))
    occ = e.groupBy("stratum", "vac", "verb", "parse_source").agg(F.count("*").alias("vac_freq"))
    totals = e.groupBy("stratum", "verb").agg(F.count("*").alias("n_verb_tokens"))
    return rounded(ct.selectivity(occ, totals).select("vac", "tau", "one_minus_tau2", "n"), "tau", "one_minus_tau2")


@query(f"with {FIRST_SQL} select * from f")
def first_age(spark: SparkSession, d: str) -> DataFrame:
    return aq.first_ages(hits(spark, d))


@query(f"with {ORDER_SQL} select * replace (round(mean_first_age, 9) as mean_first_age, round(median_first_age, 9) as median_first_age) from o")
def acquisition_order(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aq.acquisition_order(aq.first_ages(hits(spark, d))), "mean_first_age", "median_first_age")


@query(f"""
with {ORDER_SQL}, t as (select *, row_number() over (partition by vac order by n_tokens desc, item) as u from o where grain = 'schematic')
select vac, verb, n_tokens, round(median_first_age, 9) as median_first_age, rank() over (partition by vac order by median_first_age)::int as aoa_rank from t where u <= 8
""")
def frequent_schematic_order(spark: SparkSession, d: str) -> DataFrame:
    x = aq.frequent_schematic(aq.acquisition_order(aq.first_ages(hits(spark, d))))
    return rounded(x.select("vac", "verb", "n_tokens", "median_first_age", "aoa_rank"), "median_first_age")


@query(f"""
with {GRAINS_SQL}, p as (select vac, verb, item, construction, preposition, grain, count(*) as n_tokens, median(target_child_age) as median_age from g where speaker_role in ('Mother', 'Father') group by all having count(*) >= 10)
select * replace (round(median_age, 9) as median_age), rank() over (partition by vac order by n_tokens desc)::int as input_rank from p
""")
def parent_order(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aq.parent_order(hits(spark, d)), "median_age")


@query(f"""
with h as ({HITS_SQL}), f as (select lower(verb) as verb, construction, count(*) as n_frame from h where not extra and not {CHILD} group by all)
select *, n_frame::double / n_verb as share from (select *, sum(n_frame) over (partition by verb)::bigint as n_verb from f) where n_verb >= 10
""")
def adult_frame_share(spark: SparkSession, d: str) -> DataFrame:
    return aq.adult_frame_share(hits(spark, d))


@query("""
with f as (select l_shipmode_x as stratum, vac, verb, count(*) as vac_freq from (select l_returnflag as l_shipmode_x, l_linestatus as vac, 's' || cast(l_suppkey as varchar) as verb from lineitem) group by all)
select stratum, vac, verb, vac_freq from (select *, row_number() over (partition by stratum, vac order by vac_freq desc, verb) as n from f) where n <= 5
""")
def lead_verbs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("stratum"), F.col("l_linestatus").alias("vac"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("verb"), F.lit("x").alias("parse_source")).agg(F.count("*").alias("vac_freq"))
    return ct.lead_verbs(x).drop("parse_source")


CURVE_SQL = f"""{ORDER_SQL}, k as (select *, cast(least(greatest(floor((target_child_age - 12) / 3) * 3 + 12, 12), 69) as int) as age_months from g where {CHILD}),
early as (select vac, item from (select *, row_number() over (partition by vac order by aoa_rank, item) as u from o) where u <= 8),
freq as (select vac, item from (select vac, item, row_number() over (partition by vac order by count(*) desc, item) as u from k where grain = 'schematic' group by vac, item) where u <= 8 and vac not in (select vac from early)),
n as (select vac, verb, item, grain, age_months, count(*) as bin_tokens from k where item in (select item from early union select item from freq) group by all),
grid as (select * from (select distinct vac, verb, item, grain from n) cross join (select unnest(range(12, 72, 3))::int as age_months)),
ex as (select age_months, count(*) as exposure_tokens from (select cast(least(greatest(floor((target_child_age - 12) / 3) * 3 + 12, 12), 69) as int) as age_months from h where {CHILD}) group by 1),
w as (select grid.*, coalesce(bin_tokens, 0) as bin_tokens, coalesce(exposure_tokens, 0) as exposure_tokens from grid left join n using (vac, verb, item, grain, age_months) left join ex using (age_months))"""


def _curves(weight: str) -> str:
    return f"""with {CURVE_SQL}, x as (select *, {weight} as bin_weight from w)
select vac, verb, item, grain, age_months, bin_tokens, round(bin_weight, 9) as bin_weight, sum(bin_tokens) over (partition by item)::bigint as n_tokens,
  round(sum(bin_weight) over (partition by item order by age_months rows unbounded preceding) / case when sum(bin_weight) over (partition by item) = 0 then 1 else sum(bin_weight) over (partition by item) end, 9) as cumulative_share from x"""


CURVE_COLUMNS = ("vac", "verb", "item", "grain", "age_months", "bin_tokens", "bin_weight", "n_tokens", "cumulative_share")


@query(_curves("bin_tokens::double"))
def age_curve_cdf(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d)
    x = aq.age_curves(h, order=aq.acquisition_order(aq.first_ages(h)))
    return rounded(x.select(*CURVE_COLUMNS), "bin_weight", "cumulative_share")


@query(_curves("case when exposure_tokens > 0 then bin_tokens::double / exposure_tokens else 0 end"))
def age_curve_weighted(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d)
    x = aq.age_curves(h, order=aq.acquisition_order(aq.first_ages(h)), exposure=aq.token_exposure(h))
    return rounded(x.select(*CURVE_COLUMNS), "bin_weight", "cumulative_share")


SPANS_SQL = f"e as ({EVENTS_SQL}), spans as (select target_child_id as child_id, min(target_child_age) as first_obs, max(target_child_age) as last_obs from e group by 1)"


@query(f"with {SPANS_SQL} select * from spans")
def observation_spans(spark: SparkSession, d: str) -> DataFrame:
    return aq.observation_spans(event_hits(spark, d))


TIMES_SQL = f"""{SPANS_SQL}, fa as (select target_child_id as child_id, 'VO|' || verb as item, min(target_child_age) as first_age from e where value > 60 group by all),
items as (select distinct 'VO' as vac, verb, 'VO|' || verb as item from e),
grid as (select * from items cross join spans), ev as (select grid.*, first_age from grid left join fa using (child_id, item)),
t0 as (select *, first_obs as entry, (first_age is not null)::int as event, coalesce(first_age, last_obs) as time from ev),
times as (select vac, verb, item, child_id, first_obs, last_obs, first_age, entry, event, case when first_age is not null and time <= entry then entry else time end as time,
  (first_age is not null and time <= entry)::int as left_censored from t0 where time >= entry)"""


def event_times(spark: SparkSession, d: str) -> DataFrame:
    e = event_hits(spark, d)
    first = aq.first_ages(e.where("value > 60")).where("grain = 'schematic'")
    items = e.select(F.lit("VO").alias("vac"), "verb", F.concat(F.lit("VO|"), "verb").alias("item")).distinct()
    return survival.censored_times(first, aq.observation_spans(e), items)


@query(f"with {TIMES_SQL} select * from times")
def censored_times(spark: SparkSession, d: str) -> DataFrame:
    return event_times(spark, d)


KM_SQL = f"""{TIMES_SQL}, d0 as (select item, time as t, sum(event)::bigint as deaths from times where event = 1 group by all),
d1 as (select d0.*, (select count(*) from times r where r.item = d0.item and r.entry <= d0.t and r.time >= d0.t) as n_risk from d0),
d2 as (select *, 1 - deaths::double / n_risk as f from d1),
km as (select item, t, deaths, n_risk, case when min(f) over w <= 0 then 0 else exp(sum(ln(nullif(f, 0))) over w) end as survival,
  coalesce(min(f) over (partition by item order by t rows between unbounded preceding and 1 preceding), 1) as b from d2 window w as (partition by item order by t rows unbounded preceding))"""


@query(f"with {KM_SQL} select item, t, deaths, n_risk, round(survival, 9) as survival from km where b > 0")
def km_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(survival.km_curve(event_times(spark, d), ["item"]), "survival")


@query(f"with {KM_SQL} select item, min(case when survival <= 0.5 + 1e-12 then t end) as km_median, round(min(survival), 9) as km_s_end from km where b > 0 group by item")
def km_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(survival.km_median(survival.km_curve(event_times(spark, d), ["item"]), ["item"]), "km_s_end")


@query(f"""
with {KM_SQL}, m as (select item, min(case when survival <= 0.5 + 1e-12 then t end) as km_median from km where b > 0 group by item)
select vac, verb, count(*) as n_risk, sum(event)::bigint as n_event, count(*) filter (event = 0) as n_censored, sum(left_censored)::bigint as n_left_censored,
  round(median(case when event = 1 then time end), 9) as naive_median, any_value(km_median) as km_median, any_value(km_median) is not null as median_reached from times left join m using (item) group by vac, verb
""")
def censored_summary(spark: SparkSession, d: str) -> DataFrame:
    x = survival.aoa_summary(event_times(spark, d), n_boot=20)
    return rounded(x.select("vac", "verb", "n_risk", "n_event", "n_censored", "n_left_censored", "naive_median", "km_median", "median_reached"), "naive_median")


@query(f"""
with {GRAINS_SQL}, k as (select construction as vac, verb, cast(least(greatest(floor((target_child_age - 12) / 3) * 3 + 12, 12), 69) as int) as age_months from h where {CHILD} and construction = 'VO'),
n as (select vac, verb, age_months, count(*) as bin_tokens from k group by all), grid as (select * from (select distinct vac, verb from n) cross join (select unnest(range(12, 72, 3))::int as age_months))
select vac, verb, age_months, coalesce(bin_tokens, 0) as bin_tokens, round(sum(coalesce(bin_tokens, 0)) over (partition by vac, verb order by age_months rows unbounded preceding)::double / sum(bin_tokens) over (partition by vac, verb), 9) as cumulative_share from grid left join n using (vac, verb, age_months)
""")
def schematic_curves(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d)
    items = h.where("construction = 'VO'").select(F.col("construction").alias("vac"), "verb").distinct()
    return rounded(aq.schematic_curves(h, items).select("vac", "verb", "age_months", "bin_tokens", "cumulative_share"), "cumulative_share")


@query(f"""
with {SPANS_SQL}, half as (select target_child_id as child_id, min(target_child_age) as first_obs, max(target_child_age) as last_obs from e group by target_child_id, value > 50)
select child_id, min(first_obs) as first_obs, max(last_obs) as last_obs from half group by 1
""")
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    e = event_hits(spark, d)
    return aq.merged_spans(aq.observation_spans(e.where("value > 50")).union(aq.observation_spans(e.where("not value > 50"))))


@query()
def km_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return survival.aoa_summary(event_times(spark, d))


@query("""
with f as (select event_type as vac, value as mlu_w, cast(event_id as varchar) as u, 'u' || cast(user_id as varchar) as verb from events),
r as (select *, (row_number() over (partition by vac, verb order by mlu_w, u) = 1)::int as new from f)
select vac, mlu_w, sum(new) over (partition by vac order by mlu_w, u rows unbounded preceding)::bigint as n_types from r
""")
def running_types(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("utterance_id"), F.lit("Child I").alias("stratum"), F.col("event_type").alias("construction"), F.lit(None).cast("string").alias("preposition"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("verb"), F.col("value").alias("mlu_w"))
    return ct.cumulative_types(e, e.select("utterance_id", "mlu_w"))


@query("select cast(l_orderkey as varchar) as utterance_id, count(*)::double as mlu_w from lineitem group by 1")
def mlu_by_utterance(spark: SparkSession, d: str) -> DataFrame:
    return ct.mlu_by_utterance(table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("utterance_id")))


@query("""
with u as (select event_type as construction, user_id, count(*)::double as a, sum(value) as b from events group by all),
r as (select construction, rank() over (partition by construction order by a) + (count(*) over (partition by construction, a) - 1) / 2.0::double as x, rank() over (partition by construction order by b) + (count(*) over (partition by construction, b) - 1) / 2.0::double as y from u)
select construction, round(corr(x, y), 9) as rho, count(*) as n from r group by 1
""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy(F.col("event_type").alias("construction"), "user_id").agg(F.count("*").cast("double").alias("a"), F.sum("value").alias("b"))
    return rounded(probing.spearman_groups(u, ["construction"], "a", "b", 0).select("construction", "rho", "n"), "rho")


@query()
def spearman_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy(F.col("event_type").alias("construction"), "user_id").agg(F.count("*").cast("double").alias("a"), F.sum("value").alias("b"))
    return probing.spearman_groups(u, ["construction"], "a", "b")


PAIR_SQL = f"""with h as ({HITS_SQL}), f as (select construction as vac, verb, count(*) filter ({CHILD} and target_child_age < 36) as cf, count(*) filter (speaker_role in ('Mother', 'Father') and target_child_age < 37) as pf from h where construction in ('VO', 'VOO') and not extra group by all)"""


@query(f"{PAIR_SQL} select vac, count(*) as n, round(corr(log10(pf), log10(cf)), 9) as pearson_r from f where cf > 0 and pf > 0 group by 1")
def parent_child_pearson(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).where(F.col("construction").isin("VO", "VOO")).drop("parse_source")
    x = ct.parent_child(ct.occupancy(extract.explode_strata(h)).where("stratum is not null"))
    return rounded(x.where("child_stratum = 'Child I'").select("vac", "n", "pearson_r"), "pearson_r")


@query()
def ols_three_predictors(spark: SparkSession, d: str) -> DataFrame:
    h = extract.explode_strata(hits(spark, d))
    totals = h.where("stratum is not null").groupBy("stratum", "verb").agg(F.count("*").alias("n_verb_tokens"))
    occ = ct.occupancy(h, totals).withColumn("betweenness", F.abs(F.hash("verb") % 100) / 1000)
    return ct.parent_child(occ)


def values_sql(rows, names: str) -> str:
    """Rows of constants as SQL."""
    text = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


VERB_SETS = [(k, v, kind) for kind, sets in (("occupant", lx.OCCUPANTS), ("distractor", lx.DISTRACTORS)) for k, vs in sets.items() for v in vs]


@query(f"""
with fr as (select * from {values_sql(lx.FRAMES, 'item_id, construction, preposition, template')}), vs as (select * from {values_sql(VERB_SETS, 'construction, verb, kind')})
select item_id, construction, preposition, verb, kind, replace(template, '{{verb}}', verb) as sentence from fr join vs using (construction)
""")
def item_bank(spark: SparkSession, d: str) -> DataFrame:
    return probing.item_bank(spark)


SCORES_SQL = """sc as (select 't' as track, extract(day from ts)::int as epoch, event_type as vac, 'u' || cast(user_id % 30 as varchar) as verb, case when user_id % 30 < 20 then 'occupant' else 'distractor' end as kind, avg(value) as score from events group by all)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit("t").alias("track"), F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("construction"), F.lit(None).cast("string").alias("preposition"), F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")).alias("verb"), F.when(F.col("user_id") % 30 < 20, "occupant").otherwise("distractor").alias("kind"), F.col("value").alias("score"))


@query(f"""
with {SCORES_SQL}, ds as (select vac, epoch, avg(score) as m from sc where kind = 'distractor' group by all),
a as (select sc.vac, verb, min(case when score > m then sc.epoch end) as acquire_epoch, round(max_by(score, sc.epoch), 9) as final_score from sc left join ds using (vac, epoch) where kind = 'occupant' group by all)
select *, case when acquire_epoch is not null then rank() over (partition by vac order by acquire_epoch nulls last)::int end as epoch_rank from a
""")
def model_acquire_epoch(spark: SparkSession, d: str) -> DataFrame:
    x = aq.model_order(aq.model_curves(scores(spark, d)))
    return rounded(x.select("vac", "verb", "acquire_epoch", "final_score", "epoch_rank"), "final_score")


@query("""
with r as (select event_type as construction, avg(value) as rho, min(value) - 5 as ci_low from events group by 1), a as (select event_type as construction, avg(value - 50) as mean_affinity, stddev_samp(value - 50) / sqrt(count(*)) as sem, count(*) as n_affinity from events group by 1)
select construction, round(rho, 9) as rho_frequency, round(ci_low, 9) as rho_ci_low, round(mean_affinity, 9) as mean_affinity, round(sem, 6) as sem_affinity, n_affinity, ci_low > 0 and mean_affinity > 0 as acquired from r join a using (construction)
""")
def acquired_flag(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("t").alias("track"), F.lit(1).alias("epoch"), F.col("event_type").alias("construction"), "value")
    corr = e.groupBy("track", "epoch", "construction").agg(F.lit("frequency").alias("predictor"), F.avg("value").alias("rho"), (F.min("value") - 5).alias("ci_low"), F.lit(0.01).alias("p"))
    x = probing.acquired(corr, e.withColumn("affinity", F.col("value") - 50))
    return rounded(x.drop("track", "epoch"), "rho_frequency", "rho_ci_low", "mean_affinity").withColumn("sem_affinity", F.round("sem_affinity", 6))


@query(f"""
with h as ({HITS_SQL}), s as (select utterance_id, verb, construction, preposition, case when {CHILD} then 'child' when speaker_role in ('Mother', 'Father') then 'parent' end as side from h where not extra)
select utterance_id, verb, construction, side from (select *, row_number() over (partition by construction, side order by md5('0|' || utterance_id || '|' || verb || '|' || construction || '|' || coalesce(preposition, '')), utterance_id) as n from s where side is not null) where n <= 50
""")
def handcheck_sample(spark: SparkSession, d: str) -> DataFrame:
    return qc.handcheck_sample(hits(spark, d)).select("utterance_id", "verb", "construction", "side")


@query("""
with want as (select * from (values ('VL', 'v0'), ('VO', 'v1')) t(key, verb)), h as (select case o_orderkey % 4 when 0 then 'VL' when 1 then 'VOL' when 2 then 'VO' else 'VOO' end as key, ('v' || cast(o_custkey % 47 as varchar)) as verb from orders),
t as (select key, verb, row_number() over (partition by key order by count(*) desc, verb) as r from h group by key, verb)
select key, list(verb order by r) as recovered from t where r <= 3 group by key
""")
def qc_leads(spark: SparkSession, d: str) -> DataFrame:
    occ = hits(spark, d).groupBy("construction", "verb").agg(F.count("*").alias("vac_freq")).withColumns({"preposition": F.lit(None).cast("string"), "stratum": F.lit(None).cast("string")})
    return qc.qualitative_leads(occ).where(F.col("key").isin("VL", "VOL", "VO", "VOO")).select("key", "recovered")


# Lines of documents as utterances: tags follow from places and lengths.

TAGS = {
    "pos": "case n % 7 when 0 then 'VERB' when 1 then 'adp' when 2 then 'noun' when 3 then 'det' when 4 then 'pron' when 5 then 'adv' else 'adj' end",
    "rel": "case (ix + n) % 6 when 0 then 'OBJ' when 1 then 'obl' when 2 then 'iobj' when 3 then 'case' when 4 then 'COMPOUND-PRT' else 'nsubj' end",
    "stem": "case n % 7 when 0 then case ix % 4 when 0 then 'give' when 1 then 'put' when 2 then 'go' else 'see' end when 1 then case ix % 5 when 0 then 'to' when 1 then 'on' when 2 then 'at' when 3 then 'near' else 'off' end else 'x' end",
    "head": "case when ix % 4 = 2 then ix - 4 else ix - ix % 4 + 2 end",
}
TAG_LIST = ", ".join(f"{v} as {k}" for k, v in TAGS.items())


def line_tokens(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Words of lines; ``dealt``: the lines are shuffled by utterance, so that what brings tokens together need not move words, which are many times as long."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words")).select(F.concat_ws("-", "doc_id", "line").alias("utterance_id"), "words")
    x = (lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "utterance_id") if dealt else lines).select("utterance_id", F.posexplode(F.split("words", " ")).alias("p", "gloss"))
    x = x.selectExpr("utterance_id", "gloss", "p + 1 as ix", "char_length(gloss) as n").selectExpr("*", *[f"{v} as {k}" for k, v in TAGS.items()])
    return x.select("utterance_id", F.col("ix").cast("long").alias("id"), F.col("ix").cast("long").alias("token_order"), "gloss", F.col("pos").alias("part_of_speech"), "stem", F.lit("").alias("suffix"), F.col("ix").cast("long").alias("gra_index"), F.col("head").cast("long").alias("gra_head"), F.col("rel").alias("gra_relation"))


TOKENS_SQL = f"""
l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as words from documents),
w as (select doc_id || '-' || line as u, generate_subscripts(string_split(words, ' '), 1) as ix, unnest(string_split(words, ' ')) as gloss from l),
tk as (select u, ix, gloss, length(gloss) as n from w),
t as (select u, ix, gloss, lower(pos) as pos, case rel when 'OBJ' then 'obj' when 'COMPOUND-PRT' then 'compound:prt' else rel end as rel, stem, head from (select *, {TAG_LIST} from tk)),
q as (select distinct u from t where gloss = '?'), vb as (select u, ix, stem from t where pos = 'verb' and u not in (select u from q))
"""
PREPS_SQL = "('to', 'on', 'off', 'at', 'near')"


@query(f"""
with {TOKENS_SQL},
k as (select vb.u, vb.ix as v, vb.stem as verb, c.ix, c.pos, c.rel, c.stem from vb left join t c on c.u = vb.u and c.head = vb.ix),
fl as (select u, v, verb, count(*) filter (rel = 'obj') as n_obj, count(*) filter (rel = 'iobj') as n_iobj from k group by all),
ob as (select k.u, k.v, k.ix, case when k.pos = 'adp' then k.stem else coalesce(min_by(c.stem, c.ix) filter (c.pos = 'adp'), min_by(c.stem, c.ix) filter (c.rel = 'case')) end as p
  from k left join t c on c.u = k.u and c.head = k.ix where k.rel = 'obl' group by k.u, k.v, k.ix, k.pos, k.stem),
o1 as (select u, v, min_by(p, ix) as p from ob where p in {PREPS_SQL} group by all), pr as (select u, v, min_by(stem, ix) as p from k where rel = 'compound:prt' and stem in {PREPS_SQL} group by all),
f as (select fl.*, coalesce(o1.p, pr.p) as p, n_obj > 0 as o, n_iobj > 0 or n_obj > 1 as i from fl left join o1 using (u, v) left join pr using (u, v)),
hits as (select verb, 'VL' as construction, p as preposition from f where p is not null and not o union all select verb, 'VOL', p from f where p in ('to', 'on', 'off') and o
  union all select verb, 'VOO', null from f where o and i and verb = 'give' union all select verb, 'VO', null from f where o and not i and not coalesce(p in ('to', 'on', 'off'), false))
select verb, construction, preposition, count(*) as n from hits group by all
""")
def ud_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(line_tokens(spark, d), "ud", extras=False).groupBy("verb", "construction", "preposition").agg(F.count("*").alias("n"))


@query(f"""
with {TOKENS_SQL}, np as (select *, pos in ('noun', 'pron', 'det', 'adj') as np from t),
ob as (select vb.u, vb.ix as v, list(c.ix) filter (c.rel = 'obj') as o, count(*) filter (c.rel = 'obj') as n_obj, count(*) filter (c.rel = 'iobj') as n_iobj from vb left join t c on c.u = vb.u and c.head = vb.ix group by all),
b as (select vb.*, coalesce(o, []) as o, n_obj, n_iobj, a1.pos as p1, a1.stem as s1, a1.np as n1, a2.pos as p2, a2.stem as s2, a2.np as n2, a3.pos as p3, a3.stem as s3, a3.np as n3, a4.pos as p4, a4.stem as s4
  from vb join ob on ob.u = vb.u and ob.v = vb.ix left join np a1 on a1.u = vb.u and a1.ix = vb.ix + 1 left join np a2 on a2.u = vb.u and a2.ix = vb.ix + 2 left join np a3 on a3.u = vb.u and a3.ix = vb.ix + 3 left join np a4 on a4.u = vb.u and a4.ix = vb.ix + 4),
stop as (select vb.u, vb.ix as v, min(x.ix) as e from vb left join np x on x.u = vb.u and x.ix > vb.ix and not x.np group by all),
c as (select b.*, e, case when p2 = 'adp' and s2 in ('to', 'on', 'off') and n1 and list_contains(o, b.ix + 1) then s2
  when p3 = 'adp' and s3 in ('to', 'on', 'off') and n1 and n2 and (list_contains(o, b.ix + 1) or list_contains(o, b.ix + 2)) then s3
  when p4 = 'adp' and s4 in ('to', 'on', 'off') and n1 and n2 and n3 and (list_contains(o, b.ix + 1) or list_contains(o, b.ix + 2) or list_contains(o, b.ix + 3)) then s4 end as vp from b join stop on stop.u = b.u and stop.v = b.ix),
hits as (select stem as verb, 'VL' as construction, s1 as preposition from c where p1 = 'adp' and s1 in {PREPS_SQL} and n_obj = 0 union all select stem, 'VOL', vp from c where vp is not null
  union all select stem, 'VO', null from c where n_iobj = 0 and len(list_filter(o, lambda x: x > c.ix and x < coalesce(e, 1000000000))) > 0)
select verb, construction, preposition, count(*) as n from hits group by all
""")
def s74_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(line_tokens(spark, d, dealt=True), "s74").groupBy("verb", "construction", "preposition").agg(F.count("*").alias("n"))


@query("""
with t as (select o_custkey as u, o_orderkey as id, case when o_totalprice > 300000 then 'verb' end as p, case when o_orderpriority = '5-LOW' then 'xxx' else 'word' end as g from orders),
s as (select u, count(*) filter (g <> 'xxx') > 0 and count(*) filter (g <> 'xxx' and p is not null) = 0 as bare from t group by 1)
select u as utterance_id, id, coalesce(p, case when bare then 'NOUN' end) as part_of_speech, case when p is null and bare then 'stanza_gloss' end as parse_source from t join s using (u)
""")
def fill_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("utterance_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 300000, "verb").alias("part_of_speech"), F.when(F.col("o_orderpriority") == "5-LOW", "xxx").otherwise("word").alias("gloss"))
    x = fill.annotate_existing_parses(o.withColumn("gra_relation", F.lit(None).cast("string")))
    bare = x.join(fill.utterance_state(x).where("state = 'unparsed'"), "utterance_id", "left_semi")
    none = F.lit(None)
    silver = bare.select("utterance_id", "id", F.lit("NOUN").alias("silver_pos"), none.cast("long").alias("silver_gra_index"), none.cast("long").alias("silver_gra_head"), none.cast("string").alias("silver_gra_relation"), none.cast("string").alias("silver_lemma"))
    return fill.merge_silver(x, silver, "stanza_gloss").select("utterance_id", "id", "part_of_speech", "parse_source")


@query("select o_orderpriority as k, avg((o_orderstatus = case when o_totalprice > 150000 then 'F' else 'O' end)::int) as pos_agreement from orders where trim(o_orderstatus) <> '' group by 1")
def pos_agreement(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("gold"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O").alias("pred"))
    return fill.pos_agreement(o, "gold", "pred", "k")


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("src"), "n_regionkey"), n.select(F.col("n_name").alias("dst"), "n_regionkey")
    edges = a.join(b, "n_regionkey").where((F.col("src") < F.col("dst")) & ((F.length("src") + F.length("dst")) % 3 > 0)).select(F.col("n_regionkey").cast("string").alias("g"), "src", "dst")
    return ct.betweenness(edges, graph="g")


@query("select coalesce(case when o_totalprice > 200000 then 'childesdb' end, 'unparsed') as parse_source, count(*) as n_tokens from orders group by 1")
def source_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.source_histogram(table(spark, d, "orders").select(F.when(F.col("o_totalprice") > 200000, "childesdb").alias("parse_source")))


@query(f"with {GRAINS_SQL}, x as (select least(greatest(floor((target_child_age - 12) / 3) * 3 + 12, 12), 69)::int as a, count(*) as n from h where {CHILD} group by 1) select max_by(a, n * 1000 - a) as most_at, min_by(a, n * 1000 + a) as least_at, sum(n)::bigint as tokens from x")
def exposure_extremes(spark: SparkSession, d: str) -> DataFrame:
    return reports.extremes(aq.token_exposure(hits(spark, d)))


@query("""
with e as (select 'VO' as vac, event_type as verb, value as time, user_id as child_id, event_id from events), b as (select *, round(time / 1) * 1 as bin from e)
select vac, verb, time, bin, row_number() over (partition by vac, verb, bin order by time, child_id) - (count(*) over (partition by vac, verb, bin) + 1) / 2.0::double as "offset" from b
""")
def swarm_positions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("VO").alias("vac"), F.col("event_type").alias("verb"), F.col("value").alias("time"), F.col("user_id").alias("child_id"), F.lit(1).alias("event"))
    return reports.swarm(e)


from . import linked_queries  # noqa: E402, F401  adds its own to QUERIES and ORACLES
