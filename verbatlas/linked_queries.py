"""More queries over the star-schema tables, for scans, parse filling, treebanks, probing and reports, with their SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as lx
from .operators import acquisition as aq
from .operators import contingency as ct
from .operators import coverage, extract, fill, probing, qc, reports
from .queries import CHILD, ORDER_SQL, PREPS_SQL, TAGS, TOKENS_SQL, event_hits, hits, line_tokens, query, rounded, table, values_sql
from .sources import conllu, sinks
from .sources import tokens as src

# Orders as tokens of transcripts, which are customers. Ages are days, or months.

ROLE_SQL = "case o_custkey % 6 when 0 then 'Target_Child' when 1 then 'Child' when 2 then 'Mother' when 3 then 'Father' when 4 then 'Teacher' else 'Visitor' end"
CORPUS_SQL = "case o_orderkey % 5 when 0 then 'Brown' when 1 then 'Bloom' when 2 then 'Other' when 3 then 'wells' else 'Nowhere' end"
COLLECTION_SQL = "case o_orderkey % 7 when 0 then 'Romance' when 1 then 'Eng-UK' else 'Eng-NA' end"
DAYS_SQL = "cast(200 + o_orderkey % 2600 as double)"


def order_tokens(spark: SparkSession, d: str, age: str = DAYS_SQL) -> tuple[DataFrame, DataFrame]:
    names = {
        "id": "o_orderkey", "utterance_id": "o_custkey", "transcript_id": "o_custkey", "token_order": "cast(o_orderkey as long)", "gloss": "lower(o_clerk)" if "o_clerk" in table(spark, d, "orders").columns else "lower(o_orderpriority)",
        "part_of_speech": "case when o_orderstatus = 'F' then 'verb' end", "stem": "lower(o_orderpriority)", "suffix": "''", "clitic": "''", "gra_index": "1", "gra_head": "0", "gra_relation": "case when o_totalprice > 100000 then 'root' end",
        "collection_name": COLLECTION_SQL, "corpus_name": CORPUS_SQL, "speaker_role": ROLE_SQL, "utterance_type": "'declarative'", "target_child_age": age, "target_child_id": "o_custkey % 40", "target_child_name": "'c'",
    }
    tokens = table(spark, d, "orders").selectExpr(*[f"{v} as {k}" for k, v in names.items()])
    files = table(spark, d, "customer").selectExpr("c_custkey as id", "case c_custkey % 4 when 0 then 'Korman/' when 1 then 'Bernstein\\\\Interview/' when 2 then 'Gleason/Father/eddie' else 'x/' end || c_name as filename")
    return tokens, files


FILE_SQL = "case c_custkey % 4 when 0 then 'Korman/' when 1 then 'Bernstein\\Interview/' when 2 then 'Gleason/Father/eddie' else 'x/' end || c_name"


@query(f"""
select o_orderkey as id, {CORPUS_SQL} as corpus_name, {ROLE_SQL} as speaker_role, {DAYS_SQL} as target_child_age, {FILE_SQL} as filename
from orders left join customer on o_custkey = c_custkey
where {COLLECTION_SQL} <> 'Romance' and o_custkey % 6 < 4 and {DAYS_SQL} >= 12 * 365.25 / 12 and {DAYS_SQL} < 72 * 365.25 / 12
""")
def token_scan(spark: SparkSession, d: str) -> DataFrame:
    return src.scan(*order_tokens(spark, d)).select("id", "corpus_name", "speaker_role", "target_child_age", "filename")


GONE_SQL = "o_custkey % 4 = 1 or (o_custkey % 6 in (2, 3) and o_custkey % 4 in (0, 2))"


@query(f"""
with t as (select {CORPUS_SQL} as corpus_name, {ROLE_SQL} as speaker_role, o_orderstatus = 'F' and o_totalprice > 100000 as parsed from orders join customer on o_custkey = c_custkey
  where {COLLECTION_SQL} <> 'Romance' and o_custkey % 6 < 4 and {CORPUS_SQL} in ('Brown', 'Bloom', 'Other') and o_orderkey % 80 >= 12 and o_orderkey % 80 < 72 and not ({GONE_SQL}))
select corpus_name, speaker_role, corpus_name in ('Brown', 'Bloom') as in_s7_2, case when parsed then 'childesdb' end as parse_source, count(*) as n from t group by all
""")
def token_load_months(spark: SparkSession, d: str) -> DataFrame:
    """No age is in days between the limits, so ages are taken as months; files are left out by role."""
    x = src.load(*order_tokens(spark, d, "cast(o_orderkey % 80 as double)"), corpora=["Brown", "Bloom", "Other"])
    return x.groupBy("corpus_name", "speaker_role", "in_s7_2", "parse_source").agg(F.count("*").alias("n"))


@query(f"""
select {CORPUS_SQL} as corpus_name, round(sum({DAYS_SQL} / (365.25 / 12)), 4) as months, count(*) as n from orders
where {COLLECTION_SQL} <> 'Romance' and o_custkey % 6 < 4 and {DAYS_SQL} >= 12 * 365.25 / 12 and {DAYS_SQL} < 72 * 365.25 / 12 and not ({GONE_SQL}) group by 1
""")
def token_load_days(spark: SparkSession, d: str) -> DataFrame:
    x = src.load(*order_tokens(spark, d))
    return x.groupBy("corpus_name").agg(F.round(F.sum("target_child_age"), 4).alias("months"), F.count("*").alias("n"))


@query(f"select 'Brown' as corpus_name, {ROLE_SQL} as speaker_role, count(*) as n from orders where {COLLECTION_SQL} <> 'Romance' and {CORPUS_SQL} = 'Brown' and o_custkey % 6 < 4 group by all")
def token_load_without_ages(spark: SparkSession, d: str) -> DataFrame:
    """Neither unit finds an age, so tokens without one are taken."""
    tokens, files = order_tokens(spark, d, "cast(null as double)")
    return src.load(tokens, files.withColumn("filename", F.lit("x")), corpora=["Brown"]).groupBy("corpus_name", "speaker_role").agg(F.count("*").alias("n"))


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


@query(f"""
select {CORPUS_SQL} as corpus_name, count(*) * case when {CORPUS_SQL} in ('Brown', 'wells') then 2 else 1 end as n from orders where {CORPUS_SQL} <> 'Nowhere' group by 1
""")
def corpora_appended(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora are written, doubled; then all but one are added, where those two stay as they are."""
    x, path = order_tokens(spark, d)[0], own_folder(spark, "corpora")
    some = x.where("corpus_name in ('Brown', 'wells')")
    src.corpora_written(some.union(some), path)
    src.append_missing(x.where("corpus_name <> 'Nowhere'"), path)
    return src.corpora_read(spark, path).groupBy("corpus_name").agg(F.count("*").alias("n"))


@query(f"select {CORPUS_SQL} as corpus_name, count(*) as n from orders where {CORPUS_SQL} in ('Brown', 'Other') group by 1")
def corpora_pruned(spark: SparkSession, d: str) -> DataFrame:
    x, path = order_tokens(spark, d)[0], own_folder(spark, "corpora")
    src.corpora_written(x, path)
    src.corpora_written(x.where("corpus_name = 'Brown'"), path)  # replaces one partition
    return src.corpora_read(spark, path, ["Brown", "Other"]).groupBy("corpus_name").agg(F.count("*").alias("n"))


@query(f"select {COLLECTION_SQL} as collection_name, count(distinct {CORPUS_SQL}) as n_corpora, list_sort(list(distinct {CORPUS_SQL})) as corpora from orders group by 1")
def corpora_of_collections(spark: SparkSession, d: str) -> DataFrame:
    return src.corpora_of(order_tokens(spark, d)[0])


@query(f"select {CORPUS_SQL} as corpus_name, count(*)::bigint as n_tokens from orders where {COLLECTION_SQL} <> 'Romance' group by 1")
def corpora_by_size(spark: SparkSession, d: str) -> DataFrame:
    return src.corpora_by_size(coverage.audit(order_tokens(spark, d)[0]))


@query(f"""
select {CORPUS_SQL} as corpus_name, count(*) as n_tokens, {CORPUS_SQL} in ('Brown', 'Bloom', 'wells') as in_s7_2, count(*) filter (o_orderstatus = 'F') as n_pos, count(*) filter (o_totalprice > 100000) as n_gra
from orders where {COLLECTION_SQL} <> 'Romance' group by 1
""")
def coverage_of_study(spark: SparkSession, d: str) -> DataFrame:
    return coverage.audit(order_tokens(spark, d)[0].withColumn("collection_name", F.when(F.col("collection_name") == "Romance", "Romance").otherwise("Eng-NA"))).select("corpus_name", "n_tokens", "in_s7_2", "n_pos", "n_gra")


@query("select n_name as name, n_regionkey as k, 1 as n_files from nation where n_regionkey > 0")
def sinks_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parquet and CSV that are written and read again; a path that is not there gives no table."""
    folder = own_folder(spark, "sinks")
    x = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"))
    sinks.write_parquet(x, f"{folder}/p.parquet")
    sinks.write_csv(x.where("k > 0"), f"{folder}/x.csv")
    none = src.try_read(spark, f"{folder}/nothing.parquet")
    csv = src.read_table(spark, f"{folder}/x.csv").select("name")
    return src.read_table(spark, f"{folder}/p.parquet").join(csv, "name").withColumn("n_files", F.lit(1 if none is None else 0))


# Parse filling with a parser that tags every word of a text.


def word_parser(text: str) -> list[fill.Word]:
    return [(w, "NOUN", k, 0, "dep", w[:3]) for k, w in enumerate(text.split(), 1)]


SPOKEN_SQL = """
t as (select o_custkey as u, o_orderkey as id, case when o_totalprice > 300000 then 'verb' end as p, case when o_orderpriority = '5-LOW' then 'xxx' else 'word' || (o_orderkey % 9) end as g from orders),
s as (select u, count(*) filter (g <> 'xxx') > 0 and count(*) filter (g <> 'xxx' and p is not null) = 0 as bare from t group by 1),
k as (select t.*, bare, count(*) filter (g = 'xxx') over (partition by u order by id) as gaps, row_number() over (partition by u order by id) as r from t join s using (u))
"""


def spoken(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("utterance_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("token_order"), F.when(F.col("o_totalprice") > 300000, "verb").alias("part_of_speech"), F.lit(None).cast("string").alias("gra_relation"),
        F.when(F.col("o_orderpriority") == "5-LOW", "xxx").otherwise(F.concat(F.lit("word"), (F.col("o_orderkey") % 9).cast("string"))).alias("gloss"))


@query(f"""
with {SPOKEN_SQL}
select u as utterance_id, id, coalesce(p, case when bare and g <> 'xxx' and gaps = 0 then 'NOUN' end) as part_of_speech, case when bare and g <> 'xxx' and gaps = 0 then 'dep' end as gra_relation,
  case when bare and g <> 'xxx' and gaps = 0 then r end as gra_index, case when bare and g <> 'xxx' and gaps = 0 then 'wor' end as stem, case when bare and g <> 'xxx' and gaps = 0 then 'stanza_gloss' end as parse_source from k
""")
def fill_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """A nonword is in the parser's text but takes no word, so what follows it finds another word in its place and stays bare."""
    x = fill.fill_unparsed(spoken(spark, d), word_parser)
    return x.select("utterance_id", "id", "part_of_speech", "gra_relation", F.col("gra_index").cast("long").alias("gra_index"), "stem", "parse_source")


@query(f"""
with {SPOKEN_SQL} select u as utterance_id, id, case when g <> 'xxx' and gaps = 0 then 'NOUN' end as silver_pos, case when g <> 'xxx' and gaps = 0 then r end as silver_gra_index from k
""")
def silver_tags(spark: SparkSession, d: str) -> DataFrame:
    return fill.silver_tags(spoken(spark, d), word_parser).select("utterance_id", "id", "silver_pos", "silver_gra_index")


@query("""
with t as (select o_custkey as u, o_orderkey as id, case when o_totalprice > 200000 then case when o_orderkey % 3 = 0 then 'NOUN' else 'VERB' end end as p from orders),
f as (select u, min(id) as first_id from t where p is not null group by 1 order by 2 limit 50), a as (select u, avg((p = 'NOUN')::int) as s from t join f using (u) where p is not null group by 1)
select count(*) as n, round(avg(s), 9) as pos_agreement from a
""")
def parser_agreement(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("utterance_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("token_order"), F.lit("word").alias("gloss"), F.when(F.col("o_totalprice") > 200000, F.when(F.col("o_orderkey") % 3 == 0, "NOUN").otherwise("VERB")).alias("part_of_speech"))
    return rounded(fill.parser_agreement(t, word_parser), "pos_agreement")


# Treebanks: a nation's customers are the sentences of its file.


def treebank_texts(spark: SparkSession, d: str) -> DataFrame:
    line = lambda k, form, pos, head, rel: F.concat_ws("\t", F.lit(str(k)), form, F.lower(form), F.lit(pos), F.lit("_"), F.lit("_"), F.lit(head), F.lit(rel), F.lit("_"), F.lit("_"))
    c = table(spark, d, "customer")
    sentence = F.concat_ws(
        "\n", F.concat(F.lit("# "), "c_name"), F.lit("1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_"), line(1, F.lit("She"), "PRON", "2", "nsubj"), line(2, F.when(F.col("c_custkey") % 3 == 0, "Put").otherwise("Give"), "VERB", "0", "root"),
        F.when(F.col("c_custkey") % 2 == 0, line(3, F.lit("it"), "PRON", "2", "obj")), line(4, F.lit("on"), "ADP", "5", "case"), line(5, F.col("c_mktsegment"), "NOUN", "2", "obl"), F.lit(""))
    return c.groupBy(F.concat(F.lit("f"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("path")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", sentence.alias("s")))), lambda x: x["s"])).alias("text"))


BANK_SQL = """
c as (select *, dense_rank() over (order by c_nationkey) as f, row_number() over (partition by c_nationkey order by c_custkey) as s from customer),
w as (select f, s, 1 as o, 'She' as g, 2 as h, 'nsubj' as r from c union all select f, s, 2, case when c_custkey % 3 = 0 then 'Put' else 'Give' end, 0, 'root' from c union all select f, s, 3, 'it', 2, 'obj' from c where c_custkey % 2 = 0
  union all select f, s, 4, 'on', 5, 'case' from c union all select f, s, 5, c_mktsegment, 2, 'obl' from c)
"""


@query(f"""
with {BANK_SQL} select 'ud-' || f || '-' || s as utterance_id, o::bigint as token_order, g as gloss, lower(g) as stem, h::bigint as gra_head, r as gra_relation, row_number() over (partition by f order by s, o) as id from w
""")
def conllu_tokens(spark: SparkSession, d: str) -> DataFrame:
    return conllu.parse(treebank_texts(spark, d)).select("utterance_id", "token_order", "gloss", "stem", "gra_head", "gra_relation", "id")


@query(f"""
with {BANK_SQL} select case when c_custkey % 3 = 0 then 'put' else 'give' end as verb, case when c_custkey % 2 = 0 then 'VOL' else 'VL' end as construction, 'on' as preposition, count(*) as n from c group by all
""")
def treebank_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(conllu.parse(treebank_texts(spark, d)), extras=False).groupBy("verb", "construction", "preposition").agg(F.count("*").alias("n"))


# Extraction with extras, passives and gerunds.

MORE_TAGS = TAGS | {"rel": "case (ix + n) % 9 when 0 then 'OBJ' when 1 then 'obl' when 2 then 'iobj' when 3 then 'case' when 4 then 'COMPOUND-PRT' when 5 then 'xcomp' when 6 then 'cop' when 7 then case when n % 2 = 0 then 'nsubj:pass' else 'nsubj' end else 'det' end"}
MORE_TOKENS_SQL = TOKENS_SQL.replace(TAGS["rel"], MORE_TAGS["rel"]).replace("where pos = 'verb'", "where u in (select u from t where pos = 'verb') and (pos = 'verb' or length(gloss) % 7 = 6)")


@query(f"""
with {MORE_TOKENS_SQL},
k as (select vb.u, vb.ix as v, vb.stem as verb, c.ix, c.pos, c.rel, c.stem from vb left join t c on c.u = vb.u and c.head = vb.ix),
fl as (select u, v, verb, count(*) filter (rel = 'obj') as n_obj, count(*) filter (rel = 'iobj') as n_iobj, count(*) filter (rel = 'xcomp') as n_x from k group by all having count(*) filter (rel = 'nsubj:pass') = 0),
ob as (select k.u, k.v, k.ix, case when k.pos = 'adp' then k.stem else coalesce(min_by(c.stem, c.ix) filter (c.pos = 'adp'), min_by(c.stem, c.ix) filter (c.rel = 'case')) end as p
  from k left join t c on c.u = k.u and c.head = k.ix where k.rel = 'obl' group by k.u, k.v, k.ix, k.pos, k.stem),
o1 as (select u, v, min_by(p, ix) as p from ob where p in {PREPS_SQL} group by all), pr as (select u, v, min_by(stem, ix) as p from k where rel = 'compound:prt' and stem in {PREPS_SQL} group by all),
f as (select fl.*, coalesce(o1.p, pr.p) as p, n_obj > 0 as o, n_iobj > 0 or n_obj > 1 as i from fl left join o1 using (u, v) left join pr using (u, v)),
hits as (select verb, 'VL' as construction, p as preposition, false as extra from f where p is not null and not o union all select verb, 'VOL', p, false from f where p in ('to', 'on', 'off') and o
  union all select verb, 'VOO', null, false from f where o and i and verb = 'give' union all select verb, 'VO', null, false from f where o and not i and not coalesce(p in ('to', 'on', 'off'), false)
  union all select verb, 'resultative', null, true from f where o and n_x > 0 union all select verb, 'intransitive', null, true from f where not o and not i and p is null
  union all select verb, 'prep_dative', p, true from f where o and p = 'to' and verb = 'give' union all select stem, 'copular', null, true from t where rel = 'cop' and u not in (select u from q) and u in (select u from t where pos = 'verb'))
select verb, construction, preposition, extra, count(*) as n from hits group by all
""")
def ud_extract_extras(spark: SparkSession, d: str) -> DataFrame:
    x = line_tokens(spark, d).withColumns({"n": F.char_length("gloss"), "ix": F.col("id")}).withColumns({"gra_relation": F.expr(MORE_TAGS["rel"]), "suffix": F.when(F.col("n") % 7 == 6, "Ger").otherwise("")})
    return extract.extract(x, "ud").groupBy("verb", "construction", "preposition", "extra").agg(F.count("*").alias("n"))


# Probing with models whose scores SQL can give.


def length_model(model: str, architecture: str) -> probing.Scorer:
    epoch = float(model.rpartition("-")[2])
    return lambda sentence, verb: (epoch - len(sentence), len(verb) - probing.verb_place(sentence, verb) / epoch)


EPOCHS = [1, 2, 5]
MODELS_SQL = values_sql([(e,) for e in EPOCHS], "e")


def models(spark: SparkSession) -> DataFrame:
    return probing.checkpoints(spark, "gpt2_100m", EPOCHS)


@query(f"select item_id, construction, verb, grammatical, control from {values_sql(lx.AFFINITY, 'item_id, construction, verb, grammatical, control')}")
def affinity_items(spark: SparkSession, d: str) -> DataFrame:
    return probing.affinity_items(spark)


@query("select 'gpt2_100m' as track, 'Raj-Sanjay-Shah/babyLM_100M_gpt2_epoch-' || e as model_id, 'gpt2' as architecture, e::int as epoch from range(1, 25) t(e)")
def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return probing.checkpoints(spark, "gpt2_100m")


ITEMS_SQL = "items as (select p_partkey as item_id, p_name as sentence, split_part(p_name, ' ', 2) as verb from part)"


@query(f"""
with {ITEMS_SQL}, m as (select e::int as e from {MODELS_SQL})
select item_id, e as epoch, round(e - length(sentence), 6)::double as harmony, round(length(verb) - (case when verb = '' then 0 else instr(lower(sentence), lower(verb)) - 1 end)::double / e, 6) as verb_span_logprob, (e - length(sentence))::double as score from items, m
""")
def score_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("sentence"), F.element_at(F.concat(F.split("p_name", " "), F.array(F.lit(""), F.lit(""))), 2).alias("verb"))
    return probing.score_items(items, models(spark), length_model).select("item_id", "epoch", "harmony", F.round("verb_span_logprob", 6).alias("verb_span_logprob"), "score")


@query(f"""
with m as (select e::int as e from {MODELS_SQL}), a as (select * from {values_sql(lx.AFFINITY, 'item_id, construction, verb, grammatical, control')})
select item_id, construction, verb, e as epoch, (e - length(grammatical))::double as grammatical_score, (e - length(control))::double as control_score, (length(control) - length(grammatical))::double as affinity from a, m
""")
def score_affinity(spark: SparkSession, d: str) -> DataFrame:
    return probing.score_affinity(probing.affinity_items(spark), models(spark), length_model).select("item_id", "construction", "verb", "epoch", "grammatical_score", "control_score", "affinity")


VOCABULARY = 7


def _causal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences of k tokens, each next one of which has the logit v and all others zero, but the last, which has 2 v."""
    for f in frames:
        out = []
        for e, k, v in zip(f["event_id"], f["k"], f["v"], strict=True):
            ids = [j % VOCABULARY for j in range(k)]
            logits = np.zeros((k, VOCABULARY))
            for j in range(k - 1):
                logits[j, ids[j + 1]] = v * (2 if j == k - 2 else 1)
            out.append((e, *probing.causal_scores(logits, ids, k - 1), probing.masked_score(logits, 0, ids[1:2])))
        yield pd.DataFrame(out, columns=["event_id", "every", "span", "masked"])


NEXT_SQL = f"(v - ln(exp(v) + {VOCABULARY - 1}))"


@query(f"""
with e as (select event_id, 3 + user_id % 5 as k, value / 100 as v from events)
select event_id, round((({NEXT_SQL}) * (k - 2) + (2 * v - ln(exp(2 * v) + {VOCABULARY - 1}))) / (k - 1), 6) as "every", round(2 * v - ln(exp(2 * v) + {VOCABULARY - 1}), 6) as span, round({NEXT_SQL}, 6) as masked from e
""")
def causal_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "cast(3 + user_id % 5 as int) as k", "value / 100 as v")
    return rounded(e.mapInPandas(_causal, f"event_id {dict(e.dtypes)['event_id']}, every double, span double, masked double"), "every", "span", "masked", digits=6)


def _masked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A model that gives each id the logit of itself over ten where a mask stands, and zero elsewhere."""
    encode = lambda text: [len(w) for w in text.split()]
    predict = lambda ids: np.array([[(j / 10 if i == 0 else 0.0) for j in range(12)] for i in ids])
    score = probing.masked_scorer(encode, predict, 0)
    for f in frames:
        yield pd.DataFrame({"p_partkey": f["p_partkey"], "score": [score(s, v)[0] for s, v in zip(f["p_name"], f["verb"], strict=True)]})


@query("""
with z as (select ln(sum(exp(j / 10.0::double))) as z from range(12) t(j)) select p_partkey, round(length(split_part(p_name, ' ', 1)) / 10.0::double - z, 9) as score from part, z
""")
def masked_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ")[0].alias("verb"))
    return rounded(p.mapInPandas(_masked, f"p_partkey {dict(p.dtypes)['p_partkey']}, score double"), "score")


RANK_SQL = "rank() over (partition by {0} order by {1}) + (count(*) over (partition by {0}, {1}) - 1) / 2.0::double"


@query(f"""
with s as (select 't' as track, extract(day from ts)::int % 3 as epoch, event_type as construction, 'u' || (user_id % 60) as verb, avg(value) as score from events group by all),
o as (select event_type as construction, 'u' || (user_id % 60) as verb, sum(value)::double as f, avg(event_id % 13)::double as dp from events group by all),
l as (select track, epoch, construction, score, 'frequency' as predictor, f as usage from s join o using (construction, verb) union all select track, epoch, construction, score, 'delta_p', dp from s join o using (construction, verb)),
r as (select *, {RANK_SQL.format('track, epoch, construction, predictor', 'score')} as x, {RANK_SQL.format('track, epoch, construction, predictor', 'usage')} as y from l)
select track, epoch, construction, predictor, round(corr(x, y), 9) as rho, count(*) as n from r group by all
""")
def ranking_correlations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("verb", F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")))
    scores = e.select(F.lit("t").alias("track"), (F.dayofmonth("ts") % 3).alias("epoch"), F.col("event_type").alias("construction"), "verb", F.col("value").alias("score"))
    occ = e.select(F.col("event_type").alias("construction"), "verb", F.col("value").alias("vac_freq"), (F.col("event_id") % 13).alias("delta_p_cw"))
    return rounded(probing.ranking_correlations(scores, occ, 0).select("track", "epoch", "construction", "predictor", "rho", "n"), "rho")


@query(f"""
with u as (select event_type as vac, 'u' || (user_id % 50) as verb, count(*) as a, floor(avg(value)) as b from events group by all),
r as (select *, rank() over (partition by vac order by a) as ca, case when b > 40 then rank() over (partition by vac order by b) end as mb from u),
k as (select vac, ca::double as ca, mb::double as mb from r where mb is not null), q as (select *, {RANK_SQL.format('vac', 'ca')} as x, {RANK_SQL.format('vac', 'mb')} as y from k)
select 't' as track, vac, count(*) as n_verbs, round(corr(x, y), 9) as spearman_rho from q group by vac having count(*) >= 3
""")
def compare_orders(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy(F.col("event_type").alias("vac"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("verb")).agg(F.count("*").alias("a"), F.floor(F.avg("value")).alias("b"))
    child = u.withColumn("aoa_rank", aq.min_rank("a", "vac"))
    model = u.select(F.lit("t").alias("track"), "vac", "verb", F.when(F.col("b") > 40, aq.min_rank("b", "vac")).alias("epoch_rank"))
    return rounded(probing.compare_orders(child, model).select("track", "vac", "n_verbs", "spearman_rho"), "spearman_rho")


@query("""
with e as (select extract(day from ts)::int % 4 as epoch, case event_id % 3 when 0 then 'VL' when 1 then 'VOL' else 'VO' end as construction, case event_id % 4 when 0 then 'To' when 1 then 'on' end as preposition, 'u' || (user_id % 10) as verb, value from events),
b as (select epoch, construction as vac, 'schematic' as grain, construction, preposition, verb, value from e union all select epoch, construction || '-' || lower(preposition), 'prep', construction, preposition, verb, value from e where construction <> 'VO' and preposition is not null)
select epoch, vac, grain, preposition, verb, round(avg(value), 9) as score from b group by all
""")
def model_curves_by_preposition(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    x = e.select(
        F.lit("t").alias("track"), (F.dayofmonth("ts") % 4).alias("epoch"), F.when(e["event_id"] % 3 == 0, "VL").when(e["event_id"] % 3 == 1, "VOL").otherwise("VO").alias("construction"), F.when(e["event_id"] % 4 == 0, "To").when(e["event_id"] % 4 == 1, "on").alias("preposition"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("verb"), F.lit("occupant").alias("kind"), F.col("value").alias("score"))
    return rounded(aq.model_curves(x, pooled=False).select("epoch", "vac", "grain", "preposition", "verb", "score"), "score")


# Reports.


@query(f"""
with {ORDER_SQL}, x as (select *, row_number() over (partition by vac order by aoa_rank nulls last, item) as k from o where vac in ('VL', 'VOL', 'VO', 'VOO')) select vac, verb, item from x where k <= 8
""")
def earliest_schematic(spark: SparkSession, d: str) -> DataFrame:
    return aq.earliest_schematic(aq.acquisition_order(aq.first_ages(hits(spark, d))))


SHARES_SQL = "(select event_type as vac, 'u' || (user_id % 12) as verb, (12 + 3 * (extract(day from ts)::int % 20))::int as age_months, floor(avg(value)) / 1000 as cumulative_share from events group by all)"


@query(f"""
with s as (select * from {SHARES_SQL}), o as (select *, row_number() over (partition by vac order by n_tokens desc, item) as k from (select event_type as vac, 'u' || (user_id % 12) as verb, event_type || '|u' || (user_id % 12) as item, count(*) as n_tokens from events where event_type is not null group by all))
select vac, verb, (select list(round(cumulative_share, 4) order by age_months) from s where s.vac = o.vac and s.verb = o.verb) as shares from o where k <= 8 and vac in ('VL', 'VOL', 'VO', 'VOO')
""".replace("event_type", "(case event_id % 4 when 0 then 'VL' when 1 then 'VOL' when 2 then 'VO' else 'VOO' end)"))
def verb_series(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("case event_id % 4 when 0 then 'VL' when 1 then 'VOL' when 2 then 'VO' else 'VOO' end as vac", "'u' || cast(user_id % 12 as string) as verb", "cast(12 + 3 * (day(ts) % 20) as int) as age_months", "value")
    curves = e.groupBy("vac", "verb", "age_months").agg((F.floor(F.avg("value")) / 1000).alias("cumulative_share"))
    order = e.groupBy("vac", "verb", F.concat("vac", F.lit("|"), "verb").alias("item")).agg(F.count("*").alias("n_tokens"), F.lit("schematic").alias("grain"), F.lit(1).alias("n_children"), F.avg("value").alias("median_first_age"))
    return reports.verb_series(order, curves).select("vac", "verb", "shares")


TIMES_SQL = "(select 'VO' as vac, event_type as verb, round(value) as time, (value > 30)::int as event, user_id as child_id from events)"


@query(f"""
with t as (select * from {TIMES_SQL}), m as (select vac, verb, case when avg(event) > 0.69 then round(avg(time), 3) end as km_median from t group by all), a as (select vac, verb, time as age, count(*) as n from t where event = 1 group by all)
select vac, verb, km_median, rank() over (partition by vac order by km_median nulls last)::int as place, (select list(age || 'x' || n order by age) from a where a.vac = m.vac and a.verb = m.verb) as ages from m
""")
def first_production(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").selectExpr("'VO' as vac", "event_type as verb", "round(value) as time", "cast(value > 30 as int) as event")
    summary = t.groupBy("vac", "verb").agg(F.when(F.avg("event") > 0.69, F.round(F.avg("time"), 3)).alias("km_median"))
    x = reports.first_production(summary, t)
    return x.select("vac", "verb", "km_median", "place", F.transform("ages", lambda a: F.concat(a["age"].cast("string"), F.lit("x"), a["n"].cast("string"))).alias("ages"))


@query("""
with s as (select 'VO' as vac, 'v' || s_suppkey as verb, case when s_suppkey % 4 > 0 then 20 + s_suppkey % 17 / 10.0::double end as m, case when s_suppkey % 5 > 0 then 18 + s_suppkey % 9 / 5.0::double end as lo, case when s_suppkey % 3 > 0 then 25 + s_suppkey % 11 / 5.0::double end as hi, s_suppkey * 977 as n_tokens from supplier)
select vac, verb, format('{:,}', n_tokens) as tokens, coalesce(printf('%.1f', m), 'not reached') as median, case when lo is null then '—' when hi is null then '≥ ' || printf('%.1f', lo) else printf('%.1f', lo) || '–' || printf('%.1f', hi) end as "interval" from s
""")
def km_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(
        F.lit("VO").alias("vac"), F.concat(F.lit("v"), k.cast("string")).alias("verb"), F.when(k % 4 > 0, 20 + k % 17 / 10).alias("km_median"), F.when(k % 5 > 0, 18 + k % 9 / 5).alias("km_ci_low"), F.when(k % 3 > 0, 25 + k % 11 / 5).alias("km_ci_high"),
        F.lit(1).alias("n_event"), F.lit(2).alias("n_risk"), (k * 977).alias("n_tokens"))
    return reports.km_table(s.drop("n_tokens"), s.select("vac", "verb", "n_tokens")).select("vac", "verb", "tokens", "median", "interval")


@query("""
select cast(user_id as varchar) as child_id, 12 + min(extract(day from ts) + extract(hour from ts) / 24.0::double) as first_obs, 12 + max(extract(day from ts) + extract(hour from ts) / 24.0::double) as last_obs, coalesce(min(case when user_id % 3 > 0 then 'n' || user_id end), '') as child_name from events group by 1
""")
def observation_spans_named(spark: SparkSession, d: str) -> DataFrame:
    e = event_hits(spark, d).withColumn("target_child_name", F.when(F.col("target_child_id").cast("long") % 3 > 0, F.concat(F.lit("n"), "target_child_id")))
    x = aq.observation_spans(e)
    return rounded(x, "first_obs", "last_obs")


@query(f"""
with want as (select * from {values_sql([(k, v) for k, vs in (lx.LEADS | lx.PREP_LEADS).items() for v in vs], 'key, expected')}),
h as (select case o_orderkey % 4 when 0 then 'VL' when 1 then 'VOL' when 2 then 'VO' else 'VOO' end as c, case o_custkey % 5 when 0 then 'to' when 1 then 'about' when 2 then 'down' when 3 then 'off' end as p, case when o_custkey % 2 = 0 then 'Child I' else 'Parent All' end as s,
  case o_orderkey % 11 when 0 then 'go' when 1 then 'come' when 2 then 'give' when 3 then 'get' when 4 then 'sit' when 5 then 'talk' else 'v' || (o_orderkey % 11) end as verb from orders),
k as (select c as key, verb from h union all select c || '-' || p, verb from h where c || '-' || p in ('VL-about', 'VL-at', 'VOL-off', 'VOL-to') union all select 'VL-down_' || case when s = 'Child I' then 'children' else 'parents' end, verb from h where c = 'VL' and p = 'down'),
r as (select key, verb, row_number() over (partition by key order by count(*) desc, verb) as r from k group by key, verb), top as (select key, list(verb order by r) as recovered from r where r <= 3 group by key)
select w.key, coalesce(any_value(recovered), []) as recovered, coalesce(list(expected order by expected) filter (not list_contains(coalesce(recovered, []), expected)), []) as missing from want w left join top using (key) group by w.key
""")
def qc_leads_all(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").selectExpr(
        "case o_orderkey % 4 when 0 then 'VL' when 1 then 'VOL' when 2 then 'VO' else 'VOO' end as construction", "case o_custkey % 5 when 0 then 'to' when 1 then 'about' when 2 then 'down' when 3 then 'off' end as preposition", "case when o_custkey % 2 = 0 then 'Child I' else 'Parent All' end as stratum",
        "case o_orderkey % 11 when 0 then 'go' when 1 then 'come' when 2 then 'give' when 3 then 'get' when 4 then 'sit' when 5 then 'talk' else 'v' || cast(o_orderkey % 11 as string) end as verb")
    return qc.qualitative_leads(x.groupBy("construction", "preposition", "stratum", "verb").agg(F.count("*").alias("vac_freq")))


SPREAD = math.pi


@query(f"""
with h as (select 'VO' as vac, 'v' || p_partkey as verb, (1 + p_partkey % 50)::double as cf, (2 + p_partkey % 31)::double as pf, p_size * {SPREAD} as dp from part)
select count(*) as n, round(corr(log10(pf), log10(cf)), 9) as pearson_r from h
""")
def parent_child_all_verbs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.lit("VO").alias("vac"), F.lit("VO").alias("construction"), F.lit(None).cast("string").alias("preposition"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("verb"), (1 + F.col("p_partkey") % 50).alias("cf"), (2 + F.col("p_partkey") % 31).alias("pf"))
    h = p.select("*", F.explode(F.array(F.struct(F.lit("Child I").alias("stratum"), F.col("cf").alias("k")), F.struct(F.lit("Parent Young").alias("stratum"), F.col("pf").alias("k")))).alias("s")).select("construction", "preposition", "verb", "s.stratum", F.explode(F.sequence(F.lit(1), "s.k")))
    return rounded(ct.parent_child(ct.occupancy(h)).where("child_stratum = 'Child I'").select("n", "pearson_r"), "pearson_r")
