"""Constructions in hand-written utterances."""

import pytest

from verbatlas.operators import extract as x

COLUMNS = "id long, utterance_id string, token_order long, gloss string, part_of_speech string, stem string, suffix string, gra_index long, gra_head long, gra_relation string, utterance_type string, speaker_role string, target_child_age double"
SENTENCES = {
    "vl": "she:pron:2:nsubj go:verb:0:root to:adp:5:case the:det:5:det park:noun:2:obl",
    "vol": "she:pron:2:nsubj put:verb:0:root the:det:4:det cup:noun:2:obj on:adp:7:case the:det:7:det table:noun:2:obl",
    "voo": "they:pron:2:nsubj give:verb:0:root him:pron:2:iobj the:det:5:det book:noun:2:obj",
    "vo": "she:pron:2:nsubj eat:verb:0:root the:det:4:det apple:noun:2:obj",
    "passive": "the:det:2:det apple:noun:4:nsubj|pass was:aux:4:aux|pass eat:verb:0:root",
    "question": "what:pron:4:obj did:aux:4:aux she:pron:4:nsubj eat:verb:0:root ?:punct:4:punct",
    "particle": "he:pron:2:nsubj take:verb:0:root the:det:4:det hat:noun:2:obj off:adp:2:compound|prt",
    "onto": "she:pron:2:nsubj put:verb:0:root the:det:4:det bag:noun:2:obj onto:adp:7:case the:det:7:det shelf:noun:2:obl",
    "copula": "she:pron:3:nsubj be:aux:3:cop happy:adj:0:root",
    "chat": "he:PRON:2:SUBJ take:VERB:0:ROOT the:DET:4:DET hat:NOUN:2:OBJ off:ADP:2:COMPOUND-PRT",
    "at": "she:pron:2:nsubj draw:verb:0:root it:pron:2:obj at:adp:5:case school:noun:2:obl",
    "unlisted": "she:pron:2:nsubj eat:verb:0:root him:pron:2:iobj it:pron:2:obj",
    "result": "she:pron:2:nsubj make:verb:0:root it:pron:2:obj clean:adj:2:xcomp",
    "alone": "she:pron:2:nsubj sleep:verb:0:root",
    "dative": "she:pron:2:nsubj give:verb:0:root it:pron:2:obj to:adp:5:case him:pron:2:obl",
}


def tokens(spark, *names, **changed):
    rows = []
    for u in names or SENTENCES:
        for i, w in enumerate(SENTENCES[u].split(), 1):
            g, p, h, r = w.split(":")
            rows.append((1000 + i, u, i, g, p, g.lower(), "", i, int(h), r.replace("|", ":"), "question" if u == "question" else "declarative", changed.get("role", "Mother"), changed.get("age", 24.0)))
    return spark.createDataFrame(rows, COLUMNS)


def found(df, extra=False):
    return {(r.utterance_id, r.verb, r.construction, r.preposition) for r in df.collect() if r.extra == extra}


def test_tree_extractor(spark):
    hits = x.extract(tokens(spark))
    assert found(hits) == {
        ("vl", "go", "VL", "to"), ("vol", "put", "VOL", "on"), ("voo", "give", "VOO", None), ("vo", "eat", "VO", None), ("particle", "take", "VOL", "off"),
        ("onto", "put", "VOL", "onto"), ("chat", "take", "VOL", "off"), ("at", "draw", "VO", None), ("result", "make", "VO", None), ("dative", "give", "VOL", "to"),
    }
    assert found(hits, extra=True) == {("result", "make", "resultative", None), ("alone", "sleep", "intransitive", None), ("dative", "give", "prep_dative", "to")}


def test_copula_needs_no_verb_only_if_asked(spark):
    assert found(x.extract(tokens(spark, "copula")), True) == set()
    assert found(x.extract(tokens(spark, "copula"), require_verb=False), True) == {("copula", "be", "copular", None)}


def test_linear_windows(spark):
    hits = found(x.extract(tokens(spark, "vl", "vol", "voo", "vo", "passive", "question"), "s74"))
    assert {("vl", "go", "VL", "to"), ("vol", "put", "VOL", "on"), ("vo", "eat", "VO", None)} <= hits
    assert not any(h[0] in ("passive", "question") or h[2] == "VOO" for h in hits)


def test_linear_windows_keep_tokens_as_rows(spark):
    words = "put the cup on go to see it now".split()
    tags = dict(zip(words, "verb det noun adp verb adp verb pron adv".split(), strict=True))
    rows = spark.range(9 * 1000).selectExpr("id + 1 as n", f"array({', '.join(map(repr, words))})[id % 9] as gloss")
    of = " ".join(f"when '{w}' then '{p}'" for w, p in tags.items())
    df = rows.selectExpr("n as id", "'u' as utterance_id", "n as token_order", "gloss", f"case gloss {of} end as part_of_speech", "gloss as stem", "'' as suffix", "n as gra_index",
                         "case gloss when 'cup' then n - 2 when 'it' then n - 1 else 0 end as gra_head", "if(gloss in ('cup', 'it'), 'obj', 'dep') as gra_relation")
    hits = x.extract(df, "s74")
    assert "collect_list" not in hits._jdf.queryExecution().executedPlan().toString()  # no row grows with its utterance
    got = {(r.verb, r.construction, r.preposition): r["count"] for r in hits.groupBy("verb", "construction", "preposition").count().collect()}
    assert got == {("put", "VOL", "on"): 1000, ("put", "VO", None): 1000, ("go", "VL", "to"): 1000, ("see", "VO", None): 1000}


def test_linear_windows_tell_dependents_apart(spark):
    rows = [  # u: the object before the verb is no neighbour; an indirect object rules VO out; the own head of a verb; a gap of four words
        *[("u", *r) for r in [(1, "it", "pron", 2, "obj"), (2, "go", "verb", 2, "obj"), (3, "to", "adp", 0, "case"), (4, "eat", "verb", 0, "root"), (5, "him", "pron", 4, "iobj"), (6, "it", "pron", 4, "obj")]],
        *[("v", *r) for r in [(1, "put", "verb", 0, "root"), (2, "a", "det", 0, "det"), (3, "b", "adj", 0, "amod"), (4, "c", "adj", 0, "amod"), (5, "d", "noun", 1, "obj"), (6, "on", "adp", 0, "case")]],
        *[("w", *r) for r in [(1, "put", "verb", 0, "root"), (2, "a", "det", 0, "det"), (3, "b", "adj", 0, "amod"), (4, "d", "noun", 1, "obj"), (5, "on", "adp", 0, "case")]],
        *[("x", *r) for r in [(1, "go", "noun", 0, "root"), (2, "to", "adp", 1, "case")]],
    ]
    df = spark.createDataFrame(rows, "utterance_id string, id long, gloss string, part_of_speech string, gra_head long, gra_relation string").selectExpr("*", "id as token_order", "if(utterance_id = 'x' and id = 1, 'Ger', '') as suffix")
    assert found(x.extract(df, "s74")) == {("v", "put", "VO", None), ("w", "put", "VOL", "on"), ("w", "put", "VO", None)}
    assert found(x.extract(df, "s74", require_verb=False)) >= {("x", "go", "VL", "to")}


def test_unknown_extractor(spark):
    with pytest.raises(ValueError):
        x.extract(tokens(spark, "vl"), "other")


def test_gerunds_and_null_tags(spark):
    df = spark.createDataFrame([(1, "u", 1, "run", "verb", None, None, 1, 0, "root"), (2, "u", 2, "going", "noun", " ", "VerbForm=Ger", 2, 1, None), (3, "u", 3, "it", None, "it", None, 3, 2, "obj"), (4, None, 1, "x", "verb", "x", "", 1, 0, "root")],
                               "id long, utterance_id string, token_order long, gloss string, part_of_speech string, stem string, suffix string, gra_index long, gra_head long, gra_relation string")
    assert found(x.extract(df)) == {("u", "going", "VO", None)}
    assert x.extract(df.limit(0)).count() == 0


def test_late_prepositions_leave_young_strata(spark):
    hits = x.explode_strata(x.extract(tokens(spark, "onto")))
    assert [r.stratum for r in hits.collect()] == ["Parent All"]
    assert x.explode_strata(x.extract(tokens(spark, "onto", role="Child"))).count() == 0
    assert [r.stratum for r in x.explode_strata(x.extract(tokens(spark, "onto", role="Child", age=48.0))).collect()] == ["Child II"]
    assert sorted(r.stratum for r in x.explode_strata(x.extract(tokens(spark, "vl"))).collect()) == ["Parent All", "Parent Young"]
