"""Ingest, strata, parse filling and files."""

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import columns as c
from verbatlas.operators import coverage, fill
from verbatlas.sources import conllu, sinks
from verbatlas.sources import tokens as src

SAMPLE = "# a\n1-2\tShe's\t_\t_\t_\t_\t_\t_\t_\t_\n1\tShe\tshe\tPRON\t_\tCase=Nom\t2\tnsubj\t_\t_\n2\tput\tput\tVERB\t_\t_\t0\troot\t_\t_\n3\tit\tit\tPRON\t_\t_\t2\tobj\t_\t_\n4\ton\ton\tADP\t_\t_\t5\tcase\t_\t_\n5\tit\tit\tPRON\t_\t_\t2\tobl\t_\t_\n\n1\tGo\tgo\tVERB\t_\t_\t_\troot\t_\t_\n1.1\tx\tx\tX\t_\t_\t_\t_\t_\t_\n"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column).first()[0]


def test_strata(spark):
    s = lambda role, age: one(spark, c.strata("r", "a"), r=role, a=float(age))
    assert s("Mother", 24) == ["Parent Young", "Parent All"] and s("Father", 40) == ["Parent All"]
    assert s("Target_Child", 12) == ["Child I"] and s("Child", 48) == ["Child II"] and s("Child", 72) == [] and s("Visitor", 20) == []
    assert one(spark, c.narrowest_stratum("r", "a"), r="Father", a=24.0) == "Parent Young"


@pytest.mark.parametrize(("value", "months"), [("24.0", 24.0), (str(18 * 365.25 / 12), 18.0), ("nan", None), ("x", None), (None, None)])
def test_age_units(spark, value, months):
    got = spark.createDataFrame([(value,)], "a string").select(c.age_in_months("a")).first()[0]
    assert got == (None if months is None else pytest.approx(months))


def test_files_and_corpora(spark):
    gone = lambda f, s="child": one(spark, c.excluded_file("f", s), f=f)
    assert gone("Bernstein/Interview/foo.cha") and gone("a\\bloom70\\GIA\\gia10.cha") and not gone("Brown/Adam/adam01.cha")
    assert gone("Korman/x", "parent_young") and not gone("Korman/x") and gone("Brown/Sarah/sarah113", "parent_all") and not gone("Brown/Sarah/sarah113", "parent_young")
    assert one(spark, c.in_study("x"), x="bloom") and not one(spark, c.in_study("x"), x="Providence")


TOKENS = [
    (1, "u1", 1, "dog", "noun", "root", "Eng-NA", "Brown", "Child", 800.0, 1), (2, "u1", 2, "xxx", None, None, "Eng-NA", "Brown", "Child", 800.0, 1),
    (3, "u2", 1, "go", None, "nan", "Eng-UK", "Wells", "Mother", 2500.0, 2), (4, "u3", 1, "cat", "", "", "Other", "Brown", "Mother", 800.0, 3), (5, "u4", 1, "hi", "intj", "root", "Eng-NA", "Late", "Mother", 20.0, 9),
]


def frame(spark):
    x = spark.createDataFrame(TOKENS, "id long, utterance_id string, token_order long, gloss string, part_of_speech string, gra_relation string, collection_name string, corpus_name string, speaker_role string, target_child_age double, transcript_id long")
    return x.withColumns({n: F.lit(None).cast("string") for n in src.COLUMNS if n not in x.columns})


def test_scan_load_and_annotate(spark):
    tr = spark.createDataFrame([(1, "Brown/a.cha")], "id long, filename string")
    x = src.load(frame(spark), tr).collect()
    assert [(r.id, r.filename, r.parse_source, r.in_s7_2) for r in sorted(x)] == [(1, "Brown/a.cha", "childesdb", True), (2, "Brown/a.cha", None, True)]
    assert x[0].target_child_age == pytest.approx(800 * 12 / 365.25) and x[0].target_child_age_days == 800
    again = src.annotate(src.load(frame(spark), tr)).first()
    assert again.target_child_age == pytest.approx(800 * 12 / 365.25)
    assert [r.id for r in src.load(frame(spark), tr, corpora=["Late"]).collect()] == [5]
    assert src.load(frame(spark), tr, limit=1).count() == 1
    plan = src.scan(frame(spark), tr)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Filter")


def test_diagnostics_and_coverage(spark):
    d = src.diagnostics(frame(spark), ["Brown", "Wells"]).first()
    assert (d.n, d.n_null_age, d.min_age, d.max_age, d.n_cds_roles) == (3, 0, 800.0, 2500.0, 3)
    cov = coverage.audit(frame(spark))
    got = {r.corpus_name: (r.n_tokens, r.n_parsed, r.parsed_rate, r.in_s7_2) for r in cov.collect()}
    assert got == {"Brown": (2, 1, 0.5, True), "Wells": (1, 0, 0.0, True), "Late": (1, 1, 1.0, False)}
    s = coverage.summary(cov)
    assert s["n_corpora"] == 3 and s["zero_parse_corpora"] == ["Wells"] and "bloom70" in s["missing"]
    assert {r.corpus_name for r in coverage.drop_unparsed(frame(spark), cov).collect()} == {"Brown", "Late"}
    assert coverage.drop_unparsed(frame(spark), None).count() == 5


def test_files(spark, tmp_path):
    path = str(tmp_path / "corpora")
    src.corpora_written(frame(spark).where("corpus_name <> 'Late'"), path)
    src.append_missing(frame(spark), path)
    assert src.corpora_read(spark, path).count() == 5 and src.corpora_read(spark, path, ["Late"]).count() == 1
    src.append_missing(frame(spark), path)
    assert src.corpora_read(spark, path).count() == 5
    assert src.try_read(spark, str(tmp_path / "none/x"), str(tmp_path / "why.txt")) is None and (tmp_path / "why.txt").read_text()
    assert sinks.write_tables({"t": frame(spark).select("id", "gloss")}, str(tmp_path), "p") == {"t": 5}
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert src.read_table(spark, str(tmp_path / "a.jsonl")).count() == 2


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(SAMPLE)
    rows = sorted(conllu.read(spark, str(tmp_path / "a.conllu")).collect(), key=lambda r: r.id)
    assert [r.gloss for r in rows] == ["She", "put", "it", "on", "it", "Go"] and [r.utterance_id for r in rows] == ["ud-1"] * 5 + ["ud-2"]
    assert rows[0].suffix == "Case=Nom" and rows[1].suffix == "" and rows[5].gra_head == 0


def test_parse_states_and_keeping(spark):
    x = frame(spark)
    assert {r.utterance_id: r.state for r in fill.utterance_state(x).collect()} == {"u1": "partial", "u2": "unparsed", "u3": "unparsed", "u4": "parsed"}
    assert {r.utterance_id for r in fill.keep_parsed_utterances(x).collect()} == {"u1", "u4"}


def test_alignment():
    w = lambda text, pos="NOUN": (text, pos, 1, 0, "root", text)
    assert [a and a[0] for a in fill.aligned(["dogs", "xxx", "ran", "on"], [w("dog"), w("ran"), w(",", "PUNCT"), w("on")])] == ["dog", None, "ran", "on"]
    assert [a and a[0] for a in fill.aligned(["cat", "dog"], [w("dog")])] == [None, "dog"]
    assert [a and a[0] for a in fill.aligned(["dog", "on"], [w("dog"), w(",", "PUNCT"), w("on")])] == ["dog", "on"]


def parser(text):
    return [(t, "VERB", k + 1, 0, "root", t) for k, t in enumerate(text.split())]


def test_filling_overwrites_nothing(spark):
    got = {r.id: r for r in fill.fill_unparsed(frame(spark), parser).collect()}
    assert (got[3].part_of_speech, got[3].gra_relation, got[3].parse_source, got[3].stem) == ("VERB", "root", "stanza_gloss", "go")
    assert got[1].part_of_speech == "noun" and got[1].parse_source == "childesdb" and got[2].part_of_speech is None
    assert fill.parser_agreement(frame(spark), parser).first().pos_agreement == 0.0


def test_parse_fill_skips_finished_corpora(spark, tmp_path):
    """A corpus is parsed once, however often the command runs; with force again."""
    import sys
    import types
    from verbatlas import cli

    calls = tmp_path / "calls"
    path = str(calls)

    def parser(text):
        with open(path, "a") as f:
            f.write(text + "\n")
        return [(w, "NOUN", k, 0, "dep", w) for k, w in enumerate(text.split(), 1)]

    sys.modules["counting_parsers"] = types.SimpleNamespace(parser=parser)
    row = lambda k, corpus: (k, k // 2, k, f"w{k}", None, None, None, None, None, None, "Eng-NA", corpus, "Child", "q", 700.0, 1)
    names = "id long, utterance_id long, token_order long, gloss string, part_of_speech string, stem string, suffix string, gra_index long, gra_head long, gra_relation string, collection_name string, corpus_name string, speaker_role string, utterance_type string, target_child_age double, target_child_id long"
    both = spark.createDataFrame([row(k, "A" if k < 4 else "B") for k in range(8)], names)
    both.where("corpus_name = 'A'").write.parquet(f"{tmp_path}/a.parquet")
    both.write.parquet(f"{tmp_path}/ab.parquet")

    def run(name, *more):
        a = cli.build_parser().parse_args(["parse-fill", "--tokens", f"{tmp_path}/{name}.parquet", "--out", f"{tmp_path}/out", "--parser", "counting_parsers:parser", *more])
        a.run(spark, a)
        n = len(calls.read_text().splitlines())
        calls.write_text("")
        return n

    assert [run("a"), run("ab"), run("ab"), run("ab", "--force")] == [2, 2, 0, 4]
    filled = spark.read.parquet(f"{tmp_path}/out/tokens_filled")
    assert filled.count() == 8 and filled.where("part_of_speech = 'NOUN' and parse_source = 'stanza_gloss'").count() == 8


def test_treebank_hits(spark, tmp_path):
    from verbatlas.plans import studies

    (tmp_path / "a.conllu").write_text(SAMPLE)
    assert {(r.verb, r.construction, r.preposition) for r in studies.treebank_hits(spark, str(tmp_path)).where("not extra").collect()} == {("put", "VOL", "on")}
