"""The commands over small files."""

import json

import pytest

from tests.test_extract import tokens
from verbatlas import cli
from verbatlas.operators import contingency, extract


@pytest.fixture
def here(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark)
    x = tokens(spark, role="Child").withColumns({n: cli.F.lit(v) for n, v in (("corpus_name", "Brown"), ("collection_name", "Eng-NA"), ("target_child_id", "c1"), ("filename", "a"))})
    x.write.parquet(str(tmp_path / "tokens"))
    return tmp_path


def run(here, command, **options):
    args = [command, "--out", str(here)]
    for k, v in options.items():
        args += [f"--{k.replace('_', '-')}"] + ([] if v is True else [str(v)])
    cli.main(args)


def test_extract_and_after(spark, here):
    t = here / "tokens"
    run(here, "coverage", tokens=t)
    assert json.loads((here / "coverage_status.json").read_text())["n_corpora"] == 1
    run(here, "extract", tokens=t, skip_unparsed=True, parsed_only=True)
    hits = here / "hits_ud"
    assert spark.read.parquet(str(hits)).where("not extra").count() == 10
    run(here, "stats", hits=hits, tokens=t)
    contingency.occupancy(extract.explode_strata(spark.read.parquet(str(hits)))).write.parquet(str(here / "occ"))
    run(here, "qc", occupancy=here / "occ", hits=hits)
    assert "VOO" in json.loads((here / "qc_report.json").read_text())["lead_verbs"]
    run(here, "curves", tokens=t, n_boot=20, weighted=True)
    assert json.loads((here / "acq_status.json").read_text())["rows"]["child_first_ages"] > 0
    run(here, "eval")
    run(here, "parse-fill", tokens=t, parser="tests.test_sources:parser")
    assert spark.read.parquet(str(here / "tokens_filled")).count() == spark.read.parquet(str(t)).count()
