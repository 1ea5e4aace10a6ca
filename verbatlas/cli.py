"""Commands: coverage, parse-fill, extract, stats, qc, eval and curves over tables in files."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import acquisition as aq
from .operators import coverage, extract, fill, probing, qc
from .operators.contingency import verb_token_totals
from .plans import studies
from .sources import sinks, tokens


def attribute(path: str):
    """``module:name``, for the parser or model loader that a command is given."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def selected(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    x = tokens.load_file(spark, a.tokens)
    x = x.where("in_s7_2") if a.subset else x
    if a.corpora:
        x = x.where(F.col("corpus_name").isin(a.corpora))
    if a.skip_unparsed:
        x = coverage.drop_unparsed(x, coverage.audit(x))
    x = fill.keep_parsed_utterances(x) if a.parsed_only else x
    return x.limit(a.limit) if a.limit is not None else x


def run_coverage(spark, a):
    cov = coverage.audit(tokens.read_table(spark, a.tokens))
    sinks.write_parquet(cov, f"{a.out}/coverage")
    sinks.write_csv(cov, f"{a.out}/coverage_csv")
    sinks.write_status(coverage.summary(cov), a.out, "coverage_status")


def run_parse_fill(spark, a):
    """Corpora that the dataset has are not parsed again; what is parsed is written before it is counted."""
    out = f"{a.out}/tokens_filled"
    parser = attribute(a.parser) if a.parser else None
    todo = tokens.missing_corpora(tokens.load_file(spark, a.tokens), out, a.force)
    names = sorted(r[0] for r in tokens.corpus_names(todo).collect())
    before = {f"{r['state']}_before": r["n_utterances"] for r in fill.fill_status(todo).collect()}
    if names:
        tokens.corpora_written(fill.fill_unparsed(todo, parser), out)
    done = tokens.corpora_read(spark, out, names) if names else None
    after = {r["state"]: r["n_utterances"] for r in fill.fill_status(done).collect()} if names else {}
    sinks.write_status(after | before | {"corpora": names}, a.out, "parse_fill_status")


def run_extract(spark, a):
    hits = extract.extract(selected(spark, a), a.extractor, extras=not a.no_extras)
    sinks.write_parquet(hits, f"{a.out}/hits_{a.extractor}")


def run_stats(spark, a):
    t = tokens.load_file(spark, a.tokens) if a.tokens else None
    sim = tokens.read_table(spark, a.similarity) if a.similarity else None
    out = studies.chapter_statistics(spark.read.parquet(a.hits), verb_token_totals(t) if t is not None else None, t, sim)
    print(json.dumps(studies.saved(out, a.out, "stats")))


def run_qc(spark, a):
    leads = {r["key"]: {"recovered": r["recovered"], "missing": r["missing"]} for r in qc.qualitative_leads(tokens.read_table(spark, a.occupancy)).collect()}
    if a.hits:
        sinks.write_csv(qc.handcheck_sample(spark.read.parquet(a.hits)), f"{a.out}/qc_handcheck_sample")
    sinks.write_status({"lead_verbs": leads}, a.out, "qc_report")


def run_eval(spark, a):
    items = probing.item_bank(spark)
    out = {"items": items}
    if a.loader:
        models, load = probing.checkpoints(spark, a.track, a.epochs), attribute(a.loader)
        out |= {"ranking": probing.score_items(items, models, load), "affinity": probing.score_affinity(probing.affinity_items(spark), models, load)}
        if a.occupancy:
            out["correlations"] = probing.ranking_correlations(out["ranking"], tokens.read_table(spark, a.occupancy))
            out["acquired"] = probing.acquired(out["correlations"], out["affinity"])
    print(json.dumps(studies.saved(out, a.out, f"eval_{a.track}")))


def run_curves(spark, a):
    t = selected(spark, a)
    hits = spark.read.parquet(a.hits) if a.hits else extract.extract(t)
    ranking = tokens.read_table(spark, a.ranking) if a.ranking else None
    out = studies.acquisition(hits, ranking, aq.observation_spans(t), a.bin_months, a.n_boot, aq.token_exposure(t, a.bin_months) if a.weighted else None)
    print(json.dumps(studies.saved(out, a.out, "acq")))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbatlas")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name, run, *needs, **options):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--out", default="out")
        for n in needs:
            c.add_argument(f"--{n}", required=True)
        for n, how in options.items():
            c.add_argument(f"--{n.replace('_', '-')}", **how)
        return c

    flag, some = {"action": "store_true"}, {"nargs": "*"}
    filters = {"subset": flag, "corpora": some, "skip_unparsed": flag, "parsed_only": flag, "limit": {"type": int}}
    command("coverage", run_coverage, "tokens")
    command("parse-fill", run_parse_fill, "tokens", parser={}, force=flag)
    command("extract", run_extract, "tokens", extractor={"default": "ud", "choices": ("ud", "s74")}, no_extras=flag, **filters)
    command("stats", run_stats, "hits", tokens={}, similarity={})
    command("qc", run_qc, "occupancy", hits={})
    command("eval", run_eval, track={"default": "gpt2_100m"}, epochs={"nargs": "*", "type": int}, loader={}, occupancy={})
    command("curves", run_curves, "tokens", hits={}, ranking={}, bin_months={"type": float, "default": 3.0}, n_boot={"type": int, "default": 1000}, weighted=flag, **filters)
    return p


def main(argv: list[str] | None = None) -> None:
    a = build_parser().parse_args(argv)
    a.run(SparkSession.builder.appName("verbatlas").getOrCreate(), a)


if __name__ == "__main__":
    main()
