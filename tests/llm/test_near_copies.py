"""Near copies against brute force over whole sets of five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from verbatlas.llm import near_copies  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def kept(rows):
    """The least id of each component of brute-force links at 0.8."""
    root = {d: d for d in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    sets = {d: shingles(t) for d, t in rows.items()}
    for a in rows:
        for b in rows:
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in rows}


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_near_copies_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", small)
    rng = random.Random(4)
    rows = {}
    for g in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((60, 200, 300)))]
        for k in range(10):
            rows[len(rows)] = " ".join(edited(words, rng.randrange(7), rng))
    rows |= {len(rows) + k: t for k, t in enumerate([None, "", "one two", "One  two", "one two three", rows[5]])}
    rows = {d * 7919 % 10007: t for d, t in rows.items()}
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows.items()], DOC).repartition(5)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(kept(rows)) and all(r.text == rows[r.doc_id] for r in got)


def test_tables_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = kept({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_clashing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, c), (None, a), (None, a)]
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], DOC)
    assert sorted(((r.doc_id or 0), r.text) for r in near_copies.deduplicated(docs).collect()) == sorted([(0, a), (0, a), (1, a), (2, b), (3, c)])
    assert near_copies.deduplicated(docs.limit(0)).count() == 0 and near_copies.deduplicated(docs.withColumn("set", F.lit(1))).columns == [*docs.columns, "set"]


def crowd(rng, n, edits):
    """Copies of one text of 150 words, each with edits of its own."""
    words = [f"w{k}" for k in range(150)]
    return {d: " ".join(edited(words, edits(d), rng)) for d in range(n)}


def test_crowd_makes_few_pairs(spark, monkeypatch):
    rows, made, compared = crowd(random.Random(6), 300, lambda d: 1 + d % 9), [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: made.append(pairs.count()) or compared(pairs, sets))
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows.items()], DOC)
    got = {r.doc_id for r in near_copies.deduplicated(docs).collect()}
    assert got == kept(rows) and 150 < len(got) < 300
    assert sum(made) < 20 * len(rows)


def test_shared_edits_make_few_pairs(spark, monkeypatch):
    rng, words = random.Random(7), [f"w{k}" for k in range(150)]
    rows, made, compared = {}, [], near_copies.verified
    for d in range(300):
        at = set(rng.sample(range(150), d % 7))  # a place is always edited in the same way, so that few shingles are of one text alone
        rows[d] = " ".join(f"new{k}" if k in at else w for k, w in enumerate(words))
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: made.append(pairs.count()) or compared(pairs, sets))
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows.items()], DOC)
    got = {r.doc_id for r in near_copies.deduplicated(docs).collect()}
    assert got == kept(rows) and 50 < len(got) < 250
    assert sum(made) < 20 * len(rows)


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    rng = random.Random(9)
    for n in (6, 150, 3000):
        words = [f"w{k}" for k in range(n)]
        a, b = (near_copies.shingle_set(" ".join(edited(words, k, rng))) for k in (0, 1 + n // 50))
        bits = sum((int(x) & (1 << 64) - 1).bit_count() for x in near_copies.sketch(a) ^ near_copies.sketch(b))
        assert 0 < bits <= len(set(a.tolist()) ^ set(b.tolist()))
        assert not near_copies.sketch(a[:0]).any()


def test_alike_sets_have_near_prints():
    rng = random.Random(8)
    for n in (10, 60, 400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        sets = [near_copies.shingle_set(" ".join(edited(words, rng.randrange(max(2, n // 60)), rng))) for _ in range(12)]
        for a in sets:
            for b in sets:
                apart = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(near_copies.print_of(a), near_copies.print_of(b), strict=True))
                assert apart <= near_copies.WIDE or not near_copies.alike(a, b)
        assert not any(p in (0, -1) for p in near_copies.print_of(sets[0]))
