"""Links within a wide radius, and op9's near copies, against brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")
from tests.llm.test_operators import linked  # noqa: E402
from verbatlas.llm import fingerprints, hamming  # noqa: E402
from verbatlas.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize(("crowd", "radius"), [(2048, 16), (3, 16), (2048, 7), (3, 7), (3, 3)])
def test_wide_radius(spark, crowd, radius, monkeypatch):
    monkeypatch.setattr(hamming, "CROWD", crowd)
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(12)]
    prints = {}
    for k in range(200):
        x = base[k % 12]
        for b in rng.sample(range(128), rng.randint(0, radius + 8)):
            x ^= 1 << b
        prints[k] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(x & (2**64 - 1)), signed(x >> 64)) for k, x in prints.items()]
    found = hamming.near_components(spark.createDataFrame(rows, "node long, f0 long, f1 long"), ["f0", "f1"], radius).collect()
    want = linked(prints, radius)
    assert {r.node: r.component for r in found} == {min(k for k in prints if prints[k] == prints[d]): want[d] for d in prints}


def test_query_near_ids(spark):
    got = QUERIES["op9_document_fingerprints"](spark, "/root/testdata/sf0.01").collect()
    want = linked({r.doc_id: int(r.fingerprint, 16) for r in got}, fingerprints.NEAR)
    assert {r.doc_id: r.near_id for r in got} == want and want != linked({r.doc_id: int(r.fingerprint, 16) for r in got}, 2)
