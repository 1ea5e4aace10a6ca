"""The pipeline's stages, each against what its operator gives on the stage's own input."""

import pytest

pytest.importorskip("corpus_pipeline")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from tests.llm.test_near_copies import kept  # noqa: E402
from tests.llm.test_operators import WORDS, brute_counts, brute_removed  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, D, "documents")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, D), name.replace(" ", "-"))
        at[name] = {r.doc_id: r for r in before.collect()}, docs.collect()
        if name != "encode":
            assert docs.columns == columns
    before, after = at["quality rules"]
    failed = {d for d, r in before.items() if (n := brute_counts(r.text))[0] < 50 or 100 * n[4] > 50 * n[0]}
    assert not failed & {r.doc_id for r in after} and len(after) > 0.8 * (len(before) - len(failed))
    before, after = at["near dedup"]
    assert {r.doc_id for r in after} == kept({d: r.text for d, r in before.items()})
    before, after = at["suffix dedup"]
    cut = {d: n for d, _, n, _, _ in brute_removed([(d, r.text.encode()) for d, r in before.items()])}
    assert len(after) == len(before) and all(0 <= len(before[r.doc_id].text.encode()) - len(r.text.encode()) - cut[r.doc_id] <= 6 for r in after)
    before, after = at["mix sources"]
    assert {r.doc_id for r in after} <= set(before) and len(after) > len(before)
    before, after = at["encode"]
    t = Tokenizer.from_file(WORDS)
    assert all(list(r.ids) == t.encode(before[r.doc_id].text, add_special_tokens=False).ids for r in after)
