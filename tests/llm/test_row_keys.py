"""Dedup stages of the pipeline on rows that share a doc_id or have none."""

import random

import corpus_pipeline


def test_dedup_stages_keep_one_row_of_each_group(spark, docs):
    random.seed(12)
    a, b, c, d, e = (" ".join(f"{random.randrange(10**9):09d}" for _ in range(40)) for _ in range(5))
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b), (3, c), (None, c), (None, d), (None, d), (None, e), (4, a + " "), (5, None), (5, "")]
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.simhash_dedup):
        out = stage(spark, docs(*rows), "")
        got = sorted([(r.doc_id, (r.text or "").strip()) for r in out.collect()], key=repr)
        want = [(1, a), (2, b), (3, c), (None, d), (None, e), (5, "")]
        if stage is corpus_pipeline.exact_dedup:
            want = [(4, a)] + want[1:]  # the most code points come first
        assert got == sorted(want, key=repr)
