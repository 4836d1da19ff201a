"""Sums over lists of terms: common terms by a product of matrices, and what leaves a task."""

import numpy as np
import pandas as pd
import pytest

from sextant.operators import accumulate as A


@pytest.mark.parametrize("cells, lowest", [(1e-9, 0.1), (1e9, 0.1), (300, 0.1), (1e9, -1.0)])
def test_common_terms_and_what_a_task_gives(spark, monkeypatch, cells, lowest):
    monkeypatch.setattr(A, "_CELLS_FOR_ENTRY", cells, raising=False)
    monkeypatch.setattr(A, "_HELD_SCORES", 70)  # ten documents at a time
    monkeypatch.setattr(A, "_HELD_COMMON", 200, raising=False)
    rng = np.random.default_rng(2)
    asked = pd.DataFrame([(f"q{q}", t, rng.uniform(lowest, 2)) for q in range(7) for t in rng.choice(30, 8, replace=False)], columns=["query_id", "term", "weight"])
    docs = [(f"{d:03}", len(ts) + 1, [int(t) for t in ts], [int(x) for x in rng.integers(1, 5, len(ts))]) for d in range(90) for ts in [np.unique(rng.integers(0, 30, rng.integers(0, 12)) ** 2 // 30)]]
    held = spark.createDataFrame(docs, "doc_id string, n_tokens int, terms array<int>, tfs array<int>").coalesce(1)

    def parts(x):
        plain = x["tfs"] / (x["tfs"] + x["n_tokens"])
        return {1: plain, 2: np.where(x["terms"] % 3 > 0, plain, np.nan)}

    got = A.best_of_lists(held, "terms", ["tfs"], ["n_tokens"], A.AskedTerms.of(asked, 30), parts, 4, "string").collect()
    weight = {(r.query_id, r.term): r.weight for r in asked.itertuples()}
    want = {}
    for n in (1, 2):
        for q in asked["query_id"].unique():
            some = []
            for d, size, terms, tfs in docs:
                found = [weight[q, t] * tf / (tf + size) for t, tf in zip(terms, tfs) if (q, t) in weight and (n == 1 or t % 3)]
                some += [(-round(sum(found), 6), d)] if found else []
            want |= {(n, q, d): -s for s, d in sorted(some)[:4]}
    assert {(r.n, r.query_id, r.doc_id): round(r.score, 6) + 0.0 for r in got} == pytest.approx(want, abs=2e-6)
    assert len(got) == len(want)  # none of the batches before
