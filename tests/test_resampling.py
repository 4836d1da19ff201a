"""Resamples against plain Python, whatever the blocks; the exact signed-rank law."""

import hashlib
import itertools

import numpy as np
import pytest

from sextant.operators import significance as S


def drawn(prefix, r, i):
    return int(hashlib.md5(f"{prefix}:{r}:{i}".encode()).hexdigest()[:8], 16)


def rows(spark, diffs, metric="m"):
    return spark.createDataFrame([(f"q{i:04}", metric, 0.0, d, d) for i, d in enumerate(diffs)], "query_id string, metric string, a double, b double, d double")


@pytest.fixture(params=[(262_144, 262_144), (7, 10)])
def blocks(request, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_PLACES", request.param[0])
    monkeypatch.setattr(S, "_HELD_HASHES", request.param[1])


def test_resamples(spark, blocks):
    rng = np.random.default_rng(2)
    d = {"long": rng.standard_normal(23).round(3).tolist(), "short": [0.5, -0.25, 0.125], "one": [0.75]}
    pairs = rows(spark, d["long"], "long").unionByName(rows(spark, d["short"], "short")).unionByName(rows(spark, d["one"], "one")).repartition(5)
    low, high = {}, {}
    flips = {}
    for m, v in d.items():
        means = [np.mean([v[drawn("9", r, i) % len(v)] for i in range(len(v))]) for r in range(40)]
        low[m], high[m] = np.quantile(means, [0.05, 0.95])
        signed = [abs(np.mean([x if drawn("9:flip", r, i) % 2 == 0 else -x for i, x in enumerate(v)])) for r in range(40)]
        flips[m] = (sum(round(s, 9) >= round(abs(np.mean(v)), 9) for s in signed) + 1) / 41
    got = {r.metric: r for r in S.bootstrap_ci(pairs, 40, 0.9, 9).collect()}
    p = {r.metric: r.p for r in S.permutation_p(pairs, 40, 9).collect()}
    assert set(got) == set(p) == set(d)
    for m in d:
        assert got[m].ci_low == pytest.approx(low[m]) and got[m].ci_high == pytest.approx(high[m]) and p[m] == pytest.approx(flips[m])
    assert S.bootstrap_ci(pairs.limit(0), 10).count() == S.permutation_p(pairs.limit(0), 10).count() == 0


def test_no_row_of_a_query_and_a_resample(spark):
    """What is shuffled after the draws is a sum per resample, metric and block."""
    pairs = rows(spark, [0.1] * 300)
    got = S._resampled(S._placed(pairs), 500, "1", False)
    assert got.count() == 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and "Generate explode" in plan


def test_places_follow_query_ids(spark):
    got = S._placed(rows(spark, [float(i) for i in range(50)]).repartition(7)).collect()
    assert sorted((r.i, r.d) for r in got) == [(i, float(i)) for i in range(50)]


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_counts_of_rank_sums(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    assert list(S.rank_sum_counts(n)) == [sums.count(s) for s in range(n * (n + 1) // 2 + 1)]


# The published two-sided critical values of the signed-rank statistic at 0.05 and 0.01.
CRITICAL = {6: (0, None), 7: (2, None), 8: (3, 0), 9: (5, 1), 10: (8, 3), 12: (13, 7), 15: (25, 15), 20: (52, 37), 25: (89, 68), 30: (137, 109)}


@pytest.mark.parametrize("n", CRITICAL)
def test_critical_values(n):
    for level, t in zip((0.05, 0.01), CRITICAL[n]):
        if t is not None:
            assert S.signed_rank_p(n, t, None, True) <= level < S.signed_rank_p(n, t + 1, None, True)


def test_which_law(spark):
    exact = S.wilcoxon_p(rows(spark, [0.1, 0.2, -0.3, 0.4, 0.5])).first().wilcoxon_p
    assert exact == 2 * sum(S.rank_sum_counts(5)[:4]) / 32  # the smaller sum is 3
    for diffs in ([0.1, 0.2, -0.3, 0.4, 0.0], [0.1, 0.1, -0.3, 0.4, 0.5], [(-1) ** i * (i + 1) / 100 for i in range(51)]):
        own = rows(spark, diffs)
        assert S.wilcoxon_p(own).first().wilcoxon_p == S.two_sided_p(S.wilcoxon(own).first().z)
    assert S.wilcoxon_p(rows(spark, [0.0, 0.0])).first().wilcoxon_p == 1.0
    assert S.signed_rank_p(1, 0, None, True) == 1.0
