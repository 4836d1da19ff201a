"""Metrics, comparisons and diagnostics against hand-checked values and invariants."""

import pytest
from pyspark.sql import functions as F

from sextant.operators import diagnostics as D
from sextant.operators import evaluate as E
from sextant.operators import rag, reports
from sextant.operators import significance as S

ALL = ("ndcg@2", "ndcg@4", "recall@2", "recall@4", "mrr@4", "map@4", "precision@4", "hits@4")


def run_of(spark, rows):
    return E.build_run(spark.createDataFrame(rows, "query_id string, doc_id string, score double"))


def labels(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, grade int")


def values(df):
    return {(r.query_id, r.metric): round(r.value, 6) for r in df.collect()}


def test_metrics(spark):
    run = run_of(spark, [("q", "a", 4.0), ("q", "b", 3.0), ("q", "c", 2.0), ("q", "d", 1.0)])
    gold = labels(spark, [("q", "b", 2), ("q", "c", 1), ("q", "x", 1), ("none", "z", 1)])
    got = values(E.query_metrics(run, gold, ALL))
    assert got["q", "ndcg@4"] == 0.562727 and got["q", "mrr@4"] == 0.5 and got["q", "recall@4"] == round(2 / 3, 6)
    assert got["q", "map@4"] == round((1 / 2 + 2 / 3) / 3, 6) and got["q", "precision@4"] == 0.5 and got["q", "hits@4"] == 2
    assert all(v == 0 for (q, _), v in got.items() if q == "none")
    assert got["q", "recall@2"] <= got["q", "recall@4"]
    exponential = values(E.query_metrics(run, gold, ("ndcg@4",), gain="exponential"))
    assert exponential["q", "ndcg@4"] == 0.579237
    ideal = run_of(spark, [("q", "b", 3.0), ("q", "c", 2.0), ("q", "x", 1.0)])
    assert values(E.query_metrics(ideal, gold, ("ndcg@4",)))["q", "ndcg@4"] == 1


def test_build_run(spark):
    rows = spark.createDataFrame([("q", "b", 1.0, 1), ("q", "a", 1.0, 2), ("q", "b", 5.0, 3)], "query_id string, doc_id string, score double, rank int")
    assert [(r.doc_id, r.score) for r in E.build_run(rows).orderBy("rank").collect()] == [("b", 5.0), ("a", 1.0)]
    assert [r.doc_id for r in E.build_run(rows.limit(2), by="rank").orderBy("rank").collect()] == ["b", "a"]
    assert E.effective_depth(10, ("ndcg@100",)) == 100


def test_siblings(spark):
    of = spark.createDataFrame([("p1", "A"), ("p2", "A"), ("p3", "A"), ("p4", "B")], "doc_id string, did string")
    gold = labels(spark, [("q", "p1", 1)])
    assert {(r.doc_id, r.grade) for r in E.sibling_qrels(gold, of).collect()} == {("p1", 2), ("p2", 1), ("p3", 1)}
    run = run_of(spark, [("q", "p2", 2.0), ("q", "p4", 1.0)])
    row = E.doc_level_diagnosis(run, gold.union(labels(spark, [("r", "p4", 1)])), of).first()
    assert (row.exact_pct, row.sibling_only_pct, row.miss_pct, row.mean_doc_precision) == (0.0, 0.5, 0.5, 0.25)
    neg = spark.createDataFrame([("q", "p2"), ("q", "p4")], "query_id string, doc_id string")
    s = D.sibling_stats(gold, neg, of).first()
    assert (s.n_docs, s.multi_docs, s.siblings, s.sibling_negatives) == (2, 1, 2, 1)
    assert [r.doc_id for r in D.pid_orphans(of.select("doc_id"), of.where("did = 'A'")).collect()] == ["p4"]


def pairs(spark, diffs):
    return spark.createDataFrame([(f"q{i:02}", "m", 0.0, d, d) for i, d in enumerate(diffs)], "query_id string, metric string, a double, b double, d double")


def test_comparison(spark):
    p = pairs(spark, [0.1, 0.2, -0.1, 0.0, 0.3])
    s = S.pair_summary(p).first()
    assert (s.win, s.loss, round(s.tie, 9), round(s.delta, 9)) == (0.6, 0.2, 0.2, 0.1)
    ci = S.bootstrap_ci(p, 300).first()
    assert ci.ci_low <= 0.1 <= ci.ci_high
    assert 0 < S.permutation_p(p, 300).first().p <= 1
    w = S.wilcoxon(p).first()
    assert (w.n, w.t_plus, w.t_minus) == (4, 8.5, 1.5)
    none = S.wilcoxon(pairs(spark, [0.0, 0.0])).first()
    assert none.z is None and S.two_sided_p(none.z) == 1.0 and round(S.two_sided_p(-1.959964), 4) == 0.05


def test_corpus_stats(spark):
    lengths = spark.createDataFrame([(1,), (2,), (3,), (10,), (50,)], "n int")
    row = D.corpus_stats(lengths, max_seq=10, length=F.col("n")).first()
    assert (row.p50, row.p90, row.p95, row.p99) == (3, 34, 41, 48)
    assert row.pct_over_max == 0.2 and round(row.truncation_loss, 6) == round(40 / 66, 6)
    assert D.needs_chunking(D.corpus_stats(lengths, 10, F.col("n"))).first()[0]
    assert not D.needs_chunking(D.corpus_stats(lengths, 100, F.col("n"))).first()[0]


def test_gold_rank_of_ties(spark):
    rows = spark.createDataFrame([("q", "g", 1, 2.0), ("q", "a", 0, 2.0), ("q", "b", 0, 2.0), ("q", "c", 0, 3.0), ("q", "d", 0, 0.0)], "query_id string, doc_id string, gold int, score double")
    row = D.gold_ranks(rows, ["query_id"]).first()
    assert row["rank"] == 3.0 and not row.zero


def test_pools(spark):
    gold = labels(spark, [("q", "a", 1), ("r", "b", 1)])
    neg = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, doc_id string")
    assert {(r.query_id, r.doc_id, r.gold) for r in D.pools(gold, neg).collect()} == {("q", "a", 1), ("q", "c", 0)}
    assert [(r.query_id, r.pool_size) for r in D.pool_sizes(gold, neg).collect()] == [("q", 3)]


def test_rag(spark):
    queries = spark.createDataFrame([("q", "Why?"), ("r", "What?")], "query_id string, query string")
    corpus = spark.createDataFrame([("a", "A text"), ("b", "B text")], "doc_id string, text string")
    hits = spark.createDataFrame([("q", "b", 1.0, 1), ("q", "a", 0.5, 2)], "query_id string, doc_id string, score double, rank int")
    asked = rag.prompts(queries, hits, corpus)
    row = asked.first()
    assert row.prompt == f"Question: Why?\n\n{rag.EXCERPTS_HEADING}\n[doc_id: b]\nB text\n\n[doc_id: a]\nA text\n\n{rag.CLOSING}" and row.retrieved == ["b", "a"]
    got = {r.query_id: r for r in rag.answer(queries, asked, lambda p: {"answer": str(len(p)), "citations": [{"doc_id": "a", "quote": "A"}, {"doc_id": "z", "quote": "no"}]}).collect()}
    assert got["r"].answer == rag.NOTHING_FOUND and [c.doc_id for c in got["q"].citations] == ["a"]
    assert rag.short_quote("x" * 160) == "x" * 160 and rag.short_quote("x" * 161) == "x" * 157 + "..."


@pytest.mark.parametrize("limit,want", [(None, ["a", "b"]), (1, ["b"])])
def test_first_queries(spark, limit, want):
    queries = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "query_id string, q_ord long")
    got = E.first_queries(labels(spark, [("a", "x", 1), ("b", "x", 1)]), queries, limit)
    assert sorted(r.query_id for r in got.collect()) == want


def test_reports(spark):
    p = pairs(spark, [0.1, -0.1, 0.3])
    text = reports.comparison_report(S.pair_summary(p).join(S.bootstrap_ci(p, 50), "metric").join(S.permutation_p(p, 50), "metric"), "a", "b")
    assert text.startswith("a -> b\nm: 0.0000 -> 0.1000 (+0.1000) [") and "win 66.7% / loss 33.3%" in text
    means = spark.createDataFrame([("ndcg@10", 0.5, 3)], "metric string, value double, n_queries long")
    assert reports.retrieval_report(means) == "Queries: 3\nNDCG@10: 0.5000"
    assert reports.display_metric("map@5") == "MAP@5"
    stats = D.corpus_stats(spark.createDataFrame([(1,), (600,)], "n int"), 512, F.col("n"))
    assert "pct_over_max: 50.0%" in reports.table_report(stats, "Corpus")
    with pytest.raises(ValueError):
        reports.table_report(spark.range(300), "x")


def test_fisher(spark):
    rows = [(run, f"q{i}", "m", v + (0.2 if run == "b" else 0.0)) for run in "abc" for i, v in enumerate([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])]
    got = {(r.run_a, r.run_b): r for r in S.fisher_p(spark.createDataFrame(rows, "run string, query_id string, metric string, value double"), 500).collect()}
    assert got["a", "b"].significant and not got["a", "c"].significant and len(got) == 3


def test_comparison_in_one_call(spark):
    rows = [(run, f"q{i}", "m", v + (0.2 if run == "b" and i != 3 else 0.0)) for run in "ab" for i, v in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])]
    row = S.compare_pair(spark.createDataFrame(rows, "run string, query_id string, metric string, value double"), "a", "b", 400).first()
    assert (row.n, round(row.delta, 9), row.win, row.loss) == (5, 0.16, 0.8, 0.0) and row.ci_low <= 0.16 <= row.ci_high and 0 < row.p <= 1 and 0 < row.wilcoxon_p <= 1


def test_tails():
    # Quantiles of Student's t and of the studentized range from printed tables.
    for t, freedom in ((2.228, 10), (2.776, 4), (1.96, 100_000), (12.706, 1)):
        assert abs(S.student_p(t, freedom) - 0.05) < 2e-4
    for q, runs, freedom in ((3.88, 3, 10), (4.33, 4, 10), (3.58, 3, 20), (2.77, 2, 100_000)):
        assert abs(S.studentized_range_p(q, runs, freedom) - 0.05) < 1e-3
    assert S.student_p(None, 3) is None


def test_tests_of_all_pairs(spark):
    noise = [0.01, -0.02, 0.03, 0.0, -0.01, 0.02, -0.03, 0.01]
    rows = [(run, f"q{i}", "m", 0.1 * i + shift + e * k) for k, (run, shift) in enumerate((("a", 0.0), ("b", 0.0), ("c", 0.3))) for i, e in enumerate(noise)]
    metrics = spark.createDataFrame(rows, "run string, query_id string, metric string, value double")
    for test in (S.student_test, S.tukey_test):
        got = {(r.run_a, r.run_b): r for r in test(metrics).collect()}
        assert len(got) == 3 and got["a", "c"].significant and got["b", "c"].significant and not got["a", "b"].significant
    same = S.tukey_test(metrics.where("run <> 'b'").withColumn("value", F.lit(1.0))).first()
    assert same.p is None and not same.significant


def test_assistant(spark):
    class Two:
        def search(self, queries, limit):
            return queries.where("query_id = 'q'").selectExpr("query_id", "'b' doc_id", "1.0D score", "1 rank")

    queries = spark.createDataFrame([("q", "Why?"), ("r", "What?")], "query_id string, query string")
    corpus = spark.createDataFrame([("b", "B text")], "doc_id string, text string")

    def generate(model, messages, temperature, max_tokens):
        return {"answer": f"{model} {messages[0]['role']} {messages[1]['content'][:14]} {temperature} {max_tokens}", "citations": []}

    got = {r.query_id: r for r in rag.Assistant(Two(), corpus, generate, "m", "Cite the excerpts.").ask(queries).collect()}
    assert got["q"].answer == "m system Question: Why? 0.1 4096" and got["r"].answer == rag.NOTHING_FOUND


def test_lengths_by_a_tokenizer(spark):
    corpus = spark.createDataFrame([("a b",), (None,), ("c",)], "text string")
    lengths = D.token_lengths(corpus, lambda: lambda texts: [len(t.split()) + 2 for t in texts])
    row = D.corpus_stats(lengths, length=F.col("len")).first()
    assert (row.n_docs, row.total, row.max) == (3, 9, 4)


def test_shown_shares_add_up(spark, monkeypatch):
    """As in its SQL, ties are what is left of 1 by the shown wins and losses."""
    from sextant.plans import queries

    monkeypatch.setattr(queries, "_pairs", lambda r: pairs(spark, [0.1, -0.1, 0.0]))
    row = queries.pairwise_stats(None).first()
    assert (row.win, row.loss, row.tie) == (0.333333, 0.333333, 0.333334)
