"""Ranked search against plain Python, whatever the shards and blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(TERM, text or "")]


def plain(docs, items, k):
    counted = [(d, Counter(t), len(t)) for d, text in docs if (t := terms(text))]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, []).extend(terms(text))
    out = []
    for item, asked in queries.items():
        scored = []
        for doc_id, tf, length in counted:
            m = 75 + 25 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, i + 1, None if null else doc_id, -score) for i, (score, null, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


WORDS = ["the", "The", "of", "café", "CAFÉ", "日本", "x1", "a", "b", "rare"]


def _docs():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[:-1], int(rng.integers(1, 30))))) for i in range(300)]
    rows += [(1000 + i, "the same text, in copies") for i in range(150)]  # ties across shards
    rows += [(5, "repeated id: the of"), (5, "repeated id: the of"), (None, "the same text, in copies"), (None, None), (7, ""), (8, "... --- \n"), (9, "rare"), (2**62, "tail-rare; snake_case"), (10, "the " * 50_000)]
    return rows


ITEMS = [(1, "The same text"), (2, "rare words of CAFÉ"), (3, None), (4, ""), (5, "the the the of"), (6, "unknown"), (7, "日本, x1"), (7, "a b"), (None, "copies rare"), (8, "case")]


@pytest.mark.parametrize("shard_bytes, shard_docs, block_bytes", [(1 << 20, 1 << 16, 1 << 20), (300, 1 << 16, 1 << 20), (1 << 20, 7, 100)])
def test_against_plain_python(spark, shard_bytes, shard_docs, block_bytes):
    rows = _docs()
    clash = {c: F.lit("clash") for c in ("rank", "score", "item", "term", "terms", "h")}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns(clash)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumns(clash)
    index = lexical.build_index(docs, shard_bytes, shard_docs)
    for k in (1, 20, 1000):
        got = index.search(items, k, block_bytes=block_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows, ITEMS, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame(_docs(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.build_index(docs.limit(0)).search(items).count() == 0
    assert lexical.build_index(docs.where("text is null")).search(items).count() == 0
    assert lexical.build_index(docs).search(items.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-3, 3), st.booleans()), max_size=30), st.integers(1, 9))
def test_selection_keeps_ties(rows, k):
    scores, ids, nulls = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int64, bool)))
    got = [(rows[i][0], rows[i][2], rows[i][1]) for i in lexical.best(scores, ids, nulls, k)]
    assert got == [(s, n, i) for s, n, i in sorted(((s, n, i) for s, i, n in rows if s > 0), key=lambda r: (-r[0], r[1], r[2]))][:k]


def test_impacts_beyond_64_bits():
    length = np.array([10, 2**40], dtype=np.int64)
    got = lexical.impacts(np.array([3, 5]), length, 2**33, 2**50)
    assert got.tolist() == [10**9 * t // (1000 * t + 12 * (75 + 25 * n * 2**33 // 2**50)) for t, n in ((3, 10), (5, 2**40))]
