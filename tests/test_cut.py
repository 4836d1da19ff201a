"""Passages cut, counted and looked at in one pass, against the plain way."""

import random
from collections import Counter

import pytest

from sextant.operators import cut
from sextant.operators.counts import tokens_of
from sextant.operators.cut import cut_and_count
from sextant.plans import roles
from sextant.plans.queries import QUERIES
from sextant.plans.roles import _words

PIECES = ["the", "The", "ab.c", "§", "§12(a)", "12§..", "...", "((x", "-", "-.-9", "K", "Kelvin", "aKb", "İ", "xİ.", "ñé", "ña", "e.", "a.b..", "x\x0by", "\xa0", "z\xa0w", "日本", "()", "........7", "end.)", "\x00"]
BLANKS = [" ", "  ", "\n", "\t", "\r\n", "\f", " \n "]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) + rng.choice(BLANKS) for _ in range(rng.randrange(0, 40))) for _ in range(120)]
    return [*made, "", " ", "\n\n", "the", " the", None, "." * 50 + "a" + "." * 50, "§", "K"]


@pytest.mark.parametrize("held", [1, 200, 4_000_000])
def test_one_pass(spark, monkeypatch, held):
    monkeypatch.setattr(cut, "_HELD_TEXT", held)
    docs = [(str(i), t) for i, t in enumerate(texts())]
    passages = [(f"{i}_{c // 7}", i, " ".join(w[c : c + 7])) for i, w in ((i, _words(t or "")) for i, t in docs) for c in range(0, len(w), 7)]
    tokens = {p: tokens_of(t.lower()) for p, _, t in passages}
    grams = sorted({(t, 1) for some in tokens.values() for t in some if t[0] != "1"} | {(f"{a}_{b}", 2) for some in tokens.values() for a, b in zip(some, some[1:]) if b[0] != "e"})
    sought = [(f"q{k}", w, w.split(" ")[1]) for k, w in enumerate(dict.fromkeys(" ".join(t.split(" ")[k : k + 3])[k % 2 :] for _, _, t in passages for k in (0, 1, 4) if len(t.split(" ")) >= k + 3))]
    got = {r.doc_id: r for r in cut_and_count(spark.createDataFrame(docs, "did string, text string").repartition(3), 7, grams, sought).collect()}
    assert set(got) == set(tokens)
    for p, did, text in passages:
        r, own = got[p], tokens[p]
        counts = Counter(own) + Counter(f"{a}_{b}" for a, b in zip(own, own[1:]))
        assert (r.did, r.n_tokens) == (did, len(own))
        assert {grams[t][0]: n for t, n in zip(r.terms, r.tfs)} == {g: counts[g] for g, _ in grams if g in counts}
        assert sorted(r.labels) == sorted(i for i, s, a in sought if a in text.split(" ") and s in text)


def test_all_characters_that_lower_to_token_characters():
    own = set("abcdefghijklmnopqrstuvwxyz0123456789§.-()")
    assert {c for c in map(chr, range(128, 0x110000)) if c != "§" and own & set(c.lower())} == {c.decode() for c in cut._LOWERED}


@pytest.mark.parametrize("name", ["doc_level_diagnosis", "permutation_p", "rerank_ngram_bm25", "recall_at_10", "unique_doc_topk"])
def test_texts_of_passages_are_not_written(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(roles, "staged", lambda df, what, f=roles.staged: (written.append(df.columns), f(df, what))[1])
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert not [c for c in written if "text" in c] and sum("terms" in c for c in written) == 1
