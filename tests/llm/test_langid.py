"""Language profiles against a plain loop over letters, and on held-out documents."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.llm import langid
from sextant.llm.words import Texts

SF = "/root/testdata/sf0.01"


def bundle(text, dimensions, order):
    """Letter by letter, n-gram by n-gram."""
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    letters = " ".join(["", *letters.split(), ""]) if letters.split() else " "
    vector = {c: langid.letter_vectors(np.array([0 if c == " " else ord(c)]), dimensions)[0].astype(int) for c in set(letters)}
    total = np.zeros(dimensions, dtype=int)
    for i in range(len(letters) - order + 1):
        bound = np.ones(dimensions, dtype=int)
        for j in range(order):
            bound = bound * np.roll(vector[letters[i + j]], order - 1 - j)
        total += bound
    return total


TEXTS = ["", None, "a", "Ab ab", "no  1 letters: 42", "123 !?", "日本語", "ÉCOLE éc", "ſİß", "x" * 3000, "\x00a\x00", " led and followed "]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_bundles(order):
    texts = Texts.of(pa.array(TEXTS))
    grams = langid.grams_of(texts, 64, order)
    got = grams.bundles(grams.text, len(TEXTS))
    for i, t in enumerate(TEXTS):
        assert (got[i] == bundle(t, 64, order)).all(), t
    part = grams.of(3, 7)
    assert (part.bundles(part.text, 4) == got[3:7]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abÄ é1\n日😀")), max_size=9), min_size=1, max_size=6))
def test_any_batch(texts):
    grams = langid.grams_of(Texts.of(pa.array(texts)), 16, 3)
    assert (grams.bundles(grams.text, len(texts)) == np.array([bundle(t, 16, 3) for t in texts])).all()


def test_vectors_are_nearly_orthogonal():
    v = langid.letter_vectors(np.arange(200), 1024).astype(float)
    cosine = v @ v.T / 1024
    assert set(np.unique(v)) == {-1, 1} and np.abs(cosine - np.eye(200)).max() < 0.2


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_of(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and 150 < got.held_out.sum() < 350
    unseen = got[got.held_out]
    assert (unseen.lang == unseen.lang_pred).mean() >= 0.99
    assert got.score.between(0, 1).all()
    # Neither lang nor source nor doc_id of a held-out row has a say, and rows of others don't depend on it.
    hidden = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(str, langid.language_of(hidden).collect())) == sorted(map(str, langid.language_of(docs.repartition(7)).collect()))


def test_edges(spark):
    rows = [(i, f"le chat et la souris {i}", "fr") for i in range(1, 40)] + [(i, f"the cat and the mouse {i}", "en") for i in range(40, 80)]
    rows += [(None, "the cat", None), (None, None, "en"), (7, "le chat", "fr"), (7, "le chat", "fr"), (90, "", "fr"), (91, "42 -- !", "zz"), (92, "the mouse " * 40_000, None), (93, "\x00", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("clash") for c in ("v", "d", "x", "score", "lang_pred")})
    got = langid.language_of(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[90].lang_pred == by[91].lang_pred == by[93].lang_pred == "und" and by[91].score == 0
    assert by[92].lang_pred == "en" and by[7].lang_pred == "fr"
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == ["en", "und"]
    assert langid.language_of(docs.limit(0)).count() == 0
    nothing = langid.language_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    with pytest.raises(ValueError, match="1 to 3 letters"):
        langid.learn(docs, order=4)


def test_equal_prototypes_go_to_the_first(spark):
    rows = [(1, "same words", "b"), (3, "same words", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs)).collect()} == {"a"}
