"""Text and vector functions against hand-checked values."""

import zlib

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions import vectors as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("See 958 F.2d 15, § 512(k).", ["see", "958", "f.2d", "15", "§", "512(k)"]),
        ("Don't stop... v. U.S.C. §§", ["don", "t", "stop", "v", "u.s.c", "§§"]),
        ("U.S. e.g. -x (a) 3.", ["u.s", "e.g", "x", "a)", "3"]),
        ("a_b c", ["a", "b", "c"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(F.col("t")), t=text) == tokens


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.ngrams(F.col("t"), 3)).collect()] == [["a", "b", "c", "a_b", "b_c", "a_b_c"], ["a"], []]
    structs = df.select(T.gram_structs(F.col("t"), 2)).first()[0]
    assert [(s.gram, s.n) for s in structs] == [("a", 1), ("b", 1), ("c", 1), ("a_b", 2), ("b_c", 2)]


@pytest.mark.parametrize("gram", ["hello", "the_statute", "§_512(k"])
def test_gram_hash(spark, gram):
    assert one(spark, T.gram_hash(F.col("g")), g=gram) == zlib.crc32(gram.encode())


def test_entities(spark):
    text = "See 17 U.S.C. §§ 512(k), 958 F.2d 15; 112 Stat. 2877 and 100 F. Supp. 2d 33 in Doe v.  Roe\n(§ 512(d)). O’Neil v. McDonald's"
    got = set(one(spark, T.entities(F.col("t")), t=text))
    assert {"usc:17 u.s.c. §§ 512(k)", "reporter:958 f.2d 15", "reporter:112 stat. 2877", "reporter:100 f. supp. 2d 33", "section:§ 512(d)).", "case:doe v. roe", "case:o’neil v. mcdonald's"} <= got
    assert "reporter:958 f.2d 15" in one(spark, T.entities(F.col("t")), t="958 F.2d 15")


def test_words_and_quotes(spark):
    assert one(spark, T.word_count(F.col("t")), t=" a b\tc  ") == 3
    assert [one(spark, T.has_quote(F.col("t")), t=t) for t in ('a "b"', "“x", "it's")] == [True, True, False]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8])], "a array<float>, b array<float>")
    assert round(df.select(V.cosine(F.col("a"), F.col("b"))).first()[0], 6) == 0.6
    q, d = [[1.0, 0.0], [0.0, 1.0]], [[0.6, 0.8], [0.8, 0.6], [1.0, 0.0]]
    df = spark.createDataFrame([(q, d), ([[1.0, 0.0]], [[0.6, 0.8]])], "q array<array<float>>, d array<array<float>>")
    assert [round(r[0], 6) for r in df.select(V.maxsim(F.col("q"), F.col("d"))).collect()] == [1.8, 0.6]
