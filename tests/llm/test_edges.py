"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, decontam, dedup, huffman, packing, pages, pii, quality, secrets, sharding
from sextant.llm.tokens import vocabulary_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["rep", "path", "key", "k", "bin", "bucket", "doc", "row_key", "rank", "items", "hits", "label", "size", "law", "base", "of_email", "print", "held", "score"]
LONG = "word and other words " * 20_000 + "x" * 50_000
ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "one", "en", None, 3), (5, "Two words", None, "s", 9), (6, LONG, "en", "s", len(LONG)), (7, "same text here", "en", "s", 14), (7, "same text here", "en", "s", 14), (8, "same text here", "en", "s", 14), (None, "same text here", "en", "s", 14), (9, "é😀 日本語 \x00\x1c a@b.co", "fr", "s", 1), (2**62 + 1, "big id", "en", "s", 6)]


def _labels(spark, rows=((4, 1, 0), (5, 0, 0), (None, 1, None), (7, None, 0), (99, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def _items(spark, rows=((1, "Same text, here"), (2, None), (3, ""), (4, "...."))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


OPERATORS = {
    "dedup": lambda s, d: dedup.near_duplicates(d),
    "pii": lambda s, d: pii.find_personal_data(d),
    "quality": lambda s, d: quality.quality_rules(d, _labels(s)),
    "sharding": lambda s, d: sharding.shard_documents(d),
    "huffman": lambda s, d: huffman.encode_documents(d, vocabulary_path()),
    "decontam": lambda s, d: decontam.find_contamination(d, _items(s)),
    "decontam by joins": lambda s, d: decontam.find_contamination(d, _items(s), block_words=1),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "sanitised": lambda s, d: pii.sanitised(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((r[0] is None, r[0]) for r in ROWS)
    wide = docs.withColumns({c: F.lit("clash") for c in CLASH})
    again = OPERATORS[name](spark, wide)
    if name == "sanitised":
        again = again.select(*docs.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("clash") for c in CLASH})
    got = packing.pack_documents(docs, vocabulary_path()).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert packing.pack_documents(docs.limit(0), vocabulary_path()).count() == 0
    assert all(r.length == 1 for r in got if r.doc_id in (1, 2, 3))


def test_filters_keep_columns(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("clash") for c in CLASH})
    one = dedup.one_of_each(docs, 5, 80)
    assert one.columns == docs.columns
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(7) == 1 and 8 not in ids and None in ids and {1, 2, 3} <= set(ids)
    clean = decontam.drop_contaminated(docs, _items(spark))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, 5, 6, 9, 2**62 + 1}
    joined = decontam.drop_contaminated(docs, _items(spark), block_words=1)
    assert joined.columns == docs.columns and sorted(map(str, joined.collect())) == sorted(map(str, clean.collect()))
    good = quality.keep_good(docs, _labels(spark, ()))
    assert good.columns == docs.columns and good.count() == 0  # all too short, or repeating
    for f in (lambda d: dedup.one_of_each(d), lambda d: decontam.drop_contaminated(d, _items(spark, ())), lambda d: quality.keep_good(d, _labels(spark, ()))):
        assert f(docs.limit(0)).count() == 0


def test_texts_of_one_doc_id(spark):
    """A copy of another document takes no other text of its doc_id with it."""
    words = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcd"]
    rows = [(3, words[0], "x"), (5, words[0], "x"), (5, words[1], "x"), (5, words[1], "x"), (5, words[2], "y"), (6, words[2], "y"), (7, None, "n"), (7, "", "n"), (7, "", "n"), (None, words[0], "z"), (8, words[3] + " tail", "w"), (8, words[3], "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string").withColumns({c: F.lit("clash") for c in ("part", "own", "row", "first", "h")})
    one = dedup.one_of_each(docs)
    assert one.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or str(r.text)) for r in one.collect())
    tails = [g for g in got if g[0] == 8]
    assert len(tails) == 1 and tails[0][1] in (words[3], words[3] + " tail")
    assert [g for g in got if g[0] != 8] == sorted([(0, words[0]), (3, words[0]), (5, words[1]), (5, words[2]), (7, ""), (7, "None")])


def test_dedup_values(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(spark.createDataFrame(ROWS, DOCS)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 5, True), (7, 2, 7, True), (8, 2, 7, False)} <= rows


def test_conversations(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", ""), (2, None, "user", "<|end|>\\"), (None, 0, "assistant", "<|assistant|>\n\\<\\|"), (3, 5, "a|>\n<|b", "t")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("clash") for c in ("segment", "start", "example", "head_chars")})
    segments = chat.expand_prefix_targets(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert {k: (v.n_turns, v.loss_chars) for k, v in got.items()} == {1: (3, 0), 2: (1, 0), None: (1, 18), 3: (1, 0)}
    assert chat.read_back(chat.expand_prefix_targets(turns.limit(0))).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>" * 3000), (4, "u", "no tags"), (None, "u", "<article><p>Text &amp; more.<br>Line</p></article>"), (5, "u", "<article><p>" + LONG + "</p></article>"), (5, "u", "<article><p>" + LONG + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars")})
    got = pages.extract_main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[None].text == "Text & more. Line" and by[1].text == "" and by[1].url is None
    assert by[5].n_chars == len(" ".join(LONG.split()))
    assert pages.extract_main_text(df.limit(0)).count() == 0
