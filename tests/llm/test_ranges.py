"""Hot groups dealt over tasks: one long conversation, many equal rows, short texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, huffman, packing, sharding

TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("long_text", ["", "word and more of it <|x|> \\ " * 2000])
def test_one_long_conversation(spark, long_text):
    rows = [(7, t, "assistant" if t % 3 else "user", f"turn {t % 50}" + long_text * (t == 11)) for t in range(600)]
    rows += [(None, 0, "assistant", "null conversation"), (8, 0, "user", "q"), (8, 1, "assistant", "a"), (9, None, "assistant", "a"), (9, None, "assistant", "a")]
    segments = chat.expand_prefix_targets(spark.createDataFrame(rows, TURNS).repartition(6)).cache()
    own = sorted(segments.where("conv_id = 7").collect(), key=lambda r: r.segment)
    assert [r.segment for r in own] == list(range(600))
    assert [r.example for r in own if r.example is not None] == list(range(400))
    at = 0
    for r in own:
        assert r.start == at
        at += len(r.text)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    examples = chat.render_examples(segments.where("conv_id = 7 and segment < 60 or conv_id <> 7")).collect()
    short = {r.conv_id: r for r in chat.read_back(segments.where("conv_id = 7 and segment < 60 or conv_id <> 7")).collect()}
    for conv in (7, 8, 9):
        lines = "".join(f"{e.example}:{len(e.text)}:{e.loss_start}:{e.loss_end}:{hashlib.sha256(e.text.encode()).hexdigest()}\n" for e in sorted((e for e in examples if e.conv_id == conv), key=lambda e: e.example))
        assert short[conv].examples_sha256 == hashlib.sha256(lines.encode()).hexdigest()
    assert got[7].n_turns == 600 and got[7].n_examples == 400 and got[None].n_examples == 1 and got[9].n_turns == 2


def test_a_broken_stream_is_an_error(spark):
    segments = chat.expand_prefix_targets(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], TURNS))
    for broken in (segments.where("segment = 1"), segments.withColumn("loss_end", F.col("loss_end") - 1)):
        with pytest.raises(Exception, match="a segment does not follow|does not end with its reply"):
            chat.read_back(broken).collect()


def test_short_documents_fill_sequences(spark):
    rows = [(i, 0, n, i, n) for i, n in enumerate([1] * 3000 + [10] * 700 + [33] * 150 + [2048] * 3)]
    got = packing.harmonic_pack(spark.createDataFrame(rows, packing.PIECES).repartition(3)).toPandas()
    assert sorted(got.doc_id) == list(range(len(rows)))
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    got = got.sort_values(["sequence_id", "offset"])
    used = got.groupby("sequence_id").length
    assert (used.cumsum() - got.length == got.offset).all() and used.sum().max() <= 2048


def test_equal_pieces_and_null_ids(spark):
    rows = [(None, 0, 1, 5, 1)] * 4000 + [(i, 0, 700, i, 700) for i in range(9)]
    got = packing.harmonic_pack(spark.createDataFrame(rows, packing.PIECES).repartition(4), bucket_rows=50).toPandas()
    assert len(got) == len(rows) and not got.duplicated(["sequence_id", "offset"]).any()


def test_equal_rows_in_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_COPIES", 7)
    rows = [(None, "t")] * 40 + [(3, "x")] * 25 + [(3, "y"), (None, None), (4, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 5).toPandas()
    assert len(got) == len(rows)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_codes_of_long_documents(monkeypatch):
    """Offsets beyond 32 bits are kept in 64: the switch is tried at a small size."""
    ids = np.random.default_rng(2).integers(0, 500, 5000).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=huffman.ID_VALUES))
    codes, counts = huffman.canonical_codes(lengths), np.array([4000, 1000])
    narrow = huffman.encode_batch(ids, counts, lengths, codes)
    monkeypatch.setattr(huffman, "LIMIT", 2**31)
    wide = huffman.encode_batch(ids, counts, lengths, codes)
    assert narrow[0] == wide[0] and wide[2].dtype == np.int64 and (narrow[2] == wide[2]).all()


def test_one_doc_id_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(huffman, "SIDE_BYTES", 100)
    rows = [(None, np.full(300 + i % 7, i % 90, "<u2").tobytes()) for i in range(200)] + [(5, np.array([1, 2], "<u2").tobytes())]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/one-id"
    huffman.write_ids(spark.createDataFrame(rows, "doc_id bigint, ids binary").repartition(5), path)
    got = sorted(huffman.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 200 + [5]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
