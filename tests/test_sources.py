"""Ingestion, the store, the cache, encoders and streams."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sextant.operators.search import warm_up
from sextant.sources import encoders, ingest, staging, store
from sextant.streaming.upsert import upsert_stream


def test_ingest(spark, tmp_path):
    p = lambda *ids: [{"docid": i, "text": t} for i, t in ids]
    rows = [
        {"row_id": 0, "query_id": "q1", "query": "old", "positive_passages": p(("a", "first")), "negative_passages": p(("b", "neg first"))},
        {"row_id": 1, "query_id": "q2", "query": "two", "positive_passages": p(("b", "second b")), "negative_passages": p(("b", "second b"))},
        {"row_id": 2, "query_id": "q1", "query": "new", "positive_passages": p(("c", "x"), ("c", "y")), "negative_passages": []},
    ]
    path = tmp_path / "rows.json"
    path.write_text("\n".join(map(json.dumps, rows)) + '\n["not", "a", "row"]\n{"row_id": 9}\n')
    got = ingest.read_rows(spark, str(path)).cache()
    assert got.count() == 3 and ingest.read_rows(spark, str(path), 2).count() == 2
    assert {(r.doc_id, r.text) for r in ingest.corpus_of(got).collect()} == {("a", "first"), ("b", "neg first"), ("c", "x")}
    assert {(r.query_id, r.query, r.q_ord) for r in ingest.queries_of(got).collect()} == {("q1", "new", 0), ("q2", "two", 1)}
    assert {(r.query_id, r.doc_id) for r in ingest.qrels_of(got).collect()} == {("q1", "c"), ("q2", "b")}
    assert {(r.query_id, r.doc_id) for r in ingest.negatives_of(got).collect()} == {("q2", "b")}


def test_pid2did(spark, tmp_path):
    (tmp_path / "map.tsv").write_text("p1\td1\np2\td1\np3\td2\n")
    only = spark.createDataFrame([("p3",), ("p9",)], "doc_id string")
    assert [(r.doc_id, r.did) for r in ingest.read_pid2did(spark, str(tmp_path / "map.tsv"), only).collect()] == [("p3", "d2")]


def test_store(spark, tmp_path):
    points = store.PointStore(spark, f"file://{tmp_path}/c")
    assert not points.exists()
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    points.ensure(a.schema)
    points.upload(a)
    points.ensure(a.schema)  # nothing happens
    points.upload(spark.createDataFrame([(2, "new"), (3, "z")], "id long, text string"))
    assert {(r.id, r.text) for r in points.read().collect()} == {(1, "x"), (2, "y"), (3, "z")}
    points.upload(spark.createDataFrame([(2, "new")], "id long, text string"), skip_existing=False)
    assert {(r.id, r.text) for r in points.read().collect()} == {(1, "x"), (2, "new"), (3, "z")}
    points.add_slot(encoders.Slot("bm", "own", "sparse", "ngram"), "double")
    points.backfill("bm", spark.createDataFrame([(1, 0.5)], "id long, bm double"))
    assert {r.id: r.bm for r in points.read().collect()} == {1: 0.5, 2: None, 3: None} and points.count() == 3
    with pytest.raises(ValueError):
        points.backfill("no", a)
    with pytest.raises(TypeError):
        points.upload(spark.createDataFrame([(1.5,)], "id double"))
    points.ensure(a.schema, recreate=True)
    assert points.count() == 0


def test_cache(spark, tmp_path):
    cache = store.EmbeddingCache(spark, f"file://{tmp_path}/cache")
    items = spark.createDataFrame([("1", "aa"), ("2", "bbb")], "item_id string, text string")
    encode = lambda rows: rows.select("item_id", F.array(F.char_length("text").cast("float")).alias("vec"))
    assert {r.item_id: r.vec for r in cache.fill("o/m", "dense", items, encode).collect()} == {"1": [2.0], "2": [3.0]}
    changed = spark.createDataFrame([("1", "aa"), ("2", "b")], "item_id string, text string")
    never = lambda rows: rows.select("item_id", F.array(F.lit(-1.0).cast("float")).alias("vec"))
    assert {r.item_id: r.vec for r in cache.fill("o/m", "dense", changed, never).collect()} == {"1": [2.0], "2": [-1.0]}


def test_slots():
    assert encoders.Slot("n", "own", "sparse", "ngram", options={"api_key": "k", "max_n": 3}).encoder_options() == {"max_n": 3, "k1": 1.5, "b": 0.75}
    assert encoders.Slot("d", "m", size=4, query_prompt="query: ").prompted("x") == "query: x"
    for bad in ({"kind": "dense", "backend": "ngram", "size": 3}, {"kind": "sparse", "backend": "http"}, {"kind": "dense"}, {"kind": "odd", "size": 1}):
        with pytest.raises(ValueError):
            encoders.Slot("s", "m", **bad)


def test_retry():
    waits, answers = [], iter([(503, None), (429, None), (200, "ok")])
    assert encoders.with_retry(lambda: next(answers), sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        encoders.with_retry(lambda: (400, None), sleep=waits.append)
    with pytest.raises(RuntimeError):
        encoders.with_retry(lambda: (500, None), attempts=3, sleep=waits.append)


def test_http_encoder():
    seen = []

    def post(model, texts):
        seen.append((model, len(texts)))
        return 200, [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))]

    assert encoders.HttpEncoder("p/m", post, 2, "p/").encode(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
    assert seen == [("m", 2), ("m", 1)]
    with pytest.raises(ValueError):
        encoders.HttpEncoder("m", lambda m, t: (200, [])).encode(["a"])


def test_encode_column(spark):
    rows = spark.createDataFrame([("1", "ab"), ("2", "")], "doc_id string, text string")

    def make():
        class Lengths:
            def encode(self, texts):
                return [[float(len(t))] for t in texts]

        return Lengths()

    assert {r.doc_id: r.vec for r in encoders.encode_column(rows, make, "lengths").collect()} == {"1": [2.0], "2": [0.0]}


def test_stream(spark, tmp_path):
    schema = "id long, text string, version long"
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).coalesce(1).write.parquet(str(source))
    points = store.PointStore(spark, f"file://{tmp_path}/s")
    run = lambda: upsert_stream(spark.readStream.schema(schema).parquet(str(source)), points, str(tmp_path / "cp")).awaitTermination(120)
    run()
    assert {(r.id, r.text) for r in points.read().collect()} == {(1, "b"), (2, "c")}
    spark.createDataFrame([(2, "d", 2)], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert {(r.id, r.text) for r in points.read().collect()} == {(1, "b"), (2, "d")}


def test_late_batches_and_equal_keys(spark, tmp_path):
    schema = "id long, text string, version long"
    points = store.PointStore(spark, f"file://{tmp_path}/late")
    points.ensure(spark.createDataFrame([], schema).schema)
    points.upload(spark.createDataFrame([(2, "b", 5), (2, "c", 4), (3, "x", 1)], schema))
    assert points.count() == 2
    points.upload(spark.createDataFrame([(2, "old", 3), (2, "older", 2), (3, "new", 2)], schema), skip_existing=False, version="version")
    assert {(r.id, r.version) for r in points.read().collect() if r.id == 3} == {(3, 2)} and points.read().where("text like 'old%'").count() == 0
    points.upload(spark.createDataFrame([(3, "y", 9), (3, "z", 9)], schema), skip_existing=False)
    assert [(r.id, r.text) for r in points.read().where("id = 3").collect()] == [(3, "z")]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    points = store.PointStore(spark, f"file://{tmp_path}/two")
    a = spark.createDataFrame([(1, "x")], "id long, text string")
    points.ensure(a.schema)
    before = points._current()
    points.upload(a)
    monkeypatch.setattr(store.PointStore, "_current", lambda self: before)
    with pytest.raises(Exception, match="(?i)exists"):
        points.upload(spark.createDataFrame([(2, "y")], "id long, text string"))
    monkeypatch.undo()
    assert [r.id for r in points.read().collect()] == [1]


def test_slots_of_a_collection(spark, tmp_path):
    points = store.PointStore(spark, f"file://{tmp_path}/slots")
    slot = encoders.Slot("v", "m", size=2)
    schema = spark.createDataFrame([], "id long, v array<float>").schema
    points.ensure(schema, slots=[slot])
    assert points.slots() == {"v": slot}
    points.ensure(schema, slots=[slot])
    with pytest.raises(ValueError):
        points.ensure(schema, slots=[encoders.Slot("v", "m", size=3)])
    with pytest.raises(ValueError):
        store.PointStore(spark, f"file://{tmp_path}/none").ensure(schema, slots=[encoders.Slot("w", "m", size=3)])
    with pytest.raises(Exception, match="slot v has 2 places"):
        points.upload(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], schema))
    points.upload(spark.createDataFrame([(1, [1.0, 2.0])], schema))
    assert points.count() == 1


def test_encoders_by_backend(spark, tmp_path):
    class Lengths:
        def encode(self, texts):
            return [[float(len(t)), 0.0] for t in texts]

    made = encoders.Encoders(sentence=lambda slot: Lengths())
    slot = encoders.Slot("v", "m", backend="sentence", size=2, distance="dot", query_prompt="ask: ")
    asked = spark.createDataFrame([("1", "ab"), ("2", "ab")], "query_id string, query string")
    assert [r.vec for r in made.queries(slot, asked).collect()] == [[7.0, 0.0]] * 2
    unit = encoders.Slot("u", "m", backend="sentence", size=2)
    assert made.documents(unit, spark.createDataFrame([("1", "abc"), ("2", "")], "doc_id string, text string")).where("vec[0] = 1").count() == 1
    with pytest.raises(ValueError):
        made.documents(encoders.Slot("h", "m", backend="http", size=1), asked)
    with pytest.raises(ValueError):
        encoders.Encoders(odd=lambda slot: Lengths())
    with pytest.raises(ValueError):
        encoders.Slot("h", "m", backend="http", size=1).api_key("NO_SUCH_VARIABLE", {})
    assert encoders.Slot("h", "m", backend="http", size=1).api_key("K", {"K": "v"}) == "v"
    cache = store.EmbeddingCache(spark, f"file://{tmp_path}/warm")
    for _ in range(2):
        assert {r.query: r.vec for r in warm_up(cache, slot, asked, Lengths).collect()} == {"ab": [7.0, 0.0]}


def test_shared_folder(spark):
    assert staging.place(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    def without(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, applicationId=master))

    assert staging.shared_dir(without("local[4]")) == staging.shared_dir(without("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            staging.shared_dir(without(master))
