"""The store's segments: what a write costs, failures half way, merges, compaction and removal; and the progress of encoders."""

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sextant.sources import store
from sextant.sources.encoders import Slot

SCHEMA = "id long, text string, v double, version long"


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def held(points):
    return {r.id: (r.text, r.v, r.version) for r in points.read().collect()}


@pytest.fixture
def points(spark, tmp_path):
    p = store.PointStore(spark, f"file://{tmp_path}/c")
    p.ensure(rows(spark, []).schema, slots=[], buckets=4)
    return p


def test_bytes_follow_the_batch(spark, points, tmp_path):
    spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"), F.rand(1).alias("v"), F.lit(1).cast("long").alias("version")).createOrReplaceTempView("big")
    points.upload(spark.table("big"))
    whole = size(tmp_path)
    for batch in ([(5, "new", 0.5, 2)], [(-1, "other", 0.1, 1), (7, "x", 0.2, 3)]):
        before = size(tmp_path)
        points.upload(rows(spark, batch), skip_existing=False, version="version")
        assert size(tmp_path) - before < whole / 200
    before = size(tmp_path)
    points.add_slot(Slot("w", "m", "sparse", "ngram"), "double")
    points.backfill("w", spark.createDataFrame([(9, 1.5), (123_456, 2.0)], "id long, w double"))
    assert size(tmp_path) - before < whole / 200
    assert points.count() == 100_001
    got = {r.id: r for r in points.read().where("id in (5, 7, 9, -1)").collect()}
    assert (got[5].text, got[7].text, got[9].w, got[-1].text) == ("new", "x", 1.5, "other") and got[5].w is None


def test_only_the_batch_s_buckets_are_looked_at(spark, points):
    points.upload(rows(spark, [(i, "a", 0.0, 1) for i in range(40)]))
    c = points._current()
    plan = points._merged(c, ["id"], [2])._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "PartitionFilters: [isnotnull(_bucket" in plan and "text" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_a_write_that_fails_half_way(spark, points, monkeypatch):
    points.upload(rows(spark, [(1, "a", 0.0, 1)]))
    whole = held(points)
    monkeypatch.setattr(store.PointStore, "_point", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        points.upload(rows(spark, [(1, "b", 0.0, 2), (2, "c", 0.0, 1)]), skip_existing=False)
    monkeypatch.undo()
    assert held(points) == whole
    orphans = [n for n, _ in points._names() if n.startswith("rows-")]
    assert points.vacuum() == 0 and len([n for n, _ in points._names() if n.startswith("rows-")]) == len(orphans)  # perhaps a writer at work
    assert points.vacuum(orphan_hours=-1) == 1 and held(points) == whole


def test_any_writes_against_a_dictionary(spark, points, monkeypatch):
    monkeypatch.setattr(store, "FANOUT", 3)
    rng, want = random.Random(4), {}
    points.add_slot(Slot("w", "m", "sparse", "ngram"), "double")
    want = {}
    for step in range(12):
        batch = {rng.randrange(30): (f"t{step}", float(step), rng.randrange(9)) for _ in range(rng.randrange(1, 12))}
        items = rows(spark, [(k, *v) for k, v in batch.items()])
        how = rng.choice(["skip", "replace", "version", "fill", "fill"])
        if how == "fill":
            points.backfill("w", spark.createDataFrame([(k, float(step)) for k in batch], "id long, w double"))
            want.update({k: want[k][:3] + (float(step),) for k in batch if k in want})
            continue
        points.upload(items, skip_existing=how == "skip", version="version" if how == "version" else None)
        for k, v in batch.items():
            if k not in want or how == "replace" or how == "version" and v[2] >= want[k][2]:
                want[k] = (*v, None)
        if step == 7:
            points.compact()
            assert len(points._current().segments) == 1
    assert {r.id: (r.text, r.v, r.version, r.w) for r in points.read().collect()} == want and points.count() == len(want)
    assert len(points._current().segments) < 9
    points.vacuum()
    assert {r.id: (r.text, r.v, r.version, r.w) for r in points.read().collect()} == want
    assert len(points._numbers()) == 1
    points.compact()
    assert {r.id: (r.text, r.v, r.version, r.w) for r in points.read().collect()} == want


def test_keys_and_types(spark, points):
    with pytest.raises(Exception, match="a point without a key"):
        points.upload(rows(spark, [(None, "a", 0.0, 1)]))
    with pytest.raises(TypeError, match="v is double"):
        points.upload(spark.createDataFrame([(1, "x")], "id long, v string"))
    with pytest.raises(ValueError, match="points go by id"):
        points.upload(spark.createDataFrame([("x",)], "name string"), key="name")
    points.upload(spark.createDataFrame([(1, "x")], "id long, more string"))  # a new column
    assert [(r.id, r.text, r.more) for r in points.read().collect()] == [(1, None, "x")]
    points.upload(rows(spark, []))
    assert points.count() == 1


def encoder(path, fails=()):
    """Lengths of texts; writes what it is asked to the folder, and fails on some texts."""

    def apply(frames):
        for frame in frames:
            for t in frame["text"]:
                if t in fails:
                    raise RuntimeError("the service is down")
                Path(path, f"{t}-{threading.get_ident()}-{random.random()}").touch()
            yield frame.assign(vec=[[float(len(t))] for t in frame["text"]])[["item_id", "vec"]]

    return lambda items: items.mapInPandas(apply, "item_id string, vec array<float>")


def test_an_encoder_that_fails_near_the_end_is_called_for_the_rest_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "AT_A_TIME", 1)
    cache = store.EmbeddingCache(spark, f"file://{tmp_path}/cache")
    items = spark.createDataFrame([(str(i), f"text{i}") for i in range(40)], "item_id string, text string")
    # The text that fails is in the last of four chunks.
    last = items.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(4))).where("chunk = 3").first().text
    asked = [tmp_path / "one", tmp_path / "two"]
    for a in asked:
        a.mkdir()
    with pytest.raises(Exception, match="the service is down"):
        cache.fill("m", "dense", items, encoder(str(asked[0]), {last}), chunk_items=10)
    kept = {r.item_id for r in cache.load("m", "dense").collect()}
    assert 20 <= len(kept) < 40
    got = cache.fill("m", "dense", items, encoder(str(asked[1])), chunk_items=10).collect()
    assert len(got) == 40 and all(r.vec == [float(len(f"text{r.item_id}"))] for r in got)
    again = {f.name.split("-")[0] for f in asked[1].iterdir()}
    assert again == {f"text{i}" for i in range(40)} - {f"text{k}" for k in kept}


def test_chunks_side_by_side(spark, tmp_path):
    cache = store.EmbeddingCache(spark, f"file://{tmp_path}/cache")
    items = spark.createDataFrame([(str(i), f"text{i}") for i in range(60)] + [(None, "x"), ("y", None)], "item_id string, text string")
    (tmp_path / "a").mkdir()
    assert cache.fill("o/m", "dense", items, encoder(str(tmp_path / "a")), chunk_items=7).count() == 60
    assert cache.load("o/m", "dense").count() == 60
