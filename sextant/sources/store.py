"""A store of points (one row per document, one column per slot) and a cache of embeddings, as Parquet.

A write adds a segment, a folder of the batch alone dealt into buckets by the hash of the key, and then a pointer that lists all segments: bytes
written follow the batch, whatever the store holds.  Pointers are numbered and never overwritten: readers take the highest number, so they see all of
a write or nothing of it, a failed write changes nothing, and of two writers that started from the same pointer the second fails.

Rows carry the number of their write.  A read merges segments by it: of the rows of a key the last counts, and a slot that was filled
later than its row was written has the filled value.  Where several segments of about one size have come together they are rewritten as
one, so a row is rewritten a number of times that grows with the logarithm of the store.  `vacuum` removes what no pointer that is kept names.

A key is never null; that is an error.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .encoders import Slot
from .staging import place, staged


def latest(points: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The last version of each point."""
    own = Window.partitionBy(key).orderBy(F.col(version).desc())
    return points.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def one_each(items: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """One item of each key: the last version, or else, versions or none, the one that is last by its written form."""
    by = [F.col(version).desc()] if version else []
    own = Window.partitionBy(key).orderBy(*by, F.to_json(F.struct(*items.columns)).desc())
    return items.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n").select(*items.columns)


def new_points(items: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Items whose key the store does not have, one of each key; only the key column of the store is read."""
    return one_each(items.join(existing.select(key), key, "left_anti"), key)


def upserted(existing: DataFrame, items: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """The store after items, one of each key, replaced the points of the same key; with a version, only older points or equals."""
    items = one_each(items, key, version)
    if version:
        held = existing.select(key, F.col(version).alias("_held"))
        items = items.join(held, key, "left").where(F.col("_held").isNull() | (F.col(version) >= F.col("_held"))).select(*items.columns)
    return existing.join(items.select(key), key, "left_anti").unionByName(items, allowMissingColumns=True)


def backfilled(points: DataFrame, slot: str, values: DataFrame, key: str = "id") -> DataFrame:
    """Points with one slot filled from values (key, slot); other slots, and points without a value, stay."""
    filled = one_each(values.select(key, slot), key).select(key, F.col(slot).alias("_new"))
    joined = points.join(filled, key, "left")
    return joined.withColumn(slot, F.coalesce("_new", slot)).select(*points.columns)


#: Buckets of a store, by the hash of the key, and segments of about one size that are rewritten as one.
BUCKETS, FANOUT = 16, 6
#: Column names that segments have besides the points' own.
_SEQ, _BUCKET = "_seq", "_bucket"


@dataclass(frozen=True)
class Segment:
    """A folder of rows, or of one slot's values, from the writes `first` to `last`."""

    folder: str
    slot: str | None
    first: int
    last: int
    rows: int

    @property
    def tier(self) -> int:
        """Segments of one tier are within a factor of four."""
        return (self.rows.bit_length() + 1) // 2


@dataclass(frozen=True)
class Commit:
    """What a pointer says."""

    number: int
    key: str
    buckets: int
    schema: StructType
    slots: str
    segments: tuple[Segment, ...]


_POINTER = "key string, buckets int, schema string, slots string, segments string"


def _fields(schema: StructType, names: Iterable[str]) -> StructType:
    return StructType([schema[n] for n in names])


@dataclass
class PointStore:
    """A named collection of points under a folder."""

    spark: SparkSession
    path: str

    def _files(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list[tuple[str, int]]:
        """Names in the folder, and when they were changed (milliseconds)."""
        files, path = self._files()
        if not files.exists(path(self.path)):
            return []
        return [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(path(self.path))]

    def _numbers(self) -> list[int]:
        """Numbers of the pointers there are."""
        files, path = self._files()
        whole = [n for n, _ in self._names() if n.startswith("current-") and files.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("current-")) for n in whole)

    def exists(self) -> bool:
        return bool(self._numbers())

    def _read_pointer(self, number: int) -> Commit:
        row = self.spark.read.schema(_POINTER).parquet(f"{self.path}/current-{number}").first()
        segments = tuple(Segment(**x) for x in json.loads(row.segments))
        return Commit(number, row.key, row.buckets, StructType.fromJson(json.loads(row.schema)), row.slots, segments)

    def _current(self) -> Commit:
        """The newest pointer."""
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"no collection at {self.path}")
        return self._read_pointer(numbers[-1])

    def _point(self, after: Commit, **changes) -> Commit:
        """Writes the pointer that follows; fails if another writer's is there."""
        c = replace(after, number=after.number + 1, **changes)
        row = (c.key, c.buckets, json.dumps(c.schema.jsonValue()), c.slots, json.dumps([asdict(x) for x in c.segments]))
        self.spark.createDataFrame([row], _POINTER).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/current-{c.number}")
        return c

    # ---- segments

    def _bucketed(self, rows: DataFrame, c: Commit) -> DataFrame:
        key = F.when(F.col(c.key).isNull(), F.raise_error(F.lit("a point without a key"))).otherwise(F.col(c.key).cast("string"))
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(c.buckets)).cast("int"))

    def _segment(self, rows: DataFrame, c: Commit, slot: str | None, first: int, last: int) -> Segment:
        """Writes rows (with _seq) by bucket, sorted by key."""
        folder = f"{'rows' if slot is None else 'slot'}-{uuid.uuid4().hex}"
        dealt = self._bucketed(rows, c).repartition(_BUCKET, F.pmod(F.xxhash64(c.key, F.lit(1)), F.lit(4))).sortWithinPartitions(_BUCKET, c.key)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        schema = StructType([f for f in dealt.schema if f.name != _BUCKET]).add(_BUCKET, IntegerType())
        return Segment(folder, slot, first, last, self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").count())

    def _held(self, c: Commit, segments: Iterable[Segment], names: list[str], buckets: list[int] | None) -> DataFrame | None:
        """Rows of segments as they are; columns that a segment lacks are null."""
        paths = [f"{self.path}/{x.folder}" for x in segments]
        if not paths:
            return None
        schema = _fields(c.schema, names).add(_SEQ, LongType()).add(_BUCKET, IntegerType())
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows if buckets is None else rows.where(F.col(_BUCKET).isin(buckets))

    @staticmethod
    def _last_of(rows: DataFrame, key: str) -> DataFrame:
        """Of the rows of each key the one written last."""
        names = [n for n in rows.columns if n != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*names), _SEQ).alias("_x")).select(key, *(F.col("_x")[n].alias(n) for n in names))

    def _merged(self, c: Commit, names: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All points as of a commit, with _seq and _bucket; only some columns and buckets if named."""
        names = names or c.schema.names
        rows = [x for x in c.segments if x.slot is None]
        base = max(rows, key=lambda x: x.rows, default=None)
        others = [x for x in rows if x is not base]
        points = self._held(c, [base] if base else [], names, buckets)
        if points is None:
            points = self.spark.createDataFrame([], _fields(c.schema, names).add(_SEQ, LongType()).add(_BUCKET, IntegerType()))
        if others and base.last < min(x.first for x in others):
            newer = self._last_of(self._held(c, others, names, buckets), c.key)
            points = points.join(newer.select(c.key), c.key, "left_anti").unionByName(newer)
        elif others:
            points = self._last_of(points.unionByName(self._held(c, others, names, buckets)), c.key)
        for slot in sorted({x.slot for x in c.segments if x.slot in names}):
            filled = self._last_of(self._held(c, [x for x in c.segments if x.slot == slot], [c.key, slot], buckets).drop(_BUCKET), c.key)
            filled = filled.select(c.key, F.col(slot).alias("_new"), F.col(_SEQ).alias("_at"))
            points = points.join(filled, c.key, "left")
            later = F.col("_at") > F.col(_SEQ)
            points = points.withColumn(slot, F.when(later, F.col("_new")).otherwise(F.col(slot))).withColumn("_top", F.when(later, F.col("_at")).otherwise(F.col("_top") if "_top" in points.columns else F.col(_SEQ))).drop("_new", "_at")
        if "_top" in points.columns:
            points = points.withColumn(_SEQ, F.greatest(_SEQ, "_top")).drop("_top")
        return points.select(*names, _SEQ, _BUCKET)

    def _tidied(self, c: Commit) -> Commit:
        """Segments of one tier, where there are FANOUT of them, as one."""
        groups: dict[tuple, list[Segment]] = {}
        for x in c.segments:
            groups.setdefault((x.slot, x.tier), []).append(x)
        for (slot, _), own in groups.items():
            if len(own) >= FANOUT:
                names = c.schema.names if slot is None else [c.key, slot]
                whole = self._last_of(self._held(c, own, names, None).drop(_BUCKET), c.key)
                one = self._segment(whole, c, slot, min(x.first for x in own), max(x.last for x in own))
                return self._tidied(self._point(c, segments=tuple(x for x in c.segments if x not in own) + (one,)))
        return c

    def compact(self) -> None:
        """All points in one segment."""
        c = self._current()
        if len(c.segments) > 1:
            self._point(c, segments=(self._segment(self._merged(c).drop(_BUCKET), c, None, c.segments[0].first, c.number),))

    def vacuum(self, keep: int = 1, orphan_hours: float = 24.0) -> int:
        """Removes all but the last pointers and the folders that they don't name; how many folders that were.

        A folder that no pointer ever named may be that of a writer at work, so it goes only when it is old.
        """
        numbers = self._numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        named = {x.folder for n in kept for x in self._read_pointer(n).segments}
        was_named = {x.folder for n in old for x in self._read_pointer(n).segments}
        before = time.time() * 1000 - orphan_hours * 3_600_000
        segments = [n for n, at in self._names() if n.startswith(("rows-", "slot-")) and n not in named and (n in was_named or at < before)]
        files, path = self._files()
        for name in [f"current-{n}" for n in old] + segments:  # pointers first: what they name is still there until they are gone
            files.delete(path(f"{self.path}/{name}"), True)
        return len(segments)

    # ---- collections

    def read(self) -> DataFrame:
        return self._merged(self._current()).drop(_SEQ, _BUCKET)

    def slots(self) -> dict[str, Slot]:
        """The slots that the collection was made with or given since, by name."""
        return {x["name"]: Slot(**x) for x in json.loads(self._current().slots)} if self.exists() else {}

    def ensure(self, schema: StructType, recreate: bool = False, slots: Iterable[Slot] = (), key: str = "id", buckets: int = BUCKETS) -> None:
        """Creates an empty collection with its slots; where there is one, its slots have to be the same, unless it is to be recreated."""
        wanted = {x.name: x for x in slots}
        unknown = [n for n in [*wanted, key] if n not in schema.names]
        if unknown:
            raise ValueError(f"no columns for {unknown}")
        if recreate or not self.exists():
            number = self._current().number if self.exists() else 0
            free = StructType([StructField(f.name, f.dataType, True) for f in schema])
            self._point(Commit(number, key, buckets, free, "[]", ()), slots=json.dumps([asdict(x) for x in wanted.values()]))
            return
        for name, have in self.slots().items():
            if name in wanted and (have.kind, have.size, have.distance) != (wanted[name].kind, wanted[name].size, wanted[name].distance):
                raise ValueError(f"slot {name} is {have.kind} of size {have.size} by {have.distance}")

    def _checked(self, items: DataFrame) -> DataFrame:
        """Items with an error for every dense vector that has not its slot's size."""
        for name, slot in self.slots().items():
            if name in items.columns and slot.size and slot.kind == "dense":
                size = F.size(name)
                wrong = F.raise_error(F.concat(F.lit(f"slot {name} has {slot.size} places, a vector "), size.cast("string")))
                items = items.withColumn(name, F.when(F.col(name).isNotNull() & (size != slot.size), wrong).otherwise(F.col(name)))
        return items

    def _with(self, c: Commit, items: DataFrame) -> StructType:
        """The schema with the columns that items add; a column of another type is an error."""
        schema = StructType(list(c.schema))
        for f in items.schema:
            if f.name not in schema.names:
                schema.add(f.name, f.dataType, True)
            elif schema[f.name].dataType.simpleString() != f.dataType.simpleString():
                raise TypeError(f"{f.name} is {schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        return schema

    def upload(self, items: DataFrame, key: str = "id", skip_existing: bool = True, version: str | None = None) -> None:
        """Adds items; points of the same key stay, or are replaced, with a version only by one that is not older.

        Items are evaluated once; of the store only keys (and versions) of the batch's buckets are read.
        """
        c = self._current()
        if key != c.key:
            raise ValueError(f"points go by {c.key}")
        if items.schema[key].dataType.simpleString() not in ("bigint", "int", "string"):
            raise TypeError(f"{key} has to be a number or a string")
        c = replace(c, schema=self._with(c, items))
        items = one_each(self._checked(items), key, None if skip_existing else version)
        if c.segments and (skip_existing or version):
            items = staged(self._bucketed(items, c), "batch")
            buckets = [r[0] for r in items.select(_BUCKET).distinct().collect()]  # at most the store's buckets
            held = self._merged(c, [key] if skip_existing else [key, version], buckets)
            if skip_existing:
                items = items.join(held.select(key), key, "left_anti")
            else:
                items = items.join(held.select(key, F.col(version).alias("_held")), key, "left").where(F.col("_held").isNull() | (F.col(version) >= F.col("_held"))).drop("_held")
            items = items.drop(_BUCKET)
        n = c.number + 1
        one = self._segment(items.withColumn(_SEQ, F.lit(n).cast("bigint")), c, None, n, n)
        self._tidied(self._point(c, segments=c.segments + ((one,) if one.rows else ())))

    def add_slot(self, slot: Slot, of: str = "array<struct<idx:bigint,val:double>>") -> None:
        """A new slot, empty in all points: only the pointer is written."""
        c = self._current()
        if slot.name not in c.schema.names:
            self._point(c, schema=StructType(list(c.schema)).add(slot.name, StructType.fromDDL(f"x {of}")["x"].dataType), slots=json.dumps([asdict(x) for x in [*self.slots().values(), slot]]))

    def backfill(self, slot: str, values: DataFrame, key: str = "id") -> None:
        """Fills a slot of the points there are from values (key, slot): only keys and values are written; a null value changes nothing."""
        c = self._current()
        if slot not in c.schema.names:
            raise ValueError(f"no slot {slot}")
        filled = one_each(self._checked(values.select(key, slot)).where(F.col(slot).isNotNull()), key)
        self._with(c, filled)
        n = c.number + 1
        one = self._segment(filled.withColumn(_SEQ, F.lit(n).cast("bigint")), c, slot, n, n)
        self._tidied(self._point(c, segments=c.segments + ((one,) if one.rows else ())))

    def count(self) -> int:
        c = self._current()
        return self._merged(c, [c.key]).count()


#: Items that are encoded between two saves of a cache, and saves of one fill at most; fills that run at a time.
CHUNK_ITEMS, MOST_CHUNKS, AT_A_TIME = 20_000, 1000, 4


@dataclass
class EmbeddingCache:
    """Vectors by item, kept per model and kind; rows also hold a hash of the text, so a changed text is a miss."""

    spark: SparkSession
    path: str

    def _store(self, model: str, kind: str) -> PointStore:
        return PointStore(self.spark, f"{self.path}/{model.replace('/', '__')}/{kind}")

    def load(self, model: str, kind: str) -> DataFrame:
        store = self._store(model, kind)
        return store.read() if store.exists() else self.spark.createDataFrame([], _VECTORS)

    def save(self, model: str, kind: str, vectors: DataFrame) -> None:
        """Adds vectors (item_id, text_hash, vec); what is there is not rewritten."""
        store = self._store(model, kind)
        store.ensure(self.spark.createDataFrame([], _VECTORS).schema, key="item_id")
        store.upload(vectors.select("item_id", "text_hash", "vec"), "item_id", skip_existing=False)

    def fill(self, model: str, kind: str, items: DataFrame, encode: Callable[[DataFrame], DataFrame], chunk_items: int = CHUNK_ITEMS) -> DataFrame:
        """item_id, vec for all items (item_id, text): cached ones, and the others encoded and saved.

        Misses are encoded in chunks, some at a time, and each chunk is saved when it is done.  Where one fails the others that have begun are
        still saved and the first error is raised; the next fill encodes only what is missing.  Items without an id or text are no items.
        """
        keyed = one_each(items.select("item_id", "text").where("item_id is not null and text is not null"), "item_id").select("item_id", "text", F.xxhash64("text").alias("text_hash"))
        have = self.load(model, kind)
        missing = staged(keyed.join(have, ["item_id", "text_hash"], "left_anti"), "misses")
        n = missing.count()
        chunks = min(-(-n // chunk_items), MOST_CHUNKS)
        if chunks:
            self._encode(model, kind, missing, encode, chunks)
        return keyed.select("item_id", "text_hash").join(self.load(model, kind), ["item_id", "text_hash"]).select("item_id", "vec")

    def _encode(self, model: str, kind: str, missing: DataFrame, encode: Callable[[DataFrame], DataFrame], chunks: int) -> None:
        folder = place(self.spark, "chunks")
        missing.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int")).repartition("chunk").write.partitionBy("chunk").parquet(folder)
        dealt = self.spark.read.schema("item_id string, text string, text_hash bigint, chunk int").parquet(folder)
        saving, failed = threading.Lock(), threading.Event()

        def one(i: int) -> None:
            if failed.is_set():
                return
            try:
                own = dealt.where(F.col("chunk") == i)
                fresh = staged(encode(own.select("item_id", "text")).join(own.select("item_id", "text_hash"), "item_id").select("item_id", "text_hash", "vec"), "encoded")
                with saving:
                    self.save(model, kind, fresh)
            except BaseException:
                failed.set()
                raise

        with ThreadPoolExecutor(AT_A_TIME) as pool:
            running = [pool.submit(inheritable_thread_target(self.spark)(one), i) for i in range(chunks)]
        for r in running:
            r.result()


_VECTORS = "item_id string, text_hash bigint, vec array<float>"


def cache_misses(items: DataFrame, cache: DataFrame, key: str = "item_id") -> DataFrame:
    return items.join(cache.select(key), key, "left_anti")
