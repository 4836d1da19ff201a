"""Harmonic packing of token pieces into sequences of a fixed capacity.

Class k holds the pieces of which k, and not k + 1, fit into one sequence: lengths
over capacity / (k + 1) and up to capacity / k.  Every sequence of class k takes
exactly k pieces, whatever they are, so each worker fills the sequences of its own pieces
and never talks about bins.  What is left of the workers' classes is numbered per class and fills
sequences in the same way; what is left of that, fewer pieces than k in class k, is put together by size.

Documents are cut to suit the classes: whole sequences first; of what is left, a piece
that nearly fills its class's share stays, else the share of the next class is cut off.

Defined results: a null or empty text is its end id alone, one piece of length 1;
repeated rows are packed each for itself; which of the sequences that suit a piece takes it follows from the order in
which workers meet pieces; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import staged
from .tokens import worker_tokenizer
from .words import slices

CAPACITY = 2048
#: Documents are cut for classes below this one; smaller rests stay as they are, in classes of their own up to the capacity.
CUT_CLASSES = 64
#: A piece stays whole if it fills this part of its share.
FILL = 0.985
#: The most pieces that the end of a document, under one capacity, is cut into.
MOST_CUTS = 3

#: Words whose ids a worker keeps; packing may follow other stages in the same executors.
CACHED_WORDS = 500_000

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_lengths(n: int, capacity: int = CAPACITY, classes: int = CUT_CLASSES) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(MOST_CUTS - 1):
        if not rest:
            break
        k = capacity // rest
        if k >= classes or rest >= FILL * (capacity // k):
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, classes: int = CUT_CLASSES) -> DataFrame:
    """Encodes every text, appends end_id and cuts the ids; one row per piece, without the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = worker_tokenizer(vocabulary, CACHED_WORDS), np.array([end_id], dtype=np.uint32)
        for batch in slices(batches, "text", 2_000_000):
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), tok.encode_texts(batch.column("text").to_pylist())):
                ids = np.concatenate([np.frombuffer(raw, dtype=np.uint16).astype("<u4"), end])
                at = 0
                for n in cut_lengths(len(ids), capacity, classes):
                    rows.append((doc_id, at, n, zlib.crc32(ids[at : at + n]), len(ids)))
                    at += n
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


_FILLED = PIECES + ", part int, k int, bin bigint, offset bigint"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _filled(pieces: DataFrame, capacity: int, classes: int) -> DataFrame:
    """Adds to pieces their part (task) and class, and the part's sequence and the place there; none for what fills no sequence.

    A task holds the pieces of its open sequences, under k of class k, whatever the number of its pieces.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bins = TaskContext.get().partitionId(), 0
        open_: dict[int, list[tuple]] = {}
        for batch in batches:
            out: list[tuple] = []
            for piece in zip(*(batch.column(n).to_pylist() for n in _NAMES)):
                k = min(classes, capacity // piece[2])
                held = open_.setdefault(k, [])
                held.append(piece)
                if len(held) == k:
                    at = 0
                    for p in held:
                        out.append((*p, part, k, bins, at))
                        at += p[2]
                    bins += 1
                    held.clear()
            if out:
                yield _rows_of(out)
        left = [(*p, part, k, None, None) for k, held in open_.items() for p in held]
        if left:
            yield _rows_of(left)

    return pieces.select(*_NAMES).mapInArrow(fill, _FILLED)


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in _FILLED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _FILLED.split(", ")])


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY, classes: int | None = None, bucket_rows: int = 4_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, doc_tokens)."""
    pieces = staged(_filled(pieces, capacity, classes or capacity), "pieces")
    whole = pieces.where("bin is not null")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.groupBy("part").agg((F.max("bin") + 1).alias("bins"))  # one row per task
    n_whole = parts.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
    parts = parts.select("part", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("first_bin"))
    done = whole.join(parts, "part").withColumn("sequence_id", F.col("first_bin") + F.col("bin"))

    # What the parts have left over, numbered per class in buckets of a bounded size.
    left = pieces.where("bin is null").drop("bin", "offset")
    sizes = left.groupBy("k").agg(F.count("*").alias("in_class"))  # one row per class
    earlier = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("bins", F.floor(F.col("in_class") / F.col("k"))).withColumn("first_bin", F.coalesce(F.sum("bins").over(earlier), F.lit(0)) + F.lit(n_whole))
    sizes = sizes.withColumn("base", F.sum("bins").over(Window.partitionBy()) + F.lit(n_whole))
    left = left.join(F.broadcast(sizes), "k")  # classes are at most the capacity
    # A class has few pieces of one part, so parts spread over buckets whatever documents repeat.
    left = staged(left.withColumn("bucket", F.pmod(F.xxhash64("part", "doc_id", "start"), F.ceil(F.col("in_class") / F.lit(bucket_rows)))), "left")
    counts = left.groupBy("k", "bucket").count()
    upto = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "length", "ids_crc32", "part")
    numbered = left.withColumn("i", F.row_number().over(own) - 1).join(counts, ["k", "bucket"]).withColumn("i", F.col("i") + F.col("before"))
    numbered = staged(numbered.withColumn("bin", F.floor(F.col("i") / F.col("k"))), "numbered")
    full = numbered.where("bin < bins").withColumn("sequence_id", F.col("first_bin") + F.col("bin"))
    inside = Window.partitionBy("sequence_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    def by_size(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in parts]
        if not tables:
            return
        got = pa.concat_tables(tables).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        used: list[int] = []
        bins_, offsets = [], []
        for n in got["length"].to_pylist():
            at = next((j for j, u in enumerate(used) if u + n <= capacity), len(used))
            if at == len(used):
                used.append(0)
            bins_.append(at)
            offsets.append(used[at])
            used[at] += n
        got = got.append_column("bin", pa.array(bins_, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from got.to_batches()

    rest = numbered.where("bin >= bins").select(*_NAMES, "base").repartition(1).mapInArrow(by_size, PIECES + ", base bigint, bin bigint, offset bigint")
    rest = rest.withColumn("sequence_id", F.col("base") + F.col("bin"))
    out = [*_NAMES, F.col("sequence_id").cast("bigint").alias("sequence_id"), F.col("offset").cast("bigint").alias("offset")]
    return done.select(*out).unionByName(full.select(*out)).unionByName(rest.select(*out))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    return harmonic_pack(token_pieces(docs, vocabulary, end_id, capacity), capacity)
