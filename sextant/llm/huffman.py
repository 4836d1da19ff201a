"""Token ids in files of canonical, length-limited Huffman codes.

Format: a folder with two Parquet tables.  `codebook` has the code length of every id that
occurs; canonical codes follow from the lengths.  `blocks` has one row per block, in
ascending doc_id order within a part and parts in ascending order: its documents, their
numbers of ids, their first bytes, how many ids of the part come before it, its bytes, and
checkpoints: the bit offset of every 256th id of each document.  Documents start at a byte, so blocks, documents
and checkpoints can each be decoded without what comes before.

Codes come from the counts of all ids of all documents; the counts are at most one number
per id of the vocabulary.  Encoding and decoding work on whole batches: a decoder runs
through all checkpoints of many blocks side by side, one table look-up per id.

Defined results: a null or empty text is its end id alone; documents with equal doc_id go
by a hash of their ids; a null doc_id comes first; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import shared_dir, staged
from .tokens import worker_tokenizer
from .words import slices

LIMIT = 16
CHECKPOINT = 256
#: A block is closed at this many ids; a longer document is a block of its own.
BLOCK_IDS = 65_536
#: Blocks that are decoded side by side, and their bytes; a larger block is decoded alone.
SIDE_BY_SIDE, SIDE_BYTES = 16, 16 << 20
ID_VALUES = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code length of each id under the limit, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.lexsort((used, counts[used]))]
    coins = counts[order].astype(np.float64)
    row, is_coin = coins, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([coins, row[0:even:2] + row[1:even:2]])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_coin.append(by < n)
    take = 2 * (n - 1)
    for coin in reversed(is_coin):
        picked = int(coin[:take].sum())
        lengths[order[:picked]] += 1
        take = 2 * (take - picked)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each next `limit` bits: the id times 32, plus its length."""
    table = np.zeros(1 << limit, np.uint32)
    for i in np.flatnonzero(lengths).tolist():
        shift = limit - int(lengths[i])
        table[int(codes[i]) << shift : (int(codes[i]) + 1) << shift] = i * 32 + int(lengths[i])
    return table


def encode_batch(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes of documents side by side, each document's first byte, and each id's bit offset in its document."""
    kind = np.int32 if LIMIT * len(ids) < 2**31 else np.int64  # one very long document may need more
    size = lengths.astype(kind)[ids]
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ends = np.zeros(len(ids) + 1, kind)
    np.cumsum(size, out=ends[1:])
    bits = ends[first[1:]] - ends[first[:-1]]
    at_byte = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    shift = (at_byte[:-1] * 8 - ends[first[:-1]]).astype(kind)
    inside = ends[:-1] - np.repeat(ends[first[:-1]], counts)
    at = ends[:-1] + np.repeat(shift, counts)
    out = np.zeros(at_byte[-1] // 8 + 2, np.uint64)
    word, space = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    over = np.flatnonzero(space < 0)
    high = code << np.maximum(space, 0).astype(np.uint8)
    high[over] = code[over] >> (-space[over]).astype(np.uint8)
    if len(word):
        begins = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out[word[begins]] = np.bitwise_or.reduceat(high, begins)
        out[word[over] + 1] |= code[over] << (64 + space[over]).astype(np.uint64)
    return out.byteswap().tobytes()[: at_byte[-1]], at_byte, inside


def decode_lanes(payload: bytes, bit_at: np.ndarray, n: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids from each bit offset on, lane by lane, n of each; one array in lane order."""
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    order = np.argsort(-n, kind="stable")
    kind = np.int32 if 8 * len(payload) < 2**31 else np.int64
    at, left = bit_at[order].astype(kind), n[order]
    out = np.zeros(int(n.sum()), np.uint16)
    to = (np.cumsum(n) - n)[order]
    mask = np.uint32((1 << limit) - 1)
    upper = kind(32 - limit)
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))  # lanes with more than `step` ids
        a = at[:live]
        seen = (ahead[a >> 3] >> (upper - (a & 7)).astype(np.uint8)) & mask
        found = table[seen]
        out[to[:live] + step] = found >> np.uint32(5)
        a += (found & np.uint32(31)).astype(kind)
    return out


def token_ids(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and ids: little-endian uint16 ids of each whole text, with the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = worker_tokenizer(vocabulary), np.array([end_id], "<u2").tobytes()
        for batch in slices(batches, "text", 2_000_000):
            ids = [x + end for x in tok.encode_texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, ids binary")


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ID_VALUES, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column("ids"))[0], minlength=ID_VALUES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    out = np.zeros(ID_VALUES, np.int64)
    for row in ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.id] = row.n
    return out


BLOCKS = "part int, block int, part_start bigint, n_ids bigint, doc_ids array<bigint>, doc_counts array<bigint>, doc_bytes array<bigint>, checkpoints binary, payload binary"


def write_ids(ids: DataFrame, path: str) -> None:
    """Writes the folder of the format from a table of doc_id and ids."""
    spark = ids.sparkSession
    lengths = code_lengths(id_counts(ids))
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # of the vocabulary's size

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_counts", pa.list_(pa.int64())), ("doc_bytes", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = sent.value
        part, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "ids", 1_000_000):
            raw = batch.column("ids")
            ids, offsets = _flat(raw)
            counts = np.diff(offsets)
            payload, at, inside = encode_batch(ids, counts, lengths, codes)
            # Blocks end where the next document would pass the limit.
            docs, lo = batch.column("doc_id"), 0
            while lo < len(counts):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_IDS, side="right")) - 1)
                n = counts[lo:hi]
                points = _checkpoint_places(offsets[lo:hi], n)
                row = {
                    "part": part, "block": block, "part_start": start, "n_ids": int(n.sum()), "doc_ids": docs.slice(lo, hi - lo).to_pylist(), "doc_counts": n.tolist(),
                    "doc_bytes": (at[lo:hi] - at[lo]).tolist(), "checkpoints": inside[points].astype("<u8").tobytes(), "payload": payload[at[lo] : at[hi]],
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                block, start, lo = block + 1, start + row["n_ids"], hi

    # The ids are sampled for the ranges, and so are ordered before they are encoded; rows of one doc_id may fill many ranges.
    ordered = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "ids")
    # The codes are as dense as they get; Parquet need not try again.
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and the first one of each row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u2"), (at - at[0]) // 2


def _checkpoint_places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of every CHECKPOINTth id of each document."""
    k = -(-counts // CHECKPOINT)
    nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return np.repeat(first, k) + nth * CHECKPOINT


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    return decoded(spark, path, "ids_crc32 bigint", zlib.crc32, pa.int64())


def decoded(spark: SparkSession, path: str, column: str, of, kind: pa.DataType) -> DataFrame:
    """One row per document with a value of its uint32 ids, in the column named."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row per id of the vocabulary
    lengths = np.zeros(ID_VALUES, np.int64)
    for row in book:
        lengths[row.id] = row.length
    sent = spark.sparkContext.broadcast(decode_table(lengths, canonical_codes(lengths)))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            size = pc.binary_length(batch.column("payload")).to_numpy()
            group = np.maximum(np.cumsum(size) // SIDE_BYTES, 0) * batch.num_rows + np.arange(len(size)) // SIDE_BY_SIDE
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]]).tolist()
            for at, upto in zip(cuts, cuts[1:]):
                rows = batch.slice(at, upto - at)
                if not rows.num_rows:
                    continue
                counts = rows.column("doc_counts").flatten().to_numpy()
                per_block = pc.list_value_length(rows.column("doc_counts")).to_numpy()
                payload = rows.column("payload").to_pylist()
                base = np.concatenate([[0], np.cumsum([len(x) for x in payload])])[:-1]
                first = rows.column("doc_bytes").flatten().to_numpy() + np.repeat(base, per_block)
                k = -(-counts // CHECKPOINT)
                bit_at = np.frombuffer(b"".join(rows.column("checkpoints").to_pylist()), "<u8").astype(np.int64) + np.repeat(first * 8, k)
                size = np.full(len(bit_at), CHECKPOINT, np.int64)
                size[np.cumsum(k) - 1] = counts - (k - 1) * CHECKPOINT
                ids = decode_lanes(b"".join(payload), bit_at, size, table)
                ends = np.cumsum(counts)
                starts = ends - counts
                in_block = starts - np.repeat(starts[np.cumsum(per_block) - per_block], per_block)
                wide = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_ids").flatten(), pa.array(np.repeat(rows.column("part").to_numpy(), per_block)), pa.array(in_block + np.repeat(rows.column("part_start").to_numpy(), per_block)),
                        pa.array(counts), pa.array([of(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], kind),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", column.split()[0]],
                )

    docs = blocks.mapInArrow(decode, f"doc_id bigint, part int, start_in_part bigint, n_tokens bigint, {column}")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row per part
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", column.split()[0])


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the ids of all documents and returns what reading the files back gives."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(staged(token_ids(docs, vocabulary, end_id), "ids"), path)
    return read_ids(spark, path)
