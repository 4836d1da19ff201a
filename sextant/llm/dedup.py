"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Documents with equal sets are one
class from the start.  Class representatives carry minwise tokens; a tree begins with all
of them and, at every node, branches by the values of a few tokens that the node's path
picks, so documents go down together with the probability of their similarity at each
token.  A node of few documents, or one of which most are near copies of one of them, is
compared exhaustively, by sketches; what looks similar there is confirmed on the full sets.  Independent trees are repeated until a pair at the
threshold is met with the target probability.

In a node the similar documents are first joined by a spanning forest, a link less than
documents.  Only nodes that these links leave in more than one class are looked at again,
for all similar pairs between classes, so no pair that a node has found is left out and none
within a class is listed.  A node that stays large because its documents are near copies of
each other is dealt into blocks that share one document; documents outside the node's main
class are then compared with all its blocks.

Defined results: no words: 0 shingles, linked with nothing; fewer words than a shingle: the
whole sequence is the one shingle; a null doc_id is kept and only linked to its equals; repeated rows are linked with each other; ties of links
don't matter, as classes are named by their smallest doc_id; empty tables give an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .stages import staged
from .words import NOT_SPACE, Texts, slices, span_hashes, windows

TOKENS = 64
BRANCHES = 2
TARGET_RECALL = 0.9999
#: Nodes up to this size are compared exhaustively; larger ones that do not shrink are dealt into blocks of it.
LEAF = 96
#: Documents of a block when classes of a large node are held against each other; two blocks meet at a time.
BLOCK = 2048
#: A child with more than this part of its parent has not been split by the token.
UNSPLIT = 0.8
#: Share of equal tokens from which a document of a node is taken for a near copy of the node's pivot.
RESOLVED_CUT = 0.75
#: Large nodes up to this number are broadcast, with their pivots' tokens (at most 16 MB); more are joined by a shuffle.
BROADCAST_NODES = 50_000
#: Documents that are held against one document's set, sent once.
PARTNERS = 32
MOST_LEVELS = 8
#: Sketches agree in 0.8 of 64 places on average where sets do in 0.8; below this share is five deviations off.
SKETCH_CUT = 0.55
#: Bits of the parity sketch that rules out pairs between classes.
PARITY_BITS = 4096
#: Ids of documents to confirm that are broadcast (at most 16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(77)
_FACTOR = (_RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_SHIFT = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64)[:, None]


def trees_for(recall: float, similarity: float, branches: int = BRANCHES) -> int:
    """Trees that a pair of that similarity needs to share a leaf of one of them, however deep they are."""
    p = 1.0
    for _ in range(100):
        p = 1 - (1 - similarity * p) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def shingle_sets(t: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    t = t.lowered()
    starts, ends, first = t.runs(NOT_SPACE)
    words = span_hashes(t.data, starts, ends)
    found, bounds = windows(words, first, size)
    out = [np.unique(found[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    n = np.diff(first)
    for m in range(1, size):
        short = np.flatnonzero(n == m)
        if len(short):
            whole, at = windows(words, first, m)
            for i in short.tolist():
                out[i] = whole[at[i] : at[i] + 1]
    return out


def minwise(values: np.ndarray) -> np.ndarray:
    """The 64 minwise tokens of a set, as int32."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 4096):
        least = np.minimum(least, (_FACTOR * values[None, at : at + 4096] + _SHIFT).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parities(values: np.ndarray) -> bytes:
    """A bit per hash value modulo PARITY_BITS: whether an odd number of the set's values has it."""
    return np.packbits(np.bincount((values & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1).tobytes()


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(Texts.of(batch.column("text")), size)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            tokens = np.stack([minwise(s) for s in sets])
            sketches = [x.tobytes() for x in tokens.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TOKENS), pa.array(tokens.ravel())), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "print", "tokens", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, "doc_id bigint, n_shingles bigint, print binary, tokens array<int>, sketch binary")


def _children(path: Column, branches: int) -> Column:
    """For each branch that the path picks: its token's value leads to a child node."""
    begin, step = F.pmod(F.xxhash64(path, F.lit("begin")), F.lit(TOKENS)), F.pmod(F.xxhash64(path, F.lit("step")), F.lit(TOKENS // 2)) * 2 + 1
    picks = [F.pmod(begin + step * j, F.lit(TOKENS)).cast("int") for j in range(branches)]
    return F.array(*(F.xxhash64(path, p, F.element_at("tokens", p + 1)) for p in picks))


def _leaves(reps: DataFrame, n_reps: int, trees: int, branches: int) -> DataFrame:
    """path, rep, size, pivot: the documents of all nodes that are compared, from all trees."""
    roots = F.flatten(F.array(*(_children(F.xxhash64(F.lit(t)), branches) for t in range(trees))))
    rows = reps.select("rep", "tokens", F.lit(n_reps).cast("bigint").alias("above"), F.explode(roots).alias("path"))
    found = None
    for level in range(1, MOST_LEVELS + 1):
        sizes = staged(rows.groupBy("path").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1"), "sizes")
        # Large nodes are few and their rows stay where they are; small ones meet by path, none with more than a leaf's rows.
        large = sizes.where(F.col("size") > LEAF).join(reps.select(F.col("rep").alias("pivot"), F.col("tokens").alias("of_pivot")), "pivot")
        few = sizes.where(F.col("size") > LEAF).count() <= BROADCAST_NODES
        equal = F.aggregate(F.zip_with("tokens", "of_pivot", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        held = rows.join(F.broadcast(large) if few else large, "path").select("path", "rep", "size", "pivot", "above", (equal >= int(RESOLVED_CUT * TOKENS)).alias("alike"))
        small = rows.select("path", "rep").join(sizes.where(F.col("size") <= LEAF), "path").select("path", "rep", "size", "pivot", F.lit(0).cast("bigint").alias("above"), F.lit(True).alias("alike"))
        nodes = staged(held.unionByName(small), "nodes")
        # Near copies of the pivot go down together whatever token is picked: a node mostly of them is compared as it is.
        own = nodes.where(F.col("size") > LEAF)
        resolved = own.groupBy("path").agg((F.avg(F.col("alike").cast("double")) >= 0.5).alias("resolved"))
        own = own.join(F.broadcast(resolved) if few else resolved, "path")
        done = F.col("resolved") | (F.col("size") > UNSPLIT * F.col("above")) | F.lit(level == MOST_LEVELS)
        leaves = own.where(done).select("path", "rep", "size", "pivot").unionByName(nodes.where(F.col("size") <= LEAF).select("path", "rep", "size", "pivot"))
        found = leaves if found is None else found.unionByName(leaves)
        rest = own.where(~done)
        if level == MOST_LEVELS or rest.isEmpty():
            return staged(found, "leaves")
        down = rest.select("path", "rep", F.col("size").alias("above")).join(reps.select("rep", "tokens"), "rep")
        rows = down.select("rep", "tokens", "above", F.explode(_children(F.col("path"), branches)).alias("path"))
    return found


def _blocks(size: Column, of: int) -> Column:
    return F.ceil(size / F.lit(of)).cast("int")


def _in_groups(rows: DataFrame, names: list[str], out: str, of) -> DataFrame:
    """Runs of(list of numpy columns, group bounds) over whole groups of equal `key`, many at a time."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            kept += batch.num_rows
            if kept < 5000:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            key = whole["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left")) if key[0] <= key[-1] else 0
            if cut:
                yield from of(*_grouped(whole.slice(0, cut), names))
                whole = whole.slice(cut)
            held, kept = whole.to_batches(), whole.num_rows
        if held:
            yield from of(*_grouped(pa.Table.from_batches(held).combine_chunks(), names))

    return rows.repartition("key").sortWithinPartitions("key").select("key", *names).mapInArrow(walk, out)


def _grouped(rows: pa.Table, names: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    key = rows["key"].to_numpy()
    bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    cols = {}
    for n in names:
        if n == "sketch":
            cols[n] = np.frombuffer(b"".join(rows[n].to_pylist()), np.uint8).reshape(-1, TOKENS)
        elif n == "parity":
            cols[n] = np.frombuffer(b"".join(rows[n].to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)
        else:
            cols[n] = rows[n].to_numpy()
    return cols, bounds


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Share of equal sketch places where sizes and sketches allow the similarity, else -1."""
    same = (a == b).mean(-1, dtype=np.float32)
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return np.where(fits & (same >= SKETCH_CUT), same, -1)


def _forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """Links of a largest spanning forest; alike < 0 means no link."""
    m = len(alike)
    best, parent, free = np.full(m, -1.0), np.zeros(m, np.int64), np.ones(m, bool)
    links = []
    for _ in range(m):
        v = int(np.where(free, best, -2).argmax())
        if best[v] >= 0:
            links.append((int(parent[v]), v))
        free[v] = False
        closer = free & (alike[v] > best)
        best[closer], parent[closer] = alike[v][closer], v
    return links


def _forests(rows: DataFrame, percent: int) -> DataFrame:
    """path, a, b, wide: links of each leaf's forests."""

    def link(cols: dict[str, np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep, n, sketch, path, wide = (cols[k] for k in ("rep", "n_shingles", "sketch", "path", "wide"))
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        hit = two[_alike(sketch[two], sketch[two + 1], n[two], n[two + 1], percent) >= 0] if len(two) else two
        left, right = [hit], [hit + 1]
        for i in np.flatnonzero(size > 2).tolist():
            a, b = int(bounds[i]), int(bounds[i + 1])
            s, m = sketch[a:b], n[a:b]
            alike = _alike(s[:, None, :], s[None, :, :], m[:, None], m[None, :], percent)
            np.fill_diagonal(alike, -1)
            if (alike >= 0).any():
                links = np.array(_forest(alike), np.int64) + a
                left.append(links[:, 0])
                right.append(links[:, 1])
        x, y = np.concatenate(left), np.concatenate(right)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(path[x]), pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y])), pa.array(wide[x])], names=["path", "a", "b", "wide"])

    return _in_groups(rows, ["path", "rep", "n_shingles", "sketch", "wide"], "path bigint, a bigint, b bigint, wide boolean", link)


def _between_classes(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: all similar pairs of a group that are not in one class yet."""

    def link(cols: dict[str, np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep, n, sketch, label, parity = (cols[k] for k in ("rep", "n_shingles", "sketch", "label", "parity"))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if (label[a:b] == label[a]).all():
                continue
            for at in range(a, b, 64):
                upto = min(at + 64, b)
                alike = _alike(sketch[at:upto, None, :], sketch[None, a:b, :], n[at:upto, None], n[None, a:b], percent)
                x, y = np.nonzero((alike >= 0) & (label[at:upto, None] < label[None, a:b]))
                x, y = x + at, y + a
                for i in range(0, len(x), 4096):  # at most (100 - percent) / (100 + percent) of both sizes may differ
                    differ = np.bitwise_count(parity[x[i : i + 4096]] ^ parity[y[i : i + 4096]]).sum(1, dtype=np.int64)
                    close = differ * (100 + percent) <= (n[x[i : i + 4096]] + n[y[i : i + 4096]]) * (100 - percent)
                    x[i : i + 4096][~close] = -1
                x, y = x[x >= 0], y[x >= 0]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], names=["a", "b"])

    return _in_groups(rows, ["rep", "n_shingles", "sketch", "label", "parity"], "a bigint, b bigint", link)


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, items, parity: the full sets, and their parity sketches, of the documents in ids (distinct doc_id)."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(Texts.of(batch.column("text")), size)
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), items, pa.array([parities(s) for s in sets], pa.binary())], names=["doc_id", "items", "parity"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return texts.mapInArrow(whole, "doc_id bigint, items array<bigint>, parity binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; a document's set is sent once for a block of its partners."""
    pairs = staged(pairs.where("a <> b").distinct(), "pairs")
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), size).select("doc_id", "items")
    sets = staged(sets, "sets")
    blocks = pairs.groupBy("a").agg(_blocks(F.count("*"), PARTNERS).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    right = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "block", "b", "items")
    left = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "block", F.lit(None).cast("bigint").alias("b"), "items")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column("items")
            items, bounds = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]).tolist()
            found = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                other = items[bounds[i] : bounds[i + 1]]
                if b is None:
                    of, own = a, other.copy()
                    continue
                if of != a:
                    raise ValueError(f"no set of document {a} before its partners")
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    found.append((a, b))
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    # Nulls come first: each block begins with the set that its partners are held against.
    met = left.unionByName(right).repartition("a", "block").sortWithinPartitions("a", "block", "b")
    return met.select("a", "b", "items").mapInArrow(compare, "a bigint, b bigint")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    named = labels.select(F.col("node").alias(node), F.col("label").alias(out))
    return rows.join(named, node, "left").withColumn(out, F.coalesce(out, node))


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, recall: float = TARGET_RECALL, branches: int = BRANCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document."""
    signed = staged(_signed(docs, shingle), "signed")
    classes = signed.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = staged(classes, "classes")
    reps = classes.where("rep is not null").select("rep", "n_shingles", "tokens", "sketch")
    links = _links(docs, reps, shingle, percent, trees_for(recall, percent / 100, branches), branches)
    labels = components(links)
    first = classes.where("copies > 1").select("print", "rep")
    rows = signed.select("doc_id", "n_shingles", "print").join(first, "print", "left")
    rows = rows.withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    rows = _labelled(rows, labels, "rep", "component_id")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(docs: DataFrame, reps: DataFrame, shingle: int, percent: int, trees: int, branches: int) -> DataFrame:
    leaves = _leaves(reps, reps.count(), trees, branches)
    side = reps.select("rep", "n_shingles", "sketch")
    wide = F.col("size") > LEAF
    block = F.when(~wide, F.array(F.lit(0))).when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), _blocks(F.col("size"), LEAF) - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep", "path"), _blocks(F.col("size"), LEAF)).cast("int")))
    dealt = leaves.select("path", "rep", wide.alias("wide"), F.explode(block).alias("block")).join(side, "rep")
    forest = staged(_forests(dealt.withColumn("key", F.xxhash64("path", "block")), percent), "forest")
    tested = forest.select("a", "b").distinct()
    sure = staged(_confirmed(docs, tested, shingle, percent), "links")
    labels = components(sure)

    open_ = _labelled(_labelled(forest, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("path")
    large = _labelled(leaves.where(wide), labels, "rep", "label")
    split = large.groupBy("path").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("path")
    again = staged(open_.unionByName(split).distinct(), "open")
    if again.isEmpty():
        return sure
    rows = staged(_labelled(leaves.join(again, "path", "left_semi"), labels, "rep", "label"), "again")
    most = rows.where(wide).groupBy("path", "label").count().groupBy("path").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("of_main"))
    narrow = rows.where(~wide).select("path", "rep", "label", F.lit(0).alias("block"), F.lit(0).alias("beside"))
    # Every document is in one block beside each block of those outside the main class, and those are beside every block.
    others = _blocks(F.col("all") - F.col("of_main"), BLOCK)
    of_path = rows.where(wide).join(most, "path").withColumn("own", F.pmod(F.xxhash64("rep", "path"), _blocks(F.col("size"), BLOCK)).cast("int"))
    blocks = of_path.select("path", "rep", "label", F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), others - 1)).alias("beside"))
    outside = of_path.where("label <> main").withColumn("beside", F.pmod(F.xxhash64("path", "rep"), others).cast("int"))
    outside = outside.select("path", "rep", "label", F.explode(F.sequence(F.lit(0), _blocks(F.col("size"), BLOCK) - 1)).alias("block"), "beside")
    marks = staged(_sets_of(docs, rows.select(F.col("rep").alias("doc_id")).distinct(), shingle).select(F.col("doc_id").alias("rep"), "parity"), "parities")
    groups = narrow.unionByName(blocks).unionByName(outside).distinct().join(side, "rep").join(marks, "rep")
    more = _between_classes(groups.withColumn("key", F.xxhash64("path", "block", "beside")), percent)
    more = more.distinct().join(tested, ["a", "b"], "left_anti")
    return sure.unionByName(staged(_confirmed(docs, more, shingle, percent), "more-links"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, but only the first of each class of near duplicates.

    A document is a doc_id with a text: of rows that repeat both one stays, the same on every run, and texts of one doc_id are
    documents of their own.  Rows with null doc_id stay.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(_gone(docs, shingle, percent), "doc_id", "left_anti").select(*docs.columns)
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    rows = docs.where("doc_id is not null").select("doc_id", text.alias("text"), F.struct(*docs.columns).alias("row"))
    # New ids in the order of doc_ids, range by range.
    keys = staged(rows.select("doc_id", "text").distinct().repartitionByRange("doc_id", "text").withColumn("part", F.spark_partition_id()), "texts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keys.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))  # one row per task
    own = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "text")) - 1
    keys = keys.withColumn("own", own).join(parts, "part").select("doc_id", "text", (F.col("first") + F.col("own")).cast("bigint").alias("id"))
    rows = staged(rows.join(keys, ["doc_id", "text"]).select("id", "row"), "numbered")
    gone = _gone(rows.select(F.col("id").alias("doc_id"), "row.text"), shingle, percent)
    one = rows.join(gone.withColumnRenamed("doc_id", "id"), "id", "left_anti").groupBy("id").agg(F.min_by("row", F.struct(F.xxhash64("row"), F.to_json("row"))).alias("row"))
    return docs.where("doc_id is null").unionByName(one.select("row.*"))


def _gone(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id of documents that are not the first of their class."""
    gone = staged(near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct(), "gone")
    return F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
