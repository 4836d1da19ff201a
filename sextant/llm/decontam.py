"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A window is so many consecutive words of an item.  As a set of word shingles it is contained
in a text only if its rarest shingle is, so that one shingle is the necessary prefix.  Rarity
is counted over all documents.  Where a document has a window's prefix, the prefix's place
in the window says where the window would begin; it has to lie inside the document
(positional and length bounds), its hash has to agree, and then its words have to.

Up to BLOCK_WORDS words, the benchmark's windows are one broadcast index.  A larger benchmark is joined by shuffles:
windows by prefix, documents' shingles that a filter of a fixed size lets pass, then candidates with their documents,
where the words are compared.  Both give the same rows.

Defined results: a null text, or one without words, has no words, hits or items; items
without words have no windows; equal item ids count once; repeated documents are rows of
their own; columns besides doc_id/text and item_id/text are ignored; without
benchmark rows nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import staged
from .words import ALNUM, Texts, slices, span_hashes, windows

WINDOW = 10
SHINGLE = 3
#: Words of a benchmark that is broadcast: an index of about 100 bytes a word at most.  A larger one is joined by shuffles.
BLOCK_WORDS = 500_000
#: Words of a piece of an item; pieces overlap.
PIECE_WORDS = 20_000
#: Bits of the filters that go to the workers: 8 MB each, whatever they are made from.
FILTER_BITS = 1 << 26
_BITS = 20


@dataclass
class Block:
    """Item words, and the windows over them by window length."""

    ids: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def build(self, window: int) -> "Index":
        t = Texts.of(pa.array(self.texts, pa.string())).lowered()
        starts, ends, first = t.runs(ALNUM)
        raw = t.data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        hashes = span_hashes(t.data, starts, ends)
        at, length, item = [], [], []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            n = min(window, b - a)
            if n:
                at += range(a, b - n + 1)
                length += [n] * (b - a - n + 1)
                item += [i] * (b - a - n + 1)
        at_, length_ = np.array(at, np.int64), np.array(length, np.int64)
        return Index(self.ids, words, hashes, at_, length_, np.array(item, np.int64))


@dataclass
class Index:
    """Every window of a block, with the prefix shingle once the counts are known."""

    ids: list[str]
    words: list[bytes]
    hashes: np.ndarray
    at: np.ndarray
    length: np.ndarray
    item: np.ndarray
    prefixes: dict[int, tuple] = field(default_factory=dict)
    window_hash: np.ndarray | None = None

    def shingle_sizes(self) -> list[int]:
        return sorted({int(min(SHINGLE, n)) for n in np.unique(self.length)})

    def shingles(self, size: int) -> np.ndarray:
        """Sorted distinct shingle hashes of the windows that use this size."""
        use = np.minimum(self.length, SHINGLE) == size
        starts = {p for a, n in zip(self.at[use].tolist(), self.length[use].tolist()) for p in range(a, a + n - size + 1)}
        return np.unique(self._hash_at(np.array(sorted(starts), np.int64), size))

    def _hash_at(self, at: np.ndarray, k: int) -> np.ndarray:
        found, _ = windows(self.hashes, np.array([0, len(self.hashes)], np.int64), k)
        return found[at]

    def choose_prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """counts: by shingle size, how often each of shingles(size) occurs in the documents."""
        self.window_hash = np.zeros(len(self.at), np.uint64)
        for n in np.unique(self.length):
            use = np.flatnonzero(self.length == n)
            self.window_hash[use] = self._hash_at(self.at[use], int(n))
        for size in self.shingle_sizes():
            use = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
            known = self.shingles(size)
            best = np.full(len(use), np.iinfo(np.int64).max)
            place = np.zeros(len(use), np.int64)
            prefix = np.zeros(len(use), np.uint64)
            for p in range(int(self.length[use].max()) - size + 1):
                inside = np.flatnonzero(p + size <= self.length[use])
                h = self._hash_at(self.at[use[inside]] + p, size)
                c = counts[size][np.searchsorted(known, h)]
                better = c < best[inside]
                chosen = inside[better]
                best[chosen], place[chosen], prefix[chosen] = c[better], p, h[better]
            order = np.argsort(prefix, kind="stable")
            keys, first = np.unique(prefix[order], return_index=True)
            gate = np.zeros(1 << _BITS, bool)
            gate[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.prefixes[size] = (keys, np.append(first, len(use)), use[order], place[order], gate)

    def hits(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of every occurrence in the texts of a batch."""
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found_at, found_w = [], []
        for size, (keys, bounds, which, place, gate) in self.prefixes.items():
            h, wfirst = windows(hashes, first, size)
            may = np.flatnonzero(gate[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            if not len(may) or not len(keys):
                continue
            key = np.minimum(np.searchsorted(keys, h[may]), len(keys) - 1)
            same = keys[key] == h[may]
            may, key = may[same], key[same]
            if not len(may):
                continue
            doc = np.searchsorted(wfirst, may, side="right") - 1
            at = may - wfirst[doc] + first[doc]
            many = bounds[key + 1] - bounds[key]
            entry = np.repeat(bounds[key] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            begin = np.repeat(at, many) - place[entry]
            w = which[entry]
            doc = np.repeat(doc, many)
            ok = (begin >= first[doc]) & (begin + self.length[w] <= first[doc + 1])
            begin, w = begin[ok], w[ok]
            for n in np.unique(self.length[w]):
                use = np.flatnonzero(self.length[w] == n)
                full, ffirst = windows(hashes, first, int(n))
                d = doc_of[begin[use]]
                good = full[begin[use] - first[d] + ffirst[d]] == self.window_hash[w[use]]
                found_at.append(begin[use[good]])
                found_w.append(w[use[good]])
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, w = np.concatenate(found_at), np.concatenate(found_w)
        order = np.lexsort((at, at - self.at[w]))  # windows that go on from one another, side by side
        at, w = at[order], w[order]
        return self._verified(raw, starts, ends, at, w)

    def _verified(self, raw: bytes, starts, ends, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return at, w
        q, n = self.at[w], self.length[w]
        goes_on = (np.diff(at) == 1) & (np.diff(q) == 1) & (np.diff(n) == 0) & (np.diff(self.item[w]) == 0)
        runs = np.concatenate([[0], np.flatnonzero(~goes_on) + 1, [len(at)]]).tolist()
        keep = np.ones(len(at), bool)
        for a, b in zip(runs[:-1], runs[1:]):
            lo, m, p = int(at[a]), int(b - a - 1 + n[a]), int(q[a])
            s, e = starts[lo : lo + m].tolist(), ends[lo : lo + m].tolist()
            if [raw[x:y] for x, y in zip(s, e)] != self.words[p : p + m]:
                for i in range(a, b):
                    lo, m, p = int(at[i]), int(n[i]), int(q[i])
                    s, e = starts[lo : lo + m].tolist(), ends[lo : lo + m].tolist()
                    keep[i] = [raw[x:y] for x, y in zip(s, e)] == self.words[p : p + m]
        return at[keep], w[keep]


def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """item_id, text, n_words: items in pieces of at most `most` words that overlap by a window less a word, so each window is in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts.of(batch.column("text"))
            starts, ends, first = t.runs(ALNUM)
            out = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                lo, upto = int(first[i]), int(first[i + 1])
                for a in range(lo, max(upto - window + 1, lo + 1), max(1, most - window + 1)) if upto > lo else ():
                    b = min(a + max(most, window), upto)
                    out.append((item, t.data[starts[a] : ends[b - 1]].tobytes().decode(), b - a))
            if out:
                ids, texts, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["item_id", "text", "n_words"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item_id"), "text").where("text is not null")
    return rows.mapInArrow(cut, "item_id string, text string, n_words bigint")


def _index(docs: DataFrame, pieces: DataFrame, window: int) -> Index:
    """The index of a benchmark of a bounded number of words."""
    block = Block()
    for row in pieces.orderBy("item_id", "text").toLocalIterator():
        block.ids.append(row.item_id)
        block.texts.append(row.text)
    index = block.build(window)
    index.choose_prefixes(_shingle_counts(docs, index))
    return index


def _shingle_counts(docs: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """Occurrences over all documents of the block's own shingles; as many numbers as it has shingles."""
    spark = docs.sparkSession
    known = {k: index.shingles(k) for k in index.shingle_sizes()}
    sent = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, v in sent.value.items()}
        gates = {}
        for k, v in sent.value.items():
            gates[k] = np.zeros(1 << _BITS, bool)
            gates[k][(v & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        for batch in slices(batches, "text"):
            t = Texts.of(batch.column("text")).lowered()
            starts, ends, first = t.runs(ALNUM)
            hashes = span_hashes(t.data, starts, ends)
            for k, v in sent.value.items():
                h, _ = windows(hashes, first, k)
                h = h[gates[k][(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)]]
                if len(h) and len(v):
                    i = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    totals[k] += np.bincount(i[v[i] == h], minlength=len(v))
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["size", "i", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
    if any(map(len, known.values())):
        for row in docs.select("text").mapInArrow(count, "size int, i bigint, n bigint").groupBy("size", "i").agg(F.sum("n").alias("n")).toLocalIterator():
            out[row["size"]][row.i] = row.n
    return out


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _mark(docs: DataFrame, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)  # of BLOCK_WORDS item words

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in slices(batches, "text"):
            t = Texts.of(batch.column("text")).lowered()
            starts, ends, first = t.runs(ALNUM)
            at, w = index.hits(t.data.tobytes(), starts, ends, first, span_hashes(t.data, starts, ends))
            cover = np.zeros(first[-1] + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + index.length[w], -1)
            hits = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
            n_hit = hits[first[1:]] - hits[first[:-1]]
            items: list[set[str]] = [set() for _ in range(len(t))]
            doc = np.searchsorted(first, at, side="right") - 1
            for d, i in np.unique(np.stack([doc, index.item[w]], 1), axis=0).tolist():
                items[d].add(index.ids[i])
            said = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(said, pa.string()), pa.array(n_hit > 0, pa.bool_())],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(mark, RESULT)


def _item_windows(pieces: DataFrame, window: int) -> DataFrame:
    """words, shingles, item_id: every window, its words side by side and its shingle hashes in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts.of(batch.column("text")).lowered()
            starts, ends, first = t.runs(ALNUM)
            raw, hashes = t.data.tobytes(), span_hashes(t.data, starts, ends)
            said = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
            out = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                lo, upto = int(first[i]), int(first[i + 1])
                n = min(window, upto - lo)
                size = min(SHINGLE, n)
                if n:
                    h = windows(hashes[lo:upto], np.array([0, upto - lo]), size)[0].view(np.int64)
                    out += [(" ".join(said[a : a + n]), h[a - lo : a - lo + n - size + 1], item) for a in range(lo, upto - n + 1)]
            if out:
                words, shingles, ids = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(shingles, pa.list_(pa.int64())), pa.array(ids, pa.string())], names=["words", "shingles", "item_id"])

    return pieces.mapInArrow(cut, "words string, shingles array<bigint>, item_id string")


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each remainder of the hashes `s` by FILTER_BITS; workers build it in parts."""
    at = F.pmod("s", F.lit(FILTER_BITS)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        bits = np.frombuffer(row.bits, np.uint8)
        out[(row.part - 1) * len(bits) : row.part * len(bits)] = bits
    return out


def _places(rows: DataFrame, sizes: list[int], hashes: DataFrame) -> DataFrame:
    """row, s, at: where documents have shingles of these sizes that the filter of `hashes` lets pass."""
    sent = rows.sparkSession.sparkContext.broadcast(_filter(hashes))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts.of(batch.column("text")).lowered()
            starts, ends, first = t.runs(ALNUM)
            hashes, row = span_hashes(t.data, starts, ends), batch.column("row").to_numpy()
            for size in sizes:
                h, bounds = windows(hashes, first, size)
                bit = h & np.uint64(FILTER_BITS - 1)
                may = np.flatnonzero((sent.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                doc = np.searchsorted(bounds, may, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(row[doc]), pa.array(h[may].view(np.int64)), pa.array(may - bounds[doc], pa.int64())], names=["row", "s", "at"])

    return rows.select("row", "text").mapInArrow(find, "row bigint, s bigint, at bigint")


def _joined(rows: DataFrame, pieces: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(row, begin, end, words) of every window in every document (row, text), and (words, item_id) of the benchmark."""
    found = staged(_item_windows(pieces, window), "item-windows")
    owners = found.select("words", "item_id").distinct()
    shingles = staged(found.select("words", "shingles").dropDuplicates(["words"]).select("words", F.posexplode("shingles").alias("place", "s")), "item-shingles")
    sizes = sorted(r.n for r in found.select(F.least(F.lit(SHINGLE), F.size(F.split("words", " "))).alias("n")).distinct().collect())  # at most SHINGLE
    # A window with a shingle that no document has is in none; of the others the rarest shingle is the prefix.
    counts = _places(rows, sizes, shingles).groupBy("s").agg(F.count("*").alias("n"))
    known = shingles.join(counts, "s", "left").select("words", "place", "s", F.coalesce("n", F.lit(0)).alias("n"))
    prefixes = known.groupBy("words").agg(F.min_by(F.struct("place", "s"), F.struct("n", "place")).alias("p"), F.min("n").alias("n"))
    prefixes = staged(prefixes.where("n > 0").select("words", "p.place", "p.s"), "prefixes")
    may = _places(rows, sizes, prefixes).join(prefixes, "s").select("row", (F.col("at") - F.col("place")).alias("begin"), "words")
    may = staged(may.where("begin >= 0").distinct(), "candidates")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, said = None, []
        for batch in batches:
            out = []
            for row, text, begin, words in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "begin", "words"))):
                if begin is None:
                    t = Texts.of(pa.array([text], pa.string())).lowered()
                    starts, ends, _ = t.runs(ALNUM)
                    raw = t.data.tobytes()
                    of, said = row, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                    continue
                if row != of:
                    raise ValueError(f"no text of row {row} before its candidates")
                own = words.encode().split(b" ")
                if said[begin : begin + len(own)] == own:
                    out.append((row, begin, begin + len(own), words))
            if out:
                r, a, b, w = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.string())], names=["row", "begin", "end", "words"])

    # Nulls come first: a document's text goes before its candidates.
    texts = rows.join(may.select("row").distinct(), "row", "left_semi").select("row", "text", F.lit(None).cast("bigint").alias("begin"), F.lit(None).cast("string").alias("words"))
    met = texts.unionByName(may.select("row", F.lit(None).cast("string").alias("text"), "begin", "words"))
    hits = met.repartition("row").sortWithinPartitions("row", "begin").mapInArrow(verify, "row bigint, begin bigint, end bigint, words string")
    return staged(hits, "hits"), owners


def _digested(rows: DataFrame, hits: DataFrame, owners: DataFrame) -> DataFrame:
    """The result rows: words under any window, and the items with such windows, per document."""
    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("row", "begin").agg(F.max("end").alias("end"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    items = hits.select("row", "words").distinct().join(owners, "words").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit, said = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce(F.array_join("items", ","), F.lit(""))
    out = rows.select("row", "doc_id", "n_words").join(covered, "row", "left").join(items, "row", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.array_size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.sha2(said.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, first = Texts.of(batch.column("text")).runs(ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(np.diff(first), pa.int64())], names=["doc_id", "text", "n_words"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, text string, n_words bigint")


def _few(pieces: DataFrame, most: int) -> bool:
    return pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] <= most


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document."""
    pieces = staged(_pieces(items, window, min(block_words, PIECE_WORDS)), "item-pieces")
    if _few(pieces, block_words):
        return _mark(docs, _index(docs, pieces, window))
    rows = staged(_counted(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _digested(rows, *_joined(rows, pieces, window))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no item's window occurs, with all their columns."""
    pieces = staged(_pieces(items, window, min(block_words, PIECE_WORDS)), "item-pieces")
    if _few(pieces, block_words):
        return _without(docs, _index(docs, pieces, window))
    rows = staged(docs.select(F.struct(*docs.columns).alias("doc"), "text", F.monotonically_increasing_id().alias("row")), "numbered")
    hits, _ = _joined(rows.select("row", "text"), pieces, window)
    return rows.join(hits.select("row").distinct(), "row", "left_anti").select("doc.*")


def _without(docs: DataFrame, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)  # of BLOCK_WORDS item words

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts.of(batch.column("text")).lowered()
            starts, ends, first = t.runs(ALNUM)
            at, _ = sent.value.hits(t.data.tobytes(), starts, ends, first, span_hashes(t.data, starts, ends))
            clean = np.ones(len(t), bool)
            clean[np.searchsorted(first, at, side="right") - 1] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(drop, docs.schema)
