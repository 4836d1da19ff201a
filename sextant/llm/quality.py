"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

Statistics come from whole texts.  The trees learn from labelled rows, at most
`SAMPLE_ROWS` of them, those with the smallest hashes of their ids; they are kept from
rewarding symbols, repeated lines and repeated word windows (monotonic constraints).  A
document is kept if it passes the limits and the trees' probability of good quality is at
least `KEEP_FROM`.

Defined results: a null or empty text has no words and fails; repeated rows are judged
each for itself; labels that are null, or of unknown documents, are not used; labels of one
kind alone, or none, leave the limits as the only rule; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Trees, train
from .words import NOT_SPACE, Texts, byte_sums, mix, slices, span_hashes, windows

#: The most labelled rows that the trees learn from.
SAMPLE_ROWS = 20_000
KEEP_FROM = 0.3
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Statistics that the trees see, with the direction in which quality may move (0: any).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "repeated_lines": -1,
    "repeated_words": -1,
    "distinct_words": 0,
    "upper": 0,
    "digits": 0,
    "stops": 0,
    "exclamations": -1,
    "beyond_ascii": 0,
    "words_per_line": 0,
}
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _members(b"#*$%&|<>"), _members(bytes(range(65, 91))), _members(b"0123456789")
_STOP, _EXCLAIM = _members(b".,;:?"), _members(b"!")
_HIGH, _LEADING = np.arange(256) >= 0xC0, (np.arange(256) & 0xC0) != 0x80


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def statistics(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts by name, and the trees' features, one row per text."""
    n_texts, data, off = len(t), t.data, t.offsets
    starts, ends, first = t.runs(NOT_SPACE)
    sums = byte_sums(data)
    words = span_hashes(data, starts, ends, sums)
    n_words = np.diff(first)
    salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    leading = _LEADING[data]
    chars = np.concatenate([[0], np.cumsum(leading)])
    ends_at = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])]) if len(starts) else np.zeros(1, np.int64)
    word_chars = ends_at[first[1:]] - ends_at[first[:-1]]

    # Lines with a word, and those equal to an earlier one.
    ls, le, _ = t.runs(_NEWLINE)
    has_word = np.searchsorted(starts, ls) < np.searchsorted(starts, le)
    ls, le = ls[has_word], le[has_word]
    line_of = np.searchsorted(off, ls, side="right") - 1
    keys = span_hashes(data, ls, le, sums) ^ salt[line_of] if len(ls) else np.zeros(0, np.uint64)
    by = np.argsort(keys, kind="stable")
    again = by[1:][keys[by][1:] == keys[by][:-1]]
    n_lines = np.bincount(line_of, minlength=n_texts)
    n_dup_lines = np.bincount(line_of[again], minlength=n_texts)

    # Words in windows found twice or more.
    found, wfirst = windows(words, first, WINDOW)
    found = found ^ np.repeat(salt, np.diff(wfirst))
    ordered = np.sort(found)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    n_repeat = np.zeros(n_texts, np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, found), len(twice) - 1)
        hits = np.flatnonzero(twice[at] == found)
        doc = np.searchsorted(wfirst, hits, side="right") - 1
        begin = hits - wfirst[doc] + first[doc]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + WINDOW, -1)
        n_repeat = _per_text(np.cumsum(cover)[:-1] > 0, first)

    doc_of = np.repeat(np.arange(n_texts, dtype=np.uint64), n_words)
    own = np.sort((doc_of << np.uint64(40)) | (words >> np.uint64(24)))
    distinct = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    n_distinct = np.bincount((own[distinct] >> np.uint64(40)).astype(np.int64), minlength=n_texts)

    n_symbols = _per_text(_SYMBOL[data], off)
    w, c = np.maximum(n_words, 1), np.maximum(_per_text(leading, off), 1)
    x = np.stack(
        [
            np.log1p(n_words),
            word_chars / w,
            n_symbols / w,
            n_dup_lines / np.maximum(n_lines, 1),
            n_repeat / w,
            n_distinct / w,
            _per_text(_UPPER[data], off) / c,
            _per_text(_DIGIT[data], off) / c,
            _per_text(_STOP[data], off) / w,
            _per_text(_EXCLAIM[data], off) / w,
            _per_text(_HIGH[data], off) / c,
            np.log1p(n_words / np.maximum(n_lines, 1)),
        ],
        1,
    ).astype(np.float64)
    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}
    return counts, x


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from labels (doc_id, quality); None where the labels are all of one kind."""
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    names = list(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, x = statistics(Texts.of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *map(pa.array, x.T)], names=["doc_id", "quality", *names])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # at most sample_rows labels
    got = rows.mapInArrow(measure, "doc_id bigint, quality int, " + ", ".join(f"{n} double" for n in names))
    # Repeated documents could be more rows than labels; the bound holds for what is collected.
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(sample_rows).toPandas()
    y = got["quality"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return train(got[names].to_numpy(np.float64), y, np.array(list(FEATURES.values())))


RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The statistics and the verdict of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # of a size that the training parameters bound

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, x = statistics(Texts.of(batch.column("text")))
            n, repeated = counts["n_words"], counts["n_repeat_words"]
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)
            score = sent.value.probability(x) if sent.value else np.ones(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in counts.values()), pa.array(failed), pa.array(~failed & (score >= keep_from)), pa.array(score)],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rate, RESULT)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, score; one row per document."""
    return judge(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The verdict is computed in the same pass as the rows are carried through, so repeated
    doc_ids do not multiply.
    """
    trees = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, x = statistics(Texts.of(batch.column("text")))
            n, repeated = counts["n_words"], counts["n_repeat_words"]
            good = (n >= LEAST_WORDS) & (100 * repeated <= MOST_REPEATED_PERCENT * n)
            if sent.value:
                good &= sent.value.probability(x) >= KEEP_FROM
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
