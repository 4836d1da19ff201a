"""Fill-in-the-middle examples, a whole Arrow batch of UTF-8 texts at a time.

A text is cut into units (code points, words or lines).  A table gives each byte a class, a second
table says which pairs of adjacent classes have a boundary between them, and running sums of the
boundaries, less the sum at the text's own first byte, number the units of every text at once.  Both cuts of all rows are
then one search in these sums, and the output of all rows is one gather from the batch's bytes.

Cuts and forms follow from the doc_id alone (see `draws`), so they do not depend on partitions,
retries or the order of rows.

Defined results: null text is the empty text, and an empty text is plain; a null doc_id draws as an empty number;
repeated rows give repeated examples; a text that holds a marker is plain, so every output can be undone; columns other than
doc_id and text are ignored.  Nothing is shuffled and no text is cut short: a text of any length is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Texts, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Classes of bytes: inside a code point, white space, end of line, first byte of anything else.
_INSIDE, _SPACE, _BREAK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = _INSIDE
_CLASS[[0x20, 9, 11, 12, 13]] = _SPACE
_CLASS[0x0A] = _BREAK


def _between(pairs: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros((4, 4), dtype=bool)
    table[tuple(zip(*pairs))] = True
    return table.ravel()


#: Whether a unit begins between two bytes, by 4 * class of the first + class of the second.
#: A word goes with the white space after it, a line with its end.
BOUNDARIES = {
    "code_point": _between([(a, b) for a in range(4) for b in (_SPACE, _BREAK, _OTHER)]),
    "word": _between([(_SPACE, _OTHER), (_BREAK, _OTHER)]),
    "line": _between([(_BREAK, b) for b in (_SPACE, _BREAK, _OTHER)]),
}
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), dtype=np.uint8)
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers: the first groups of eight digits of the SHA-256 of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _unit_sums(texts: Texts, unit: str) -> np.ndarray:
    """How many units of the batch have begun up to and with each byte."""
    starts = np.empty(len(texts.data), dtype=bool)
    kind = _CLASS[texts.data]
    starts[1:] = BOUNDARIES[unit][kind[:-1] * np.uint8(4) + kind[1:]]
    starts[texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]]] = True
    return np.cumsum(starts, dtype=np.int32 if len(starts) < 2**31 else np.int64)


def _upto(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum over the first `at` bytes."""
    return np.where(at > 0, sums[np.maximum(at, 1) - 1], 0).astype(np.int64) if len(sums) else np.zeros(len(at), np.int64)


def _marked(texts: Texts) -> np.ndarray:
    """Texts that hold a marker."""
    d = texts.data
    if len(d) < 3:
        return np.zeros(len(texts), dtype=bool)
    at = np.flatnonzero((d[:-2] == ord("<")) & (d[2:] == ord(">")) & _TAIL[d[1:-1]])
    # Of the marks from a text's first byte on, the first must end within the text.
    first = np.append(at, len(d))[np.searchsorted(at, texts.offsets[:-1])]
    return first + 3 <= texts.offsets[1:]


def infill_batch(texts: Texts, h: np.ndarray, unit: str, plain_from: int, spm_below: int) -> dict[str, np.ndarray | pa.Array]:
    """n units, form, code points of prefix and middle, and output of every text; h has four rows of draws."""
    lo, hi = texts.offsets[:-1], texts.offsets[1:]
    sums = _unit_sums(texts, unit)
    before = _upto(sums, lo)
    n = _upto(sums, hi) - before
    plain = (n == 0) | _marked(texts) | (h[2] % 100 >= plain_from)
    spm = ~plain & (h[3] % 100 < spm_below)
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    # Unit u of a text (from 0) begins where the sum first reaches before + u + 1.
    one, two = (np.minimum(np.searchsorted(sums, (before + c + 1).astype(sums.dtype)), hi) for c in cuts)
    chars = sums if unit == "code_point" else _unit_sums(texts, "code_point")
    at_one, at_two = _upto(chars, one), _upto(chars, two)

    # Six pieces a row: a marker and a span, three times; a plain row is its last span alone.
    size = len(texts.data)
    mark = {m: size + 3 * i for i, m in enumerate((PREFIX, SUFFIX, MIDDLE))}
    psm = ~plain & ~spm
    start = np.zeros((len(n), 6), dtype=np.int64)
    length = np.zeros((len(n), 6), dtype=np.int64)
    start[:, 0] = np.where(psm, mark[PREFIX], mark[SUFFIX])
    start[:, 2] = np.where(psm, mark[SUFFIX], mark[PREFIX])
    start[:, 4] = mark[MIDDLE]
    length[:, 0::2] = np.where(plain, 0, 3)[:, None]
    start[:, 1], length[:, 1] = np.where(psm, lo, two), np.where(psm, one - lo, hi - two)
    start[:, 3], length[:, 3] = np.where(psm, two, lo), np.where(psm, hi - two, one - lo)
    start[:, 5], length[:, 5] = np.where(plain, lo, one), np.where(plain, hi - lo, two - one)
    length[plain, 1] = length[plain, 3] = 0

    ends = np.concatenate([[0], np.cumsum(length.sum(1))])
    total = int(ends[-1])
    kind = np.int32 if size + total < 2**30 else np.int64
    flat, sizes = start.ravel(), length.ravel()
    source = np.repeat((flat - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    source += np.arange(total, dtype=kind)
    output = np.concatenate([texts.data, _MARKS])[source]
    form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
    written = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(output))
    known = lambda v: pa.array(v, pa.int64(), mask=plain)
    return {"n": n, "form": form, "prefix_chars": known(at_one - _upto(chars, lo)), "middle_chars": known(at_two - at_one), "output": written}


EXAMPLES = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, unit: str = "code_point", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; one example per document.

    The prefix ends after the smaller of two drawn numbers of units, the middle after the larger.  `fim_percent` of the documents are
    transformed, `spm_percent` of these with the suffix first.
    """
    if unit not in BOUNDARIES:
        raise ValueError(f"unit is one of {', '.join(BOUNDARIES)}")
    names = [x.split()[0] for x in EXAMPLES.split(", ")]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h = np.stack([batch.column(f"h{i}").to_numpy() for i in range(4)])
            got = infill_batch(Texts.of(batch.column("text")), h, unit, fim_percent, spm_percent)
            columns = [got[c] if isinstance(got[c], pa.Array) else pa.array(got[c]) for c in names[1:]]
            columns[-1] = columns[-1].cast(pa.string()) if columns[-1].nbytes < 2**31 - 2**20 else columns[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    h = draws(F.col("doc_id").cast("bigint"), seed)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(c.alias(f"h{i}") for i, c in enumerate(h))).mapInArrow(transform, EXAMPLES)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; markers stand only where they were put, as texts that hold one are plain."""
    first, second = F.when(form == PSM, SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    head = F.split_part(body, first, F.lit(1))
    tail = F.split_part(body, first, F.lit(2))
    other, middle = F.split_part(tail, second, F.lit(1)), F.split_part(tail, second, F.lit(2))
    whole = F.when(form == PSM, F.concat(head, middle, other)).otherwise(F.concat(other, middle, head))
    return F.when(form == PLAIN, output).otherwise(whole)


def infill_digests(examples: DataFrame) -> DataFrame:
    """The examples with the digests of output and restored text in place of the output."""
    return examples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
