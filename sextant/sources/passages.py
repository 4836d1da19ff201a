"""A Spark data source for collections of passages: tab-separated lines, plain or compressed, in one file or many, read in parts.

    spark.dataSource.register(PassageSource)
    spark.read.format("passages").option("path", "/data/*.tsv.gz").load()

Rows are `doc_id, did, text, file, line`.  Plain files are split into ranges of bytes; a line belongs to the range that its first byte is in, so a line is read once
whatever the ranges.  A compressed file cannot be entered in the middle, so it is one part and the files of a folder are read side by
side, and BGZF files (gzip in independent blocks, as `bgzip` writes them) are split between blocks.  Lines are read one at a time; memory does not follow
the size of a file.  A line with too few columns is a row without text, or is left out (`mode=dropmalformed`), or is an error (`mode=failfast`).

Python reads these files itself, so the path is one that every executor has (a mounted store); for other stores use Spark's own readers.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, did string, text string, file string, line bigint"
#: Bytes of a part of a plain or block-compressed file.
PART_BYTES = 64 << 20
MODES = ("permissive", "dropmalformed", "failfast")
# The first bytes of a gzip member with an extra field, and the mark of the block size in it.
_GZIP_EXTRA, _BLOCK_MARK = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


@dataclass
class Part(InputPartition):
    """Lines that begin in file[start:end]; kind is plain, gzip or blocks; `before` is the last block with any bytes before a part of blocks."""

    file: str
    kind: str
    start: int
    end: int
    before: int | None = None


def kind_of(file: str) -> str:
    with open(file, "rb") as f:
        head = f.read(18)
    if head[:2] != _GZIP_EXTRA[:2]:
        return "plain"
    return "blocks" if head[:4] == _GZIP_EXTRA and head[12:16] == _BLOCK_MARK else "gzip"


def blocks_of(file: str) -> Iterator[tuple[int, int]]:
    """Where the blocks of a BGZF file begin and how many bytes they hold, from headers and trailers alone."""
    at, size = 0, os.path.getsize(file)
    with open(file, "rb") as f:
        while at < size:
            f.seek(at)
            head = f.read(18)
            if head[:4] != _GZIP_EXTRA or head[12:16] != _BLOCK_MARK:
                raise ValueError(f"{file}: no block at {at}")
            after = at + int.from_bytes(head[16:18], "little") + 1
            f.seek(after - 4)
            yield at, int.from_bytes(f.read(4), "little")
            at = after


def parts_of(file: str, part_bytes: int) -> list[Part]:
    kind, size = kind_of(file), os.path.getsize(file)
    if kind == "gzip" or not size:
        return [Part(file, kind, 0, size)] if size else []
    cuts: list[tuple[int, int | None]] = [(at, None) for at in range(0, size, part_bytes)] if kind == "plain" else []
    if kind == "blocks":
        before = None
        for at, held in blocks_of(file):
            if not cuts or at - cuts[-1][0] >= part_bytes:
                cuts.append((at, before))
            before = at if held else before
    return [Part(file, kind, a, b, before) for (a, before), b in zip(cuts, [*(at for at, _ in cuts[1:]), size])]


def _lines(f: BinaryIO, start: int, ends: bool) -> Iterator[tuple[int, bytes]]:
    """Lines of an open file with the place of their first byte; the rest of a line that began before is passed over."""
    at = start
    if ends:
        at += len(f.readline())
    for line in f:
        yield at, line
        at += len(line)


def lines_of(part: Part) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in a part: their place (in the file, or in a compressed file's part) and bytes."""
    if part.kind == "gzip":
        with gzip.open(part.file) as f:
            yield from _lines(f, 0, False)
        return
    if part.kind == "plain":
        with open(part.file, "rb") as f:
            # One byte before: if it ends a line, the first byte of the part begins one.
            f.seek(max(0, part.start - 1))
            for at, line in _lines(f, max(0, part.start - 1), part.start > 0):
                if at >= part.end:
                    return
                yield at, line
        return
    yield from _block_lines(part)


def _block_lines(part: Part) -> Iterator[tuple[int, bytes]]:
    """Of a block-compressed file: a line belongs to the part of the block that its first byte is in."""
    size = os.path.getsize(part.file)
    with open(part.file, "rb") as raw:

        def block(at: int) -> tuple[bytes, int]:
            raw.seek(at + 16)
            length = int.from_bytes(raw.read(2), "little") + 1
            raw.seek(at)
            return gzip.decompress(raw.read(length)), at + length

        begun = part.before is None or block(part.before)[0].endswith(b"\n")
        at, held, place = part.start, b"", 0
        while at < size and (at < part.end or held):
            data, after = block(at)
            inside = at < part.end
            *whole, held = (held + data).split(b"\n")
            for line in whole:
                if begun:
                    yield place, line
                    place += len(line) + 1
                begun = True
                if not inside:
                    return  # the line that began in the part is done
            at = after
            if not begun:
                held = b""  # of a line that began before
        if begun and held:
            yield place, held


class PassageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for pattern in options["path"].split(",") for p in _files(pattern.removeprefix("file://")))
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.mode = options.get("mode", "permissive").lower()
        self.columns = options.get("columns", "doc_id,text").split(",")
        unknown = set(self.columns) - {"doc_id", "did", "text"}
        if self.mode not in MODES or unknown or self.part_bytes < 1:
            raise ValueError(f"mode is one of {MODES}, columns are among doc_id, did and text, partBytes is a size")

    def partitions(self) -> list[Part]:
        return [p for f in self.paths for p in parts_of(f, self.part_bytes)]

    def read(self, part: Part | None) -> Iterator[tuple]:
        for at, raw in lines_of(part) if part else ():  # no files: Spark asks for a part all the same
            line = raw.rstrip(b"\r\n").decode("utf-8", "replace")
            fields = line.split("\t", len(self.columns) - 1)
            if len(fields) < len(self.columns):
                if self.mode == "failfast":
                    raise ValueError(f"{part.file}: {len(fields)} columns at {at}")
                if self.mode == "dropmalformed":
                    continue
            row = dict(zip(self.columns, fields))
            yield row.get("doc_id"), row.get("did"), row.get("text"), part.file, at


def _files(pattern: str) -> list[str]:
    found = [f for p in glob.glob(pattern) for f in ([p] if os.path.isfile(p) else glob.glob(f"{p}/**", recursive=True))]
    return [f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", "."))]


class PassageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "passages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PassageReader:
        if "path" not in self.options:
            raise ValueError("the option path names the files")
        return PassageReader(dict(self.options))


def mapped(passages: DataFrame, pid2did: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, did of the passages (doc_id) that have a document, and a row with the number of those that don't and the first of them."""
    joined = passages.select("doc_id").distinct().join(pid2did.select("doc_id", "did"), "doc_id", "left")
    lost = F.col("did").isNull()
    report = joined.agg(F.count_distinct("doc_id").alias("n"), F.count_distinct(F.when(lost, F.col("doc_id"))).alias("missing"), F.min(F.when(lost, F.col("doc_id"))).alias("first_missing"))
    return joined.where(~lost), report
