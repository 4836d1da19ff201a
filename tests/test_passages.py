"""The passage source: parts of plain, gzip and block-compressed files; every line once."""

import gzip
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.sources.passages import PassageSource, blocks_of, kind_of, lines_of, mapped, parts_of


def blocked(data, size):
    """BGZF: gzip members that say how long they are."""
    out = b""
    for at in range(0, max(len(data), 1), size):
        raw = data[at : at + size]
        body = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = body.compress(raw) + body.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC\x02\x00" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\té"), max_size=9), max_size=12), st.booleans(), st.integers(1, 60), st.sampled_from(["plain", "gzip", "blocks"]), st.integers(1, 12))
def test_every_line_once(tmp_path_factory, lines, ends, part_bytes, kind, block):
    data = "\n".join(lines).encode() + (b"\n" if ends and lines else b"")
    file = tmp_path_factory.mktemp("f") / "x"
    file.write_bytes({"plain": lambda: data, "gzip": lambda: gzip.compress(data), "blocks": lambda: blocked(data, block)}[kind]())
    want = data.decode().split("\n")
    if want[-1] == "":
        want.pop()
    parts = parts_of(str(file), part_bytes)
    got = [line.rstrip(b"\n").decode() for p in parts for _, line in lines_of(p)]
    assert got == want
    if kind == "blocks":
        assert kind_of(str(file)) == "blocks" and len(list(blocks_of(str(file)))) == -(-max(len(data), 1) // block)


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(PassageSource)
    return lambda path, **options: spark.read.format("passages").options(path=str(path), **options).load()


@pytest.fixture
def rows():
    return [(f"p{i}", f"text {i} é\twith a tab") for i in range(500)]


@pytest.mark.parametrize("kind", ["plain", "gzip", "blocks"])
def test_parts(source, rows, tmp_path, kind):
    data = "".join(f"{p}\t{t}\r\n" for p, t in rows).encode()
    name = {"plain": "a.tsv"}.get(kind, "a.tsv.gz")
    (tmp_path / name).write_bytes({"plain": data, "gzip": gzip.compress(data), "blocks": blocked(data, 700)}[kind])
    got = source(tmp_path / "*", partBytes=1500)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(rows)
    n = got.rdd.getNumPartitions()
    assert n == 1 if kind == "gzip" else n > 2
    assert got.select("file").distinct().count() == 1


def test_many_compressed_files(source, rows, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(4):
        (tmp_path / "in" / "deep" / f"{i}.tsv.gz").write_bytes(gzip.compress("".join(f"{p}\t{t}\n" for p, t in rows[i::4]).encode()))
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    got = source(tmp_path / "in")
    assert got.rdd.getNumPartitions() == 4 and got.count() == 500


def test_malformed_lines_and_columns(source, tmp_path):
    (tmp_path / "m.tsv").write_bytes(b"p1\td1\tone\np2\n\np3\td3\t\xff\n")
    read = lambda **o: [(r.doc_id, r.did, r.text) for r in source(tmp_path / "m.tsv", columns="doc_id,did,text", **o).orderBy("line").collect()]
    assert read() == [("p1", "d1", "one"), ("p2", None, None), ("", None, None), ("p3", "d3", "�")]
    assert read(mode="DROPMALFORMED") == [("p1", "d1", "one"), ("p3", "d3", "�")]
    with pytest.raises(Exception, match="1 columns at 10"):
        read(mode="failfast")
    with pytest.raises(Exception, match="mode is one of"):
        read(mode="odd")


def test_missing_documents_are_counted(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "doc_id string")
    held, report = mapped(asked, spark.createDataFrame([("a", "d1"), ("x", "d2")], "doc_id string, did string"))
    assert [(r.doc_id, r.did) for r in held.collect()] == [("a", "d1")]
    assert tuple(report.first()) == (3, 2, "b")


def test_no_files(source, tmp_path):
    assert source(tmp_path / "none*").count() == 0
    (tmp_path / "empty").write_bytes(b"")
    assert source(tmp_path / "empty").count() == 0
