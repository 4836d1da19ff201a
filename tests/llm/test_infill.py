"""Fill-in-the-middle against plain Python, over code points, words and lines."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa

from sextant.llm import infill
from sextant.llm.words import Texts

UNITS = {"code_point": r"(?s).", "word": r"[ \t\n\r\f\v]+(?=[^ \t\n\r\f\v]|$)|[^ \t\n\r\f\v]+[ \t\n\r\f\v]*", "line": r"[^\n]*\n|[^\n]+"}
TEXTS = ["", None, "a", "é", "😀", "日本語 text", "two words", "  led by space", "a\nb\n\nc", "\n", "<P>", "x<S>y", "<", "<M", "M>", "P>and<", "<X>", "é combined", "nul \x00 byte", "tail<", "a" * 70_000 + "é" * 30_000, "word and more\n" * 9_000]


def plain(doc_id, text, unit="code_point"):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", UNITS)
def test_against_plain_python(spark, unit):
    rows = [(None if i % 50 == 7 else i, TEXTS[i % len(TEXTS)]) for i in range(220)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("h0", "n", "form", "output")})
    got = [tuple(r) for r in infill.fill_in_middle(docs, unit).collect()]
    want = [(d, *plain(d, t, unit)) for d, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r[0] for r in spark.createDataFrame(got, infill.EXAMPLES).select(infill.restored(F.col("output"), F.col("form"))).collect()) == texts
    assert infill.fill_in_middle(docs.limit(0), unit).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab<PSM> \n\x00é日😀")), max_size=12), min_size=1, max_size=9), st.integers(0, 2**32 - 1))
def test_batches(texts, seed):
    """Rows of a batch do not touch each other: offsets, empty texts and markers across two texts."""
    h = np.random.default_rng(seed).integers(0, 2**32, (4, len(texts)), dtype=np.int64)
    got = infill.infill_batch(Texts.of(pa.array(texts)), h, "code_point", 90, 20)
    for i, t in enumerate(texts):
        a, b = sorted((int(h[0, i]) % (len(t) + 1), int(h[1, i]) % (len(t) + 1)))
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2, i] % 100 >= 90 else "spm" if h[3, i] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (got["n"][i], got["form"][i], got["output"][i].as_py()) == (len(t), form, out)


def test_unit_is_known(spark):
    with pytest.raises(ValueError, match="unit is one of"):
        infill.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "sentence")
