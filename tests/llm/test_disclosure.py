"""Terms that stand in the documents of an entity, near it or far from it."""

import math
import random
import re
import struct
from collections import Counter
from fractions import Fraction

import xxhash
from pyspark.sql import functions as F

from sextant.llm import pii

from test_against_brute_force import PII


def test_terms_far_from_their_entity(spark):
    rng = random.Random(8)
    gap = lambda: " ".join(f"plain{rng.randrange(300)}" for _ in range(30))
    rows = [(i, f"Quuxley {gap()} mail m{i} n{i} o{i} jane@corp.example.com p{i}") for i in range(7)]
    rows += [(i, f"mail m{i} n{i} quuxley jane@corp.example.com p{i} {gap()}") for i in range(7, 10)]  # near in three of ten
    rows += [(20 + i, f"Listed{i} Vexmoor {gap()} a{i}@one.example.com, joe@corp.example.com, b{i}@two.example.com {gap()}") for i in range(4)]
    same = f"kwyjibo {gap()} same words here jim@corp.example.com"
    rows += [(30 + i, same) for i in range(5)] + [(40 + i, f"{same} but{i}") for i in range(5)]  # copies and near copies
    rows += [(100 + i, f"nothing to see, text {i}: {gap()} mail listed{i} same words here but{i % 5}") for i in range(186)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit(1).cast("bigint"))
    got = {r.term: r.disclosure for r in pii.disclosing_terms(df).collect()}
    assert got.keys() == {"quuxley", "vexmoor"} and min(got.values()) > 0.999
    assert "term:0:7" in {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}[0]


def test_signature_lines_are_evidence_and_near_copies_are_not(spark):
    rng = random.Random(6)
    text = lambda n, of: " ".join(f"{of}{rng.randrange(500)}" for _ in range(n))
    signed = "with kind regards Wenzel Okonjo sales wenzel@corp.example.com call any time you like"
    rows = [(i, f"{text(40, 'w')} {signed}") for i in range(20)]
    page = text(60, "v").split()
    for i in range(30):  # near copies: one word of sixty is another, now and then next to the address
        words = [*page]
        words[rng.randrange(60)] = f"odd{i}"
        rows.append((100 + i, " ".join(words) + " quimby said that one can write to quimby@corp.example.com at every hour"))
    rows += [(200 + i, text(30, "w") + " with kind regards sales call any time you like said that one can write to at every hour") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.term for r in pii.disclosing_terms(df).collect()}
    assert got == {"okonjo", "wenzel"}
    assert "term:" in {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}[3]


def _hash(*values):
    """Spark's xxhash64 of longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return (seed ^ 1 << 63) - (1 << 63)


def _sketch(words):
    low = sorted((h ^ 1 << 63) - (1 << 63) for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in words or {""}))[: pii.LOWEST]
    tokens = [min(_hash(h, j) for h in low) for j in range(pii.BANDS * pii.IN_BAND)]
    return [_hash(b, *tokens[b * pii.IN_BAND : (b + 1) * pii.IN_BAND]) for b in range(pii.BANDS)]


def _brute_force(rows):
    """Terms by the definition, over all words and entities, without any bound."""
    docs = sorted({(i, t or "") for i, t in rows}, key=str)
    words = [set(re.findall(r"[^\W_]+", t.lower())) for _, t in docs]
    sketches = [_sketch(w) for w in words]
    places, bare = {}, []
    for d, (_, t) in enumerate(docs):
        spans = sorted((m.start(), k, m.end(), n, m[0]) for k, (n, p, flags, holds) in enumerate(PII) for m in re.finditer(p, t, flags) if holds(m))
        outside = t
        for n, p, flags, holds in PII:
            outside = re.sub(p, lambda m, holds=holds: "\n" if holds(m) else m[0], outside, flags=flags)
        bare.append(set(re.findall(r"[^\W_]+", outside.lower())))
        for a, k, b, n, value in spans:
            entity = f"{n}:" + (re.sub("[^0-9]", "", value) if k >= 2 else value.lower())
            places.setdefault(entity, set()).add(d)
    n = len(docs)
    out = {}
    for entity, of in places.items():
        held = Counter(v for d in of for v in sketches[d])
        weight = {d: int(Fraction(pii.UNIT * len(sketches[d]), sum(held[v] for v in sketches[d]))) for d in of}
        differ = lambda docs, weight=weight: sum(weight[d] for d in docs) >= 3 * pii.UNIT
        if len(of) < 3 or not differ(of) or len(of) == n:
            continue
        for term in set().union(*(words[d] for d in of)):
            both = [d for d in of if term in words[d]]
            if len(both) < 3 or all(term not in bare[d] for d in both) or not differ(both):
                continue
            holding = sum(term in w for w in words)
            share = math.log(len(both) / holding * n / len(of)) / math.log(n / len(of))
            if share >= pii.GENERALISE - 1e-9:
                out[term] = max(out.get(term, 0), share)
    return out


def test_terms_against_brute_force(spark):
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(60)]
    people = [(f"p{i}@corp.example.com", [f"name{i}", f"desk{i}", "x" * (i + 1)]) for i in range(8)]
    rows = []
    for i in range(300):
        w = [rng.choice(filler) for _ in range(rng.randint(4, 30))]
        if rng.random() < 0.4:
            mail, terms = rng.choice(people)
            w.insert(rng.randrange(len(w)), mail)
            for t in terms:
                if rng.random() < 0.8:
                    w.insert(rng.randrange(len(w)), t.title() if rng.random() < 0.5 else t)
        elif rng.random() < 0.1:
            w.append(rng.choice(rng.choice(people)[1]))
        rows.append((i, " ".join(w)))
    rows += rows[:40] + [(400 + i, rows[3][1]) for i in range(5)] + [(None, None), (None, "+1 743 555 3824 name1")]
    got = {r.term: round(r.disclosure, 9) for r in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    want = {t: round(v, 9) for t, v in _brute_force(rows).items()}
    assert got == want and len(want) > 8
