"""Keys inside longer runs of key characters, and short keys."""

import random
import re

from sextant.llm import secrets


def test_keys_in_paths_and_short_keys(spark):
    rng, letters = random.Random(3), secrets.ALPHABET[:62]
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, "see config/prod/service-name/" + key(32) + " there") for i in range(200)]
    rows += [(1000 + i, "key " + key(16)) for i in range(200)]
    rows += [(2000 + i, t) for i, (t, label) in enumerate(secrets.labelled_samples(seed=77, n=400)) if label == secrets.ORDINARY]
    got = {r.doc_id: "random:" in r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    share = lambda a, b: sum(v for k, v in got.items() if a <= k < b) / sum(a <= k < b for k in got)
    assert share(0, 1000) > 0.97 and share(1000, 2000) > 0.6 and share(2000, 9000) < 0.01


def _random_spans(text):
    """The rule for runs by plain Python: whole runs and their best stretch."""
    w, size, place = secrets.default_weights(), len(secrets.ALPHABET) + 1, {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % secrets.LEAST_LENGTH, text):
        scores = [w[place[a] * size + place[b]] for a, b in zip(m[0], m[0][1:])]
        best = max(sum(scores[i:j]) - secrets.PER_PAIR * (j - i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
        whole = len(m[0]) >= secrets.LEAST_WHOLE and sum(scores) >= max(secrets.IN_ALL, secrets.PER_PAIR * len(scores))
        if abs(best - secrets.BEST_STRETCH) < 1e-6:
            return None  # too near to the threshold for sums in another order
        if whole or best >= secrets.BEST_STRETCH:
            out.append(f"random:{m.start()}:{m.end()}")
    return out


def test_random_spans_against_brute_force(spark):
    rng, letters = random.Random(9), secrets.ALPHABET[:62]
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [t for t, _ in secrets.labelled_samples(seed=31, n=150)]
    texts += [f"x={key(24)}== and é😀 {key(rng.randint(10, 40))}/{'word' * 5}-{key(5)}, ===={key(18)}=" for _ in range(60)]
    texts += ["a" * 300, "=" * 50, "0123456789abcdef" * 4, ""]
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("random:")] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = {i: _random_spans(t) for i, t in enumerate(texts)}
    assert all(got[i] == w for i, w in want.items() if w is not None) and sum(bool(w) for w in want.values()) > 100
    assert got[texts.index(next(t for t in texts if t.startswith("x=")))][0].startswith("random:2:")
