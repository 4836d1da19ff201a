"""Secrets: patterns, and strings that look random rather than named.

Base spans are assignments of passwords, tokens and the like, access keys and long hex
strings.  Beyond them, every long run of key characters (with up to two signs of padding) is scored by two Markov models of
character pairs, one of random strings and one of ordinary identifiers; where the
log-likelihood ratio, in all and per character, is high enough for the run or for its best
stretch (a key at the end of a path), the run is a span of the kind `random`.  The models learn from labelled samples when the plan is made; scoring is one
array look-up per character pair, in DataFrame functions.

Defined results: a null or empty text has no spans; spans of different kinds may overlap
and all stay; repeated rows are rows of their own; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import Kind, clean, digest, together, with_spans, written

_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+"""
BASE = [
    Kind("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]++", lambda m: F.char_length(F.regexp_replace(m, "^" + _ASSIGN, "")) >= 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}+"),
    Kind("hex", r"[0-9a-f]{24,}+"),
]
NAMES = [k.name for k in BASE]

#: Shortest run that is scored, and shortest that is scored as a whole.
LEAST_LENGTH, LEAST_WHOLE = 16, 20
#: Natural-log likelihood ratio, per character pair and in all, from which a run is random.
PER_PAIR, IN_ALL = 0.4, 15.0
#: What a run's best stretch has over PER_PAIR for each of its pairs, in all, from which the run is random.
BEST_STRETCH = 8.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RANDOM, ORDINARY = 1, 0


#: Everyday words of several languages, for the ordinary samples.
WORDS = """
the quick brown fox jumps over lazy dog and with from this that have were which their about would there other after first
people should because through between before where under while great might world still every never again money water
house school number night point right story young music group problem company system question government example
und der die das nicht mit auch eine werden haben schiff fahrt gesellschaft dampf donau strasse haus zeit jahr wissenschaft
les des pour dans avec sur pas plus par est une qui que sont nous vous leur tout comme autre monde temps jour
los las para con por una como pero sus este entre cuando todo sobre tambien desde donde ciudad gobierno pueblo
account address admin balance buffer cache callback channel column command config connection container context counter
default description device directory document element encoding environment error event exception filter format function handler
header identifier image import instance interface internal iterator language length library limit listener location manager
message method module network object offset option output package parameter parent password pattern position process property protocol
provider query queue record reference region register request resource response result schema security sequence service session
setting source status storage stream string structure table template thread timeout token transaction transform update validator version window
""".split()


def labelled_samples(seed: int = 5, n: int = 4000) -> list[tuple[str, int]]:
    """Random strings in the usual alphabets, and identifiers, paths and long words from syllables."""
    rng = random.Random(seed)
    heads, cores, tails = "b c d f g h j k l m n p r s t v w st tr pr th sh ch br cl".split(), "a e i o u ai ea ou ie io".split(), " n r s t l nd nt ng st er on".split(" ")

    def word() -> str:
        if rng.random() < 0.6:
            return rng.choice(WORDS)
        return "".join(rng.choice(heads) + rng.choice(cores) + rng.choice(tails) for _ in range(rng.randint(1, 4)))

    out = []
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[:26] + "0123456789", ALPHABET[26:62]]
    for i in range(n):
        letters = alphabets[i % len(alphabets)]
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(20, 64))), RANDOM))
        words = [word() for _ in range(rng.randint(3, 7))]
        shape = i % 7
        if shape == 0:
            text = "_".join(words)
        elif shape == 1:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif shape == 2:
            text = "-".join(words) + f"-{rng.randint(1, 2030)}"
        elif shape == 3:
            text = "/".join(words)
        elif shape == 4:
            text = "_".join(words).upper()
        elif shape == 5:
            text = "".join(words)
        else:
            text = rng.choice(ALPHABET + "=-_/" * 60) * rng.randint(20, 60) if rng.random() < 0.6 else "".join(w.title() for w in words) + str(rng.randint(0, 99))
        out.append((text, ORDINARY))
    return out


def pair_weights(samples: Iterable[tuple[str, int]], smoothing: float = 3.0) -> list[float]:
    """log P_random(b|a) - log P_ordinary(b|a), by place of a and b in the alphabet (0: not in it)."""
    size = len(ALPHABET) + 1
    place = {c: i + 1 for i, c in enumerate(ALPHABET)}
    counts = [[[smoothing] * size for _ in range(size)] for _ in range(2)]
    for text, label in samples:
        codes = [place.get(c, 0) for c in text]
        for a, b in zip(codes, codes[1:]):
            counts[label][a][b] += 1
    logs = [[[math.log(x / sum(row)) for x in row] for row in table] for table in counts]
    return [round(logs[RANDOM][a][b] - logs[ORDINARY][a][b], 3) for a in range(size) for b in range(size)]


@lru_cache(maxsize=4)
def default_weights() -> tuple[float, ...]:
    return tuple(pair_weights(labelled_samples()))


def ratio(run: Column, weights: tuple[float, ...]) -> Column:
    """Log-likelihood ratio of a run of key characters, random over ordinary: in all, now and best over PER_PAIR a pair."""
    size = len(ALPHABET) + 1
    table = F.lit(list(weights))
    codes = F.transform(F.split(run, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))
    pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.char_length(run)), lambda a, b: F.when(b.isNotNull() & (b > 0), F.element_at(table, a * size + b + 1)).otherwise(F.lit(0.0)))

    def add(acc: Column, x: Column) -> Column:
        now = F.greatest(F.lit(0.0), acc["now"] + x - PER_PAIR)
        return F.struct((acc["all"] + x).alias("all"), now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    # The last pair has no second character and counts nothing.
    return F.aggregate(pairs, F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("now"), F.lit(0.0).alias("best")), add)


def kinds(weights: tuple[float, ...] | None = None) -> list[Kind]:
    weights = weights or default_weights()

    def looks_random(run: Column) -> Column:
        def holds(r: Column) -> Column:
            whole = (F.char_length(run) >= LEAST_WHOLE) & (r["all"] >= F.greatest(F.lit(IN_ALL), PER_PAIR * (F.char_length(run) - 1)))
            return whole | (r["best"] >= BEST_STRETCH)

        return F.exists(F.array(ratio(run, weights)), holds)

    return [*BASE, Kind("random", rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}+={{0,2}}", looks_random)]


def find_secrets(docs: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean(F.col("text")).alias("text"))
    rows = with_spans(rows, "text", kinds(weights), "of_").drop("text")
    rows = rows.withColumn("base", together([f"of_{n}" for n in NAMES]))
    return rows.select(
        "doc_id",
        *(F.size(f"of_{n}").cast("bigint").alias(f"n_{n}") for n in NAMES),
        digest(written(F.col("base"))).alias("base_sha256"),
        written(together(["base", "of_random"])).alias("spans"),
    )
