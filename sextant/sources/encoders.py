"""Slots and encoders: what a vector column is made of, and by which model."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm

KINDS = ("dense", "sparse", "late_interaction")
BACKENDS = ("local", "sentence", "http", "ngram")
# HTTP answers that are worth another try.
RETRIED = frozenset({429, 500, 502, 503, 504})


@dataclass(frozen=True)
class Slot:
    """A named vector column."""

    name: str
    model_id: str
    kind: str = "dense"
    backend: str = "local"
    size: int | None = None
    distance: str = "cosine"
    query_prompt: str | None = None
    with_idf: bool = False
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.backend not in BACKENDS:
            raise ValueError(f"unknown kind or backend: {self.kind}, {self.backend}")
        if self.backend == "ngram" and self.kind != "sparse":
            raise ValueError("n-gram slots are sparse")
        if self.backend in ("sentence", "http") and self.kind != "dense":
            raise ValueError(f"{self.backend} slots are dense")
        if self.kind in ("dense", "late_interaction") and not self.size:
            raise ValueError(f"slot {self.name} needs a size")

    def api_key(self, variable: str, environment: Mapping[str, str] = os.environ) -> str:
        """The key among the options, or else in the environment; an HTTP slot without one is an error."""
        key = self.options.get("api_key") or environment.get(variable)
        if not key:
            raise ValueError(f"slot {self.name} needs an API key: the option api_key, or {variable}")
        return key

    def encoder_options(self) -> dict[str, Any]:
        """Options for the encoder; n-gram slots have defaults, and API keys are kept apart."""
        own = {"max_n": 2, "k1": 1.5, "b": 0.75} if self.backend == "ngram" else {}
        return own | {k: v for k, v in self.options.items() if k != "api_key"}

    def prompted(self, query: str) -> str:
        return (self.query_prompt or "") + query


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


def with_retry(call: Callable[[], tuple[int, Any]], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls until the status is no longer one to retry; waits 1, 2, 4, ... seconds between."""
    for attempt in range(attempts):
        status, body = call()
        if status < 400:
            return body
        if status not in RETRIED or attempt == attempts - 1:
            raise RuntimeError(f"request failed with status {status}")
        sleep(2.0**attempt)
    raise AssertionError("unreachable")


@dataclass
class HttpEncoder:
    """Encodes through an injected `post(model, texts) -> (status, [{index, embedding}])`, in batches, order kept."""

    model: str
    post: Callable[[str, list[str]], tuple[int, list[dict]]]
    batch_size: int = 64
    prefix: str = ""

    def encode(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch_size):
            part = texts[at : at + self.batch_size]
            rows = with_retry(lambda part=part: self.post(self.model.removeprefix(self.prefix), part))
            if len(rows) != len(part):
                raise ValueError(f"{len(part)} texts, {len(rows)} vectors")
            out += [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
        return out


_MADE: dict[str, Encoder] = {}


class Encoders:
    """Makers of encoders by backend; what they make depends on the slot alone, and each worker makes it once."""

    def __init__(self, **makers: Callable[[Slot], Encoder]):
        unknown = set(makers) - set(BACKENDS)
        if unknown:
            raise ValueError(f"unknown backends: {sorted(unknown)}")
        self.makers = makers

    def _made(self, slot: Slot) -> Callable[[], Encoder]:
        if slot.backend not in self.makers:
            raise ValueError(f"no encoder for the backend {slot.backend}")
        maker = self.makers[slot.backend]
        return lambda: maker(slot)

    def documents(self, slot: Slot, rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """id, vec of every row; vectors of a slot by cosine have length one."""
        return self._scaled(slot, encode_column(rows, self._made(slot), f"{slot.backend}:{slot.model_id}:{slot.name}", id_column, text))

    def queries(self, slot: Slot, queries: DataFrame) -> DataFrame:
        """query_id, vec of every query (query_id, query), which the slot's prompt goes before."""
        asked = queries.select("query_id", F.concat(F.lit(slot.query_prompt or ""), F.col("query")).alias("text"))
        return self.documents(slot, asked, "query_id")

    def _scaled(self, slot: Slot, vectors: DataFrame) -> DataFrame:
        if slot.kind != "dense" or slot.distance != "cosine":
            return vectors
        size = norm(F.col("vec"))
        return vectors.withColumn("vec", F.when(size > 0, F.transform("vec", lambda x: (x / size).cast("float"))).otherwise(F.col("vec")))


def encode_column(rows: DataFrame, make: Callable[[], Encoder], key: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and vec for every row, in Arrow batches; each worker makes the encoder of `key` once."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sextant.sources import encoders

        if key not in encoders._MADE:
            encoders._MADE[key] = make()
        for b in batches:
            vectors = encoders._MADE[key].encode(b[text].tolist()) if len(b) else []
            yield pd.DataFrame({id_column: b[id_column], "vec": pd.Series(vectors, index=b.index, dtype=object)})

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, text).mapInPandas(apply, f"{id_column} {kind}, vec array<float>")


def model_catalogue(models: DataFrame, size: str = "size", drop: tuple[str, ...] = ()) -> DataFrame:
    """Known models from the smallest on, without the columns named."""
    return models.orderBy(size).drop(*drop)
