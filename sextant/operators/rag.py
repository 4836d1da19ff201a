"""Prompts of a question and its retrieved passages, and answers with citations from an injected generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import Searcher

# The wording around the excerpts.
QUESTION_PREFIX = "Question: "
EXCERPTS_HEADING = "Case excerpts (retrieved by relevance):"
CLOSING = "Answer the question using only the excerpts above."
NOTHING_FOUND = "No relevant case excerpts were found for this question. Try rephrasing or broadening the query."
TOP_K = 5
ANSWER = "query_id string, answer string, citations array<struct<doc_id:string,quote:string>>, retrieved array<string>"


def prompts(queries: DataFrame, hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, prompt, retrieved for every query with hits, passages in rank order; one that the corpus lacks has an empty text."""
    rows = hits.select("query_id", "doc_id", "rank").join(corpus.select("doc_id", "text"), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("h"))
    excerpts = F.array_join(F.transform("h", lambda x: F.concat(F.lit("[doc_id: "), x["doc_id"], F.lit("]\n"), x["text"])), "\n\n")
    text = F.concat(F.lit(QUESTION_PREFIX), F.col("query"), F.lit(f"\n\n{EXCERPTS_HEADING}\n"), excerpts, F.lit(f"\n\n{CLOSING}"))
    return parts.join(queries.select("query_id", "query"), "query_id").select("query_id", text.alias("prompt"), F.transform("h", lambda x: x["doc_id"]).alias("retrieved"))


@dataclass
class Assistant:
    """Retrieval, prompts and cited answers in one.

    `generate(model=, messages=, temperature=, max_tokens=) -> {answer, citations}` is injected; messages
    are the instructions, which the caller gives, and the prompt.
    """

    searcher: Searcher
    corpus: DataFrame
    generate: Callable[..., dict]
    model: str
    instructions: str
    top_k: int = TOP_K
    temperature: float = 0.1
    max_tokens: int = 4096
    retries: int = 2

    def ask(self, queries: DataFrame) -> DataFrame:
        """query_id, answer, citations, retrieved for every query (query_id, query, and what the searcher needs)."""
        generate, model, instructions, temperature, max_tokens = self.generate, self.model, self.instructions, self.temperature, self.max_tokens

        def one(prompt: str) -> dict:
            messages = [{"role": "system", "content": instructions}, {"role": "user", "content": prompt}]
            return generate(model=model, messages=messages, temperature=temperature, max_tokens=max_tokens)

        return answer(queries, prompts(queries, self.searcher.search(queries, self.top_k), self.corpus), one, self.retries)


def answer(queries: DataFrame, asked: DataFrame, generate: Callable[[str], dict], retries: int = 2) -> DataFrame:
    """Answers of `generate(prompt) -> {answer, citations}`; citations of passages that were not retrieved are dropped.

    Queries without a prompt get a fixed answer, and the generator is not called for them.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row.prompt is None:
                    out.append((row.query_id, NOTHING_FOUND, [], []))
                    continue
                for attempt in range(retries + 1):
                    try:
                        got = generate(row.prompt)
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                held = set(row.retrieved)
                out.append((row.query_id, got["answer"], [c for c in got.get("citations", []) if c["doc_id"] in held], list(row.retrieved)))
            yield pd.DataFrame(out, columns=["query_id", "answer", "citations", "retrieved"])

    rows = queries.select(F.col("query_id").cast("string")).join(asked, "query_id", "left").select("query_id", "prompt", "retrieved")
    return rows.mapInPandas(apply, ANSWER)


def short_quote(quote: str, most: int = 160) -> str:
    """A quote as it is printed: at most 160 characters, the last three dots if cut."""
    return quote if len(quote) <= most else quote[: most - 3] + "..."
