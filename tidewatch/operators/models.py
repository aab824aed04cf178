"""Calls to embedding and text models over a column, with offline defaults."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.prompts import likely_cause
from tidewatch.session import materialize


class Embedder(Protocol):
    """Texts to vectors, one per text and in order. ``kind``: query or document."""

    name: str
    dim: int

    def embed(self, texts: Sequence[str], kind: str) -> list[Sequence[float]]: ...


class Writer(Protocol):
    """Prompts to replies, one per prompt and in order."""

    def write(self, prompts: Sequence[str], max_tokens: int) -> list[str]: ...


class HashEmbedder:
    """Deterministic offline vectors: signed hashes of words and word pairs."""

    def __init__(self, dim: int = 64, name: str = "hash-1"):
        self.dim, self.name = dim, name

    def embed(self, texts: Sequence[str], kind: str = "document") -> list[Sequence[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            words = text.lower().split()
            for token in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                code = zlib.crc32(token.encode("utf-8"))
                row[(code >> 1) % self.dim] += 1.0 if code & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


def checked_vectors(vectors, n: int) -> list[list[float]]:
    """The reply of an embedder, or an error: wrong number, or an empty vector."""
    if not isinstance(vectors, list) or len(vectors) != n:
        got = len(vectors) if isinstance(vectors, list) else "no"
        raise RuntimeError(f"embedder returned {got} vectors for {n} inputs")
    for i, v in enumerate(vectors):
        if not isinstance(v, (list, tuple, np.ndarray)) or len(v) == 0:
            raise RuntimeError(f"embedder returned an empty vector at index {i}")
    return [[float(x) for x in v] for v in vectors]


def patient(call: Callable[[list], list], values: list, timeout: float | None, retries: int) -> list:
    """``call(values)``, tried again up to ``retries`` times; an attempt ends after ``timeout`` seconds."""
    for attempt in range(retries + 1):
        try:
            if timeout is None:
                return call(values)
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(call, values).result(timeout)
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        except Exception:
            if attempt == retries:
                raise
    return []


def _answered(
    df: DataFrame, column: str, call: Callable[[list], list], out: str, kind: str, batch: int, on_error: str, timeout: float | None, retries: int
) -> DataFrame:
    """``df`` with the answer to each distinct value of ``column``, asked once and written down.

    Values are told apart by a 256-bit hash, which is also what they are joined on.
    With ``on_error="row"`` a failing batch is asked again one by one, and what
    fails then gives ``<out>_error`` in its rows.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                values, errors = part["__value"].tolist(), [None] * len(part)
                try:
                    answers = patient(call, values, timeout, retries)
                except Exception:
                    if on_error == "raise":
                        raise
                    answers = [None] * len(part)
                    for i, value in enumerate(values):
                        try:
                            answers[i] = patient(call, [value], timeout, retries)[0]
                        except Exception as exc:  # noqa: BLE001 - the row says what went wrong
                            errors[i] = f"{type(exc).__name__}: {exc}"
                yield pd.DataFrame({"__hash": part["__hash"], out: answers, f"{out}_error": errors})

    hashed = F.sha2(F.col(column), 256)
    values = df.where(F.col(column).isNotNull()).groupBy(hashed.alias("__hash")).agg(F.first(column).alias("__value"))
    answers = materialize(values.mapInPandas(ask, f"__hash string, {out} {kind}, {out}_error string"), "answers")
    joined = df.withColumn("__hash", hashed).join(answers, "__hash", "left").drop("__hash")
    return joined.drop(f"{out}_error") if on_error == "raise" else joined


def embed(
    df: DataFrame,
    text: str,
    client: Embedder | None = None,
    kind: str = "document",
    out: str = "embedding",
    batch: int = 128,
    on_error: str = "raise",
    timeout: float | None = None,
    retries: int = 0,
) -> DataFrame:
    """Add the vector of a text column (null text has none).

    Equal texts are embedded once and the vectors written, so whatever reads the
    result later asks nothing again. With ``on_error="row"`` a text that fails gives
    ``<out>_error`` instead of stopping the job, for the dead-letter table.
    """
    model = client or HashEmbedder()

    def call(texts: list) -> list:
        return checked_vectors(model.embed(texts, kind), len(texts))

    return _answered(df, text, call, out, "array<float>", batch, on_error, timeout, retries)


def generate(
    df: DataFrame,
    prompt: str,
    client: Writer | Callable[[Column], Column],
    out: str = "response",
    max_tokens: int = 500,
    batch: int = 16,
    on_error: str = "raise",
    timeout: float | None = None,
    retries: int = 0,
) -> DataFrame:
    """Add the reply to a prompt column; equal prompts are sent once, failures as in :func:`embed`.

    ``client`` may also be a function of the prompt column, such as a model function of the platform's own SQL.
    """
    if not hasattr(client, "write"):
        replied = df.withColumn(out, client(F.col(prompt)))
        return replied.withColumn(f"{out}_error", F.lit(None).cast("string")) if on_error == "row" else replied

    def call(prompts: list) -> list:
        replies = client.write(prompts, max_tokens)
        if len(replies) != len(prompts):
            raise RuntimeError(f"writer returned {len(replies)} replies for {len(prompts)} prompts")
        return replies

    return _answered(df, prompt, call, out, "string", batch, on_error, timeout, retries)


def lateral(df: DataFrame, argument: str, call: Callable[[list], list], schema: str, how: str = "inner", batch: int = 128) -> DataFrame:
    """Each row with the rows that ``call`` gives for its ``argument``, like a lateral join to a table function.

    ``call`` takes a list of arguments and returns a list of rows (dicts) for each.
    Equal arguments are asked once. ``how="left"`` keeps rows without any, with
    nulls; a null argument has none.
    """
    answered = _answered(df, argument, call, "__rows", f"array<struct<{schema}>>", batch, "raise", None, 0)
    explode = F.explode_outer if how == "left" else F.explode
    return answered.withColumn("__row", explode("__rows")).select(*df.columns, "__row.*")


# -- rule-based explanation ----------------------------------------------------------


def best_hit(results: str = "search_results"):
    """The first high-impact hit, else the first medium one, else the first."""

    def tier(level: str):
        return F.try_element_at(F.filter(results, lambda h: F.lower(h.getField("impact_level")) == level), F.lit(1))

    return F.coalesce(tier("high"), tier("medium"), F.try_element_at(F.col(results), F.lit(1)))


def explain(df: DataFrame, results: str = "search_results", reason: str = "anomaly_reason") -> DataFrame:
    """Name the best hit as the likely cause; without hits the reason stays."""
    event = df.withColumn("__event", best_hit(results))
    return event.withColumn(reason, likely_cause(F.col(reason), "__event")).drop("__event")


def pick_by_tier(hits: DataFrame, query: str = "query_id", level: str = "impact_level", rank: str = "rank") -> DataFrame:
    """:func:`best_hit` over hits kept as rows."""
    tier = F.when(F.lower(level) == "high", 0).when(F.lower(level) == "medium", 1).otherwise(2)
    row = F.struct(tier.alias("tier"), F.col(rank).alias(rank), *[F.col(c) for c in hits.columns if c not in (query, rank)])
    return hits.groupBy(query).agg(F.min(row).alias("h")).select(query, "h.*")
