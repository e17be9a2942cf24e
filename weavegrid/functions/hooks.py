"""Hooks for remote models, each with a deterministic stub that needs no network."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weavegrid.operators.scratch import ship

DIMENSIONS = 64


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries (query_id, text) to hits (query_id, entry_id, score)."""

    def metadata(self) -> dict: ...


class Agent(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame:
        """prompts (record_id, prompt) to answers (record_id, answer)."""


def hashed_words(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """The embedding stub: a unit vector of hashed word counts."""
    out = []
    for t in texts:
        v = np.zeros(dimensions)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dimensions] += 1 if h >> 31 else -1
        out.append((v / (np.linalg.norm(v) or 1)).tolist())
    return out


def echo(prompts: list[str]) -> list[str]:
    """The language-model stub: the prompt's first line and its length."""
    return [f"{p.splitlines()[0] if p else ''} [{len(p or '')}]" for p in prompts]


def embedded(rows: DataFrame, text: str = "text", model: Callable[[list[str]], list[list[float]]] = hashed_words) -> DataFrame:
    """``rows`` with ``embedding``; the model gets the texts of an Arrow batch at a time."""

    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(model(t.tolist()))

    return rows.withColumn("embedding", embed(F.col(text)))


@dataclass(frozen=True)
class Provider:
    """A source of models: ``connect`` makes a model of its settings, on a worker, and ``stub`` stands in for it offline."""

    connect: Callable[[dict], Callable[[list[str]], list[str]]] | None = None
    defaults: dict = field(default_factory=dict)
    stub: Callable[[list[str]], list[str]] = echo


#: Providers by name; ``register`` adds those of a deployment.
PROVIDERS: dict[str, Provider] = {"offline": Provider()}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name.lower()] = provider


def model_of(name: str, settings: dict | None = None, offline: bool = False) -> Callable[[list[str]], list[str]]:
    """The model of a provider, whatever the case of its name: connected once in each worker, with its defaults where ``settings`` has nothing."""
    provider = PROVIDERS.get(name.lower())
    if provider is None:
        raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(PROVIDERS))}")
    if offline or provider.connect is None:
        return provider.stub
    connect, own = provider.connect, provider.defaults | (settings or {})
    held: list = []

    def model(prompts: list[str]) -> list[str]:
        if not held:
            held.append(connect(own))
        return held[0](prompts)

    return model


def _attempted(model: Callable[[list[str]], list[str]], prompts: list[str], attempts: int, wait: float) -> tuple[list[str] | None, str | None]:
    """Answers, or the last error of as many attempts; the wait doubles after each."""
    error = None
    for i in range(attempts):
        try:
            answers = model(prompts)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return list(answers), None
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:500]
            if i + 1 < attempts and wait:
                time.sleep(wait * 2**i)
    return None, error


def isolated_answers(model: Callable[[list[str]], list[str]], prompts: list[str], attempts: int = 3, wait: float = 0.0) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt: a batch that fails once is halved until what fails is one prompt, which is then tried ``attempts`` times."""
    answers, error = _attempted(model, prompts, attempts if len(prompts) == 1 else 1, wait)
    if answers is not None:
        return [(a, None) for a in answers]
    if len(prompts) == 1:
        return [(None, error)]
    half = len(prompts) // 2
    return isolated_answers(model, prompts[:half], attempts, wait) + isolated_answers(model, prompts[half:], attempts, wait)


def answered(prompts: DataFrame, model: Callable[[list[str]], list[str]] = echo, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """``prompts`` with ``answer`` and ``error``: a prompt for which the model fails has an error and fails no task."""

    ship(prompts.sparkSession)

    @F.pandas_udf("answer string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = isolated_answers(model, ["" if x is None else x for x in p.tolist()], attempts, wait) if len(p) else []
            yield pd.DataFrame(found, columns=["answer", "error"], dtype=object)

    said = prompts.withColumn("_said", call(F.col("prompt")))
    return said.select(*prompts.columns, F.col("_said.answer").alias("answer"), F.col("_said.error").alias("error"))


def prompt(role: str, description: Column, table: Column, notes: Column) -> Column:
    """A role's prompt from its parts; blank parts are left out."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), c))
    return F.concat_ws("\n\n", F.lit(f"You are the {role}."), part("Description", description), part("Candidates", table), part("Notes", notes))


def debate(records: DataFrame, model: Callable[[list[str]], list[str]] = echo) -> DataFrame:
    """record_id, analysis, criticism, resolution: three roles in turn, each reading those before; records: record_id, description, candidates."""
    rows = records
    said = F.lit("")
    for role, name in (("analyzer", "analysis"), ("critic", "criticism"), ("resolver", "resolution")):
        asked = rows.withColumn("prompt", prompt(role, F.col("description"), F.col("candidates"), said))
        rows = answered(asked, model).withColumnRenamed("answer", name).drop("prompt", "error")
        said = F.concat_ws("\n\n", said, F.col(name))
    return rows
