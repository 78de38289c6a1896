"""Model calls behind an interface. ``Offline`` answers from the input alone, so plans run and repeat without a network."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

ATTEMPTS, WAIT = 3, 2.0


class Provider(Protocol):
    """What plans ask of a model: text for a prompt, and a vector for a text."""

    def complete(self, task: str, text: str) -> str: ...

    def embed(self, text: str, dimensions: int) -> list[float]: ...


class Offline:
    """The stand-in for models: profiles, queries and rewordings from the words of the text; vectors from their hashes."""

    def complete(self, task: str, text: str) -> str:
        words = list(dict.fromkeys(re.findall(r"[A-Za-z0-9]+", text)))
        if task == "semantic_profile":
            return '{"Temporal": {"isTemporal": false}, "Spatial": {"isSpatial": false}, "Entity Type": "' + " ".join(words[:3]) + '"}'
        if task == "pseudo_queries":
            return '{"queries": [' + ", ".join(f'{{"query": "data about {w}"}}' for w in words[:10]) + "]}"
        if task == "complex_query":
            return "Find datasets about " + " ".join(words[:12])
        if task == "sub_queries":
            return "\n".join(f"{i}. {' '.join(words[i - 1 : i + 2])}" for i in range(1, min(len(words), 5) + 1))
        if task in ("key_points", "validation_queries"):
            return "\n".join(f"{i}. {w}" for i, w in enumerate(words[:5], 1))
        if task == "background":
            return " ".join(words[:40])
        return ""

    def embed(self, text: str, dimensions: int) -> list[float]:
        v = [0.0] * dimensions
        for word in re.findall(r"[a-z0-9]+", text.lower()):
            h = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "little")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]


class Replay:
    """Answers from a table of earlier ones; one that isn't there is empty."""

    def __init__(self, answers: dict[tuple[str, str], str], vectors: dict[str, list[float]] | None = None):
        self.answers, self.vectors = answers, vectors or {}

    def complete(self, task: str, text: str) -> str:
        return self.answers.get((task, text), "")

    def embed(self, text: str, dimensions: int) -> list[float]:
        return self.vectors.get(text, [0.0] * dimensions)


def with_retries(call: Callable[[], str], attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] | None = None) -> str:
    """Up to ``attempts`` calls, ``wait`` times n seconds after the n-th failure."""
    import time

    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            (sleep or time.sleep)(wait * n)
    raise AssertionError


def complete(df: DataFrame, provider: Provider, task: str, text: str, out: str) -> DataFrame:
    """``out``: the provider's answer for each row; a failed call leaves it null and the message in ``<out>_error``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for value in batch[text]:
                try:
                    answers.append(with_retries(lambda v=value: provider.complete(task, v or "")))
                    errors.append(None)
                except Exception as bad:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(bad))
            yield batch.assign(**{out: answers, f"{out}_error": errors})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(work, f"{fields}, `{out}` string, `{out}_error` string")


def embed(df: DataFrame, provider: Provider, text: str, out: str, dimensions: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [provider.embed(v or "", dimensions) for v in batch[text]]})

    return df.mapInPandas(work, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<float>")


def api_settings(env: dict[str, str], prefer: tuple[str, ...] = ("OPENROUTER_API_KEY", "OPENAI_API_KEY")) -> dict[str, str] | None:
    """The first key that is set, with its base URL; None without one."""
    bases = {"OPENROUTER_API_KEY": "https://openrouter.ai/api/v1", "OPENAI_API_KEY": "https://api.openai.com/v1"}
    return next(({"key": env[k], "base_url": env.get("OPENAI_BASE_URL") or bases[k]} for k in prefer if env.get(k)), None)
