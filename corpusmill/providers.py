"""Models are providers: this engine calls them in batches and keeps their retry rules, but holds none itself."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.facts import verdict


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """A row for each text; rows have unit length."""


class TokenEmbedder(Protocol):
    def embed_tokens(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """For each text its tokens and a row for each of them."""


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashingEmbedder:
    """A deterministic stand-in: signed counts of hashed words, of unit length; a text without words is all zero."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[k, h % self.size] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


class HashingTokenEmbedder:
    """A deterministic stand-in: lower-cased words; a word's vector is its hashed signs, and a little of its neighbours'."""

    def __init__(self, size: int = 32):
        self.size = size

    def _word(self, word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return np.random.default_rng(seed).choice([-1.0, 1.0], self.size)

    def embed_tokens(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        out = []
        for text in texts:
            words = (text or "").lower().split()
            x = np.array([self._word(w) for w in words]).reshape(len(words), self.size)
            around = np.zeros_like(x)
            if len(words) > 1:
                around[1:] += x[:-1]
                around[:-1] += x[1:]
            out.append((words, x + 0.25 * around))
        return out


class EchoGenerator:
    """A deterministic stand-in: the prompt's last line."""

    def generate(self, prompt: str) -> str:
        return prompt.rstrip().rsplit("\n", 1)[-1]


def embedded(df: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding", batch: int = 32) -> DataFrame:
    """The rows with the vectors of their texts. Each text is embedded once, in batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        rows = [v for at in range(0, len(values), batch) for v in embedder.embed(values[at : at + batch]).astype(np.float32)]
        return pd.Series(rows, dtype=object)

    return df.withColumn(out_col, run(text_col))


def token_vectors(df: DataFrame, embedder: TokenEmbedder, text_col: str, out: str, batch: int = 32) -> DataFrame:
    """The rows with the tokens (``out``_tokens) and vectors (``out``_vectors) of their texts, embedded in batches; null texts have none."""

    @F.pandas_udf("struct<tokens:array<string>,vectors:array<array<double>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        values = texts.fillna("").tolist()
        found = [x for at in range(0, len(values), batch) for x in embedder.embed_tokens(values[at : at + batch])]
        return pd.DataFrame({"tokens": [t for t, _ in found], "vectors": [list(v) for _, v in found]})

    both = df.withColumn("__both", run(text_col))
    return both.withColumns({f"{out}_{c}": F.col(f"__both.{c}") for c in ("tokens", "vectors")}).drop("__both")


def with_retries(call: Callable[[], str | None], tries: int = 3, delay: Callable[[int], float] = lambda n: 2.0**n, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first result that isn't None; after an error or None it waits delay(n) for the n-th try (from 0). None if all fail."""
    for n in range(tries):
        try:
            if (got := call()) is not None:
                return got
        except Exception:  # a provider's, of any kind
            pass
        if n + 1 < tries:
            sleep(delay(n))
    return None


#: The judge's, the generator's and the chat clients' waits, in seconds, by try.
def judge_delay(n: int) -> float:
    return 2.0 * 2**n


def generator_delay(n: int, bad_json: bool = False) -> float:
    return 2.0 if bad_json else 2.0**n


def client_delay(n: int, step: float = 1.0) -> float:
    return step * (n + 1)


def generated(df: DataFrame, generator: Generator, prompt_col: str = "prompt", out_col: str = "generated", tries: int = 3) -> DataFrame:
    """The rows with the generator's answers; null where all tries fail."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else with_retries(lambda: generator.generate(p), tries), na_action=None).astype(object)

    return df.withColumn(out_col, run(prompt_col))


def judged(df: DataFrame, judge: Generator, prompt_col: str = "prompt", out_col: str = "faithful") -> DataFrame:
    """The rows with 1, 0 or null from the judge's words."""
    return generated(df, judge, prompt_col, "__said").withColumn(out_col, verdict(F.col("__said"))).drop("__said")
