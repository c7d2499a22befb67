"""Stand-ins for models, all deterministic and offline. Real ones take the same arguments."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[A-Z][a-z]{5,}")
#: Of texts that a worker holds at once.
TEXT_BYTES = 4 << 20


def hash_embedding(text: str | None, dims: int = 64) -> list[float]:
    """Signed feature hashing of words to a unit vector."""
    v = np.zeros(dims)
    for w in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def hash_embeddings(texts: list[str | None]) -> list[list[float]]:
    return [hash_embedding(x) for x in texts]


def bound_texts(spark: SparkSession) -> None:
    """Bounds the Arrow batches that bring texts to a provider's workers by TEXT_BYTES; a longer text comes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def embedder(embed: Callable[[list[str | None]], list[list[float]]] = hash_embeddings, batch: int = 10, fallback: bool = True):
    """A pandas UDF over batches of texts. A batch that gives another number of vectors is embedded text by text, or fails without fallback.

    A model may answer otherwise when asked again, so Spark doesn't embed a text once to filter by its vector and once more to return it.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(texts), batch):
            part = texts.iloc[lo : lo + batch].tolist()
            got = embed(part)
            if len(got) != len(part):
                if not fallback:
                    raise ValueError(f"{len(got)} vectors of {len(part)} texts")
                got = [embed([x])[0] for x in part]
            out += got
        return pd.Series(out, index=texts.index)

    return run.asNondeterministic()


def query_entities(queries: DataFrame, provider: Callable[[str | None], list[tuple[str, str]]] | None = None) -> DataFrame:
    """queries (qid, question) to the entities a provider names: (qid, ord, type, name)."""
    named = provider or rule_entities
    kind = queries.schema["qid"].dataType.simpleString()
    bound_texts(queries.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(q, i, t, n) for q, x in zip(batch["qid"], batch["question"]) for i, (t, n) in enumerate(named(x))]
            yield pd.DataFrame(rows, columns=["qid", "ord", "type", "name"])

    return queries.select("qid", "question").mapInPandas(run, f"qid {kind}, ord int, type string, name string")


def rule_entities(text: str | None) -> list[tuple[str, str]]:
    """Capitalised words of six letters or more, in order, once each."""
    return [("subject", x) for x in dict.fromkeys(NAME.findall(text or ""))]


def rule_events(text: str | None) -> list[dict]:
    """One event for each chunk."""
    text = text or ""
    return [{"title": text.strip().split("\n")[0][:80], "content": text, "entities": rule_entities(text)}] if text.strip() else []


class ProviderTimeout(Exception):
    """A model call took too long; calling again may take as long."""


class ProviderError(Exception):
    """A model call failed in a way that another attempt may mend (limits of rate, busy services)."""


def retried(call: Callable, attempts: int = 3, delay: float = 1.0, factor: float = 2.0, most: float = 60.0, pause: Callable[[float], None] = time.sleep) -> Callable:
    """call with further attempts after a ProviderError, each pause factor times as long (and half to all of that, by chance).

    Timeouts and unknown errors are raised at once; after the last attempt so is the error itself.
    """

    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except ProviderTimeout:
                raise
            except ProviderError:
                if attempt == attempts - 1:
                    raise
                pause(min(most, delay * factor**attempt) * (0.5 + random.random() / 2))

    return run


def in_parallel(call: Callable, inputs: list, parallel: int) -> Iterator[tuple[object, Exception | None]]:
    """(result, error) of each input in the inputs' order, with at most ``parallel`` calls under way and as many results waiting."""

    def one(x):
        try:
            return call(x), None
        except Exception as error:  # noqa: BLE001  handed on with its input
            return None, error

    if parallel <= 1:
        yield from map(one, inputs)
        return
    with ThreadPoolExecutor(parallel) as pool:
        for lo in range(0, len(inputs), 2 * parallel):
            yield from pool.map(one, inputs[lo : lo + 2 * parallel])


def usage_of(prompt: str | None, answer: str | None) -> tuple[int, int]:
    """Tokens in and out of a call by the library's rough count: a Han sign is two thirds of a token, another sign a quarter."""
    count = lambda s: int(sum(2 / 3 if "一" <= c <= "鿿" else 0.25 for c in s or ""))
    return count(prompt), count(answer)
