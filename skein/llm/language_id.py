"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one scan: every task adds up a table of languages by buckets and sends it in slices, which are summed by
slice. The log-probabilities (languages x buckets, bounded by the parameters) go to the tasks once; a block's texts
are scored together from their sparse n-gram counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, ragged

BLOCK_CHARS = 1 << 20
SLICE = 2048
LETTER = re.compile(r"[^\W\d_]")


def char_blocks(texts: list[str | None], pad: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first, after the last, code points, starts, ends) of lower-cased texts.

    Each text has a 0 before it and pad behind it; an n-gram of up to pad + 1 points that starts in [start, end) ends in its text.
    """
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BLOCK_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        low = [(x or "").lower() for x in texts[lo:hi]]
        points = np.frombuffer(("\0" + ("\0" * (pad + 1)).join(low) + "\0" * pad).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, low), np.int64, len(low))
        start = np.cumsum(length + 1 + pad) - (length + 1 + pad)
        yield lo, hi, points, start, start + length + 1
        lo = hi


def gram_buckets(points: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each place (places where none fits are left out)."""
    with np.errstate(over="ignore"):
        for n in orders:
            h = np.full(max(0, len(points) - n + 1), 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ points[j : j + len(h)]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            yield (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def _count(orders: tuple[int, ...], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                table = tables.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, _, points, start, end in char_blocks([texts[i] for i in np.flatnonzero(langs == lang)], max(orders) - 1):
                    inside = np.ones(len(points), bool)
                    inside[ragged(end, np.append(start[1:], len(points)) - end)] = False
                    for buckets in gram_buckets(points, orders, bits):
                        table += np.bincount(buckets[inside[: len(buckets)]], minlength=1 << bits)
        for lang, table in tables.items():
            cut = [table[i : i + SLICE].astype("<i8").tobytes() for i in range(0, len(table), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["lang", "slice", "counts"])

    return count


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in group["counts"])
    return pd.DataFrame({"lang": group["lang"][:1], "slice": group["slice"][:1], "counts": [np.asarray(total, "<i8").tobytes()]})


def fit_languages(rows: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smoothing: float = 0.5, most_langs: int = 2048) -> dict:
    """Counts n-grams of all rows with a lang and a text. The model has at most most_langs x 2^bits numbers.

    A column with more values than most_langs holds no languages: an error, not a part of them.
    """
    configure(rows.sparkSession)
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = known.mapInArrow(_count(orders, bits), "lang string, slice int, counts binary").groupBy("lang", "slice").applyInPandas(_sum, "lang string, slice int, counts binary")
    found = sums.limit(most_langs * ((1 << bits) // SLICE + 1) + 1).collect()  # bounded by the parameters, as the next line makes sure
    langs = sorted({r["lang"] for r in found})
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    counts = np.zeros((len(langs), 1 << bits))
    for r in found:
        part = np.frombuffer(r["counts"], "<i8")
        counts[langs.index(r["lang"]), r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    logs = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=1, keepdims=True)) if len(langs) else counts
    return {"langs": langs, "logs": np.ascontiguousarray(logs.T.astype(np.float32)), "orders": orders, "bits": bits}


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs, logs = model["langs"], model["logs"]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi, points, start, end in char_blocks(texts, max(model["orders"]) - 1):
                total = np.zeros((hi - lo, len(langs)))
                cuts = np.stack([start, end], axis=1).ravel()
                for buckets in gram_buckets(points, model["orders"], model["bits"]):
                    buckets = np.append(buckets, 0)  # the last text's end is a place too
                    for j in range(len(langs)):
                        # summed text by text, so that neighbours don't change the last digits
                        total[:, j] += np.add.reduceat(logs[:, j][buckets].astype(np.float64), cuts)[::2]
                best = total.argmax(axis=1) if langs else np.zeros(hi - lo, np.int64)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if langs else np.zeros(hi - lo)
                has = np.array([bool(x and LETTER.search(x)) for x in texts[lo:hi]]) & bool(langs)
                pred = [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return predict


def predict_languages(docs: DataFrame, model: dict, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of lang_pred under equal priors) for each row of docs.

    'und' with score 0 if the text is null, has no letter, or nothing was learnt. Ties go to the first language in
    alphabetical order. Null or repeated doc_ids are rows like any other; an empty table gives an empty result. A text of
    any length is scored whole, by itself: other rows of its batch don't matter. Other columns are not read.
    """
    spark = docs.sparkSession
    configure(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # languages x buckets, bounded in fit_languages
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = 4, fold: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """Learns from the rows outside the held-out fold (crc32 of doc_id as text, modulo folds) and predicts all rows."""
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
    model = fit_languages(docs.filter(~held_out), text, lang, **fit)
    return predict_languages(docs, model, held_out, doc_id, text)
