"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns. Broader patterns propose further candidates: secrets,
bank accounts, social security numbers, local phone numbers, other long numbers and handles. Labelers (shape, gazetteer
of cue words, context signs, checksums, variety of characters, harmless cues) vote on every candidate, base ones too.

The patterns of votes and of the span's own features (length, share of digits, case, what stands before it) are counted over
all documents; their number is bounded by kinds x 3^labelers x features. Expectation-maximisation estimates each labeler's
reliability and the posterior of each pattern of votes, and a logistic span classifier is trained on kind, features and votes
with these posteriors. Base spans stay; a further candidate becomes a span if the classifier gives it at least one half and no
base span overlaps it. Every scan is linear in a text's length, also of unbroken runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure

# fixed values: the contract's kinds, in order, and their patterns. An ip starts where a run of digits does, and an email is
# grown from its @, which gives the same leftmost matches in linear time.
BASE = {
    "email": re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
MORE = {
    "secret": re.compile(r"[A-Za-z0-9_-]{16,}+"),  # with a digit and a letter
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}\b"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local": re.compile(r"(?<![0-9-])(?:\([0-9]{3}\) ?)?[0-9]{3}-[0-9]{4}(?![0-9-])"),
    "number": re.compile(r"(?<![0-9.-])[0-9]{9,19}(?![0-9.-])"),
    "handle": re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,30}\b"),
}
KINDS = [*BASE, *MORE]
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# gazetteers of cue words that stand before a value
CUES = re.compile(
    r"token|secret|passw|credential|api.?key|auth|ssn|social|iban|konto|account|cuenta|compte|card|karte|tarjeta|carte|visa|"
    r"phone|tel\b|tel[.:]|mobile|handy|fax|call|mail|e-mail|correo|contact|twitter|user",
    re.IGNORECASE,
)
HARMLESS = re.compile(r"version|order|page|invoice|isbn|issn|doi|chapter|section|serial|commit|sha|md5|build|figure|table|year|price|total", re.IGNORECASE)
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: How many values each feature of a span has: length, share of digits, case, the character before, an = nearby.
FEATURES = (4, 4, 3, 4, 2)
SHAPES = math.prod(FEATURES)
LABELERS = ("shape", "cue", "sign", "check", "variety", "harmless")


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _digits(x: str) -> str:
    return re.sub("[^0-9]", "", x)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted; leftmost matches of each kind, failing ones dropped."""
    found, last = [], 0
    if "@" in text:
        for m in BASE["email"].finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                found.append((start, 0, last))
    for m in BASE["ip"].finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in BASE["card"].finditer(text):
        if 12 <= m.end() - m.start():
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in BASE["phone"].finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _mod97(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 no opinion."""
    value, before = text[start:end], text[max(0, start - 24) : start]
    name = KINDS[kind]
    shape = {"email": 1, "ip": 1, "card": 1, "phone": 1, "account": 1, "ssn": 1, "local": 0, "handle": 0, "number": -1}.get(name, 1 if len(value) >= 24 else 0)
    cue = 1 if CUES.search(before) else 0
    sign = 1 if before.rstrip("\"' ")[-1:] in ("=", ":") and before else 0
    if name == "account":
        check = 1 if _mod97(value) else -1
    elif name in ("card", "number"):
        check = 1 if luhn(_digits(value)) and len(value) >= 12 else -1
    elif name == "ssn":
        check = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
    else:
        check = 0
    spread = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in spread.values())
    variety = 1 if entropy >= 3.0 else -1 if entropy < 1.5 else 0
    return shape, cue, sign, check, variety, -1 if HARMLESS.search(before) else 0


def _shape(text: str, kind: int, start: int, end: int) -> int:
    """The span's own features as places of FEATURES, packed."""
    value, before = text[start:end], text[start - 1 : start] if start else "\n"
    digits = sum(c.isdigit() for c in value)
    upper, lower = value.upper() != value and value.lower() != value, value != value.lower()
    parts = (
        min(3, len(value) // 10), digits * 3 // len(value), 2 if upper else 1 if lower else 0,
        0 if before == "\n" else 1 if before in "\"'=:" else 2 if before.isspace() else 3, int("=" in text[max(0, start - 4) : start]),
    )
    packed = 0
    for n, x in zip(FEATURES, parts):
        packed = packed * n + x
    return packed


def _more(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that no base span overlaps."""
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    out = []
    for k, name in enumerate(MORE, len(BASE)):
        if name == "handle" and "@" not in text:
            continue
        for m in MORE[name].finditer(text):
            if name == "secret" and not (DIGIT.search(m.group()) and LETTER.search(m.group())):
                continue
            before = bisect_left(starts, m.end())  # base spans that start before its end
            if not before or reach[before - 1] <= m.start():
                out.append((m.start(), k, m.end()))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n": [], "base": [], "starts": [], "ends": [], "kinds": [], "votes": []}
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            every = sorted(base + _more(text, base))
            out["starts"].append([s for s, _, _ in every])
            out["kinds"].append([k for _, k, _ in every])
            out["ends"].append([e for _, _, e in every])
            out["votes"].append([sum((v + 1) * 3**i for i, v in enumerate(_votes(text, k, s, e))) * SHAPES + _shape(text, k, s, e) for s, k, e in every])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(out[c], pa.list_(pa.int32())) for c in ("starts", "kinds", "ends", "votes"))],
            ["doc_id", "starts", "kinds", "ends", "votes"],
        )


def unpack(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3**i % 3 - 1 for i in range(len(LABELERS))], axis=1)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: (classes x labelers x votes) chances, and each pattern's posterior."""
    personal = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))  # starts from the majority
    chances = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - personal), counts * personal)):
            for v in range(3):
                chances[c, :, v] = (weight[:, None] * (votes == v - 1)).sum(axis=0) + 1
            chances[c] /= chances[c].sum(axis=1, keepdims=True)
        prior = np.clip((counts * personal).sum() / counts.sum(), 0.01, 0.99)
        logs = [np.log(chances[c, np.arange(votes.shape[1]), votes + 1]).sum(axis=1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log(1 - prior) - np.log(prior), -50, 50)))
        if np.abs(new - personal).max() < 1e-9:
            break
        personal = new
    return chances, personal


def _features(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    one_hot = []
    for n in reversed(FEATURES):
        one_hot.append(np.eye(n)[shapes % n])
        shapes = shapes // n
    return np.concatenate([np.ones((len(kinds), 1)), np.eye(len(KINDS))[kinds], *one_hot, votes > 0, votes < 0], axis=1).astype(float)


def train_spans(patterns: list[tuple[int, int, int]], steps: int = 400) -> tuple[dict, np.ndarray]:
    """patterns: (kind, packed votes and features, count). The classifier's chance for each of them, and the reliabilities.

    A pattern weighs the root of its share of all, so one that is everywhere doesn't drown the others, and inputs of any size
    with the same mix give the same model.
    """
    if not patterns:
        return {}, np.zeros((2, len(LABELERS), 3))
    kinds, packed, counts = (np.array(x) for x in zip(*sorted(patterns)))
    votes, shapes = unpack(packed // SHAPES), packed % SHAPES
    weight = np.sqrt(counts / counts.sum())
    weight *= 1000 / weight.sum()
    # the labelers' reliabilities come from their votes alone
    alone, place = np.unique(packed // SHAPES, return_inverse=True)
    chances, personal = reliabilities(unpack(alone), np.bincount(place, weight))
    personal = personal[place]
    x = _features(kinds, votes, shapes)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        move = np.linalg.solve(curve, x.T @ (weight * (personal - p)) - w)
        w = w + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-x @ w))
    return dict(zip(zip(kinds.tolist(), packed.tolist()), p.tolist())), chances


def _finish(shared):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = shared.value
        for batch in batches:
            counts, sha, spans = [[], [], [], []], [], []
            for starts, kinds, ends, votes in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                base = [(s, k, e) for s, k, e in zip(starts, kinds, ends) if k < len(BASE)]
                more = [(s, k, e) for s, k, e, v in zip(starts, kinds, ends, votes) if k >= len(BASE) and chance.get((k, v), 0) >= 0.5]
                for k in range(len(BASE)):
                    counts[k].append(sum(x[1] == k for x in base))
                show = lambda every: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(every))
                sha.append(hashlib.sha256(show(base).encode()).hexdigest())
                spans.append(show(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return finish


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined. A null or empty text
    has none. Null or repeated doc_ids are rows like any other; an empty table gives an empty result. A text of any length is
    scanned whole; other columns are not read.
    """
    spark = docs.sparkSession
    configure(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lists = "starts array<int>, kinds array<int>, ends array<int>, votes array<int>"
    found = Scratch(spark).stash(rows.mapInArrow(_scan, f"doc_id {kind}, {lists}"), "candidates")
    patterns = found.select(F.explode(F.arrays_zip("kinds", "votes")).alias("x")).groupBy("x.kinds", "x.votes").count()
    chance, _ = train_spans([(r[0], r[1], r[2]) for r in patterns.collect()])  # kinds x 3^labelers x SHAPES rows at most, a few hundred in fact
    shared = spark.sparkContext.broadcast(chance)
    return found.mapInArrow(_finish(shared), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
