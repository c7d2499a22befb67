"""Chunking by a tokenizer file's exact counts, document by document in Arrow batches.

Counts need the tokenizer, so this way runs in Python: all parts of a document are counted together, and a part that is too long is encoded
once and cut at its tokens' offsets, so a text without any break takes linear time. The plan is that of ``chunk_plan``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.chunk_plan import PRIMARY_ENDS, SECONDARY_ENDS, chunks_native
from skein.operators.chunking import block_heading, glue_blank, split_blocks

_counters: dict[str, "TokenCounter"] = {}
#: Signs that are encoded at once; a longer text is encoded in stretches that end at a break, if there is one.
STRETCH = 1 << 20


def counter(path: str) -> "TokenCounter":
    """The worker's counter for a tokenizer file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


class TokenCounter:
    """Counts as the file's tokenizer gives them, with the special tokens it adds to a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = len(self.tokenizer.encode("").ids)

    def counts(self, texts: list[str]) -> list[int]:
        """An empty text has no tokens, not even special ones."""
        found = iter(self.tokenizer.encode_batch([t for t in texts if t]))
        return [len(next(found).ids) if t else 0 for t in texts]

    def cut(self, text: str, most: int) -> list[str]:
        """Parts of at most ``most`` tokens each, special ones included, as long as the text's own token borders allow; at least one sign.

        A part that has more tokens when it stands alone than within the text ends a border earlier, until it fits.
        """
        room = max(1, most - self.special)
        ends = np.array([b for (_, b), kind in self._spans(text) if not kind], np.int64)
        out, start = [], 0
        first = 0
        while start < len(text):
            take = room
            while True:
                last = min(first + take, len(ends)) - 1
                # a border within a sign or behind dropped white space is no progress: the next one that is
                end = len(text) if last < 0 or last == len(ends) - 1 else int(ends[last])
                part = text[start:end]
                if not part or self.counts([part])[0] <= most:
                    break
                if take == 1:  # several signs in one token of the text that are more tokens alone
                    end = start
                    break
                take = max(1, take // 2 if take < 4 else take - max(1, take // 8))
            if end <= start:
                end = start + 1
                part = text[start:end]
            out.append(part)
            start = end
            first = int(np.searchsorted(ends, start, "right"))
        return out

    def _spans(self, text: str) -> Iterator[tuple[tuple[int, int], int]]:
        lo = 0
        while lo < len(text):
            hi = min(len(text), lo + STRETCH)
            if hi < len(text):
                gap = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi))
                hi = gap if gap > lo else hi
            found = self.tokenizer.encode(text[lo:hi])
            yield from (((a + lo, b + lo), kind) for (a, b), kind in zip(found.offsets, found.special_tokens_mask))
            lo = hi


def split_by_ends(text: str, ends: str) -> list[str]:
    """Parts that end with one of the signs, blank ones glued to their neighbours."""
    return glue_blank([m.group() for m in re.finditer(rf"(?s).*?(?:{ends})|.+", text)] or [text])


def block_parts(block: str, most: int, tokens: TokenCounter) -> list[str]:
    parts = split_by_ends(block, PRIMARY_ENDS)
    out: list[str] = []
    for part, n in zip(parts, tokens.counts(parts)):
        if n <= most:
            out.append(part)
            continue
        second = split_by_ends(part, SECONDARY_ENDS)
        for piece, m in zip(second, tokens.counts(second)):
            out += [piece] if m <= most else tokens.cut(piece, most)
    return out


def document_sections(blocks: list[tuple[str, str]], most: int, tokens: TokenCounter) -> list[tuple[int, str, str]]:
    """(render_group_index, heading, text) of (heading, block) in order; blank sections are glued to a neighbour."""
    raw: list[tuple[int, str, str]] = []
    for heading, block in blocks:
        group = len(raw) + 1
        raw += [(group, heading, p) for p in block_parts(block, most, tokens)]
    if all(not text.strip() for _, _, text in raw):
        return raw
    out: list[tuple[int, str, str]] = []
    lead = ""
    for group, heading, text in raw:
        if text.strip():
            out.append((group, heading, lead + text))
            lead = ""
        elif out:
            out[-1] = (*out[-1][:2], out[-1][2] + text)
        else:
            lead += text
    return out


def document_chunks(sections: list[tuple[int, str, str]], most: int, alone: int, strict: bool, tokens: TokenCounter) -> list[tuple[str, str, str, list[int], list[int]]]:
    """(heading, content, raw content, section indexes, render groups) of each chunk."""
    groups: list[list[tuple[int, str, str, int]]] = []
    used, open_ = 0, False
    for i, ((group, heading, text), n) in enumerate(zip(sections, tokens.counts([s[2].strip() for s in sections]))):
        if n > alone:
            groups += [[(group, heading, unit, i)] for unit in _units(text, most, tokens)]
            open_ = False
            continue
        if open_ and used + n <= most and not (strict and groups[-1][0][1] != heading):
            groups[-1].append((group, heading, text, i))
            used += n
        else:
            groups.append([(group, heading, text, i)])
            used, open_ = n, True
    out = []
    for members in groups:
        raw = "".join(m[2] for m in members)
        content = "\n".join(m[2].strip() for m in members).strip()
        out.append((next((m[1] for m in members if m[1]), ""), content or raw, raw, [m[3] for m in members], sorted({m[0] for m in members})))
    return out


def _units(text: str, most: int, tokens: TokenCounter) -> list[str]:
    paragraphs = text.strip().split("\n\n")
    if paragraphs == [""]:
        return [text]
    units: list[list[str]] = []
    used = 0
    for p, n in zip(paragraphs, tokens.counts(paragraphs)):
        if units and used + n <= most:
            units[-1].append(p)
            used += n
        else:
            units.append([p])
            used = n
    return ["\n\n".join(u) for u in units]


def chunks_by_tokenizer(
    docs: DataFrame, tokenizer: str, most: int = 1000, section_most: int | None = None, key: str = "doc_id", text: str = "text", strict: bool = False, alone: int = 600
) -> DataFrame:
    """chunk_plan.chunks_native with the counts of a tokenizer file that every worker can read."""
    section_most = max(32, section_most or max(128, min(512, most // 4)))
    most, alone = max(64, min(1000, most)), max(1, alone)
    kind = docs.schema[key].dataType.simpleString()
    blocks = docs.select(key, F.transform(split_blocks(F.col(text)), lambda b: F.struct(block_heading(b).alias("heading"), b.alias("block"))).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(tokenizer)
        for batch in batches:
            for k, bs in zip(batch[key], batch["blocks"]):
                sections = document_sections([(b["heading"], b["block"]) for b in bs], section_most, tokens)
                rows = [(k, rank, *chunk) for rank, chunk in enumerate(document_chunks(sections, most, alone, strict, tokens))]
                if rows:
                    yield pd.DataFrame(rows, columns=[key, "rank", "heading", "content", "raw_content", "references", "render_groups"])

    return blocks.mapInPandas(run, f"{key} {kind}, rank int, heading string, content string, raw_content string, references array<int>, render_groups array<int>")


def chunks_standard(docs: DataFrame, most: int = 1000, section_most: int | None = None, key: str = "doc_id", text: str = "text", strict: bool = False, alone: int = 600, tokenizer: str | None = None) -> DataFrame:
    """The chunks of each document: by a tokenizer file's counts if one is named, else natively by the estimate."""
    if tokenizer:
        return chunks_by_tokenizer(docs, tokenizer, most, section_most, key, text, strict, alone)
    return chunks_native(docs, most, section_most, key, text, strict, alone)
