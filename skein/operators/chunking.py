"""Markdown to blocks, sections and chunks: splits are expressions; greedy assembly runs by document in pandas batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the delimiters a part ends with, first choice and second
PRIMARY = r"(?<=\n\n)|(?<=(?<!\n)\n)(?!\n)|(?<=[。！？!?])|(?<=\. )"
SECONDARY = r"(?<=[，,、；;])"
HEADING = r"^#{1,6}\s+(.+)$"


def split_blocks(text: Column) -> Column:
    """Array of blocks: the text is cut at every ATX heading line; what precedes the first is a block of its own."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?md)^(#{1,6}\s+.+)$", "\u0001$1")
    return F.filter(F.split(marked, "\u0001"), lambda b: b != "")


def block_heading(block: Column) -> Column:
    return F.trim(F.regexp_extract(F.element_at(F.split(block, "\n"), 1), HEADING, 1))


def document_title(text: Column) -> Column:
    """The first heading of any level, or Untitled."""
    found = F.trim(F.regexp_extract(text, r"(?md)^#{1,6}\s+(.+)$", 1))
    return F.when(found != "", found).otherwise("Untitled")


def chunks_by_heading(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One chunk for each heading and its stripped body; empty ones go, and the rank keeps the gap."""
    x = docs.select(key, F.posexplode(split_blocks(F.col(text))).alias("rank", "block"))
    heading = block_heading(F.col("block"))
    body = F.when(heading != "", F.regexp_replace("block", r"^[^\n]*\n?", "")).otherwise(F.col("block"))
    x = x.select(key, "rank", heading.alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"))
    return x.filter((F.col("heading") != "") | (F.col("content") != ""))


def split_primary(text: Column) -> Column:
    """Parts that end with their delimiter: paragraph, line, sentence."""
    return F.filter(F.split(text, PRIMARY), lambda p: p != "")


def table_sections(block: Column) -> Column:
    """The header (two lines) and a section for each row of a Markdown table; shorter blocks stay as they are."""
    lines = F.filter(F.split(block, "\n"), lambda s: F.trim(s) != "")
    return F.when(F.size(lines) > 2, F.concat(F.array(F.array_join(F.slice(lines, 1, 2), "\n")), F.slice(lines, F.lit(3), F.size(lines)))).otherwise(F.array(block))


def block_section(kind: Column, block: Column, alt: Column) -> Column:
    """Routing by block type: tables by row, images as their alternative text, formulas and code whole; others split as text."""
    return (
        F.when(kind == "TABLE", table_sections(block)).when(kind == "IMAGE", F.array(F.concat(F.lit("[IMAGE] alt: "), F.coalesce(alt, F.lit("")))))
        .when(kind.isin("FORMULA", "CODE"), F.array(block)).when(kind == "TEXT", split_primary(block)).otherwise(F.raise_error(F.concat(F.lit("no chunker for "), kind)).cast("array<string>"))
    )


def _estimate(s: str) -> int:
    han = sum("一" <= c <= "鿿" for c in s)
    return int(han / 1.5 + (len(s) - han) / 4)


def force_split(s: str, most: int, count=_estimate) -> list[str]:
    """Longest prefixes within most tokens, by bisection, at least one character."""
    out = []
    while s:
        lo, hi = 1, len(s)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if count(s[:mid]) <= most else (lo, mid - 1)
        out.append(s[:lo])
        s = s[lo:]
    return out


def glue_blank(parts: list[str]) -> list[str]:
    """White-space-only parts join the part before (leading ones the part behind)."""
    out, lead = [], ""
    for p in parts:
        if not p.strip():
            if out:
                out[-1] += p
            else:
                lead += p
        else:
            out.append(lead + p)
            lead = ""
    return out + ([lead] if lead and not out else [])


def split_text(s: str, most: int, count=_estimate) -> list[str]:
    """Primary delimiters, then secondary ones for long parts, then by force."""
    out = []
    for p in filter(None, re.split(PRIMARY, s)):
        if count(p) <= most:
            out.append(p)
            continue
        for q in filter(None, re.split(SECONDARY, p)):
            out += [q] if count(q) <= most else force_split(q, most, count)
    return glue_blank(out)


def assemble(sections: list[tuple[str, str]], most: int, alone: int = 600, strict: bool = False, count=_estimate) -> list[list[int]]:
    """Greedy packing of (heading, text) sections to chunks of at most most tokens (64 to 1000); longer than alone stands alone."""
    most = max(64, min(1000, most))
    chunks, used = [], 0
    open_ = False
    for i, (heading, text) in enumerate(sections):
        n = count(text)
        if n > alone:
            chunks.append([i])
            open_ = False
        elif open_ and used + n <= most and not (strict and sections[chunks[-1][-1]][0] != heading):
            chunks[-1].append(i)
            used += n
        else:
            chunks.append([i])
            used, open_ = n, True
    return chunks


def pack_paragraphs(text: str, most: int, count=_estimate) -> list[str]:
    """A large section's paragraphs, packed greedily to parts of at most most tokens; a longer paragraph stands alone. Blank text stays one part."""
    out, used = [], 0
    if not text.strip():
        return [text]
    for p in text.strip().split("\n\n"):
        n = count(p)
        if out and used + n <= most:
            out[-1] += "\n\n" + p
            used += n
        else:
            out.append(p)
            used = n
    return out


def packed_sections(sections: DataFrame, most: int, large: int = 600, text: str = "text", count=_estimate) -> DataFrame:
    """sections with the texts over large tokens as several rows (part from 0), by pack_paragraphs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = batch[text].map(lambda x: pack_paragraphs(x or "", most, count) if count(x or "") > large else [x])
            yield batch.assign(**{text: parts, "part": parts.map(lambda x: list(range(len(x))))}).explode([text, "part"], ignore_index=True).astype({"part": "int32"})

    return sections.mapInPandas(run, T.StructType([*sections.schema.fields, T.StructField("part", T.IntegerType())]))


def section_references(chunks: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rank, references: ids of sections in order) from chunks' order indexes and sections (key, order_index, section_id)."""
    x = chunks.select(key, "rank", F.posexplode("references").alias("_pos", "order_index")).join(sections.select(key, "order_index", "section_id"), [key, "order_index"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "section_id"))), lambda s: s["section_id"])
    return x.groupBy(key, "rank").agg(ids.alias("references"))


def chunk_sections(chunks: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rank, section_id): the sections that a chunk refers to; all of the document's if it refers to none."""
    x = chunks.select(key, "rank", F.coalesce("references", F.array().cast(chunks.schema["references"].dataType)).alias("r"))
    named = x.select(key, "rank", F.explode("r").alias("order_index")).join(sections, [key, "order_index"])
    every = x.filter(F.size("r") == 0).select(key, "rank").join(sections, key)
    return named.select(key, "rank", "section_id").union(every.select(key, "rank", "section_id"))


def heading_breaks(sections: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """sections with ``chunk``: how often the heading has changed before or at the row."""
    w = Window.partitionBy(key).orderBy(order)
    turned = sections.withColumn("_turned", F.col(heading) != F.lag(heading, 1).over(w))
    return turned.withColumn("chunk", F.count_if("_turned").over(w)).drop("_turned")


def chunks_standard(docs: DataFrame, most: int = 1000, section_most: int | None = None, key: str = "doc_id", text: str = "text", strict: bool = False) -> DataFrame:
    """(key, rank, heading, content, raw_content, references): the whole chain for each document, a batch at a time."""
    section_most = section_most or max(128, min(512, most // 4))
    kind = docs.schema[key].dataType.simpleString()
    blocks = docs.select(key, split_blocks(F.col(text)).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, bs in zip(batch[key], batch["blocks"]):
                sections = []
                for block in bs:
                    m = re.match(r"#{1,6}\s+(.+)", block.split("\n", 1)[0])
                    sections += [(m.group(1).strip() if m else "", p) for p in split_text(block, section_most)]
                for rank, members in enumerate(assemble(sections, most, strict=strict)):
                    texts = [sections[i][1] for i in members]
                    rows.append((k, rank, next((sections[i][0] for i in members if sections[i][0]), ""), "\n".join(x.strip() for x in texts), "".join(texts), members))
            yield pd.DataFrame(rows, columns=[key, "rank", "heading", "content", "raw_content", "references"])

    return blocks.mapInPandas(run, f"{key} {kind}, rank int, heading string, content string, raw_content string, references array<int>")


def build_chunks(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rank, order_index, heading, text) to one row a chunk: first non-empty heading, stripped texts by line, raw text, references."""
    parts = F.array_sort(F.collect_list(F.struct("order_index", "heading", "text")))
    x = sections.groupBy(key, "rank").agg(parts.alias("p"))
    heads = F.filter(F.col("p.heading"), lambda h: h.isNotNull() & (h != ""))
    return x.select(
        key, "rank", F.coalesce(F.get(heads, F.lit(0)), F.lit("")).alias("heading"),
        F.array_join(F.transform(F.col("p.text"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), "\n").alias("content"),
        F.array_join("p.text", "").alias("raw_content"), F.col("p.order_index").alias("references"),
    )
