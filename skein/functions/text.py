"""Text scalars as Column expressions (JVM side); only Unicode normalisation needs pandas."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_text(x: Column) -> Column:
    """White space runs (Unicode) become one space; ends are stripped."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")


@F.pandas_udf(T.StringType())
def normalize_for_embedding(x: pd.Series) -> pd.Series:
    """NFKC, lower case, white space collapsed. Spark has no Unicode normalisation built in."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).lower().split()))


def normalize_entity_name(x: Column) -> Column:
    """Lower case, only word characters and white space, collapsed."""
    return normalize_text(F.regexp_replace(F.lower(x), r"(?U)[^\w\s一-鿿]", ""))


def strip(x: Column) -> Column:
    """Without white space (Unicode, and the separators U+001C to U+001F) at the ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def markdown_headings(x: Column) -> Column:
    """Array of headings, line by line: the marks, a space and the title; indented ones count too."""
    pattern = r"(?Ud)^(#{1,6})[\s\x1c-\x1f]+(.+)$"
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s.rlike(pattern))
    return F.transform(lines, lambda s: F.concat(F.regexp_extract(s, pattern, 1), F.lit(" "), F.regexp_extract(s, pattern, 2)))


def text_hash(x: Column) -> Column:
    return F.md5(x)


def truncate_text(x: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, max(0, most - len(suffix))), F.lit(suffix))).otherwise(x)


def normalize_heading(x: Column, most: int = 500, suffix: str = "...") -> Column:
    """Heading marks go, links keep their label, white space collapses; null is empty.

    A text over ``most`` signs is cut so that it ends with the suffix (without room for it, just cut); most of 0 or less is no limit.
    """
    x = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"(?U)^#{1,6}[\s\x1c-\x1f]*", "")
    x = strip(F.regexp_replace(F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"(?U)[\s\x1c-\x1f]+", " "))
    if most <= 0:
        return x
    short = F.substring(x, 1, most) if most <= len(suffix) else F.concat(strip_right(F.substring(x, 1, most - len(suffix))), F.lit(suffix))
    return F.when(F.length(x) > most, short).otherwise(x)


def strip_right(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+\z", "")


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def han_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^一-鿿]", ""))


def estimate_tokens(x: Column) -> Column:
    """Han characters / 1.5 plus others / 4, truncated."""
    han = han_count(x)
    return (han / F.lit(1.5) + (F.length(x) - han) / F.lit(4)).cast("int")


def estimate_tokens_weighted(x: Column, han: float = 0.6, word: float = 1.3, other: float = 0.5) -> Column:
    """Weights for Han characters, runs of ASCII letters and other visible signs; at least 1, 0 for empty text."""
    words = F.size(F.regexp_extract_all(x, F.lit("([a-zA-Z]+)"), F.lit(1)))
    signs = F.length(F.regexp_replace(x, r"[a-zA-Z一-鿿\s]", ""))
    total = (han_count(x) * F.lit(han) + words * F.lit(word) + signs * F.lit(other)).cast("int")
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(total, F.lit(1)))


def clean_whitespace(x: Column) -> Column:
    """Space runs become one, three or more newlines two, each line is stripped."""
    x = F.regexp_replace(F.regexp_replace(x, " +", " "), r"\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), "\n")


def cut_to_tokens(x: Column, most: int = 8000) -> Column:
    """Cuts in proportion, with a tenth to spare, if the estimate exceeds most."""
    n = estimate_tokens(x)
    return F.when(n > most, F.substring(x, F.lit(1), (F.length(x) * (F.lit(float(most)) / n) * F.lit(0.9)).cast("int"))).otherwise(x)


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def normalize_answer(x: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, white space collapsed."""
    x = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return normalize_text(F.regexp_replace(x, r"\b(a|an|the)\b", " "))


def section_text(heading: Column, content: Column) -> Column:
    """'heading\\ncontent', without a first content line that equals the heading."""
    lines = F.split(content, "\n")
    same = F.trim(F.element_at(lines, 1)) == F.trim(heading)
    body = F.when(same, F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")).otherwise(content)
    return F.when(F.coalesce(heading, F.lit("")) == "", content).otherwise(F.concat_ws("\n", heading, body))


def section_markdown(heading: Column, content: Column) -> Column:
    return F.when(F.coalesce(heading, F.lit("")) == "", content).otherwise(F.concat(F.lit("# "), heading, F.lit("\n"), content))


def previous_context(x: Column, cut: int = 800, show: int = 300) -> Column:
    x = F.substring(x, 1, cut)
    return F.when(F.length(x) > show, F.concat(F.substring(x, 1, show), F.lit("…"))).otherwise(x)


def chunk_embedding_text(heading: Column, content: Column, most: int = 1024) -> Column:
    body = F.substring(content, 1, most)
    return F.when(F.coalesce(heading, F.lit("")) == "", body).otherwise(F.concat(heading, F.lit("\n\n"), body))


def event_embedding_text(title: Column, content: Column) -> Column:
    return chunk_embedding_text(title, content, 500)


def link_embedding_text(description: Column, event: Column, entity: Column) -> Column:
    return F.coalesce(F.nullif(description, F.lit("")), F.concat(event, F.lit("-"), entity))
