"""Blocks to sections to chunks as one native plan: everything of a document happens in expressions on its row, without a shuffle.

Splitting is by patterns that take a part together with the blank parts behind it. What needs a running state is an ordered fold
(``aggregate``) that keeps only where chunks begin, so its state stays small; sections and chunks are then slices between these places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import estimate_tokens, strip
from skein.operators.chunking import block_heading, split_blocks

# fixed values: the signs a part ends with, first choice and second
PRIMARY_ENDS = r"\r\n\r\n|\n\n|\r\n|\n|\r|。|！|？|!|\?|\. "
SECONDARY_ENDS = "[，,、；;]"
_WS, _SOLID = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
#: Leading blank parts, a part up to its end sign, and all blank parts behind it; or a text that is blank altogether.
PRIMARY_PART = rf"(?sU){_WS}*(?:(?:[。！？!?]|\. )|{_SOLID}.*?(?:{PRIMARY_ENDS}|\z))(?:{_WS}*[\r\n])?(?:{_WS}+\z)?|(?:{_WS}+\z)"
SECONDARY_PART = rf"(?sU).*?{SECONDARY_ENDS}(?:{_WS}+\z)?|.+\z"
SECTION = "array<struct<order_index:int,render_group_index:int,heading:string,text:string>>"

Count = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once however often body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(x: Column) -> Column:
    return ~x.rlike(f"(?U){_SOLID}")


def force_parts(x: Column, most: int) -> Column:
    """Longest prefixes of at most ``most`` estimated tokens, one after the other.

    The estimate is a sum over signs (8/12 for a Han sign, 3/12 for another), cut to a whole number, so one fold over the signs finds all cuts.
    """
    signs = F.filter(F.split(x, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.array(F.lit(0)).alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        weight = F.when(c.between("一", "鿿"), 8).otherwise(3).cast("long")
        full = (s["sum"] + weight >= 12 * (most + 1)) & (F.element_at(s["cuts"], -1) < s["at"])
        return F.struct((s["at"] + 1).alias("at"), F.when(full, weight).otherwise(s["sum"] + weight).alias("sum"), F.when(full, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.aggregate(signs, start, step, lambda s: F.array_append(s["cuts"], s["at"]))
    return let(cuts, lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: F.substring(x, a + 1, F.get(c, i + 1) - a)))


def text_parts(block: Column, most: int, count: Count = estimate_tokens) -> Column:
    """A block's sections: primary parts, those that are too long by secondary signs, and what is still too long by force."""
    by_force = lambda f: F.when(count(f) <= most, F.array(f)).otherwise(force_parts(f, most))
    by_second = lambda p: F.when(count(p) <= most, F.array(p)).otherwise(F.flatten(F.transform(F.regexp_extract_all(p, F.lit(SECONDARY_PART), F.lit(0)), by_force)))
    return F.when(block == "", F.array(F.lit(""))).otherwise(F.flatten(F.transform(F.regexp_extract_all(block, F.lit(PRIMARY_PART), F.lit(0)), by_second)))


def _between(places: Column, total: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(index, place, length) for each stretch that begins at one of the places (0-based, rising) and ends before the next."""
    return F.transform(places, lambda a, i: make(i, a, F.coalesce(F.get(places, i + 1), total) - a))


def sections_of(text: Column, most: int, count: Count = estimate_tokens) -> Column:
    """Array of sections (order_index, render_group_index, heading, text); its expressions are repeated, so take it as a column of its own.

    A block's render group is one more than the number of sections before it. Blank sections are glued to the one before (leading ones to the one
    behind), and order indexes count what is left.
    """
    blocks = F.transform(split_blocks(text), lambda b: F.struct(block_heading(b).alias("heading"), text_parts(b, most, count).alias("parts")))
    return F.flatten(
        F.transform(blocks, lambda b, i: F.transform(b["parts"], lambda p: F.struct(i.alias("block"), b["heading"].alias("heading"), p.alias("text"))))
    )


def with_sections(docs: DataFrame, most: int, key: str = "doc_id", text: str = "text", count: Count = estimate_tokens) -> DataFrame:
    """(key, sections) of each document: see sections_of."""
    x = docs.select(key, sections_of(F.col(text), most, count).alias("raw"))
    firsts = F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: (i == 0) | (F.get(F.col("raw"), i)["block"] != F.get(F.col("raw"), i - 1)["block"]))
    solid = F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: ~is_blank(F.get(F.col("raw"), i)["text"]))
    empty = F.size("raw") == 0
    x = x.select(key, "raw", F.when(empty, F.array().cast("array<int>")).otherwise(firsts).alias("firsts"), F.when(empty, F.array().cast("array<int>")).otherwise(solid).alias("solid"))
    # leading blank sections go with the first that isn't blank; if all are blank they stay as they are
    starts = F.when(F.size("solid") == 0, F.when(empty, F.col("solid")).otherwise(F.sequence(F.lit(0), F.size("raw") - 1))).otherwise(F.transform("solid", lambda a, i: F.when(i == 0, 0).otherwise(a)))
    x = x.select(key, "raw", "firsts", "solid", starts.alias("starts"))

    def section(i: Column, a: Column, n: Column) -> Column:
        own = F.get(F.col("raw"), F.coalesce(F.get(F.col("solid"), i), a))
        return F.struct(
            i.alias("order_index"), (F.get(F.col("firsts"), own["block"]) + 1).alias("render_group_index"), own["heading"].alias("heading"),
            F.array_join(F.transform(F.slice(F.col("raw"), a + 1, n), lambda s: s["text"]), "").alias("text"),
        )

    return x.select(key, _between(F.col("starts"), F.size("raw"), section).cast(SECTION).alias("sections"))


def chunk_starts(sections: Column, most: int, alone: int = 600, strict: bool = False, count: Count = estimate_tokens) -> Column:
    """Array of (at, large): where greedy packing begins a chunk. A section of over ``alone`` tokens is large and stands alone; strict begins anew at a new heading."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.lit(False).alias("open"), F.lit("").alias("heading"), F.array().cast("array<struct<at:int,large:boolean>>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        n = x["tokens"]
        large = n > alone
        goes_on = s["open"] & ~large & (s["used"] + n <= most)
        if strict:
            goes_on = goes_on & (x["heading"] == s["heading"])
        begun = F.array_append(s["starts"], F.struct(s["at"].alias("at"), large.alias("large")))
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(goes_on, s["used"] + n).otherwise(n).alias("used"), (~large).alias("open"), x["heading"].alias("heading"), F.when(goes_on, s["starts"]).otherwise(begun).alias("starts")
        )

    narrow = F.transform(sections, lambda x: F.struct(F.coalesce(x["heading"], F.lit("")).alias("heading"), count(strip(x["text"])).alias("tokens")))
    return F.aggregate(narrow, start, step, lambda s: s["starts"])


def paragraph_units(text: Column, most: int, count: Count = estimate_tokens) -> Column:
    """A large section's stripped text in parts of paragraphs, packed greedily; a longer paragraph stands alone. Blank text stays one part."""
    paragraphs = F.split(strip(text), "\n\n")
    sizes = F.transform(paragraphs, count)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, n: Column) -> Column:
        goes_on = (s["at"] > 0) & (s["used"] + n <= most)
        return F.struct((s["at"] + 1).alias("at"), F.when(goes_on, s["used"] + n).otherwise(n).alias("used"), F.when(goes_on, s["starts"]).otherwise(F.array_append(s["starts"], s["at"])).alias("starts"))

    starts = F.aggregate(sizes, start, step, lambda s: s["starts"])
    both = F.struct(paragraphs.alias("paragraphs"), starts.alias("starts"))
    units = let(both, lambda b: _between(b["starts"], F.size(b["paragraphs"]), lambda _, a, n: F.array_join(F.slice(b["paragraphs"], a + 1, n), "\n\n")))
    return F.when(strip(text) == "", F.array(text)).otherwise(units)


def _chunk(heading: Column, texts: Column, members: Column, groups: Column) -> Column:
    raw = F.array_join(texts, "")
    content = strip(F.array_join(F.transform(texts, strip), "\n"))
    return F.struct(
        heading.alias("heading"), F.coalesce(F.nullif(content, F.lit("")), raw).alias("content"), raw.alias("raw_content"), members.cast("array<int>").alias("references"),
        F.array_sort(F.array_distinct(groups)).cast("array<int>").alias("render_groups"),
    )


def chunks_native(
    docs: DataFrame, most: int = 1000, section_most: int | None = None, key: str = "doc_id", text: str = "text", strict: bool = False, alone: int = 600, count: Count = estimate_tokens
) -> DataFrame:
    """(key, rank, heading, content, raw_content, references, render_groups): the chunks of each document.

    ``most`` is held between 64 and 1000, ``section_most`` (by default a quarter of most, from 128 to 512) is at least 32. A null or empty text has no
    chunk. ``count`` gives a text's tokens as an expression; force splitting goes by the library's estimate.
    """
    section_most = max(32, section_most or max(128, min(512, most // 4)))
    most, alone = max(64, min(1000, most)), max(1, alone)
    x = with_sections(docs, section_most, key, text, count)
    x = x.select(key, "sections", chunk_starts(F.col("sections"), most, alone, strict, count).alias("starts"))
    sections = F.col("sections")
    first_heading = lambda some: F.coalesce(F.get(F.filter(F.transform(some, lambda s: s["heading"]), lambda h: h != ""), F.lit(0)), F.lit(""))

    def packed(i: Column, s: Column) -> Column:
        n = F.coalesce(F.get(F.col("starts"), i + 1)["at"], F.size(sections)) - s["at"]
        some = F.slice(sections, s["at"] + 1, n)
        fields = lambda name: F.transform(some, lambda y: y[name])
        one = F.get(sections, s["at"])
        units = F.transform(paragraph_units(one["text"], most, count), lambda u: _chunk(one["heading"], F.array(u), F.array(one["order_index"]), F.array(one["render_group_index"])))
        return F.when(s["large"], units).otherwise(F.array(_chunk(first_heading(some), fields("text"), fields("order_index"), fields("render_group_index"))))

    made = F.flatten(F.transform("starts", lambda s, i: packed(i, s)))
    # outer: for an inner one Spark adds a filter on the array's size below all steps, which would work them out anew for every element
    return x.select(key, F.posexplode_outer(made).alias("rank", "chunk")).filter("rank IS NOT NULL").select(key, "rank", "chunk.heading", "chunk.content", "chunk.raw_content", "chunk.references", "chunk.render_groups")


def section_rows(docs: DataFrame, section_most: int = 250, key: str = "doc_id", text: str = "text", count: Count = estimate_tokens) -> DataFrame:
    """(key, order_index, render_group_index, heading, text): the sections as rows."""
    return with_sections(docs, max(32, section_most), key, text, count).select(key, F.inline_outer("sections")).filter("order_index IS NOT NULL")
