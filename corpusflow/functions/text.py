"""Text columns: blanks, token estimates, headings, summaries and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``; lambdas have no common-subexpression reuse."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim every Unicode blank (plain ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(fv.BLANK_CHARS))


def strip_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(fv.BLANK_CHARS))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(fv.BLANK_CHARS))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def word_count(c: Column) -> Column:
    """Number of maximal runs of non-blank characters.

    The class tests plain letters first and the run is possessive, which makes
    the scan two to three times faster than the bare negated class.
    """
    return F.regexp_count(c, F.lit(f"[!-~À-ɏ[^{fv.BLANK}]]++"))


def han_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(fv.HAN_CLASS))


def token_estimate(c: Column) -> Column:
    """Half a token per Han character; a quarter per other character or 0.75 per word."""

    def from_counts(s: Column) -> Column:
        other = F.ceil((F.length(c) - s["han"]) / 4)
        words = F.ceil(s["words"] * 0.75)
        return F.ceil(s["han"] / 2) + F.greatest(other, words)

    counts = F.struct(han_count(c).alias("han"), word_count(c).alias("words"))
    return F.coalesce(let(counts, from_counts), F.lit(0)).cast("bigint")


def max_text_length(max_tokens: Column, sample: Column) -> Column:
    """Longest text for a token budget at the sample's characters-per-token rate."""
    tokens = token_estimate(sample)
    return (
        F.when(tokens > 0, F.floor(max_tokens * (F.length(sample) / tokens)))
        .otherwise(max_tokens * 4)
        .cast("bigint")
    )


def coarse_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("bigint")


def needs_chunking(c: Column, max_chunk_size: int = fv.TEXT_CHUNK_SIZE) -> Column:
    return coarse_tokens(c) > max_chunk_size * 0.75


def _any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def is_section_heading(paragraph: Column) -> Column:
    """Does the first line of the paragraph open a section?"""

    def check(first: Column) -> Column:
        short = F.length(first).between(1, fv.SECTION_HEADING_MAX)
        return short & _any_match(first, fv.SECTION_HEADING_PATTERNS)

    return let(strip(F.regexp_extract(paragraph, r"^([^\r\n]*)", 1)), check)


def is_likely_heading(line: Column) -> Column:
    return (F.length(line) <= fv.LIKELY_HEADING_MAX) & _any_match(line, fv.LIKELY_HEADING_PATTERNS)


def is_edge_candidate(line: Column) -> Column:
    """Short line with a digit or without lower-case letters: may be a header or footer."""

    def check(t: Column) -> Column:
        return F.length(t).between(1, fv.EDGE_MAX_CHARS) & (t.rlike("[0-9]") | (t == F.upper(t)))

    return let(strip(line), check)


def is_page_number(line: Column) -> Column:
    return strip(line).rlike("^[0-9]+$")


def normalize_line(c: Column) -> Column:
    """Collapse blanks, no blank before closing marks or after an opening bracket.

    All closing marks are fixed, not the first one only.
    """
    one_space = F.regexp_replace(c, f"[{fv.BLANK}]+", " ")
    closed = F.regexp_replace(one_space, r" ([,.;:!?%)])", "$1")
    return strip(F.regexp_replace(closed, r"\( ", "("))


def paragraphs(c: Column) -> Column:
    """Array of trimmed, non-blank paragraphs."""
    parts = F.split(c, fv.PARAGRAPH_SPLIT)
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)


def clip(c: Column, size: int) -> Column:
    """Cut to ``size`` characters and mark the cut with three dots."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def preview(c: Column) -> Column:
    t = strip(c)
    return F.when(F.length(t) == 0, F.lit(fv.EMPTY_PREVIEW)).otherwise(clip(t, fv.PREVIEW_CHARS))


def chunk_summary(content: Column, number: Column) -> Column:
    """Chunk header followed by the clipped answer."""
    header = F.replace(F.lit(fv.CHUNK_HEADER), F.lit("{index}"), number.cast("string"))
    return F.concat(header, clip(strip(content), fv.SUMMARY_CHARS))


def shrunk_summary(summary: Column, number: Column) -> Column:
    """Replace the chunk header by a fresh one and clip the body further."""
    body = strip(F.regexp_replace(strip(summary), fv.CHUNK_HEADER_PATTERN, ""))
    header = F.replace(F.lit(fv.CHUNK_HEADER), F.lit("{index}"), number.cast("string"))
    return F.concat(header, clip(body, fv.SHRUNK_SUMMARY_CHARS))


def _section(text: Column, names: str, terminators: list[str]) -> Column:
    stop = "|".join([r"\n\s*\n"] + [rf"\n\s*{t}" for t in terminators] + [r"\z"])
    hit = F.regexp_extract(text, rf"(?is)({names})[\s:]+(.*?)(?={stop})", 2)
    found = text.rlike(rf"(?i)({names})[\s:]")
    return F.when(found, strip(hit))


def abstract_section(text: Column) -> Column:
    return _section(text, "abstract", ["introduction", "背景", "引言"])


def introduction_section(text: Column) -> Column:
    return _section(text, "introduction|背景|引言", ["methods", "方法", "实验"])


def keywords_section(text: Column) -> Column:
    return _section(text, "keywords|关键词", ["abstract"])
