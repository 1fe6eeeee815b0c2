"""Chunkers: by tokens, characters, page ranges and sections.

Each chunker is a column function from a text to an array of spans or pieces,
so chunking itself never shuffles; ``chunk_rows`` explodes the array and numbers
the rows inside the same stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import fixed_values as fv
from corpusflow.functions.text import is_blank, is_section_heading, let, paragraphs, strip

_BLANK_CODES = np.array([ord(ch) for ch in fv.BLANK_CHARS], dtype=np.uint32)
_SECTION_MARKS = [re.compile(p) for p in fv.CHUNK_SECTION_PATTERNS]
TOKEN_CHUNK_TYPE = T.ArrayType(
    T.StructType()
    .add("text", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("tokens", T.IntegerType())
)


class _TokenCounter:
    """Token estimates of any span of one text in constant time, from running counts."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        han = (codes >= 0x4E00) & (codes <= 0x9FA5)
        self._word = ~np.isin(codes, _BLANK_CODES)
        starts = self._word.copy()
        starts[1:] &= ~self._word[:-1]
        self._han = np.concatenate(([0], np.cumsum(han)))
        self._starts = np.concatenate(([0], np.cumsum(starts)))

    def count(self, a: int, b: int) -> int:
        if b <= a:
            return 0
        han = int(self._han[b] - self._han[a])
        words = int(self._starts[b] - self._starts[a + 1]) + int(self._word[a])
        other = max(-(-(b - a - han) // 4), -(-3 * words // 4))
        return -(-han // 2) + other


def _boundary(window: str) -> int:
    """Length to keep of a window: section mark, blank line, sentence end, then space."""
    size = len(window)
    for mark in _SECTION_MARKS:
        last = max((m.start() for m in mark.finditer(window)), default=0)
        if last > size * 0.7:
            return last
    blank_line = window.rfind("\n\n")
    if blank_line > 0:
        return blank_line
    ends = [(window.rfind(e), len(e)) for e in fv.SENTENCE_ENDS]
    at, width = max(((i, n) for i, n in ends if i > size * 0.5), default=(0, 0))
    if at > 0:
        return at + width
    space = window.rfind(" ")
    return space if space > 0 else size


def _token_spans(text: str, limit: int) -> list[tuple[str, int, int, int]]:
    n = len(text)
    counter = _TokenCounter(text)
    overlap_tokens = min(fv.OVERLAP_TOKEN_CAP, limit // 10)
    spans, at = [], 0
    while at < n:
        rest = counter.count(at, n)
        if rest <= limit:
            piece = text[at:].strip(fv.BLANK_CHARS)
            if piece or not spans:
                spans.append((piece, at, n, rest))
            break
        size = min(int(limit * ((n - at) / rest)), n - at)
        while size > 0 and counter.count(at, at + size) > limit:
            size = int(size * 0.9)
        size = max(_boundary(text[at : at + size]), 1)
        piece = text[at : at + size].strip(fv.BLANK_CHARS)
        step = size
        if piece:
            tokens = counter.count(at, at + size)
            spans.append((piece, at, at + size, tokens))
            step = size - int(overlap_tokens * (size / tokens))
        at += max(step, -(-size // 2))
    return spans


def _chunk_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, limits in batches:
        yield pd.Series(
            [_token_spans(t, int(n)) if t else [("", 0, 0, 0)] for t, n in zip(texts, limits)]
        )


# marked non-deterministic so that no inferred filter evaluates it a second time
_token_chunks = F.pandas_udf(_chunk_batches, TOKEN_CHUNK_TYPE).asNondeterministic()


def token_chunks(text: Column, limit: Column) -> Column:
    """Chunks of at most ``limit`` tokens with up to a tenth of overlap.

    A rest that fits is one last chunk, and every step moves on by at least half
    a chunk, so the work grows linearly with the text.
    """
    return _token_chunks(text, limit)


def last_index(reversed_window: Column, size: Column, mark: str) -> Column:
    """Zero-based position of the last ``mark``, or a negative number."""
    # a missing mark has position 0, which gives a value past the window: keep it negative
    found = F.nullif(F.locate(mark[::-1], reversed_window), F.lit(0))
    return F.coalesce(size - found + (1 - len(mark)), F.lit(-1))


def _spans(text: Column, size: int, steps: int | None, break_length, last_uncut: bool) -> Column:
    """Fold over a text that cuts windows of ``size``; returns ``array<struct<start, chars>>``.

    Only offsets are carried. ``break_length`` maps (reversed window, length) to
    the length to keep; ``last_uncut`` skips the break search in the last step.
    Without ``steps`` the whole text is cut.
    """
    empty = F.array().cast("array<struct<start:int,chars:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def fold(n: Column) -> Column:
        def kept(state: Column) -> Column:
            window = F.reverse(F.substring(text, state["at"] + 1, F.lit(size)))
            return let(window, lambda w: break_length(w, F.lit(size)))

        def step(state: Column, number: Column) -> Column:
            more = state["at"] + size < n
            if last_uncut and steps is not None:
                more = more & (number < steps)
            length = F.when(more, kept(state)).otherwise(F.least(F.lit(size), n - state["at"])).cast("int")

            def advance(m: Column) -> Column:
                span = F.struct(state["at"].alias("start"), m.alias("chars"))
                return F.struct(
                    (state["at"] + m).alias("at"), F.array_append(state["spans"], span).alias("spans")
                )

            return F.when(state["at"] < n, let(length, advance)).otherwise(state)

        # no more steps than the text can fill: each cut keeps more than half a window
        needed = F.greatest(F.lit(1), (F.ceil(n * 2 / size) + 1).cast("int"))
        needed = needed if steps is None else F.least(F.lit(steps), needed)
        return F.aggregate(F.sequence(F.lit(1), needed), start, step, lambda s: s["spans"])

    return let(F.length(text), fold)


def _latest_break(window: Column, n: Column) -> Column:
    at = F.greatest(*[last_index(window, n, m) for m in fv.TEXT_BREAKS])
    return F.when(at > n * 0.5, at + 1).otherwise(n)


def _ranked_break(window: Column, n: Column) -> Column:
    hits = [last_index(window, n, m) for m in fv.PAGE_BREAKS]
    return F.coalesce(*[F.when(h > n * 0.5, h + 1) for h in hits], n)


def text_chunks(
    text: Column, size: int = fv.TEXT_CHUNK_SIZE, max_chunks: int | None = None
) -> Column:
    """Fixed-size chunks cut at the latest break past the middle.

    ``array<struct<content, start, chars>>``; a blank text gives one empty chunk.
    The whole text is covered; text past ``max_chunks`` chunks, if given, is not, see ``dropped_chars``.
    """
    spans = _spans(text, size, max_chunks, _latest_break, last_uncut=True)
    cut = F.transform(
        spans,
        lambda s: F.struct(
            strip(F.substring(text, s["start"] + 1, s["chars"])).alias("content"),
            s["start"].alias("start"),
            s["chars"].alias("chars"),
        ),
    )
    nothing = F.array(F.struct(F.lit("").alias("content"), F.lit(0).alias("start"), F.lit(0).alias("chars")))
    return F.when(is_blank(text), nothing).otherwise(cut)


def dropped_chars(text: Column, chunks: Column) -> Column:
    """Characters behind the last chunk."""
    last = F.element_at(chunks, -1)
    return F.when(is_blank(text), 0).otherwise(F.length(text) - last["start"] - last["chars"])


def page_texts(text: Column) -> Column:
    return F.split(text, fv.PAGE_SPLIT)


def page_range_chunks(
    text: Column,
    ranges: list[tuple[int, int | None]],
    size: int = fv.TEXT_CHUNK_SIZE,
    max_chunks: int | None = None,
) -> Column:
    """Chunks of page ranges; a range without an end goes to the last page.

    ``array<struct<content, start_page, end_page, chars>>``. ``max_chunks``, if
    given, counts over all ranges: all are cut first; the last allowed chunk then
    takes its full window.
    """

    def end(pages: Column, first: int, last: int | None) -> Column:
        return F.greatest(F.size(pages), F.lit(first)) if last is None else F.lit(last)

    def range_text(pages: Column, first: int, last: int | None) -> Column:
        picked = strip(F.array_join(F.slice(pages, F.lit(first), end(pages, first, last) - first + 1), "\n\n"))
        return F.when(F.size(pages) <= 1, text).otherwise(picked)

    def pieces(body: Column, first: int, last: Column) -> Column:
        spans = _spans(body, size, max_chunks, _ranked_break, last_uncut=False)
        rows = F.transform(
            spans,
            lambda s: F.struct(
                F.lit(first).alias("start_page"),
                last.alias("end_page"),
                s["chars"].alias("chars"),
                F.substring(body, s["start"] + 1, s["chars"]).alias("cut"),
                F.substring(body, s["start"] + 1, F.lit(size)).alias("full"),
            ),
        )
        return F.when(is_blank(body), F.slice(rows, 1, 0)).otherwise(rows)

    def of_range(pages: Column, first: int, last: int | None) -> Column:
        return let(range_text(pages, first, last), lambda body: pieces(body, first, end(pages, first, last)))

    def collect(pages: Column) -> Column:
        kept = F.concat(*[of_range(pages, a, b) for a, b in ranges])
        kept = kept if max_chunks is None else F.slice(kept, 1, max_chunks)

        def row(p: Column, i: Column) -> Column:
            raw = p["cut"] if max_chunks is None else F.when(i == max_chunks - 1, p["full"]).otherwise(p["cut"])
            return F.struct(
                strip(raw).alias("content"),
                p["start_page"].alias("start_page"),
                p["end_page"].alias("end_page"),
                F.length(raw).alias("chars"),
            )

        return F.transform(kept, row)

    return let(page_texts(text), collect)


def _join_from(parts: Column, starts: Column, separator: str) -> Column:
    """Join ``parts`` into groups that begin at the given one-based positions."""
    end = F.size(parts) + 1
    return F.transform(
        starts,
        lambda s, k: F.array_join(
            F.slice(parts, s, F.coalesce(F.get(starts, k + 1), end) - s), separator
        ),
    )


def section_texts(text: Column) -> Column:
    """Paragraphs grouped under section headings; fewer than two groups give the whole text."""

    def group(parts: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))
        starts = F.filter(numbers, lambda i: (i == 1) | is_section_heading(F.get(parts, i - 1)))
        return F.when(F.size(starts) > 1, _join_from(parts, starts, "\n\n")).otherwise(F.array(text))

    return let(paragraphs(text), group)


def _packed(parts: Column, max_chars: int) -> Column:
    """Greedy packing joined by blank lines; the fold sees lengths only."""
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))
    numbered = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("chars"), (i + 1).alias("at")))

    def step(state: Column, part: Column) -> Column:
        grown = state["size"] + 2 + part["chars"]
        fits = (F.size(state["starts"]) > 0) & (grown <= max_chars)
        return F.struct(
            F.when(fits, grown).otherwise(part["chars"]).alias("size"),
            F.when(fits, state["starts"])
            .otherwise(F.array_append(state["starts"], part["at"]))
            .alias("starts"),
        )

    starts = F.aggregate(numbered, start, step, lambda s: s["starts"])
    return let(starts, lambda s: _join_from(parts, s, "\n\n"))


def _hard_cut(pieces: Column, max_chars: int) -> Column:
    def cut(p: Column) -> Column:
        offsets = F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(max_chars))
        return F.transform(offsets, lambda o: strip(F.substring(p, o + 1, F.lit(max_chars))))

    parts = F.transform(pieces, lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(cut(p)))
    return F.filter(F.flatten(parts), lambda p: F.length(p) > 0)


def section_chunks(text: Column, max_chars: int) -> Column:
    """Sections, or paragraphs when there is one section only, packed up to ``max_chars``."""

    def build(body: Column) -> Column:
        def pick(sections: Column) -> Column:
            by_section = _hard_cut(_packed(sections, max_chars), max_chars)
            by_paragraph = _hard_cut(let(paragraphs(body), lambda p: _packed(p, max_chars)), max_chars)
            return F.when(
                F.size(sections) > 1,
                let(by_section, lambda c: F.when(F.size(c) > 1, c).otherwise(by_paragraph)),
            ).otherwise(by_paragraph)

        return F.when(F.length(body) <= max_chars, F.array(body)).otherwise(let(section_texts(body), pick))

    return let(strip(text), build)


def chunk_rows(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk with id, index, real total and first/last flags.

    The outer form of the explode is used because the inner one adds a filter
    that would run the chunker twice; chunkers never return an empty array.
    """
    number = F.col("index").cast("string")
    chunk_id = F.sha2(F.concat_ws(":", F.col(keep[0]).cast("string"), number), 256)
    exploded = df.select(*keep, chunks.alias("_chunks")).select(
        *keep, F.size("_chunks").alias("total"), F.posexplode_outer("_chunks").alias("index", "chunk")
    )
    return exploded.select(
        *keep,
        chunk_id.alias("chunk_id"),
        "index",
        "total",
        (F.col("index") == 0).alias("is_first"),
        (F.col("index") == F.col("total") - 1).alias("is_last"),
        "chunk",
    )


def split_rows(df: DataFrame, parts: Column, key: str, name: str, number: str) -> DataFrame:
    """One row per part, numbered from one; the outer explode evaluates ``parts`` once."""
    exploded = df.select(key, F.posexplode_outer(parts).alias("_pos", name))
    return exploded.filter(F.col("_pos").isNotNull()).select(key, (F.col("_pos") + 1).alias(number), name)


def merge_rows(df: DataFrame, key: str, order: str, text: str, separator: str = fv.MERGE_SEPARATOR) -> DataFrame:
    """Join the non-blank texts of a key in order; a key holds one document's answers."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    texts = F.transform(ordered, lambda s: s[text])
    kept = F.filter(texts, lambda t: F.length(strip(t)) > 0)
    return df.groupBy(key).agg(F.array_join(kept, separator).alias("merged"))
