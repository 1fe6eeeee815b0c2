"""Chunkers as SQL table functions: ``SELECT d.id, c.* FROM docs d, LATERAL cf_chunk_text(d.text, 8000) c``.

Bodies are plain SQL over built-ins. The optimizer inlines them into a ``Generate`` over the
caller's rows, so they neither shuffle nor join. A null text gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from corpusflow import fixed_values as fv


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    return f"btrim({x}, {_text(fv.BLANK_CHARS)})"


def _let(value: str, name: str, body: str) -> str:
    """Bind ``value`` once; lambdas have no common-subexpression reuse."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _last_mark(mark: str) -> str:
    """Zero-based place of the last mark in the reversed window ``w`` of ``size``, or -1."""
    return f"coalesce(size - nullif(locate({_text(mark[::-1])}, w), 0) + {1 - len(mark)}, -1)"


def _latest_break() -> str:
    at = f"greatest({', '.join(_last_mark(m) for m in fv.TEXT_BREAKS)})"
    return _let(at, "hit", "CASE WHEN hit > size * 0.5 THEN hit + 1 ELSE size END")


def _ranked_break() -> str:
    hits = ", ".join(_let(_last_mark(m), "hit", "CASE WHEN hit > size * 0.5 THEN hit + 1 END") for m in fv.PAGE_BREAKS)
    return f"coalesce({hits}, size)"


def _spans(body: str, break_length: str) -> str:
    """Fold that cuts windows of ``size`` characters; only offsets are carried."""
    kept = _let(f"reverse(substring({body}, s.at + 1, size))", "w", break_length)
    length = f"CAST(CASE WHEN s.at + size < length({body}) THEN {kept} ELSE least(size, length({body}) - s.at) END AS INT)"
    grown = "named_struct('at', s.at + m, 'spans', array_append(s.spans, named_struct('start', s.at, 'chars', m)))"
    return (
        f"aggregate(sequence(1, greatest(1, CAST(ceil(length({body}) * 2 / size) + 1 AS INT))), "
        "named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<start: INT, chars: INT>>)), "
        f"(s, k) -> CASE WHEN s.at < length({body}) THEN {_let(length, 'm', grown)} ELSE s END, s -> s.spans)"
    )


def _text_chunks() -> str:
    cut = f"transform({_spans('t', _latest_break())}, c -> named_struct('content', {_strip('substring(t, c.start + 1, c.chars)')}, 'start', c.start, 'chars', c.chars))"
    return f"CASE WHEN length({_strip('t')}) = 0 THEN array(named_struct('content', '', 'start', 0, 'chars', 0)) ELSE {cut} END"


def _page_chunks() -> str:
    last = "coalesce(r.last, greatest(size(ps), r.first))"
    picked = _strip(f"array_join(slice(ps, r.first, {last} - r.first + 1), '\\n\\n')")
    raw = "substring(body, c.start + 1, c.chars)"
    row = f"named_struct('start_page', r.first, 'end_page', {last}, 'chars', length({raw}), 'content', {_strip(raw)})"
    pieces = f"transform({_spans('body', _ranked_break())}, c -> {row})"
    some = f"CASE WHEN length({_strip('body')}) = 0 THEN slice({pieces}, 1, 0) ELSE {pieces} END"
    of_range = _let(f"CASE WHEN size(ps) <= 1 THEN t ELSE {picked} END", "body", some)
    return _let(f"split(t, {_text(fv.PAGE_SPLIT)})", "ps", f"flatten(transform(ranges, r -> {of_range}))")


def _heading(paragraph: str) -> str:
    first = _strip(f"regexp_extract({paragraph}, {_text('^([^' + chr(92) + 'r' + chr(92) + 'n]*)')}, 1)")
    marks = " OR ".join(f"line RLIKE {_text(p)}" for p in fv.SECTION_HEADING_PATTERNS)
    return _let(first, "line", f"length(line) BETWEEN 1 AND {fv.SECTION_HEADING_MAX} AND ({marks})")


def _paragraphs(x: str) -> str:
    return f"filter(transform(split({x}, {_text(fv.PARAGRAPH_SPLIT)}), p -> {_strip('p')}), p -> length(p) > 0)"


def _joined(parts: str, starts: str) -> str:
    """Groups of ``parts`` that begin at the one-based ``starts``, joined by blank lines."""
    upto = f"coalesce(get({starts}, k + 1), size({parts}) + 1)"
    return f"transform({starts}, (b, k) -> array_join(slice({parts}, b, {upto} - b), '\\n\\n'))"


def _packed(parts: str) -> str:
    """Greedy packing up to ``max_chars``; the fold sees lengths only."""
    numbered = f"transform({parts}, (p, i) -> named_struct('chars', length(p), 'at', i + 1))"
    fits = "size(s.starts) > 0 AND s.size + 2 + q.chars <= max_chars"
    step = (
        f"named_struct('size', CASE WHEN {fits} THEN s.size + 2 + q.chars ELSE q.chars END, "
        f"'starts', CASE WHEN {fits} THEN s.starts ELSE array_append(s.starts, q.at) END)"
    )
    starts = f"aggregate({numbered}, named_struct('size', 0, 'starts', CAST(array() AS ARRAY<INT>)), (s, q) -> {step}, s -> s.starts)"
    return _let(starts, "begins", _joined(parts, "begins"))


def _hard_cut(pieces: str) -> str:
    offsets = "sequence(0, greatest(length(p) - 1, 0), max_chars)"
    cut = f"transform({offsets}, o -> {_strip('substring(p, o + 1, max_chars)')})"
    parts = f"transform({pieces}, p -> CASE WHEN length(p) <= max_chars THEN array(p) ELSE {cut} END)"
    return f"filter(flatten({parts}), p -> length(p) > 0)"


def _section_chunks() -> str:
    numbers = "sequence(1, greatest(size(paras), 1))"
    starts = f"filter({numbers}, n -> n = 1 OR {_heading('get(paras, n - 1)')})"
    by_section = _hard_cut(_let(_joined("paras", "heads"), "sections", _packed("sections")))
    by_paragraph = _hard_cut(_packed("paras"))
    chosen = _let(by_section, "c", f"CASE WHEN size(c) > 1 THEN c ELSE {by_paragraph} END")
    grouped = _let(starts, "heads", f"CASE WHEN size(heads) > 1 THEN {chosen} ELSE {by_paragraph} END")
    long = _let(_paragraphs("body"), "paras", grouped)
    return _let(_strip("t"), "body", f"CASE WHEN length(body) <= max_chars THEN array(body) ELSE {long} END")


def _rows(chunks: str, columns: str) -> str:
    """``SELECT`` of the chunks with their index and the number of all; made once, then exploded."""
    rest = "length(t) - element_at(chunks, -1).start - element_at(chunks, -1).chars" if "e.rest" in columns else "0"
    numbered = f"transform(chunks, (e, i) -> named_struct('index', i, 'total', size(chunks), 'rest', {rest}, 'chunk', e))"
    return f"SELECT {columns} FROM (SELECT explode({_let(chunks, 'chunks', numbered)}) AS e)"


_FORMS: dict[str, tuple[str, str, Callable[[], str]]] = {
    "chunk_text": (
        f"t STRING, size INT DEFAULT {fv.TEXT_CHUNK_SIZE}",
        "index INT, total INT, start INT, chars INT, content STRING, dropped_chars INT",
        lambda: _rows(_text_chunks(), "e.index, e.total, e.chunk.start, e.chunk.chars, e.chunk.content, e.rest"),
    ),
    "chunk_pages": (
        f"t STRING, ranges ARRAY<STRUCT<first: INT, last: INT>>, size INT DEFAULT {fv.TEXT_CHUNK_SIZE}",
        "index INT, total INT, start_page INT, end_page INT, chars INT, content STRING",
        lambda: _rows(_page_chunks(), "e.index, e.total, e.chunk.start_page, e.chunk.end_page, e.chunk.chars, e.chunk.content"),
    ),
    "chunk_sections": (
        "t STRING, max_chars INT",
        "index INT, total INT, content STRING",
        lambda: _rows(_section_chunks(), "e.index, e.total, e.chunk"),
    ),
}


def register_tables(spark: SparkSession, prefix: str = "cf_") -> list[str]:
    """Create the table functions in this session and return their names.

    Token chunks stay ``inline(cf_token_chunks(text, limit))``, see ``functions.sql``.
    """
    for name, (arguments, columns, body) in _FORMS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE ({columns}) RETURN {body()}")
    return [prefix + name for name in _FORMS]
