"""Catalogue: page layout, splitters, chunkers and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions import models, replies, table_sql, templates, text
from corpusflow.operators import chunking, layout
from corpusflow.plans import oracle_views as ov
from corpusflow.plans import samples, views
from corpusflow.plans.registry import query

SECTION_SIZE = 600
RANGES = [(1, 2), (3, 4), (5, None)]


# --- layout ---------------------------------------------------------------------------


@query("items_to_lines", "SELECT doc_id, page_no, line_no, line FROM v_clean_lines")
def items_to_lines(spark, sf_dir):
    return layout.items_to_lines(views.page_items(spark, sf_dir))


@query("repeated_edges", "SELECT doc_id, line, pages FROM v_edges")
def repeated_edges(spark, sf_dir):
    return layout.repeated_edges(_clean_pages(spark, sf_dir))


def _clean_pages(spark, sf_dir):
    """Pages whose lines went through the same normalisation as items do."""
    pages = views.page_arrays(spark, sf_dir)
    lines = F.filter(F.transform("lines", text.normalize_line), lambda x: F.length(x) > 0)
    return pages.select("doc_id", "page_no", lines.alias("lines"))


@query(
    "strip_headers",
    """SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS line_no, line FROM v_clean_lines l
    WHERE NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.doc_id = l.doc_id AND e.line = l.line)""",
)
def strip_headers(spark, sf_dir):
    stripped = layout.strip_repeated_edges(_clean_pages(spark, sf_dir))
    return stripped.select("doc_id", "page_no", F.posexplode("lines").alias("line_no", "line"))


@query(
    "rebuild_paragraphs",
    """SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY paragraph_no) AS paragraph_no, paragraph
    FROM v_paragraph_rows""",
)
def rebuild_paragraphs(spark, sf_dir):
    stripped = layout.strip_repeated_edges(_clean_pages(spark, sf_dir))
    lines = layout.drop_page_numbers(F.col("lines"))
    rebuilt = layout.rebuilt_paragraphs(F.col("lines"))
    return (
        stripped.select("doc_id", "page_no", lines.alias("lines"))
        .select("doc_id", "page_no", F.posexplode(rebuilt).alias("n", "paragraph"))
        .select("doc_id", "page_no", (F.col("n") + 1).alias("paragraph_no"), "paragraph")
    )


@query(
    "assemble_pages",
    f"""SELECT doc_id, {ov.strip('string_agg(page_text, chr(10) || chr(10) ORDER BY page_no)')} AS text FROM v_page_texts GROUP BY doc_id""",
)
def assemble_pages(spark, sf_dir):
    stripped = layout.strip_repeated_edges(_clean_pages(spark, sf_dir))
    lines = layout.drop_page_numbers(F.col("lines"))
    return layout.assemble_pages(layout.page_texts(stripped.select("doc_id", "page_no", lines.alias("lines"))))


@query(
    "clean_layout",
    f"""SELECT d.doc_id, coalesce(t.text, '') AS text, CASE WHEN coalesce(t.text, '') = '' THEN 'EMPTY_CONTENT' END AS error FROM documents d
    LEFT JOIN (SELECT doc_id, {ov.strip('string_agg(page_text, chr(10) || chr(10) ORDER BY page_no)')} AS text FROM v_page_texts GROUP BY doc_id) t USING (doc_id)""",
)
def clean_layout(spark, sf_dir):
    return layout.clean_layout(views.page_items(spark, sf_dir))


# --- splitters -----------------------------------------------------------------------------


@query(
    "split_pages",
    """SELECT doc_id, generate_subscripts(ps, 1) AS page_no, unnest(ps) AS page_text
    FROM (SELECT doc_id, string_split(text, chr(12)) AS ps FROM v_ff_docs)""",
)
def split_pages(spark, sf_dir):
    return chunking.split_rows(views.ff_docs(spark, sf_dir), chunking.page_texts(F.col("text")), "doc_id", "page_text", "page_no")


@query(
    "split_paragraphs",
    f"""SELECT doc_id, generate_subscripts(ps, 1) AS paragraph_no, unnest(ps) AS paragraph
    FROM (SELECT doc_id, {ov.paragraphs('text')} AS ps FROM v_para_docs)""",
)
def split_paragraphs(spark, sf_dir):
    return chunking.split_rows(views.para_docs(spark, sf_dir), text.paragraphs(F.col("text")), "doc_id", "paragraph", "paragraph_no")


_SECTIONS = f"""paras AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, {ov.paragraphs('text')} AS ps FROM v_para_docs)),
    flagged AS (SELECT *, CASE WHEN i = 1 OR {ov.section_heading('p')} THEN 1 ELSE 0 END AS opens FROM paras),
    grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM flagged),
    joined AS (SELECT doc_id, g, string_agg(p, chr(10) || chr(10) ORDER BY i) AS section FROM grouped GROUP BY ALL),
    counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM joined),
    sections AS (SELECT doc_id, CAST(g AS BIGINT) AS section_no, section, total FROM counted WHERE total > 1
      UNION ALL SELECT doc_id, 1, text, 1 FROM v_para_docs WHERE doc_id NOT IN (SELECT doc_id FROM counted WHERE total > 1))"""


@query("build_sections", f"WITH {_SECTIONS} SELECT doc_id, section_no, section FROM sections")
def build_sections(spark, sf_dir):
    return chunking.split_rows(views.para_docs(spark, sf_dir), chunking.section_texts(F.col("text")), "doc_id", "section", "section_no")


# --- chunkers --------------------------------------------------------------------------------


def _last(window: str, mark: str, length: int) -> str:
    """Zero-based last position of a mark in SQL; negative when missing."""
    return f"CASE WHEN contains({window}, {mark}) THEN length({window}) - strpos(reverse({window}), reverse({mark})) - {length} + 1 ELSE -1 END"


_LATEST = f"greatest({_last('w', 'chr(10) || chr(10)', 2)}, {_last('w', ov.lit('。'), 1)}, {_last('w', 'chr(12)', 1)})"


def text_chunk_sql(source: str, size: int) -> str:
    """Recursive CTE body ``tc(doc_id, idx, pos, chars, content)``."""
    return f"""tc0(doc_id, text, idx, pos, chars) AS (
      SELECT doc_id, text, -1, 0, 0 FROM {source}
      UNION ALL SELECT doc_id, text, idx + 1, pos + chars, CASE WHEN pos + chars + {size} < length(text)
          AND best > length(w) * 0.5 THEN best + 1 ELSE length(w) END
        FROM (SELECT *, {_LATEST} AS best FROM (SELECT *, substr(text, pos + chars + 1, {size}) AS w FROM tc0
          WHERE pos + chars < length(text)))),
    tc AS (SELECT doc_id, idx, pos, chars, {ov.strip('substr(text, pos + 1, chars)')} AS content FROM tc0
      WHERE idx >= 0 AND {ov.strip('text')} <> ''
      UNION ALL SELECT doc_id, 0, 0, 0, '' FROM {source} WHERE {ov.strip('text')} = '')"""


@query(
    "chunk_text",
    f"""WITH RECURSIVE {text_chunk_sql('v_ff_docs', 1000)}
    SELECT doc_id, idx AS index, count(*) OVER (PARTITION BY doc_id) AS total, pos AS start, chars, content,
    length(text) - max(pos + chars) OVER (PARTITION BY doc_id) AS dropped_chars FROM tc JOIN v_ff_docs USING (doc_id)""",
)
def chunk_text(spark, sf_dir):
    docs = views.ff_docs(spark, sf_dir)
    chunked = docs.select("doc_id", F.length("text").alias("size"), chunking.text_chunks(F.col("text"), 1000).alias("chunks"))
    last = F.element_at("chunks", -1)
    dropped = chunked.withColumn("dropped_chars", F.col("size") - last["start"] - last["chars"])
    rows = chunking.chunk_rows(dropped, F.col("chunks"), "doc_id", "dropped_chars")
    return rows.select("doc_id", "index", "total", "chunk.start", "chunk.chars", "chunk.content", "dropped_chars")


_RANKED = "CASE " + " ".join(
    f"WHEN ({_last('w', m, n)}) > length(w) * 0.5 THEN {_last('w', m, n)} + 1"
    for m, n in [("chr(10) || chr(10)", 2), ("'。' || chr(10)", 2), ("'。'", 1), ("chr(10)", 1)]
) + " ELSE length(w) END"
PAGE_SIZE = 400


@query(
    "chunk_pages",
    f"""WITH RECURSIVE ranges AS (SELECT * FROM (VALUES (1, 1, 2), (2, 3, 4), (3, 5, NULL)) AS r(rno, a, last)),
    bodies AS (SELECT doc_id, rno, a, b, CASE WHEN len(ps) <= 1 THEN text ELSE {ov.strip("array_to_string(ps[a:b], chr(10) || chr(10))")} END AS body
      FROM (SELECT doc_id, text, ps, rno, a, coalesce(last, greatest(len(ps), a)) AS b
        FROM (SELECT doc_id, text, string_split(text, chr(12)) AS ps FROM v_ff_docs), ranges)),
    cuts(doc_id, rno, a, b, body, k, pos, chars) AS (SELECT doc_id, rno, a, b, body, -1, 0, 0 FROM bodies WHERE {ov.strip('body')} <> ''
      UNION ALL SELECT doc_id, rno, a, b, body, k + 1, pos + chars, CASE WHEN pos + chars + {PAGE_SIZE} < length(body) THEN {_RANKED} ELSE length(w) END
      FROM (SELECT *, substr(body, pos + chars + 1, {PAGE_SIZE}) AS w FROM cuts WHERE pos + chars < length(body))),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rno, k) - 1 AS idx FROM cuts WHERE k >= 0),
    kept AS (SELECT *, substr(body, pos + 1, chars) AS raw FROM numbered)
    SELECT doc_id, idx AS index, count(*) OVER (PARTITION BY doc_id) AS total, a AS start_page, b AS end_page, length(raw) AS chars,
    {ov.strip('raw')} AS content FROM kept""",
)
def chunk_pages(spark, sf_dir):
    chunks = chunking.page_range_chunks(F.col("text"), RANGES, PAGE_SIZE)
    rows = chunking.chunk_rows(views.ff_docs(spark, sf_dir), chunks, "doc_id")
    return rows.select("doc_id", "index", "total", "chunk.start_page", "chunk.end_page", "chunk.chars", "chunk.content")


@query(
    "chunk_sections",
    f"""WITH RECURSIVE {_SECTIONS},
    parts AS (SELECT doc_id, section_no AS i, section AS p, total > 1 AS sectioned FROM sections WHERE total > 1
      UNION ALL SELECT doc_id, i, p, false FROM paras WHERE doc_id NOT IN (SELECT doc_id FROM sections WHERE total > 1)),
    pack(doc_id, i, size, g) AS (SELECT doc_id, 1::BIGINT, length(p), 1 FROM parts WHERE i = 1
      UNION ALL SELECT n.doc_id, n.i, CASE WHEN c.size + 2 + length(n.p) <= {SECTION_SIZE} THEN c.size + 2 + length(n.p) ELSE length(n.p) END,
        CASE WHEN c.size + 2 + length(n.p) <= {SECTION_SIZE} THEN c.g ELSE c.g + 1 END
      FROM pack c JOIN parts n ON n.doc_id = c.doc_id AND n.i = c.i + 1),
    packed AS (SELECT doc_id, g, string_agg(p, chr(10) || chr(10) ORDER BY i) AS body FROM pack JOIN parts USING (doc_id, i) GROUP BY ALL),
    pieces AS (SELECT doc_id, g, o, {ov.strip(f'substr(body, o * {SECTION_SIZE} + 1, {SECTION_SIZE})')} AS piece, length(body) <= {SECTION_SIZE} AS small, body
      FROM (SELECT *, unnest(range(0, greatest(1, (length(body) + {SECTION_SIZE - 1}) // {SECTION_SIZE}))) AS o FROM packed)),
    final AS (SELECT doc_id, g, o, CASE WHEN small THEN body ELSE piece END AS content FROM pieces
        WHERE doc_id IN (SELECT doc_id FROM v_para_docs WHERE length({ov.strip('text')}) > {SECTION_SIZE})
      UNION ALL SELECT doc_id, 1, 0, {ov.strip('text')} FROM v_para_docs WHERE length({ov.strip('text')}) <= {SECTION_SIZE})
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, o) - 1 AS index, count(*) OVER (PARTITION BY doc_id) AS total, content
    FROM final WHERE content <> ''""",
)
def chunk_sections(spark, sf_dir):
    chunks = chunking.section_chunks(F.col("text"), SECTION_SIZE)
    rows = chunking.chunk_rows(views.para_docs(spark, sf_dir), chunks, "doc_id")
    return rows.select("doc_id", "index", "total", F.col("chunk").alias("content"))


# --- chunkers from SQL ---------------------------------------------------------------------------


def _from_sql(spark, docs, call: str):
    """Rows of a SQL table function over each document, in plain SQL."""
    table_sql.register_tables(spark)
    return spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL {call} c", docs=docs)


@query("sql_chunk_text", same_as="chunk_text")
def sql_chunk_text(spark, sf_dir):
    return _from_sql(spark, views.ff_docs(spark, sf_dir), "cf_chunk_text(d.text, 1000)")


@query("sql_chunk_pages", same_as="chunk_pages")
def sql_chunk_pages(spark, sf_dir):
    ranges = ", ".join(f"named_struct('first', {a}, 'last', {'CAST(NULL AS INT)' if b is None else b})" for a, b in RANGES)
    return _from_sql(spark, views.ff_docs(spark, sf_dir), f"cf_chunk_pages(d.text, array({ranges}), {PAGE_SIZE})")


@query("sql_chunk_sections", same_as="chunk_sections")
def sql_chunk_sections(spark, sf_dir):
    return _from_sql(spark, views.para_docs(spark, sf_dir), f"cf_chunk_sections(d.text, {SECTION_SIZE})")


TOKEN_LIMIT = 200


def token_chunk_rows(spark, sf_dir, limit: int = TOKEN_LIMIT):
    """Token chunks of the documents and of their Han forms."""
    docs = views.han_docs(spark, sf_dir)
    chunks = chunking.token_chunks(F.col("text"), models.chunk_token_limit(F.lit(""), F.lit(limit)))
    return chunking.chunk_rows(docs, chunks, "doc_id", "variant")


_SECTION_AT = ", ".join(
    f"length(regexp_extract(x, {ov.lit(f'(?s)^(.*){p}')}, 1)) AS m{i}" for i, p in enumerate(fv.CHUNK_SECTION_PATTERNS)
)
_SECTION_CUT = " ".join(f"WHEN m{i} > n * 0.7 THEN m{i}" for i in range(len(fv.CHUNK_SECTION_PATTERNS)))
_SENTENCE_AT = "greatest(" + ", ".join(_last("x", ov.lit(e), 2) for e in fv.SENTENCE_ENDS) + ")"


def token_chunk_sql(source: str, limit: int) -> str:
    """Recursive CTE body ``cut(doc_id, variant, c_start, c_end, c_tokens, content)``.

    One recursion step either sizes a window, shrinks it by a tenth, or cuts it and moves on.
    """
    overlap = min(fv.OVERLAP_TOKEN_CAP, limit // 10)
    last = f"w < 0 AND rest <= {limit}"
    cut = "w >= 0 AND fits"
    return f"""tk(doc_id, variant, text, pos, w, c_start, c_end, c_tokens) AS (
      SELECT doc_id, variant, text, 0::BIGINT, -1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM {source}
      UNION ALL
      SELECT doc_id, variant, text,
        CASE WHEN {cut} THEN pos + greatest(step, (size + 1) // 2) WHEN {last} THEN length(text) ELSE pos END,
        CASE WHEN w < 0 AND rest > {limit} THEN CAST(floor({limit} * (CAST(length(text) - pos AS DOUBLE) / rest)) AS BIGINT)
          WHEN w >= 0 AND NOT fits THEN CAST(floor(w * 0.9::DOUBLE) AS BIGINT) ELSE -1 END,
        CASE WHEN ({cut}) OR ({last}) THEN pos END,
        CASE WHEN {cut} THEN pos + size WHEN {last} THEN length(text) END,
        CASE WHEN {cut} THEN cut_tokens WHEN {last} THEN rest END
      FROM (SELECT *, CASE WHEN {ov.strip('substr(x, 1, size)')} = '' THEN size
          ELSE size - CAST(floor({overlap} * (CAST(size AS DOUBLE) / cut_tokens)) AS BIGINT) END AS step
        FROM (SELECT *, {ov.tokens('substr(x, 1, size)')} AS cut_tokens
          FROM (SELECT *, greatest(1, CAST(CASE {_SECTION_CUT} WHEN blank_at > 0 THEN blank_at
              WHEN sentence_at > n * 0.5 THEN sentence_at + 2 WHEN space_at > 0 THEN space_at ELSE n END AS BIGINT)) AS size
            FROM (SELECT *, length(x) AS n, {_SECTION_AT}, {_last('x', 'chr(10) || chr(10)', 2)} AS blank_at, {_SENTENCE_AT} AS sentence_at,
                {_last('x', "' '", 1)} AS space_at, {ov.tokens('x')} <= {limit} AS fits, {ov.tokens('tail')} AS rest
              FROM (SELECT *, CASE WHEN w >= 0 THEN substr(text, pos + 1, w) ELSE '' END AS x, CASE WHEN w < 0 THEN substr(text, pos + 1) ELSE '' END AS tail
                FROM tk WHERE pos < length(text))))))),
    cut AS (SELECT doc_id, variant, c_start, c_end, c_tokens, {ov.strip('substr(text, c_start + 1, c_end - c_start)')} AS content FROM tk WHERE c_start IS NOT NULL)"""


@query(
    "chunk_tokens",
    f"""WITH RECURSIVE {token_chunk_sql('v_han_docs', TOKEN_LIMIT)}
    SELECT doc_id, variant, row_number() OVER o - 1 AS index, count(*) OVER d AS total, row_number() OVER o = 1 AS is_first,
    row_number() OVER o = count(*) OVER d AS is_last, c_start AS start, c_end AS "end", c_tokens AS tokens, content FROM cut WHERE content <> ''
    WINDOW d AS (PARTITION BY doc_id, variant), o AS (PARTITION BY doc_id, variant ORDER BY c_start)""",
)
def chunk_tokens(spark, sf_dir):
    return token_chunk_rows(spark, sf_dir).select(
        "doc_id", "variant", "index", "total", "is_first", "is_last", "chunk.start", "chunk.end", "chunk.tokens", F.col("chunk.text").alias("content")
    )


@query(
    "chunk_positions",
    f"""WITH RECURSIVE {text_chunk_sql('v_ff_docs', 500)}
    SELECT doc_id, idx AS index, count(*) OVER w AS total, idx = 0 AS is_first, idx = max(idx) OVER w AS is_last,
    sha256(doc_id || ':' || idx) AS chunk_id FROM tc WINDOW w AS (PARTITION BY doc_id)""",
)
def chunk_positions(spark, sf_dir):
    rows = chunking.chunk_rows(views.ff_docs(spark, sf_dir), chunking.text_chunks(F.col("text"), 500), "doc_id")
    return rows.select("doc_id", "index", "total", "is_first", "is_last", "chunk_id")


@query(
    "rollup_rounds",
    f"""WITH RECURSIVE {text_chunk_sql('v_ff_docs', 500)}
    SELECT doc_id, idx AS index, total, CASE WHEN total <= 5 THEN 1 ELSE idx // 5 + 1 END AS round_no,
    CASE WHEN total <= 5 THEN 1 ELSE CAST(ceil(total / 5.0) AS BIGINT) END AS rounds
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM tc)""",
)
def rollup_rounds(spark, sf_dir):
    rows = chunking.chunk_rows(views.ff_docs(spark, sf_dir), chunking.text_chunks(F.col("text"), 500), "doc_id")
    return rows.select(
        "doc_id",
        "index",
        "total",
        (F.floor(F.col("index") / fv.ROUND_SIZE) + 1).alias("round_no"),
        F.ceil(F.col("total") / fv.ROUND_SIZE).alias("rounds"),
    )


@query(
    "merge_chunks",
    f"""SELECT doc_id, string_agg(line, {ov.lit(fv.MERGE_SEPARATOR)} ORDER BY page_no, line_no) AS merged FROM v_page_lines
    WHERE {ov.strip('line')} <> '' GROUP BY doc_id""",
)
def merge_chunks(spark, sf_dir):
    lines = views.page_lines(spark, sf_dir).select(
        "doc_id", (F.col("page_no") * 1000 + F.col("line_no")).alias("index"), "line"
    )
    return chunking.merge_rows(lines, "doc_id", "index", "line")


# --- prompts ---------------------------------------------------------------------------------------

_NOTICE = ov.lit(fv.TRUNCATION_NOTICE)
BUDGET = 2000
_ROOM = BUDGET - len(fv.TRUNCATION_NOTICE)
_BOUNDED = f"""parts AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, {ov.paragraphs('text')} AS ps FROM v_para_docs)),
    run AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) + 2 * (i - 1) AS used FROM parts),
    kept AS (SELECT doc_id, i, p FROM run WHERE used <= {_ROOM}
      UNION ALL SELECT doc_id, i, {ov.strip_right(f'substr(p, 1, CAST({_ROOM} - (used - length(p)) AS BIGINT))')} FROM run
      WHERE used > {_ROOM} AND used - length(p) - CASE WHEN i > 1 THEN 2 ELSE 0 END <= {_ROOM} AND {_ROOM} - (used - length(p)) > {fv.PROMPT_MIN_TAIL}),
    bounded AS (SELECT doc_id, length({ov.strip('text')}) > {BUDGET} AS applied, length({ov.strip('text')}) AS original_length,
      CASE WHEN length({ov.strip('text')}) <= {BUDGET} THEN {ov.strip('text')} ELSE {ov.strip_right("coalesce(cut, '')")} || {_NOTICE} END AS body
      FROM v_para_docs LEFT JOIN (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS cut FROM kept GROUP BY doc_id) USING (doc_id))"""


@query("truncate_prompt", f"WITH {_BOUNDED} SELECT doc_id, applied, original_length, length(body) AS final_length, body FROM bounded")
def truncate_prompt(spark, sf_dir):
    bounded = views.para_docs(spark, sf_dir).select("doc_id", templates.bounded_body(F.col("text"), budget=BUDGET).alias("b"))
    return bounded.select("doc_id", "b.applied", "b.original_length", "b.final_length", F.col("b.text").alias("body"))


_ASK = ov.lit(samples.INSTRUCTIONS)


@query(
    "compose_prompt",
    f"""WITH {_BOUNDED} SELECT doc_id, {ov.render(fv.DOCUMENT_PROMPT, instructions=_ASK, name="'Doc ' || doc_id || '.txt'", kind="'txt'", body='body')} AS prompt FROM bounded""",
)
def compose_prompt(spark, sf_dir):
    name = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".txt"))
    bounded = views.para_docs(spark, sf_dir).select("doc_id", templates.bounded_body(F.col("text"), budget=BUDGET).alias("b"))
    return bounded.select("doc_id", templates.document_prompt(F.lit(samples.INSTRUCTIONS), name, F.lit("txt"), F.col("b.text")).alias("prompt"))


_NAME = "'Doc ' || doc_id"
_HEAD = ov.render(fv.ROUND_PROMPT_HEAD, instructions=_ASK, name=_NAME, kind="'txt'", round="idx + 1", rounds="total")


@query(
    "chunk_prompts",
    f"""WITH RECURSIVE {text_chunk_sql('v_ff_docs', 1000)},
    c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, coalesce(lag(content) OVER (PARTITION BY doc_id ORDER BY idx), '') AS previous FROM tc)
    SELECT doc_id, idx AS index, {ov.render(fv.CHUNK_PROMPT, instructions=_ASK, index='idx + 1', total='total')} AS chunk_prompt,
    {ov.render(fv.FINAL_PROMPT, instructions=_ASK, name=_NAME, kind="'txt'", bundle='content')} AS final_prompt,
    {_HEAD} || CASE WHEN idx > 0 AND length(previous) > 0 THEN {ov.render(fv.ROUND_PROMPT_PREVIOUS, previous='previous')} ELSE '' END || {ov.render(fv.ROUND_PROMPT_TAIL, bundle='content')} AS round_prompt
    FROM c""",
)
def chunk_prompts(spark, sf_dir):
    docs = views.ff_docs(spark, sf_dir).select("doc_id", chunking.text_chunks(F.col("text"), 1000).alias("chunks"))
    # the previous chunk is in the same row's array, so no window is needed
    rows = docs.select("doc_id", "chunks", F.size("chunks").alias("total"), F.posexplode("chunks").alias("index", "chunk"))
    ask, name, kind = F.lit(samples.INSTRUCTIONS), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.lit("txt")
    number, body = F.col("index") + 1, F.col("chunk.content")
    previous = F.coalesce(F.get("chunks", F.col("index") - 1)["content"], F.lit(""))
    return rows.select(
        "doc_id",
        "index",
        templates.chunk_instructions(ask, number, F.col("total")).alias("chunk_prompt"),
        templates.final_prompt(ask, name, kind, body).alias("final_prompt"),
        templates.round_prompt(ask, name, kind, body, number, F.col("total"), previous).alias("round_prompt"),
    )


USER_TEMPLATE = "Part {chunk_index} of {total_chunks}: {chunk} [{chunk_index}]"


def _first_only(template: str, place: str, value: str) -> str:
    return f"""(CASE WHEN contains({template}, '{place}') THEN substr({template}, 1, strpos({template}, '{place}') - 1) || {value} ||
      substr({template}, strpos({template}, '{place}') + {len(place)}) ELSE {template} END)"""


_TEMPLATED = f"""filled0 AS (SELECT doc_id, page_no, line_no, line, CAST(line_no + 1 AS VARCHAR) AS k, CAST(page_no AS VARCHAR) AS n,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE {ov.lit(USER_TEMPLATE)} END AS t FROM v_page_lines),
    filled1 AS (SELECT *, {_first_only('t', '{chunk}', 'line')} AS a FROM filled0),
    filled2 AS (SELECT *, {_first_only('a', '{chunk_index}', 'k')} AS b FROM filled1),
    filled3 AS (SELECT *, {_first_only('b', '{total_chunks}', 'n')} AS c FROM filled2)"""


@query(
    "fill_template",
    f"""WITH {_TEMPLATED} SELECT doc_id, page_no, line_no, CASE WHEN t <> '' THEN c WHEN page_no = 1 THEN line
      ELSE {ov.render(fv.PART_PROMPT, index='k', total='n', chunk='line')} END AS prompt FROM filled3""",
)
def fill_template(spark, sf_dir):
    user = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit(USER_TEMPLATE))
    prompt = templates.part_prompt(F.col("line"), F.col("line_no") + 1, F.col("page_no"), user)
    return views.page_lines(spark, sf_dir).select("doc_id", "page_no", "line_no", prompt.alias("prompt"))


@query(
    "degraded_report",
    f"""SELECT doc_id, regexp_replace({ov.render(fv.DEGRADED_HEAD, reason="'HTTP_503: doc ' || doc_id")} || array_to_string(list_transform(string_split(text, chr(10)),
      lambda s, i: '## 分块 ' || i || chr(10) || s || chr(10) || chr(10)), ''), '\\n$', '') AS report FROM documents""",
)
def degraded_report(spark, sf_dir):
    reason = F.concat(F.lit("HTTP_503: doc "), F.col("doc_id").cast("string"))
    return views.documents(spark, sf_dir).select("doc_id", templates.degraded_text(views.lines_of(F.col("text")), reason).alias("report"))


# --- direction answers ------------------------------------------------------------------------------


_LINES = f"""ls AS (SELECT doc_id, list_transform(string_split(answer, chr(10)), lambda l: {ov.strip('l')}) AS ls FROM v_direction_answers),
    vals AS (SELECT doc_id, {', '.join(f"list_transform(list_filter(ls, lambda l: starts_with(l, {ov.lit(lab)})), lambda l: substr(l, {len(lab) + 1})) AS v{k}" for k, lab in enumerate(fv.DIRECTION_LABELS))} FROM ls)"""


def _listed(col: str, cap: int) -> str:
    return f"array_to_string(flatten(list_transform({col}, lambda v: list_transform(string_split(v, ','), lambda s: {ov.strip('s')})))[1:{cap}], '|')"


@query(
    "parse_direction",
    f"""WITH {_LINES} SELECT doc_id, coalesce({ov.strip('v0[-1]')}, {ov.lit(fv.UNKNOWN_DIRECTION)}) AS main, {_listed('v1', 3)} AS subs, {_listed('v2', 5)} AS keywords,
    coalesce(TRY_CAST(regexp_extract(v3[-1], '^\\s*([0-9.]+)', 1) AS DOUBLE), {fv.DEFAULT_CONFIDENCE}) AS confidence FROM vals""",
)
def parse_direction(spark, sf_dir):
    parsed = views.direction_answers(spark, sf_dir).select("doc_id", replies.direction(F.col("answer")).alias("d"))
    return parsed.select(
        "doc_id",
        "d.main",
        F.array_join("d.subs", "|").alias("subs"),
        F.array_join("d.keywords", "|").alias("keywords"),
        "d.confidence",
    )


_LABELS = ", ".join(f"({ov.lit(x)}, {i})" for i, x in enumerate(fv.RESEARCH_DIRECTIONS))


@query(
    "direction_tags",
    f"""WITH labels15 AS (SELECT * FROM (VALUES {_LABELS}) AS l(label, n)),
    texts AS (SELECT doc_id, text || ' ' || {ov.pick('doc_id', fv.RESEARCH_DIRECTIONS)} || {ov.pick('doc_id // 2', fv.RESEARCH_DIRECTIONS)} AS text FROM documents)
    SELECT label AS direction, count(*) AS docs FROM texts JOIN labels15 ON contains(text, label) GROUP BY label""",
)
def direction_tags(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    tagged = F.concat(
        "text",
        F.lit(" "),
        views.pick(F.col("doc_id"), fv.RESEARCH_DIRECTIONS),
        views.pick(F.floor(F.col("doc_id") / 2), fv.RESEARCH_DIRECTIONS),
    )
    return (
        docs.select(F.explode(replies.direction_tags(tagged)).alias("direction"))
        .groupBy("direction")
        .agg(F.count("*").alias("docs"))
    )
