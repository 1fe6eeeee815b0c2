"""The derived inputs once more, as SQL for the oracle engine."""

from __future__ import annotations

import re

from corpusflow import fixed_values as fv
from corpusflow.plans import samples


def lit(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def pick(number: str, values: list) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], CAST(({number}) % {len(values)} AS BIGINT) + 1)"


def strip(expr: str) -> str:
    return f"trim({expr}, {lit(fv.BLANK_CHARS)})"


def strip_right(expr: str) -> str:
    return f"rtrim({expr}, {lit(fv.BLANK_CHARS)})"


def render(template: str, **values: str) -> str:
    """Concatenation of the template's pieces with SQL expressions."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [lit(p) if i % 2 == 0 else f"CAST({values[p]} AS VARCHAR)" for i, p in enumerate(pieces) if i % 2 or p]
    return "(" + " || ".join(parts) + ")"


def tokens(expr: str) -> str:
    """Token estimate of a text expression."""
    han = f"len(regexp_extract_all({expr}, '{fv.HAN_CLASS}'))"
    words = f"len(regexp_extract_all({expr}, '[^{fv.BLANK}]+'))"
    other = f"greatest((length({expr}) - {han} + 3) // 4, CAST(ceil({words} * 0.75) AS BIGINT))"
    return f"CAST(({han} + 1) // 2 + {other} AS BIGINT)"


def paragraphs(expr: str) -> str:
    parts = f"regexp_split_to_array({expr}, '\\n[{fv.BLANK}]*\\n')"
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: length(p) > 0)"


def any_match(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {lit(p)})" for p in patterns) + ")"


def section_heading(expr: str) -> str:
    first = strip(f"regexp_extract({expr}, '^([^\\r\\n]*)', 1)")
    return f"(length({first}) BETWEEN 1 AND {fv.SECTION_HEADING_MAX} AND {any_match(first, fv.SECTION_HEADING_PATTERNS)})"


def likely_heading(expr: str) -> str:
    return f"(length({expr}) <= {fv.LIKELY_HEADING_MAX} AND {any_match(expr, fv.LIKELY_HEADING_PATTERNS)})"


def edge_candidate(expr: str) -> str:
    t = strip(expr)
    return f"(length({t}) BETWEEN 1 AND {fv.EDGE_MAX_CHARS} AND (regexp_matches({t}, '[0-9]') OR {t} = upper({t})))"


def normalize_line(expr: str) -> str:
    one = f"regexp_replace({expr}, '[{fv.BLANK}]+', ' ', 'g')"
    closed = f"regexp_replace({one}, ' ([,.;:!?%)])', '\\1', 'g')"
    return strip(f"regexp_replace({closed}, '\\( ', '(', 'g')")


def clip(expr: str, size: int) -> str:
    return f"CASE WHEN length({expr}) > {size} THEN substr({expr}, 1, {size}) || '...' ELSE {expr} END"


def chunk_summary(expr: str, number: str) -> str:
    return f"({render(fv.CHUNK_HEADER, index=number)} || {clip(strip(expr), fv.SUMMARY_CHARS)})"


def json_text(expr: str) -> str:
    out = expr
    for a, b in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")]:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return f"""('"' || {out} || '"')"""


def handler_code(expr: str) -> str:
    rules = " ".join(f"WHEN contains({expr}, {lit(t)}) THEN {lit(c)}" for t, c in fv.HANDLER_ERROR_RULES)
    return f"CASE {rules} ELSE {lit(fv.UNKNOWN_ERROR[0])} END"


def catalog_values() -> str:
    rows = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in fv.ERROR_CATALOG)
    return f"(VALUES {rows}) AS catalog(code, message, details, suggestion, severity, category, retryable, delay_ms)"


def stub_answer(prompt: str) -> str:
    """What the local stub model says: the first sentence of the prompt's last line."""
    last = f"list_extract(string_split({prompt}, chr(10)), -1)"
    return f"('[stub] ' || string_split({last}, '.')[1])"


def _reply_shape(template: str) -> str:
    parts = []
    for i, piece in enumerate(template.split("@")):
        if i:
            parts.append("n" if piece.startswith("n") else "t")
            piece = piece[1:]
        parts.append(lit(piece))
    return " || ".join(parts)


_JSON_LINE = json_text("x || ' '")
_REPLIES = " ".join(f"WHEN {i} THEN {_reply_shape(s)}" for i, s in enumerate(samples.REPLY_SHAPES))
_MODELS = ", ".join(f"({lit(n)}, {lit(m)}, {p}, {lit(e)})" for n, m, p, e in samples.MODELS)
_MAIN, _SUBS, _KEYS, _CONF = samples.DIRECTION_LABELS

VIEWS: dict[str, str] = {
    "v_events": "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value, props FROM events",
    "v_files": f"""SELECT doc_id, '/corpus/' || source || '\\Doc ' || doc_id || {pick('doc_id', samples.EXTENSIONS)} AS path
        FROM documents""",
    "v_file_names": "SELECT *, regexp_extract(replace(path, '\\', '/'), '[^/]*$') AS name FROM v_files",
    "v_existing_outputs": f"""SELECT '/out/' || regexp_replace(name, '\\.[^.]*$', '') || {lit(fv.OUTPUT_SUFFIX)} AS output_path
        FROM v_file_names WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "v_para_docs": """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
        CASE WHEN (i - 1) % 6 = 0 THEN '## Part ' || ((i - 1) // 6 + 1) || chr(10) || chr(10) || l ELSE l END),
        chr(10) || chr(10)) AS text FROM documents""",
    "v_ff_docs": """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
        CASE WHEN i = 1 THEN l WHEN (i - 1) % 8 = 0 THEN chr(12) || l ELSE chr(10) || l END), '') AS text
        FROM documents""",
    "v_raw_lines": """SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents""",
    "v_page_lines": """SELECT doc_id, n // 8 + 1 AS page_no, n % 8 + 1 AS line_no, line FROM v_raw_lines
        UNION ALL SELECT DISTINCT doc_id, n // 8 + 1, 0, 'JOURNAL ' || source || ' 2024' FROM v_raw_lines
        UNION ALL SELECT doc_id, n // 8 + 1, max(n % 8) + 2, CAST(n // 8 + 1 AS VARCHAR) FROM v_raw_lines GROUP BY ALL""",
    "v_page_words": """SELECT doc_id, page_no, line_no, list_filter(string_split(line, ' '), lambda w: length(w) > 0) AS words
        FROM v_page_lines""",
    "v_page_items": """SELECT doc_id, page_no, line_no * 100000 + k - 1 AS item_no, words[k] AS str, CAST(k - 1 AS DOUBLE) AS x,
        CAST(800 - 12 * line_no + (k - 1) % 3 AS DOUBLE) AS y
        FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM v_page_words)""",
    # lines as the items give them back: words joined by single blanks, then normalised
    "v_clean_lines": f"""SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS line_no, line
        FROM (SELECT doc_id, page_no, line_no, {normalize_line("array_to_string(words, ' ')")} AS line FROM v_page_words)
        WHERE length(line) > 0""",
    "v_edges": f"""SELECT doc_id, line, count(DISTINCT page_no) AS pages FROM (
        SELECT *, max(line_no) OVER (PARTITION BY doc_id, page_no) AS last_no FROM v_clean_lines)
        WHERE (line_no <= 1 OR line_no = last_no) AND {edge_candidate('line')}
        GROUP BY ALL HAVING count(DISTINCT page_no) >= {fv.EDGE_MIN_REPEAT}""",
    "v_body_lines": f"""SELECT doc_id, page_no, line_no, line FROM v_clean_lines l
        WHERE NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.doc_id = l.doc_id AND e.line = l.line)
        AND NOT regexp_matches({strip('line')}, '^[0-9]+$')""",
    "v_paragraph_rows": f"""SELECT doc_id, page_no, g AS paragraph_no,
        {normalize_line("replace(regexp_replace(string_agg(line, chr(1) ORDER BY line_no), '-' || chr(1) || '([A-Za-z])', '\\1', 'g'), chr(1), ' ')")} AS paragraph
        FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS g FROM (
          SELECT *, CASE WHEN prev IS NULL OR {likely_heading('line')} OR regexp_matches(prev, {lit(fv.PARAGRAPH_END_PATTERN)})
            OR {any_match('line', fv.PARAGRAPH_START_PATTERNS)} THEN 1 ELSE 0 END AS opens
          FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS prev FROM v_body_lines)))
        GROUP BY ALL""",
    "v_page_texts": f"""SELECT doc_id, page_no, {render(fv.PAGE_HEADER, page='page_no')} ||
        string_agg(paragraph, chr(10) || chr(10) ORDER BY paragraph_no) AS page_text
        FROM v_paragraph_rows GROUP BY doc_id, page_no""",
    "v_han_docs": f"""SELECT doc_id, 0 AS variant, text FROM documents
        UNION ALL SELECT doc_id, 1, translate(text, {lit(samples.HAN_FROM)}, {lit(samples.HAN_TO)}) FROM documents""",
    "v_section_docs": """SELECT doc_id, array_to_string(list_transform(ls, lambda l, i:
        CASE WHEN i = 1 THEN 'Abstract: ' || l WHEN i - 1 = len(ls) // 3 THEN chr(10) || 'Introduction ' || l
        WHEN i - 1 = 2 * (len(ls) // 3) THEN chr(10) || 'Keywords: ' || l ELSE l END), chr(10)) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""",
    "v_direction_answers": f"""SELECT doc_id, {lit(_MAIN)} || ws[1] || chr(10) || {lit(_SUBS)} ||
        array_to_string(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')[1]), ', ') || chr(10) ||
        {lit(_KEYS)} || array_to_string(ws, ',') || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE {lit(_CONF)} || '0.' ||
        lpad(CAST(n_chars % 100 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 3 = 0 THEN ' (high)' ELSE '' END END AS answer
        FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: length(w) > 0) AS ws FROM documents)""",
    "v_job_items": f"""SELECT user_id AS job_id, event_id AS item_id, 'Doc ' || event_id || '.txt' AS name, status, skipped,
        CAST(CASE WHEN skipped OR status = 'pending' THEN 0 ELSE event_id % 3 + 1 END AS BIGINT) AS attempts,
        CASE WHEN status = 'success' THEN '/out/Doc ' || event_id || '_解读.md' END AS output_path,
        CASE status WHEN 'failed' THEN {pick('event_id', ['AUTH_FAILED', 'ENDPOINT_NOT_FOUND', 'RATE_LIMITED', 'UNKNOWN'])}
          WHEN 'cancelled' THEN 'CANCELLED' END AS error_code,
        CASE status WHEN 'failed' THEN 'HTTP_' || {pick('event_id', [401, 404, 429, 503])} WHEN 'cancelled' THEN '任务已取消' END AS error_message,
        value > 20 AS chunking_enabled, CAST(floor(value) AS BIGINT) AS chunk_count,
        value > 20 AND event_id % 4 = 0 AS degraded,
        CASE WHEN value > 20 AND event_id % 8 = 0 THEN 'HTTP_503' END AS degrade_reason, ts_ms, value
        FROM (SELECT *, event_type = 'click' AS skipped, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'success'
          WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'pending' END AS status FROM v_events)""",
    "v_attempts": f"""SELECT item_id, attempt, CASE WHEN attempt = attempts THEN status ELSE 'failed' END AS status,
        CASE WHEN attempt < attempts THEN 'HTTP_' || {pick('item_id + attempt', [429, 503, 408, 504])}
          WHEN status <> 'success' THEN error_message END AS message
        FROM (SELECT *, unnest(range(1, attempts + 1)) AS attempt FROM v_job_items WHERE NOT skipped AND attempts > 0)""",
    "v_models": f"SELECT * FROM (VALUES {_MODELS}) AS m(name, model, priority, enabled)",
    "v_model_attempts": f"""SELECT doc_id, name AS model, CAST(priority AS BIGINT) AS priority, (doc_id * 7 + priority * 3) % 4 = 0 AS ok,
        CASE WHEN (doc_id * 7 + priority * 3) % 4 = 0 THEN 'answer ' || n_chars || ' by ' || model END AS content,
        CASE WHEN (doc_id * 7 + priority * 3) % 4 <> 0 THEN 'HTTP_' || {pick('doc_id + priority', [429, 503, 404])} END AS error
        FROM documents, v_models WHERE enabled""",
    "v_error_events": f"""SELECT event_id, ts_ms, user_id, {pick('event_id', samples.ERROR_MESSAGES)} || ' #' || event_id AS message
        FROM v_events""",
    "v_catalog": f"SELECT * FROM {catalog_values()}",
    "v_coded_errors": f"SELECT *, {handler_code('message')} AS code FROM v_error_events",
    "v_error_stats": """SELECT e.code, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, any_value(c.category) AS category,
        arg_max(e.message, (ts_ms, event_id)) AS last_message
        FROM v_coded_errors e LEFT JOIN v_catalog c ON e.code = c.code GROUP BY e.code""",
    "v_metrics": f"""SELECT event_id AS metric_id, CASE WHEN event_id % 5 = 0 THEN 'memory_used' ELSE event_type END AS name, value,
        CASE WHEN event_id % 5 = 0 THEN 'MB' ELSE 'ms' END AS unit, ts_ms, {pick('user_id', ['model', 'parser', 'system'])} AS category
        FROM v_events""",
    "v_spans": """SELECT event_id // 2 AS span_id, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS mark, ts_ms,
        event_type AS name FROM v_events WHERE event_type <> 'view'""",
    "v_logs": f"""SELECT event_id AS log_id, ts_ms, {pick('event_id', ['debug', 'info', 'warn', 'error'])} AS level,
        CASE WHEN event_id % 3 > 0 THEN event_type END AS category,
        {pick('user_id', ['step done: ', 'call failed: ', 'warning: '])} || event_type || ' of user ' || user_id AS message,
        CASE WHEN event_id % 2 = 0 THEN props END AS metadata FROM v_events""",
    "v_cache_log": f"""SELECT event_id, 'key-' || user_id || '-' || event_type AS key, {pick('user_id', samples.CACHE_MODELS)} AS model, ts_ms,
        CASE event_type WHEN 'error' THEN 'miss' WHEN 'signup' THEN 'evict' ELSE 'hit' END AS outcome, value AS access_ms, props
        FROM v_events""",
    "v_cache_entries": """SELECT key, model, min(ts_ms) AS written_ms, max(ts_ms) AS last_access_ms, count(*) AS access_count,
        min(props) AS text, max(props) AS result FROM v_cache_log GROUP BY key, model""",
    "v_raw_replies": f"""SELECT conv_id, turn, CASE (conv_id + turn) % {len(samples.REPLY_SHAPES)} {_REPLIES} END AS raw
        FROM (SELECT *, {json_text('text')} AS t, CAST(length(text) AS VARCHAR) AS n FROM conversations)""",
    "v_sse_arrays": f"""SELECT conv_id * 1000 + turn AS call_id, list_concat(
        list_transform(string_split(text, chr(10)), lambda x: 'data: {{"choices":[{{"delta":{{"content":' || {_JSON_LINE} || '}}}}]}}'),
        ['data: {{broken', 'data: {{"choices":[],"usage":{{"prompt_tokens":' || length(text) || ',"completion_tokens":2,"total_tokens":' || length(text) || '}}}}',
         'data: {{"choices":[],"usage":{{"prompt_tokens":9,"completion_tokens":9,"total_tokens":9}}}}', ': comment', 'data: [DONE]']) AS ls
        FROM conversations""",
    "v_sse_lines": """SELECT call_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM v_sse_arrays""",
    "v_sse_event_arrays": f"""SELECT conv_id * 1000 + turn AS call_id, list_concat(
        ['event: message_start', 'data: {{"message":{{"usage":{{"input_tokens":' || length(text) || ',"output_tokens":0}}}}}}', 'event: content_block_delta'],
        list_transform(string_split(text, chr(10)), lambda x: 'data: {{"delta":{{"text":' || {_JSON_LINE} || '}}}}'),
        ['data: {{broken', 'event: message_delta', 'data: {{"usage":{{"input_tokens":' || length(text) || ',"output_tokens":' ||
         len(string_split(text, chr(10))) || '}}}}', 'event: message_stop', 'data: {{"delta":{{"text":"ignored"}}}}']) AS ls
        FROM conversations""",
    "v_sse_event_lines": "SELECT call_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM v_sse_event_arrays",
    "v_endpoints": f"""SELECT page_id, CASE WHEN page_id % 11 = 10 THEN 'not a url' ELSE
        CASE WHEN page_id % 4 = 1 THEN '  ' ELSE '' END || regexp_extract(url, '^(https?://[^/?#]+)', 1) || {pick('page_id', samples.ENDPOINT_PATHS)}
        END AS endpoint, CASE WHEN page_id % 9 = 8 THEN 'manual' ELSE 'auto' END AS mode FROM pages""",
    "v_bib_items": """SELECT item_id, CASE WHEN item_id % 10 = 9 THEN '' ELSE array_to_string(ws, ' ') END AS title,
        ws[1:item_id % 3 + 1] AS authors,
        CASE WHEN item_id % 4 = 0 THEN '/bib/' || item_id || '.pdf' END AS file_path,
        CASE WHEN item_id % 4 <> 2 THEN 'https://bib.example.org/' || item_id END AS url
        FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: length(w) > 0) AS ws FROM benchmark)""",
    "v_bib_membership": "SELECT item_id, item_id % 3 AS collection_id FROM benchmark",
    "v_templates": """SELECT 'tpl-' || item_id AS id, 'template ' || item_id AS name, text AS content, item_id AS position
        FROM benchmark""",
}

_NAME = re.compile(r"\bv_\w+\b")


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it needs, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[len('WITH '):]}"
    return f"WITH {views}\n{body}"
