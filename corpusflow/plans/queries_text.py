"""Catalogue: scalar columns over documents, endpoints and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions import errors, keys, labels, models, text, urls
from corpusflow.plans import oracle_views as ov
from corpusflow.plans import samples, views
from corpusflow.plans.registry import query


@query("token_estimate", f"SELECT doc_id, variant, {ov.tokens('text')} AS tokens FROM v_han_docs")
def token_estimate(spark, sf_dir):
    return views.han_docs(spark, sf_dir).select(
        "doc_id", "variant", text.token_estimate(F.col("text")).alias("tokens")
    )


@query(
    "max_text_len",
    f"""SELECT doc_id, variant, CAST(CASE WHEN t > 0 THEN floor(500 * (CAST(n AS DOUBLE) / t)) ELSE 2000 END AS BIGINT) AS max_chars
    FROM (SELECT doc_id, variant, length(text) AS n, {ov.tokens('text')} AS t FROM v_han_docs)""",
)
def max_text_len(spark, sf_dir):
    return views.han_docs(spark, sf_dir).select(
        "doc_id", "variant", text.max_text_length(F.lit(500), F.col("text")).alias("max_chars")
    )


@query(
    "should_chunk",
    """SELECT doc_id, (length(text) + 3) // 4 AS coarse_tokens, (length(text) + 3) // 4 > 0.75 * 8000 AS default_size,
    (length(text) + 3) // 4 > 0.75 * 1000 AS small_size FROM documents""",
)
def should_chunk(spark, sf_dir):
    t = F.col("text")
    return views.documents(spark, sf_dir).select(
        "doc_id",
        text.coarse_tokens(t).alias("coarse_tokens"),
        text.needs_chunking(t).alias("default_size"),
        text.needs_chunking(t, 1000).alias("small_size"),
    )


_FAMILY = """CASE WHEN model = '' THEN 8192 WHEN regexp_matches(lower(model), 'gpt-4o|gemini-1\\.5|claude-3') THEN 4096
    WHEN regexp_matches(lower(model), 'gpt-4|kimi-2\\.5') THEN 2048 ELSE 1024 END"""


def _modelled(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.withColumn("model", views.pick(F.col("doc_id"), samples.MODEL_NAMES)).withColumn(
        "given", F.when(F.col("doc_id") % 7 == 0, 300).otherwise(0)
    )


@query(
    "chunk_count",
    f"""SELECT doc_id, CAST(lim AS BIGINT) AS chunk_tokens, CAST(ceil(CAST(t AS DOUBLE) / least(lim, 1500)) AS BIGINT) AS chunks
    FROM (SELECT doc_id, {ov.tokens('text')} AS t, CASE WHEN doc_id % 7 = 0 THEN 300 ELSE {_FAMILY} END AS lim
      FROM (SELECT *, {ov.pick('doc_id', samples.MODEL_NAMES)} AS model FROM documents))""",
)
def chunk_count(spark, sf_dir):
    m, g = F.col("model"), F.col("given")
    return _modelled(spark, sf_dir).select(
        "doc_id",
        models.adjusted_chunk_tokens(m, g).cast("bigint").alias("chunk_tokens"),
        models.chunk_count(F.col("text"), m, g).alias("chunks"),
    )


@query(
    "model_limits",
    f"""SELECT doc_id, model, CAST(coalesce(l.tokens, 8192) AS BIGINT) AS token_limit
    FROM (SELECT doc_id, {ov.pick('doc_id', samples.MODEL_NAMES)} AS model FROM documents) d
    LEFT JOIN (VALUES {', '.join(f"({ov.lit(m)}, {n})" for m, n in fv.MODEL_TOKEN_LIMITS)}) AS l(name, tokens)
    ON lower(d.model) = l.name""",
)
def model_limits(spark, sf_dir):
    # twelve fixed rows live in the expression itself: nothing to join or broadcast
    return _modelled(spark, sf_dir).select(
        "doc_id", "model", models.model_token_limit(F.col("model")).cast("bigint").alias("token_limit")
    )


@query(
    "call_params",
    """SELECT doc_id, model, CASE WHEN doc_id % 7 = 0 THEN 2.7 WHEN contains(m, 'gpt-4') THEN 0.7 WHEN contains(m, 'gpt-3.5') THEN 0.8
      WHEN contains(m, 'claude') THEN 0.6 ELSE 0.7 END::DOUBLE AS temperature,
    CAST(CASE WHEN doc_id % 7 = 0 THEN 300 WHEN contains(m, 'gpt-4') THEN 2048 WHEN contains(m, 'gpt-3.5') THEN 1024
      WHEN contains(m, 'claude') OR contains(m, 'kimi') THEN 1500 ELSE 1024 END AS BIGINT) AS max_tokens,
    CASE WHEN contains(m, 'claude') OR contains(m, 'kimi') THEN 0.9 WHEN contains(m, 'gpt') THEN 0.95 END::DOUBLE AS top_p,
    least(2.0, CASE WHEN doc_id % 7 = 0 THEN 2.7 ELSE 0.7 END)::DOUBLE AS clamped_temperature,
    CAST(least(4096, greatest(1, n_chars)) AS BIGINT) AS clamped_tokens
    FROM (SELECT *, lower(model) AS m FROM (SELECT *, """
    + ov.pick("doc_id", samples.MODEL_NAMES)
    + " AS model FROM documents))",
)
def call_params(spark, sf_dir):
    m = F.col("model")
    given = F.when(F.col("given") > 0, F.lit(2.7))
    return _modelled(spark, sf_dir).select(
        "doc_id",
        "model",
        models.call_temperature(m, given).alias("temperature"),
        models.call_max_tokens(m, F.col("given")).cast("bigint").alias("max_tokens"),
        models.call_top_p(m).alias("top_p"),
        models.clamp(F.coalesce(given, F.lit(0.7)), fv.TEMPERATURE_RANGE).alias("clamped_temperature"),
        models.clamp(F.col("n_chars"), fv.MAX_TOKENS_RANGE).cast("bigint").alias("clamped_tokens"),
    )


@query(
    "text_counts",
    f"""SELECT doc_id, variant, length(text) AS chars, CAST(len(regexp_extract_all(text, '[^{fv.BLANK}]+')) AS BIGINT) AS words
    FROM v_han_docs""",
)
def text_counts(spark, sf_dir):
    t = F.col("text")
    return views.han_docs(spark, sf_dir).select(
        "doc_id",
        "variant",
        F.length(t).cast("bigint").alias("chars"),
        text.word_count(t).cast("bigint").alias("words"),
    )


# the hash is a fold over characters: lists keep the oracle free of recursion
@query(
    "chunk_key",
    """WITH h AS (SELECT conv_id, turn, text, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
      lambda a, b: (a * 31 + b) % 4294967296) AS u FROM conversations),
    s AS (SELECT *, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM h)
    SELECT conv_id, turn, h AS rolling_hash, 'gpt-4o:' || CASE WHEN h < 0 THEN '-' ELSE '' END || lower(to_base(abs(h), 36)) AS short_key,
    lower(to_base(abs(h), 16)) AS hex_hash, sha256(text) AS content_key FROM s""",
)
def chunk_key(spark, sf_dir):
    t = F.col("text")
    return views.turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        keys.rolling_hash(t).alias("rolling_hash"),
        keys.short_key(t, F.lit("gpt-4o")).alias("short_key"),
        keys.hex_hash(t).alias("hex_hash"),
        keys.content_key(t).alias("content_key"),
    )


@query(
    "request_key",
    f"""WITH d AS (SELECT doc_id, text, {ov.pick('doc_id', samples.MODEL_NAMES)} AS model,
      CASE WHEN doc_id % 2 = 0 THEN '0.3' ELSE '0.7' END AS temp, CASE WHEN doc_id % 3 = 0 THEN '2048' ELSE '1000' END AS toks FROM documents)
    SELECT doc_id, model || '|https://api.example.com|' || sha256(text) || '|' || temp || '|' || toks AS request_key,
    model || '|https://api.example.com|' || substr(text, 1, 100) || '|' || temp || '|' || toks AS prefix_key FROM d""",
)
def request_key(spark, sf_dir):
    parts = (
        F.col("model"),
        F.lit("https://api.example.com"),
        F.col("text"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(0.3)),
        F.when(F.col("doc_id") % 3 == 0, F.lit(2048)),
    )
    return _modelled(spark, sf_dir).select(
        "doc_id",
        keys.request_key(*parts).alias("request_key"),
        keys.request_key(*parts, prefix_only=True).alias("prefix_key"),
    )


@query(
    "output_path",
    f"""SELECT doc_id, name, '/out/x/' || {ov.strip(f"regexp_replace(regexp_replace(title, '(?s)^(.+)[.][^.]*$', '{chr(92)}1'), '[<>:{chr(34)}/{chr(92)}{chr(92)}|?*{chr(92)}x00-{chr(92)}x1F]', '_', 'g')")}
      || {ov.lit(fv.OUTPUT_SUFFIX)} AS titled_path,
    '/out/x/' || regexp_replace(name, '[.][^.]*$', '') || {ov.lit(fv.OUTPUT_SUFFIX)} AS output_path
    FROM (SELECT f.*, text AS title FROM v_file_names f JOIN documents d USING (doc_id))""",
)
def output_path(spark, sf_dir):
    """Output names from file names, and from whole texts as titles, which holds unsafe characters."""
    ext = views.pick(F.col("doc_id"), samples.EXTENSIONS)
    path = F.concat(F.lit("/corpus/"), "source", F.lit("\\Doc "), F.col("doc_id").cast("string"), ext)
    name = keys.base_name(path)
    return views.documents(spark, sf_dir).select(
        "doc_id",
        name.alias("name"),
        keys.join_path(F.lit("/out/x\\/"), keys.output_name(F.col("text"))).alias("titled_path"),
        keys.join_path(F.lit("/out/x\\/"), keys.output_name(name)).alias("output_path"),
    )


@query(
    "infer_kind",
    """SELECT doc_id, name, CASE lower(regexp_extract(name, '[.]([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'md' WHEN 'txt' THEN 'txt' END AS kind
    FROM v_file_names""",
)
def infer_kind(spark, sf_dir):
    return views.file_names(spark, sf_dir).select("doc_id", "name", keys.file_kind(F.col("name")).alias("kind"))


@query(
    "valid_inputs",
    f"""SELECT page_id, length({ov.strip('endpoint')}) > 0 AS non_empty, regexp_matches(endpoint, '^ *https?://[^/]') AS valid_url
    FROM v_endpoints""",
)
def valid_inputs(spark, sf_dir):
    e = F.col("endpoint")
    return views.endpoints(spark, sf_dir).select(
        "page_id", urls.is_non_empty(e).alias("non_empty"), urls.is_url(e).alias("valid_url")
    )


@query(
    "normalize_endpoint",
    """WITH e AS (SELECT *, trim(endpoint) AS t, regexp_extract(trim(endpoint), '^(https?://[^/?#]+)', 1) AS head,
      regexp_replace(regexp_extract(trim(endpoint), '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS p,
      regexp_extract(trim(endpoint), '^https?://[^?#]+(.*)$', 1) AS rest FROM v_endpoints)
    SELECT page_id, CASE WHEN mode = 'manual' OR t = 'not a url' THEN t WHEN p = '' THEN head || '/v1/chat/completions' || rest
      WHEN regexp_matches(p, '(?i)/completions$') THEN head || p || rest ELSE head || p || '/chat/completions' || rest END AS chat_endpoint,
    CASE WHEN regexp_matches(b, '/messages$') THEN b WHEN regexp_matches(b, '(?i)/v[0-9]+$') THEN b || '/messages' ELSE b || '/v1/messages' END AS messages_endpoint
    FROM (SELECT *, regexp_replace(t, '/+$', '') AS b FROM e)""",
)
def normalize_endpoint(spark, sf_dir):
    e = F.col("endpoint")
    return views.endpoints(spark, sf_dir).select(
        "page_id",
        urls.chat_endpoint(e, F.col("mode")).alias("chat_endpoint"),
        urls.messages_endpoint(text.strip(e)).alias("messages_endpoint"),
    )


@query(
    "endpoint_summary",
    """SELECT page_id, CASE WHEN t = 'not a url' THEN 'invalid-endpoint' ELSE regexp_extract(t, '^(https?://[^/?#]+)', 1) ||
      coalesce(nullif(regexp_extract(t, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') END AS summary
    FROM (SELECT page_id, trim(endpoint) AS t FROM v_endpoints)""",
)
def endpoint_summary(spark, sf_dir):
    return views.endpoints(spark, sf_dir).select(
        "page_id", urls.endpoint_summary(text.strip(F.col("endpoint"))).alias("summary")
    )


@query(
    "sniff_payload",
    """WITH p AS (SELECT page_id AS id, 'page' AS origin, html AS body FROM pages
      UNION ALL SELECT conv_id * 1000 + turn, 'reply', raw FROM v_raw_replies
      UNION ALL SELECT call_id * 10000 + line_no, 'line', line FROM v_sse_lines)
    SELECT id, origin, CASE WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'html' WHEN starts_with(h, 'data:') THEN 'sse' ELSE 'other' END AS payload
    FROM (SELECT id, origin, lower(substr(ltrim(body), 1, 200)) AS h FROM p)""",
)
def sniff_payload(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("origin"), F.col("html").alias("body"))
    replies = views.raw_replies(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("reply").alias("origin"), F.col("raw").alias("body"))
    lines = views.sse_lines(spark, sf_dir).select((F.col("call_id") * 10000 + F.col("line_no")).alias("id"), F.lit("line").alias("origin"), F.col("line").alias("body"))
    return pages.unionByName(replies).unionByName(lines).select("id", "origin", urls.sniff_payload(F.col("body")).alias("payload"))


_RUN = " ".join(
    f"WHEN {' OR '.join(f'contains(message, {ov.lit(t)})' for t in texts)} THEN {{{i}}}"
    for i, (_, texts, _) in enumerate(fv.RUN_ERROR_RULES)
)
_CANCEL = " OR ".join(f"contains(lower(message), {ov.lit(m)})" for m in fv.CANCEL_MARKS)


@query(
    "classify_run_error",
    f"""SELECT event_id, CASE WHEN {_CANCEL} THEN 'CANCELLED' {_RUN.format(*[ov.lit(c) for c, _, _ in fv.RUN_ERROR_RULES])} ELSE 'UNKNOWN' END AS run_code,
    CASE WHEN {_CANCEL} THEN {ov.lit(fv.CANCELLED_TEXT)} {_RUN.format(*[ov.lit(m) if m else 'message' for _, _, m in fv.RUN_ERROR_RULES])} ELSE message END AS run_message
    FROM v_error_events""",
)
def classify_run_error(spark, sf_dir):
    return (
        views.error_events(spark, sf_dir)
        .select("event_id", errors.run_error(F.col("message")).alias("e"))
        .select("event_id", F.col("e.code").alias("run_code"), F.col("e.message").alias("run_message"))
    )


@query("classify_error", "SELECT event_id, code FROM v_coded_errors")
def classify_error(spark, sf_dir):
    return views.error_events(spark, sf_dir).select("event_id", errors.handler_error_code(F.col("message")).alias("code"))


@query(
    "retry_schedule",
    """WITH s AS (SELECT event_id, CAST(event_id % 3 + 1 AS BIGINT) AS attempt, """
    + ov.pick("event_id", [401, 403, 404, 429, 500, 503])
    + """ AS status FROM events)
    SELECT event_id, status, attempt, attempt < 3 AND status NOT IN (401, 403, 404) AS retried,
    CASE WHEN attempt < 3 AND status NOT IN (401, 403, 404) THEN CAST(least(2000 * 2 ** attempt, 10000) AS BIGINT) END AS delay_ms FROM s""",
)
def retry_schedule(spark, sf_dir):
    status = views.pick(F.col("event_id"), [401, 403, 404, 429, 500, 503])
    attempt = F.col("event_id") % 3 + 1
    retried = models.retry_allowed(status, attempt)
    return views.events(spark, sf_dir).select(
        "event_id",
        status.alias("status"),
        attempt.alias("attempt"),
        retried.alias("retried"),
        F.when(retried, models.retry_delay(attempt)).alias("delay_ms"),
    )


@query("normalize_lines", f"SELECT doc_id, {ov.normalize_line('text')} AS line FROM v_han_docs WHERE variant = 1")
def normalize_lines(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select(
        "doc_id",
        text.normalize_line(F.translate("text", samples.HAN_FROM, samples.HAN_TO)).alias("line"),
    )


@query("drop_page_numbers", "SELECT doc_id, page_no, line_no, line FROM v_page_lines WHERE NOT regexp_matches(trim(line), '^[0-9]+$')")
def drop_page_numbers(spark, sf_dir):
    return views.page_lines(spark, sf_dir).filter(~text.is_page_number(F.col("line")))


@query(
    "section_headings",
    f"""SELECT doc_id, page_no, line_no, {ov.section_heading('line')} AS section_heading, {ov.likely_heading('line')} AS likely_heading,
    {ov.edge_candidate('line')} AS edge_candidate FROM v_page_lines""",
)
def section_headings(spark, sf_dir):
    c = F.col("line")
    return views.page_lines(spark, sf_dir).select(
        "doc_id",
        "page_no",
        "line_no",
        text.is_section_heading(c).alias("section_heading"),
        text.is_likely_heading(c).alias("likely_heading"),
        text.is_edge_candidate(c).alias("edge_candidate"),
    )


_MARKS = ", ".join(ov.lit(m) for m in samples.HEADING_MARKS)


@query(
    "heading_marks",
    f"""WITH lines AS (SELECT doc_id, mark_no, whole, marks[mark_no] || CASE WHEN whole THEN text ELSE '' END AS line
      FROM (SELECT doc_id, coalesce(text, '') AS text, [{_MARKS}] AS marks FROM documents), range(1, {len(samples.HEADING_MARKS) + 1}) AS r(mark_no), (VALUES (true), (false)) AS w(whole))
    SELECT doc_id, mark_no, whole, {ov.section_heading('line')} AS section_heading, {ov.likely_heading('line')} AS likely_heading FROM lines""",
)
def heading_marks(spark, sf_dir):
    """Headings of lines that open with marks beside Chinese text and wide blanks: the mark alone, and before each document's text."""
    marks = F.posexplode(F.array(*[F.lit(m) for m in samples.HEADING_MARKS])).alias("pos", "mark")
    rows = views.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), marks)
    lines = rows.select("doc_id", (F.col("pos") + 1).alias("mark_no"), "text", "mark", F.explode(F.array(F.lit(True), F.lit(False))).alias("whole"))
    line = F.concat("mark", F.when(F.col("whole"), F.col("text")).otherwise(""))
    return lines.select(
        "doc_id", "mark_no", "whole", text.is_section_heading(line).alias("section_heading"), text.is_likely_heading(line).alias("likely_heading")
    )


def _section_sql(names: str, stops: list[str]) -> str:
    stop = "|".join(["\\n\\s*\\n"] + [f"\\n\\s*{s}" for s in stops] + ["$"])
    found = f"regexp_matches(text, '(?i)({names})[\\s:]')"
    return f"CASE WHEN {found} THEN {ov.strip(f'regexp_extract(text, {ov.lit(f"(?is)({names})[{chr(92)}s:]+(.*?)(?:{stop})")}, 2)')} END"


@query(
    "extract_sections",
    f"""SELECT doc_id, {_section_sql('abstract', ['introduction', '背景', '引言'])} AS abstract,
    {_section_sql('introduction|背景|引言', ['methods', '方法', '实验'])} AS introduction,
    {_section_sql('keywords|关键词', ['abstract'])} AS keywords FROM v_section_docs""",
)
def extract_sections(spark, sf_dir):
    t = F.col("text")
    return views.section_docs(spark, sf_dir).select(
        "doc_id",
        text.abstract_section(t).alias("abstract"),
        text.introduction_section(t).alias("introduction"),
        text.keywords_section(t).alias("keywords"),
    )


@query(
    "trim_summaries",
    f"""WITH s AS (SELECT doc_id, text, {ov.chunk_summary('text', 'doc_id')} AS summary FROM documents)
    SELECT doc_id, summary, {ov.render(fv.CHUNK_HEADER, index='doc_id')} || {ov.clip(ov.strip(f"regexp_replace(summary, {ov.lit(fv.CHUNK_HEADER_PATTERN)}, '')"), fv.SHRUNK_SUMMARY_CHARS)} AS shrunk,
    {ov.clip(ov.strip('text'), fv.PREVIEW_CHARS)} AS preview FROM s""",
)
def trim_summaries(spark, sf_dir):
    t, n = F.col("text"), F.col("doc_id")
    return views.documents(spark, sf_dir).select("doc_id", "text", text.chunk_summary(t, n).alias("summary")).select(
        "doc_id",
        "summary",
        text.shrunk_summary(F.col("summary"), n).alias("shrunk"),
        text.preview(t).alias("preview"),
    )


@query(
    "format_duration",
    """SELECT event_id, CASE WHEN s IS NULL THEN NULL WHEN d < 1000 THEN d || 'ms' WHEN d < 60000 THEN ((d + 50) // 100) // 10 || '.' || ((d + 50) // 100) % 10 || 's'
      ELSE d // 60000 || 'm ' || (d % 60000) // 1000 || 's' END AS duration
    FROM (SELECT event_id, s, greatest(0, coalesce(e, s + 90000) - s) AS d FROM (
      SELECT event_id, CASE WHEN event_id % 13 > 0 THEN ts_ms END AS s,
        CASE WHEN event_id % 5 > 0 THEN ts_ms + CAST(floor(value * value * 10) AS BIGINT) - 200 END AS e FROM v_events))""",
)
def format_duration(spark, sf_dir):
    start = F.when(F.col("event_id") % 13 > 0, F.col("ts_ms"))
    end = F.when(F.col("event_id") % 5 > 0, F.col("ts_ms") + F.floor(F.col("value") * F.col("value") * 10) - 200)
    return views.events(spark, sf_dir).select(
        "event_id", labels.duration_label(start, end, F.col("ts_ms") + 90000).alias("duration")
    )
