"""Catalogue: registries, caches, jobs, errors, metrics, spans and logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions import labels
from corpusflow.functions.errors import handler_error_code
from corpusflow.functions.keys import content_key, join_path, output_name
from corpusflow.functions.models import enabled_by_priority
from corpusflow.operators import cache, chunking, jobs, observability, tables
from corpusflow.plans import oracle_views as ov
from corpusflow.plans import samples, views
from corpusflow.plans.queries_corpus import text_chunk_sql
from corpusflow.plans.registry import query
from corpusflow.sources import bibliography, files, reports

# --- files and bibliography -------------------------------------------------------------


@query(
    "route_by_kind",
    """SELECT doc_id, name, CASE lower(regexp_extract(name, '[.]([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'md' WHEN 'txt' THEN 'txt' END AS kind,
    CASE WHEN lower(regexp_extract(name, '[.]([^.]*)$', 1)) NOT IN ('pdf', 'md', 'txt') THEN 'UNSUPPORTED_TYPE' END AS error FROM v_file_names""",
)
def route_by_kind(spark, sf_dir):
    return files.route_by_kind(views.file_names(spark, sf_dir)).select("doc_id", "name", "kind", "error")


@query(
    "files_by_kind",
    """SELECT CASE lower(regexp_extract(name, '[.]([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'md' WHEN 'txt' THEN 'txt' END AS kind, count(*) AS files
    FROM v_file_names GROUP BY 1""",
)
def files_by_kind(spark, sf_dir):
    return files.files_by_kind(files.route_by_kind(views.file_names(spark, sf_dir)))


@query(
    "bib_by_collection",
    """SELECT item_id, title, array_to_string(authors, '; ') AS authors, file_path, url FROM v_bib_items
    WHERE item_id IN (SELECT item_id FROM v_bib_membership WHERE collection_id = 1)""",
)
def bib_by_collection(spark, sf_dir):
    found = bibliography.items_by_collection(views.bib_items(spark, sf_dir), views.bib_membership(spark, sf_dir), F.lit(1))
    return found.withColumn("authors", F.array_join("authors", "; "))


@query(
    "bib_to_files",
    """SELECT 'zotero-' || item_id AS id, CASE WHEN title = '' THEN 'Zotero Item ' || (item_id + 1) ELSE title END AS name,
    coalesce(file_path, url, '') AS path, 'pdf' AS ext FROM v_bib_items""",
)
def bib_to_files(spark, sf_dir):
    return bibliography.items_to_files(views.bib_items(spark, sf_dir), F.col("item_id"))


# --- registries -------------------------------------------------------------------------------


@query(
    "registry_upsert",
    """WITH changes AS (SELECT id, name || ' v2' AS name, reverse(content) AS content, position FROM v_templates WHERE position % 5 = 0
      UNION ALL SELECT 'doc-' || doc_id, 'from document', text, doc_id FROM documents),
    merged AS (SELECT * FROM v_templates WHERE id NOT IN (SELECT id FROM changes) UNION ALL SELECT * FROM changes)
    SELECT id, name, content, position FROM merged WHERE id NOT IN (SELECT 'doc-' || doc_id FROM labels WHERE toxic = 1)""",
)
def registry_upsert(spark, sf_dir):
    current = views.templates(spark, sf_dir)
    changed = current.filter(F.col("position") % 5 == 0).select(
        "id", F.concat("name", F.lit(" v2")).alias("name"), F.reverse("content").alias("content"), "position"
    )
    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id")
    created = views.documents(spark, sf_dir).select(
        key, F.lit("from document").alias("name"), F.col("text").alias("content"), F.col("doc_id").alias("position")
    )
    deleted = views.table(spark, sf_dir, "labels").filter("toxic = 1").select(key)
    return tables.upsert(current, changed.unionByName(created), "id", deleted)


@query(
    "registry_create",
    """SELECT id, position FROM v_templates UNION ALL
    SELECT 'doc-' || doc_id, doc_id + (SELECT min(position) FROM v_templates) - (SELECT max(doc_id) FROM documents) - 1 FROM documents""",
)
def registry_create(spark, sf_dir):
    current = views.templates(spark, sf_dir).select("id", "position")
    created = views.documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("position")
    )
    return tables.prepend(current, created, "position")


@query(
    "registry_reorder",
    """SELECT t.id, t.name, r.priority FROM v_templates t JOIN (SELECT 'tpl-' || doc_id AS id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS priority
      FROM (SELECT DISTINCT doc_id FROM labels)) r USING (id)""",
)
def registry_reorder(spark, sf_dir):
    """The listed order is the label table's documents from the highest id down."""
    listed = views.table(spark, sf_dir, "labels").select("doc_id").distinct()
    ranked = tables.global_rank(listed, [F.col("doc_id").desc()], "rank").select(
        F.concat(F.lit("tpl-"), F.col("doc_id").cast("string")).alias("id"), (F.col("rank") - 1).alias("priority")
    )
    current = views.templates(spark, sf_dir).select("id", "name", F.col("position").alias("priority"))
    return tables.reorder(current, ranked, "id", "priority")


@query(
    "template_join",
    """SELECT e.event_id, t.name AS template_name FROM events e LEFT JOIN v_templates t ON t.id = 'tpl-' || e.user_id""",
)
def template_join(spark, sf_dir):
    runs = views.events(spark, sf_dir).select(
        "event_id", F.concat(F.lit("tpl-"), F.col("user_id").cast("string")).alias("id")
    )
    names = views.templates(spark, sf_dir).select("id", F.col("name").alias("template_name"))
    return runs.join(names, "id", "left").select("event_id", "template_name")


@query("enabled_models", "SELECT doc_id, name, model, CAST(priority AS BIGINT) AS priority FROM documents, v_models WHERE enabled AND model LIKE '%k%'")
def enabled_models(spark, sf_dir):
    """Enabled models of one provider family per document, by priority: ordered in the row, so nothing is sorted or shuffled."""
    listed = enabled_by_priority(views.models(F.col("doc_id")), "k")
    rows = views.documents(spark, sf_dir).select("doc_id", F.explode(listed).alias("m"))
    return rows.select("doc_id", "m.name", "m.model", "m.priority")


# --- caches ---------------------------------------------------------------------------------------


_CACHE = f"""cache AS (SELECT 'gpt-4o' AS model, sha256(content) AS text_hash, max(doc_id % 4) AS age,
      'cached ' || max(length(content)) AS result FROM tc JOIN labels USING (doc_id) GROUP BY ALL)"""


def _chunk_calls(spark, sf_dir, size: int = 1000):
    docs = views.ff_docs(spark, sf_dir)
    rows = chunking.chunk_rows(docs, chunking.text_chunks(F.col("text"), size), "doc_id")
    return rows.select("doc_id", "index", F.lit("gpt-4o").alias("model"), F.col("chunk.content").alias("text"))


def _chunk_cache(spark, sf_dir, calls):
    """Cache of the labelled documents' chunks; every fourth is a day and a half old."""
    labelled = calls.join(views.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    age = F.max(F.col("doc_id") % 4)
    return labelled.groupBy("model", content_key(F.col("text")).alias("text_hash")).agg(
        (F.lit(samples.NOW_MS) - F.when(age == 3, 36 * 3600 * 1000).otherwise(3600 * 1000)).alias("written_ms"),
        F.concat(F.lit("cached "), F.max(F.length("text")).cast("string")).alias("result"),
    )


@query(
    "cache_lookup",
    f"""WITH RECURSIVE {text_chunk_sql('v_ff_docs', 1000)}, {_CACHE}
    SELECT doc_id, idx AS index, c.result IS NOT NULL AS hit, c.result AS cached_result FROM tc
    LEFT JOIN cache c ON sha256(tc.content) = c.text_hash AND c.age <> 3""",
)
def cache_lookup(spark, sf_dir):
    calls = _chunk_calls(spark, sf_dir)
    keyed = calls.withColumn("text_hash", content_key(F.col("text")))
    found = cache.lookup(keyed, _chunk_cache(spark, sf_dir, calls), ["model", "text_hash"], samples.NOW_MS)
    return found.select("doc_id", "index", "hit", "cached_result")


@query(
    "cache_warmup",
    """SELECT conv_id, turn, text, result, token_count FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws, turn % 3 AS m FROM conversations) c,
    LATERAL (SELECT unnest(ws) AS text, unnest(list_transform(ws, lambda w: reverse(w))) AS result, unnest(list_transform(ws, lambda w: length(w))) AS token_count) WHERE m <> 2""",
)
def cache_warmup(spark, sf_dir):
    """Words as texts; every third turn lacks one result and loads nothing."""
    words = F.split("text", " ")
    results = F.transform(words, F.reverse)
    loads = views.turns(spark, sf_dir).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("model"),
        words.alias("texts"),
        F.when(F.col("turn") % 3 == 2, F.concat(results, F.array(F.lit("extra")))).otherwise(results).alias("results"),
        F.transform(words, F.length).alias("token_counts"),
    )
    entries = cache.bulk_entries(loads, samples.NOW_MS)
    ids = F.split("model", "-")
    return entries.select(
        ids[0].cast("bigint").alias("conv_id"), ids[1].cast("bigint").alias("turn"), "text", "result",
        F.col("token_count").cast("bigint").alias("token_count"),
    )


@query(
    "cache_expire",
    f"""SELECT model, count(*) AS entries, count(*) FILTER (live) AS kept, count(*) FILTER (NOT live) AS evicted
    FROM (SELECT model, model <> 'kimi-2' AND {samples.NOW_MS} - last_access_ms <= {5 * samples.DAY_MS} AS live FROM v_cache_entries) GROUP BY model""",
)
def cache_expire(spark, sf_dir):
    entries = views.cache_entries(spark, sf_dir).withColumn("written_ms", F.col("last_access_ms"))
    live = cache.fresh(F.col("written_ms"), F.lit(samples.NOW_MS), 5 * samples.DAY_MS) & (F.col("model") != "kimi-2")
    return entries.groupBy("model").agg(
        F.count("*").alias("entries"), F.count_if(live).alias("kept"), F.count_if(~live).alias("evicted")
    )


@query(
    "cache_live",
    f"""SELECT key, model, access_count FROM v_cache_entries WHERE {samples.NOW_MS} - last_access_ms <= {5 * samples.DAY_MS} AND model <> 'kimi-2'""",
)
def cache_live(spark, sf_dir):
    entries = views.cache_entries(spark, sf_dir).withColumn("written_ms", F.col("last_access_ms"))
    return cache.unexpired(entries, samples.NOW_MS, 5 * samples.DAY_MS, drop_model="kimi-2").select("key", "model", "access_count")


@query(
    "lru_evict",
    """WITH t AS (SELECT count(*) AS n, sum(2 * (length(text) + length(result) + length(model)) + 32) AS b FROM v_cache_entries),
    k AS (SELECT CASE WHEN b > 20000 AND floor(n * 0.2) > 0 THEN floor(n * 0.2) WHEN n >= 100 OR b > 20000 THEN greatest(1, floor(n * 0.1)) ELSE 0 END AS k FROM t)
    SELECT key, r AS lru_rank, r <= (SELECT k FROM k) AS evicted FROM (SELECT key, row_number() OVER (ORDER BY last_access_ms, key) AS r FROM v_cache_entries)""",
)
def lru_evict(spark, sf_dir):
    return cache.evict(views.cache_entries(spark, sf_dir), 100, 20000).select("key", "lru_rank", "evicted")


@query(
    "lru_cutoff",
    """WITH t AS (SELECT count(*) AS n, sum(2 * (length(text) + length(result) + length(model)) + 32) AS b FROM v_cache_entries),
    k AS (SELECT CASE WHEN b > 20000 AND floor(n * 0.2) > 0 THEN floor(n * 0.2) WHEN n >= 100 OR b > 20000 THEN greatest(1, floor(n * 0.1)) ELSE 0 END AS k FROM t)
    SELECT key, r <= (SELECT k FROM k) AS evicted FROM (SELECT key, row_number() OVER (ORDER BY last_access_ms, key) AS r FROM v_cache_entries)""",
)
def lru_cutoff(spark, sf_dir):
    """The same round of eviction by a cut-off that histograms of the access times find."""
    return cache.evict_marked(views.cache_entries(spark, sf_dir), 100, 20000).select("key", "evicted")


@query(
    "cache_stats",
    """SELECT model, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome <> 'evict') AS accesses,
    round(coalesce(count(*) FILTER (outcome = 'hit') / nullif(count(*) FILTER (outcome <> 'evict'), 0)::DOUBLE, 0), 6) AS hit_rate,
    count(*) FILTER (outcome = 'evict') AS evictions, round(coalesce(avg(access_ms) FILTER (outcome <> 'evict'), 0), 6) AS mean_access_ms
    FROM v_cache_log GROUP BY model""",
)
def cache_stats(spark, sf_dir):
    stats = cache.access_stats(views.cache_log(spark, sf_dir), ["model"])
    return stats.withColumn("hit_rate", F.round("hit_rate", 6)).withColumn("mean_access_ms", F.round("mean_access_ms", 6))


@query(
    "cache_memory",
    """SELECT count(*) AS entries, CAST(sum(2 * (length(text) + length(result) + length(model)) + 32) AS BIGINT) AS chunk_bytes,
    CAST(sum(2 * (length(text) + length(result) + length(model) + length(key)) + 40) AS BIGINT) AS request_bytes FROM v_cache_entries""",
)
def cache_memory(spark, sf_dir):
    return cache.memory_estimate(views.cache_entries(spark, sf_dir).withColumn("endpoint", F.col("key")))


# --- jobs --------------------------------------------------------------------------------------------


@query(
    "skip_existing",
    f"""WITH p AS (SELECT doc_id, '/out/' || regexp_replace(name, '[.][^.]*$', '') || {ov.lit(fv.OUTPUT_SUFFIX)} AS output_path FROM v_file_names)
    SELECT doc_id, output_path, output_path IN (SELECT output_path FROM v_existing_outputs) AS skipped FROM p""",
)
def skip_existing(spark, sf_dir):
    named = views.file_names(spark, sf_dir).select("doc_id", join_path(F.lit("/out"), output_name(F.col("name"))).alias("output_path"))
    existing = views.existing_outputs(spark, sf_dir)
    todo = jobs.without_existing(named, existing, "output_path").withColumn("skipped", F.lit(False))
    done = jobs.with_existing(named, existing, "output_path").withColumn("skipped", F.lit(True))
    return todo.unionByName(done).select("doc_id", "output_path", "skipped")


_STATE = """SELECT job_id, count(*) AS total, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'cancelled') AS cancelled_count, count(*) FILTER (skipped) AS skipped_count, bool_or(status = 'cancelled') AS cancelled,
    CASE WHEN count(*) > 1 THEN 'batch' ELSE 'single' END AS mode FROM v_job_items GROUP BY job_id"""


@query("job_state", _STATE)
def job_state(spark, sf_dir):
    return jobs.job_state(views.job_items(spark, sf_dir))


@query(
    "job_progress",
    f"""SELECT job_id, completed + failed + cancelled_count AS processed,
    CAST(floor((completed + failed + cancelled_count) * 100.0 / total + 0.5) AS BIGINT) AS percent,
    greatest(total - completed - failed - cancelled_count, 0) AS remaining FROM ({_STATE})""",
)
def job_progress(spark, sf_dir):
    return jobs.progress(jobs.job_state(views.job_items(spark, sf_dir)))


@query(
    "chunking_summary",
    """SELECT job_id, count(*) FILTER (ok) AS total, count(*) FILTER (ok AND chunking_enabled) AS chunked, count(*) FILTER (ok AND degraded) AS degraded
    FROM (SELECT *, status = 'success' AND NOT skipped AS ok FROM v_job_items) GROUP BY job_id""",
)
def chunking_summary(spark, sf_dir):
    return jobs.chunking_summary(views.job_items(spark, sf_dir))


@query(
    "latest_outcomes",
    """SELECT job_id, arg_max(output_path, item_id) FILTER (status = 'success') AS latest_output,
    arg_max(error_message, item_id) FILTER (status = 'failed') AS latest_error FROM v_job_items GROUP BY job_id""",
)
def latest_outcomes(spark, sf_dir):
    return jobs.latest_outcomes(views.job_items(spark, sf_dir))


@query(
    "current_item_names",
    """WITH j AS (SELECT job_id, max(item_id) AS hi, min(item_id) AS lo, count(*) AS n FROM v_job_items GROUP BY job_id),
    w AS (SELECT job_id, unnest([hi, lo, -1]) AS item_id, unnest([1, 2, 3]) AS pos FROM j)
    SELECT j.job_id, coalesce(string_agg(i.name, '|' ORDER BY w.pos), '') AS names FROM j LEFT JOIN w USING (job_id)
    LEFT JOIN v_job_items i ON i.job_id = w.job_id AND i.item_id = w.item_id GROUP BY j.job_id""",
)
def current_item_names(spark, sf_dir):
    """Running items are the newest and the oldest one of a job, and an unknown id."""
    items = views.job_items(spark, sf_dir)
    running = items.groupBy("job_id").agg(
        F.array(F.max("item_id"), F.min("item_id"), F.lit(-1).cast("bigint")).alias("current_ids")
    )
    return jobs.current_names(running, items).select("job_id", F.array_join("names", "|").alias("names"))


@query(
    "status_labels",
    f"""SELECT item_id, CASE WHEN skipped THEN {ov.lit(fv.SKIPPED_LABEL)} ELSE CASE status {' '.join(f"WHEN {ov.lit(a)} THEN {ov.lit(b)}" for a, b in fv.STATUS_LABELS)} END END AS status_label,
    CASE WHEN status = 'pending' THEN '暂无长文处理信息' WHEN NOT chunking_enabled THEN '本次任务未启用长文分块' ELSE '已启用长文分块，共 ' || chunk_count || ' 个分块。' || chr(10) ||
      CASE WHEN degraded THEN '本次输出已触发降级。' ELSE '本次输出未触发降级。' END || CASE WHEN degraded AND degrade_reason IS NOT NULL THEN chr(10) || '降级原因：' || degrade_reason ELSE '' END END AS chunking_label,
    CASE WHEN NOT chunking_enabled THEN '长文状态：未启用分块' ELSE '长文状态：已分块（' || chunk_count || ' 段）' || CASE WHEN NOT degraded THEN '；未降级'
      WHEN degrade_reason IS NULL THEN '；已降级' ELSE '；已降级：' || degrade_reason END END AS item_label FROM v_job_items""",
)
def status_labels(spark, sf_dir):
    c = {n: F.col(n) for n in ("chunk_count", "degraded", "degrade_reason")}
    args = (c["chunk_count"], c["degraded"], c["degrade_reason"])
    known = F.when(F.col("status") != "pending", F.col("chunking_enabled"))
    return views.job_items(spark, sf_dir).select(
        "item_id",
        labels.status_label(F.col("status"), F.col("skipped")).alias("status_label"),
        labels.chunking_label(known, *args).alias("chunking_label"),
        labels.item_chunking_label(F.col("chunking_enabled"), *args).alias("item_label"),
    )


_RUN_CODE = "CASE WHEN o.message = '任务已取消' THEN {cancelled} " + " ".join(
    f"WHEN {' OR '.join(f'contains(o.message, {ov.lit(t)})' for t in texts)} THEN {{{i}}}"
    for i, (_, texts, _) in enumerate(fv.RUN_ERROR_RULES)
)


@query(
    "retry_resolve",
    f"""WITH c AS (SELECT * FROM v_attempts WHERE attempt <= 3),
    s AS (SELECT item_id, coalesce(min(attempt) FILTER (status <> 'failed'), max(attempt)) AS attempts FROM c GROUP BY item_id)
    SELECT s.item_id, s.attempts, o.status, CASE WHEN o.status <> 'success' THEN {_RUN_CODE.format(*[ov.lit(c) for c, _, _ in fv.RUN_ERROR_RULES], cancelled=ov.lit('CANCELLED'))} ELSE 'UNKNOWN' END END AS error_code,
    CASE WHEN o.status <> 'success' THEN {_RUN_CODE.format(*[ov.lit(m) if m else 'o.message' for _, _, m in fv.RUN_ERROR_RULES], cancelled='o.message')} ELSE o.message END END AS error_message
    FROM s JOIN c o ON o.item_id = s.item_id AND o.attempt = s.attempts""",
)
def retry_resolve(spark, sf_dir):
    return jobs.retry_outcome(views.attempts(spark, sf_dir), 2)


@query(
    "retry_messages",
    f"""SELECT item_id, attempt, '第 ' || attempt || ' 次尝试失败：' || {_RUN_CODE.format(*[ov.lit(m) if m else 'o.message' for _, _, m in fv.RUN_ERROR_RULES], cancelled='o.message')} ELSE o.message END AS retry_message
    FROM v_attempts o WHERE status = 'failed' AND attempt <= 2""",
)
def retry_messages(spark, sf_dir):
    return jobs.retry_messages(views.attempts(spark, sf_dir), 2)


@query(
    "batch_report",
    f"""WITH s AS ({_STATE}), l AS (SELECT *, CASE WHEN skipped THEN {ov.lit(fv.SKIPPED_LABEL)} ELSE CASE status {' '.join(f"WHEN {ov.lit(a)} THEN {ov.lit(b)}" for a, b in fv.STATUS_LABELS)} END END AS label FROM v_job_items)
    SELECT job_id, -1 AS section_no, '# 批处理报告' || chr(10) || chr(10) || '- 生成时间：2024-01-31T00:00:00.000Z' || chr(10) || '- 总任务数：' || total || chr(10) || '- 已完成：' || completed || chr(10) ||
      '- 失败：' || failed || chr(10) || '- 已取消：' || cancelled_count || chr(10) || '- 跳过已有输出：' || skipped_count || chr(10) || chr(10) || '## 任务明细' || chr(10) AS content FROM s WHERE total > 1
    UNION ALL SELECT job_id, item_id, '### ' || name || chr(10) || '- 状态：' || label || chr(10) || '- 尝试次数：' || attempts || chr(10) || '- 输出路径：' || coalesce(output_path, '无') || chr(10) ||
      '- 错误码：' || coalesce(error_code, '无') || chr(10) || '- 错误信息：' || coalesce(error_message, '无') || chr(10) FROM l WHERE job_id IN (SELECT job_id FROM s WHERE total > 1)""",
)
def batch_report(spark, sf_dir):
    items = views.job_items(spark, sf_dir)
    return reports.batch_report(items, jobs.job_state(items), "2024-01-31T00:00:00.000Z")


# --- errors -------------------------------------------------------------------------------------------


def _coded(spark, sf_dir):
    return views.error_events(spark, sf_dir).withColumn("code", handler_error_code(F.col("message")))


def _stats(spark, sf_dir):
    return observability.error_stats(_coded(spark, sf_dir), observability.error_catalog(spark))


@query(
    "error_enrich",
    """SELECT e.event_id, e.code, coalesce(c.message, '未知错误') AS title, coalesce(c.details, e.message) AS details,
    coalesce(c.suggestion, '请稍后重试，或联系系统管理员。') AS suggestion, coalesce(c.severity, 'error') AS severity, c.category,
    coalesce(c.retryable, false) AS retryable, coalesce(c.delay_ms, 1000) AS delay_ms FROM v_coded_errors e LEFT JOIN v_catalog c ON e.code = c.code""",
)
def error_enrich(spark, sf_dir):
    rich = observability.enrich_errors(_coded(spark, sf_dir), observability.error_catalog(spark))
    return rich.select("event_id", "code", "title", "details", "suggestion", "severity", "category", "retryable", "delay_ms")


@query(
    "custom_error",
    """SELECT e.event_id, e.code, CASE WHEN e.code = 'UNKNOWN_ERROR' THEN 'custom' ELSE c.category END AS category,
    CASE WHEN e.code = 'UNKNOWN_ERROR' THEN 7000 WHEN e.code = 'CACHE_ERROR' THEN 50 ELSE coalesce(c.delay_ms, 1000) END AS delay_ms
    FROM v_coded_errors e LEFT JOIN v_catalog c ON e.code = c.code""",
)
def custom_error(spark, sf_dir):
    base = observability.error_catalog(spark)
    rows = [
        ("UNKNOWN_ERROR", "自定义", "自定义", "", "warning", "custom", True, 7000),
        ("CACHE_ERROR", "缓存错误", "缓存操作失败。", "检查缓存配置。", "error", "cache", True, 50),
    ]
    custom = tables.fixed_rows(spark, base.columns, rows, [pa.string()] * 6 + [pa.bool_(), pa.int64()])
    rich = observability.enrich_errors(_coded(spark, sf_dir), observability.error_catalog(spark, custom))
    return rich.select("event_id", "code", "category", "delay_ms")


@query("error_stats", "SELECT code, n, first_ms, last_ms, last_message, category FROM v_error_stats")
def error_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(
    "error_report",
    """SELECT 'total' AS part, NULL AS name, CAST(sum(n) AS BIGINT) AS n, NULL::BIGINT AS last_ms FROM v_error_stats
    UNION ALL SELECT 'category', coalesce(category, 'unknown'), CAST(sum(n) AS BIGINT), NULL FROM v_error_stats GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'frequent', code, n, last_ms FROM v_error_stats ORDER BY n DESC, code LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'recent', code, n, last_ms FROM v_error_stats ORDER BY last_ms DESC, code LIMIT 10)""",
)
def error_report(spark, sf_dir):
    return observability.error_report(_stats(spark, sf_dir))


@query(
    "error_by_category",
    """SELECT coalesce(category, 'unknown') AS category, CAST(sum(n) AS BIGINT) AS n, string_agg(code, ',' ORDER BY n DESC, code) AS codes FROM v_error_stats GROUP BY 1""",
)
def error_by_category(spark, sf_dir):
    return observability.by_category(_stats(spark, sf_dir)).withColumn("codes", F.array_join("codes", ","))


@query(
    "bounded_history",
    """SELECT 'errors' AS history, CAST(event_id AS VARCHAR) AS id FROM (SELECT event_id FROM v_error_events ORDER BY ts_ms DESC, event_id DESC LIMIT 1000)
    UNION ALL SELECT 'metrics', CAST(metric_id AS VARCHAR) FROM (SELECT metric_id FROM v_metrics ORDER BY ts_ms DESC, metric_id DESC LIMIT 1000)
    UNION ALL SELECT 'logs', CAST(log_id AS VARCHAR) FROM (SELECT log_id FROM v_logs ORDER BY ts_ms DESC, log_id DESC LIMIT 100)
    UNION ALL SELECT 'notifications', CAST(event_id AS VARCHAR) FROM (SELECT event_id FROM v_error_events ORDER BY ts_ms DESC, event_id DESC LIMIT 20)
    UNION ALL SELECT 'stats', code FROM (SELECT code FROM v_error_stats ORDER BY last_ms DESC, code LIMIT 15)""",
)
def bounded_history(spark, sf_dir):
    """The bounded tails: errors, metrics, logs at their floor, notifications, capped statistics."""

    def tail(df, name, size, key):
        kept = observability.newest(df, size, "ts_ms", key)
        return kept.select(F.lit(name).alias("history"), F.col(key).cast("string").alias("id"))

    errors = views.error_events(spark, sf_dir)
    stats = observability.cap_stats(_stats(spark, sf_dir), 15)
    return (
        tail(errors, "errors", fv.HISTORY_SIZE, "event_id")
        .unionByName(tail(views.metrics(spark, sf_dir), "metrics", fv.HISTORY_SIZE, "metric_id"))
        .unionByName(tail(views.logs(spark, sf_dir), "logs", observability.history_size(10), "log_id"))
        .unionByName(tail(errors, "notifications", fv.NOTIFICATION_SIZE, "event_id"))
        .unionByName(stats.select(F.lit("stats").alias("history"), F.col("code").alias("id")))
    )


# --- metrics, spans, logs, rates -----------------------------------------------------------------------


@query("metrics_by_category", "SELECT metric_id, name, value, unit, ts_ms, category FROM v_metrics WHERE category = 'parser' AND unit = 'ms'")
def metrics_by_category(spark, sf_dir):
    return views.metrics(spark, sf_dir).filter((F.col("category") == "parser") & (F.col("unit") == "ms"))


@query(
    "avg_duration",
    "SELECT name, round(coalesce(avg(value) FILTER (unit = 'ms'), 0), 6) AS average_ms FROM v_metrics GROUP BY name",
)
def avg_duration(spark, sf_dir):
    return observability.average_durations(views.metrics(spark, sf_dir)).withColumn("average_ms", F.round("average_ms", 6))


@query(
    "perf_report",
    """SELECT 'average' AS part, name, round(coalesce(avg(value) FILTER (unit = 'ms'), 0), 6) AS value FROM v_metrics GROUP BY name
    UNION ALL SELECT 'memory', 'memory_used', round(arg_max(value, (ts_ms, metric_id)), 6) FROM v_metrics WHERE name = 'memory_used'
    UNION ALL SELECT 'metrics', NULL, count(*)::DOUBLE FROM v_metrics""",
)
def perf_report(spark, sf_dir):
    return observability.performance_report(views.metrics(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "distinct_ops",
    """SELECT 'metric' AS kind, name, NULL::BIGINT AS pages FROM (SELECT DISTINCT name FROM v_metrics)
    UNION ALL SELECT 'line', line, count(DISTINCT (doc_id, page_no)) FROM v_page_lines WHERE line_no = 0 GROUP BY line""",
)
def distinct_ops(spark, sf_dir):
    """Distinct metric names, and on how many pages each first line stands."""
    names = views.metrics(spark, sf_dir).select("name").distinct().select(
        F.lit("metric").alias("kind"), "name", F.lit(None).cast("bigint").alias("pages")
    )
    lines = views.page_lines(spark, sf_dir).filter("line_no = 0").groupBy(F.col("line").alias("name")).agg(
        F.countDistinct("doc_id", "page_no").alias("pages")
    )
    return names.unionByName(lines.select(F.lit("line").alias("kind"), "name", "pages"))


@query(
    "span_pairs",
    """SELECT span_id, min(name) FILTER (mark = 'start') AS name, min(ts_ms) FILTER (mark = 'start') AS start_ms, min(ts_ms) FILTER (mark = 'end') AS end_ms,
    min(ts_ms) FILTER (mark = 'end') - min(ts_ms) FILTER (mark = 'start') AS duration_ms, count(*) FILTER (mark = 'end') = 0 AS active
    FROM v_spans GROUP BY span_id HAVING count(*) FILTER (mark = 'start') > 0""",
)
def span_pairs(spark, sf_dir):
    return observability.pair_spans(views.spans(spark, sf_dir))


@query("log_min_level", "SELECT log_id, level, message FROM v_logs WHERE level IN ('warn', 'error')")
def log_min_level(spark, sf_dir):
    return observability.logs_from_level(views.logs(spark, sf_dir), "warn").select("log_id", "level", "message")


def _log_lines(spark, sf_dir):
    stamp = F.col("ts_ms").cast("string")
    line = labels.log_line(stamp, F.col("level"), F.col("category"), F.col("message"), F.col("metadata"))
    return views.logs(spark, sf_dir).select("log_id", "ts_ms", line.alias("line"))


_LINE = """'[' || ts_ms || '] ' || upper(level) || ': ' || CASE WHEN category IS NULL THEN '' ELSE '[' || category || '] ' END || message ||
    CASE WHEN metadata IS NULL THEN '' ELSE ' ' || metadata END"""
_DETECT = "CASE WHEN contains(upper(line), 'ERROR') OR contains(upper(line), 'FAIL') THEN 'ERROR' WHEN contains(upper(line), 'WARN') THEN 'WARN' ELSE 'INFO' END"


@query("format_logs", f"SELECT log_id, line, {_DETECT} AS detected FROM (SELECT log_id, {_LINE} AS line FROM v_logs)")
def format_logs(spark, sf_dir):
    return _log_lines(spark, sf_dir).select("log_id", "line", labels.detect_level(F.col("line")).alias("detected"))


@query(
    "log_search",
    f"""SELECT log_id, detected FROM (SELECT log_id, line, {_DETECT} AS detected FROM (SELECT log_id, {_LINE} AS line FROM v_logs))
    WHERE detected IN ('ERROR', 'WARN') AND contains(lower(line), 'click')""",
)
def log_search(spark, sf_dir):
    found = observability.search_logs(_log_lines(spark, sf_dir), ["ERROR", "WARN"], "Click")
    return found.select("log_id", "detected")


@query(
    "rate_window",
    """SELECT event_id, user_id, ts_ms, n AS in_window, CASE WHEN n >= 5 THEN 3600000 - (ts_ms - oldest) + 100 ELSE 0 END AS wait_ms FROM (
      SELECT event_id, user_id, ts_ms, count(*) OVER w - 1 AS n, min(ts_ms) OVER w AS oldest FROM v_events
      WINDOW w AS (PARTITION BY user_id % 2 ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW))""",
)
def rate_window(spark, sf_dir):
    """Two callers only, so each is a hot key; the limit is 5 requests an hour to fit the data's pace."""
    requests = views.events(spark, sf_dir).select("event_id", "user_id", "ts_ms", (F.col("user_id") % 2).alias("caller"))
    waits = observability.rate_waits(requests, "caller", window_ms=3600 * 1000, bucket_ms=24 * 3600 * 1000)
    return waits.select("event_id", "user_id", "ts_ms", "in_window", "wait_ms")
