"""The whole job: documents to one interpretation report each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import replies, templates, text, urls
from corpusflow.functions.models import chunk_token_limit, model_token_limit
from corpusflow.operators import cache_log, calls
from corpusflow.operators.chunking import token_chunks
from corpusflow.operators.hooks import Hooks
from corpusflow.operators.ledger import resumed_generate
from corpusflow.operators.rollups import rolled_rows
from corpusflow.session import materialise
from corpusflow.sources.reports import front_matter_report, markdown_report

_USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def analyse_direction(client, body: Column) -> Column:
    """Research direction of a text; null when the call fails, which never fails the document."""
    return text.let(
        client.respond(_direction_prompt(body)),
        lambda r: F.when(r["error"].isNull(), replies.direction(r["content"])),
    )


def _direction_prompt(body: Column) -> Column:
    return templates.direction_prompt(
        text.abstract_section(body), text.introduction_section(body), text.keywords_section(body)
    )


def _with_direction(base: DataFrame, client, hooks: Hooks) -> DataFrame:
    """Adds the ``direction`` of ``body``; hooks around calls see its prompt and answer like those of chunks."""
    if client is None:
        return base.withColumn("direction", F.lit(None).cast("struct<main:string,subs:array<string>,keywords:array<string>,confidence:double>"))
    if not hooks.around_calls():
        return base.withColumn("direction", analyse_direction(client, F.col("body")))
    asked = base.withColumn("_prompt", hooks.apply("before_call", _direction_prompt(F.col("body"))))
    answered = asked.withColumn("_reply", client.respond(F.col("_prompt")))
    answered = answered.withColumn("_answer", hooks.apply("after_call", F.col("_reply.content")))
    found = F.when(F.col("_reply.error").isNull(), replies.direction(F.col("_answer")))
    return answered.withColumn("direction", found).drop("_prompt", "_reply", "_answer")


def _prepare(docs, model, instructions, max_tokens, chunking, direction, hooks) -> DataFrame:
    """One row per document with its prompts; the text itself is not carried on."""
    asked = F.lit(max_tokens) if max_tokens else model_token_limit(F.lit(model))
    parsed = hooks.apply("after_parse", F.col("text"))
    base = docs.select("doc_id", "name", "path", "kind", text.strip(parsed).alias("body"))
    if chunking:
        limit = chunk_token_limit(F.lit(model), asked).cast("int")
        pieces = F.transform(token_chunks(F.col("body"), limit), lambda c: c["text"])
    else:
        pieces = F.array("body")
    staged = _with_direction(base.select("*", pieces.alias("pieces")), direction, hooks)
    single = F.size("pieces") <= 1
    staged = staged.withColumn("bounded", F.when(single, templates.bounded_body(F.col("body"))))

    def chunk_prompt(piece: Column, index: Column) -> Column:
        ask = templates.chunk_instructions(F.lit(instructions), index + 1, F.size("pieces"))
        return templates.document_prompt(ask, F.col("name"), F.col("kind"), piece)

    whole = templates.document_prompt(F.lit(instructions), F.col("name"), F.col("kind"), F.col("bounded.text"))
    prompts = F.when(single, F.array(whole)).otherwise(F.transform("pieces", chunk_prompt))
    size = F.length("body").cast("bigint")
    return staged.select(
        "doc_id",
        F.struct(
            "name",
            "path",
            "kind",
            size.alias("original_length"),
            F.coalesce("bounded.applied", F.lit(False)).alias("applied"),
            F.coalesce("bounded.final_length", size).alias("final_length"),
            "direction",
        ).alias("meta"),
        F.when(single, F.array("body")).otherwise(F.col("pieces")).alias("pieces"),
        prompts.alias("prompts"),
    )


def _called(rows: DataFrame, client, ledger, model, parallel, hooks) -> DataFrame:
    """``rows(doc_id, index, prompt, ...)`` with their ``reply`` instead of the prompt; hooks see every prompt and answer."""
    rows = rows.withColumn("prompt", hooks.apply("before_call", F.col("prompt")))
    if ledger is not None:
        called = resumed_generate(rows, client, ledger, model, parallel).drop("attempt")
    else:
        called = calls.generate(rows, F.col("prompt"), client, parallel).drop("prompt")
    return _after_call(called, hooks)


def _after_call(called: DataFrame, hooks) -> DataFrame:
    called = called.withColumn("answer", hooks.apply("after_call", F.col("reply.content")))
    return called.withColumn("reply", F.col("reply").withField("content", F.col("answer"))).drop("answer")


def _answered(prepared: DataFrame, client, cache, ledger, model, now_ms, parallel, hooks) -> DataFrame:
    """``(doc_id, meta, replies)`` with the replies in chunk order.

    Hooks run on rows, one per call, so that column and Python hooks work alike for every client.
    """
    if client.inline and cache is None and ledger is None and not hooks.around_calls():
        answered = F.transform("prompts", client.respond)
        return prepared.select("doc_id", "meta", answered.alias("replies"))
    rows = prepared.select(
        "doc_id", "meta", F.posexplode_outer(F.arrays_zip(F.col("pieces").alias("text"), F.col("prompts").alias("prompt"))).alias("index", "call")
    ).select("doc_id", "meta", "index", "call.text", "call.prompt")
    if cache is None:
        called = _called(rows.drop("text"), client, ledger, model, parallel, hooks)
    else:
        rows = rows.withColumn("prompt", hooks.apply("before_call", F.col("prompt")))
        if isinstance(cache, str):
            called = cache_log.generate(rows, client, cache, model, now_ms).drop("hit")
        else:
            called = calls.cached_generate(rows, client, cache, model, now_ms)
        called = _after_call(called, hooks)
    ordered = F.array_sort(F.collect_list(F.struct("index", "reply")))
    # one group is one document, so a group is bounded by its chunk count
    return called.groupBy("doc_id").agg(
        F.any_value("meta").alias("meta"), F.transform(ordered, lambda s: s["reply"]).alias("replies")
    )


def interpret(
    docs: DataFrame,
    client,
    instructions: str,
    model: str,
    *,
    endpoint: str = "https://api.example.com/v1",
    prompt_name: str | None = None,
    generated_at: str = "1970-01-01T00:00:00.000Z",
    max_tokens: int | None = None,
    chunking: bool = True,
    direction_client=None,
    cache: DataFrame | str | None = None,
    ledger: str | None = None,
    now_ms: int = 0,
    parallel: int | None = None,
    hooks: Hooks | None = None,
    front_matter: bool = False,
) -> DataFrame:
    """Interpret ``docs(doc_id, name, path, kind, text)``.

    Short documents take one call, long ones a call per token chunk and a rolling
    summary. With a column client and no cache everything happens inside the
    document's row and nothing is shuffled; otherwise calls are spread one by one
    and come back with one shuffle of the answers by document. The replies of a
    Python client are written to the shared folder first, which runs the calls.

    ``cache`` is a table of entries, or the folder of a ``cache_log``, which then learns
    the answers. ``ledger`` is a folder that all executors reach: chunk and roll-up calls that it
    has an answer for are not made, whether an earlier run failed or died. With a ledger, or with
    hooks around calls, the rounds of the roll-up are tables of calls too. Observers of
    ``before_parse`` get the documents without their texts.
    """
    if ledger is not None and cache is not None:
        raise ValueError("a job takes its calls from a ledger or from a cache, not from both")
    hooks = hooks or Hooks()
    hooks.notify("before_parse", docs.select("doc_id", "name", "path", "kind"))
    prepared = _prepare(docs, model, instructions, max_tokens, chunking, direction_client, hooks)
    if client.inline and direction_client is not None and not direction_client.inline:
        prepared = materialise(prepared, "prepared")  # or every action would repeat the direction calls
    answered = _answered(prepared, client, cache, ledger, model, now_ms, parallel, hooks)
    contents = F.transform("replies", lambda r: r["content"])
    errors = F.filter(F.transform("replies", lambda r: r["error"]), lambda e: e.isNotNull())
    staged = answered.select(
        "doc_id", "meta", "replies", contents.alias("contents"), F.get(errors, F.lit(0)).alias("call_error")
    )
    many = (F.size("replies") > 1) & F.col("call_error").isNull()
    summaries = F.when(many, F.transform("contents", lambda c, i: text.chunk_summary(c, i + 1))).otherwise(
        F.array().cast("array<string>")
    )
    staged = staged.withColumn("summaries", summaries)
    if ledger is not None or hooks.around_calls():
        staged = materialise(staged, "answers")
        todo = staged.select("doc_id", "meta.name", "meta.kind", "summaries")
        made = rolled_rows(todo, instructions, lambda rows: _called(rows, client, ledger, model, parallel, hooks))
        staged = staged.join(made, "doc_id", "left")
    else:
        rolled = calls.rolling_summary(
            client, F.col("summaries"), F.lit(instructions), F.col("meta.name"), F.col("meta.kind")
        )
        staged = staged.withColumn("rollup", F.when(F.size("summaries") > 0, rolled) if client.inline else rolled)
        if not client.inline:
            # roll-up calls are written too, or every action would repeat them
            staged = materialise(staged, "rollups")

    def used(counter: str) -> Column:
        total = F.aggregate("replies", F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r[counter], F.lit(0)))
        return total + F.when(many, F.coalesce(F.col("rollup")[counter], F.lit(0))).otherwise(0)

    content = F.when(F.col("call_error").isNull(), F.when(many, F.col("rollup.content")).otherwise(F.get("contents", F.lit(0))))
    result = staged.select(
        "doc_id",
        "meta.name",
        "meta.path",
        "meta.kind",
        F.lit(model).alias("model"),
        urls.endpoint_summary(F.lit(endpoint)).alias("endpoint_summary"),
        F.lit(prompt_name).cast("string").alias("prompt_name"),
        F.lit(generated_at).alias("generated_at"),
        F.struct(
            F.col("meta.applied").alias("applied"),
            F.col("meta.original_length").alias("original_length"),
            F.col("meta.final_length").alias("final_length"),
        ).alias("truncation"),
        F.struct(
            (F.size("replies") > 1).alias("enabled"),
            F.size("replies").alias("chunk_count"),
            F.col("meta.original_length").alias("original_length"),
            F.coalesce(F.when(many, F.length("rollup.content").cast("bigint")), F.col("meta.final_length")).alias("final_length"),
            F.coalesce(F.lit(max_tokens), model_token_limit(F.lit(model))).alias("max_tokens"),
            F.coalesce(F.when(many, F.col("rollup.degraded")), F.lit(False)).alias("degraded"),
            F.when(many, F.col("rollup.degrade_reason")).alias("degrade_reason"),
        ).alias("chunking"),
        F.col("meta.direction").alias("direction"),
        F.struct(*[used(c).alias(n) for c, n in zip(_USAGE, ("prompt", "completion", "total"))]).alias("usage"),
        content.alias("content"),
        F.when(many, F.transform("contents", text.strip)).alias("chunk_summaries"),
        F.col("call_error").alias("error"),
    )
    report = front_matter_report() if front_matter else markdown_report()
    return result.withColumn("report", F.when(F.col("error").isNull(), report))
