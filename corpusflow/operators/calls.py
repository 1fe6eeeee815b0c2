"""Model calls over a corpus: clients, chunked requests, roll-up, fallback.

A client turns a prompt column into a reply ``struct<content, prompt_tokens,
completion_tokens, total_tokens, error>``. Errors are values, so one bad call
never fails a job.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import fixed_values as fv
from corpusflow.functions import templates
from corpusflow.functions.keys import content_key
from corpusflow.functions.text import coarse_tokens, let, needs_chunking
from corpusflow.operators.arrow_text import LazyTexts
from corpusflow.operators.cache import lookup
from corpusflow.operators.chunking import chunk_rows, text_chunks
from corpusflow.session import materialise

REPLY_TYPE = (
    T.StructType()
    .add("content", T.StringType())
    .add("prompt_tokens", T.LongType())
    .add("completion_tokens", T.LongType())
    .add("total_tokens", T.LongType())
    .add("error", T.StringType())
)
STUB_MARK = "[stub] "


def reply_array(rows: list[tuple]) -> pa.Array:
    """Replies as one column of ``REPLY_TYPE``."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, names=REPLY_TYPE.names)


class StubClient:
    """Deterministic local model made of column expressions only.

    Answers with the first sentence of the prompt's last line; prompts that hold
    ``fail_on`` give an error instead.
    """

    inline = True

    def __init__(self, fail_on: str | None = None, answer: Callable[[Column], Column] | None = None):
        self.fail_on = fail_on
        self.answer = answer or self._first_sentence

    @staticmethod
    def _first_sentence(prompt: Column) -> Column:
        last_line = F.substring_index(prompt, "\n", -1)
        return F.concat(F.lit(STUB_MARK), F.substring_index(last_line, ".", 1))

    def respond(self, prompt: Column) -> Column:
        # both texts are bound, so that neither is built once per counter
        return let(prompt, lambda p: let(self.answer(p), lambda content: self._reply(p, content)))

    def _reply(self, prompt: Column, content: Column) -> Column:
        failed = F.lit(False) if self.fail_on is None else prompt.contains(self.fail_on)

        def unless_failed(c: Column) -> Column:
            return F.when(~failed, c)

        both = F.ceil((F.length(prompt) + F.length(content)) / 4).cast("bigint")
        return F.struct(
            unless_failed(content).alias("content"),
            unless_failed(coarse_tokens(prompt)).alias("prompt_tokens"),
            unless_failed(coarse_tokens(content)).alias("completion_tokens"),
            unless_failed(both).alias("total_tokens"),
            F.when(failed, F.lit("HTTP_503")).alias("error"),
        )


_FINAL = re.compile(rf"(?<!\d)({'|'.join(map(str, fv.FINAL_STATUSES))})(?!\d)")


class CallableClient:
    """A user's ``prompt -> (content, prompt tokens, completion tokens)`` callable.

    A failed call is tried ``attempts`` times in all, unless its error names a status that no repetition mends. All failed
    calls of an Arrow batch wait together, after attempt n ``first_wait_ms`` doubled n times, up to the
    longest wait of ``models.retry_delay``; so a batch waits as often as one call does.
    """

    inline = False

    def __init__(self, call: Callable[[str], tuple[str, int, int]], attempts: int = 1, first_wait_ms: int = fv.RETRY_FIRST_MS):
        self.call = call
        self.attempts = attempts
        self.first_wait_ms = first_wait_ms

    def _once(self, prompt: str) -> tuple:
        try:
            content, asked, answered = self.call(prompt)
            return content, asked, answered, asked + answered, None
        except Exception as error:  # captured per row
            return None, None, None, None, str(error) or type(error).__name__

    def replies(self, prompts: Sequence[str]) -> list[tuple]:
        found = [self._once(p) for p in prompts]
        for attempt in range(1, self.attempts):
            again = [k for k, reply in enumerate(found) if reply[-1] is not None and not _FINAL.search(reply[-1])]
            if not again:
                break
            time.sleep(min(self.first_wait_ms * 2**attempt, fv.RETRY_MAX_MS) / 1000)
            for k in again:
                found[k] = self._once(prompts[k])
        return found

    def reply(self, prompt: str) -> tuple:
        return self.replies([prompt])[0]

    def respond(self, prompt: Column) -> Column:
        replies = self.replies

        def batches(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in prompts:
                # the prompts stay in the Arrow batch; only a piece of them is Python strings at a time
                yield reply_array(replies(LazyTexts(batch)))

        # hints for arrow_udf, given as objects because annotations here are text
        batches.__annotations__ = {"prompts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(batches, REPLY_TYPE).asNondeterministic()(prompt)


def generate(df: DataFrame, prompt: Column, client, parallel: int | None = None) -> DataFrame:
    """Add the ``reply`` of every row's prompt; ``parallel`` bounds simultaneous calls.

    The replies of a Python client are written at once, so no later action and no
    lost executor repeats a call.
    """
    spread = df if parallel is None else df.repartition(parallel)
    called = spread.withColumn("reply", client.respond(prompt))
    return called if client.inline else materialise(called, "replies")


def cached_generate(
    calls: DataFrame, client, cache: DataFrame, model: str, now_ms: int, ttl_ms: int = fv.CACHE_TTL_MS, learn: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """Replies for ``calls(text, prompt, ...)`` with one model call per distinct missing text.

    Copies are reduced to distinct texts on the map side before anything is
    looked up or called. Python replies are written, because a model call must
    not be recomputed. The calls meet the replies in one join on the text's hash
    and leave texts and prompts behind. The replies are written first, so that a hot
    text is a skewed left side of plain tables, which adaptive execution splits. ``learn`` gets
    the written ``(model, text_hash, text, reply)`` of the texts that were called; a text that is its own prompt moves once.
    """
    keyed = calls.withColumn("model", F.lit(model)).withColumn("text_hash", content_key(F.col("text")))
    least = [F.min("prompt").alias("call_prompt")]
    if learn is not None:
        least.append(F.min(F.when(~F.col("text").eqNullSafe(F.col("prompt")), F.col("text"))).alias("other_text"))
    distinct = keyed.groupBy("model", "text_hash").agg(*least)
    looked_up = lookup(distinct, cache, ["model", "text_hash"], now_ms, ttl_ms)
    missing = looked_up.filter(~F.col("hit"))
    # the prompt is left behind before anything is written
    called = missing.withColumn("reply", client.respond(F.col("call_prompt")))
    if learn is not None:
        called = called.select("model", "text_hash", F.coalesce("other_text", "call_prompt").alias("text"), "reply")
        called = materialise(called, "replies")
        learn(called)
    elif not client.inline:
        called = materialise(called.select("model", "text_hash", "reply"), "replies")
    called = called.select("model", "text_hash", F.lit(False).alias("hit"), "reply")
    cached_reply = F.struct(
        F.col("cached_result").alias("content"),
        *[F.lit(None).cast("bigint").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.lit(None).cast("string").alias("error"),
    )
    known = looked_up.filter("hit").select("model", "text_hash", "hit", cached_reply.alias("reply"))
    told = materialise(known.unionByName(called), "told")
    return keyed.drop("text", "prompt").join(told, ["model", "text_hash"])


# --- chunked requests -----------------------------------------------------------------------


def chunked_generate(
    df: DataFrame,
    client,
    size: int = fv.CLIENT_CHUNK_SIZE,
    max_chunks: int | None = None,
    template: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One request per document, cut into parts when it is long.

    ``(key, parts, content, error)``: the answers of the parts are merged in
    order; the first failed part fails the request. All parts are called unless
    ``max_chunks`` is given.
    """
    body = F.col(text)
    parts = F.when(needs_chunking(body, size), F.transform(text_chunks(body, size, max_chunks), lambda c: c["content"]))
    whole = F.coalesce(F.size(parts), F.lit(1)) <= 1
    pieces = F.when(whole, F.array(body)).otherwise(parts)
    user = None if template is None else F.lit(template)

    def prompt(piece: Column, index: Column, total: Column) -> Column:
        return F.when(total == 1, piece).otherwise(templates.part_prompt(piece, index + 1, total, user))

    def summary(replies: Column) -> list[Column]:
        errors = F.filter(F.transform(replies, lambda r: r["error"]), lambda e: e.isNotNull())
        merged = F.when(F.size(replies) == 1, replies[0]["content"]).otherwise(
            templates.merged_results(F.transform(replies, lambda r: r["content"]))
        )
        return [
            F.size(replies).alias("parts"),
            F.when(F.size(errors) == 0, merged).alias("content"),
            F.get(errors, F.lit(0)).alias("error"),
        ]

    base = df.select(key, pieces.alias("pieces"))
    if client.inline:
        # the replies stay in the document's row: no explode, no shuffle
        replies = F.transform("pieces", lambda p, i: client.respond(prompt(p, i, F.size("pieces"))))
        return base.select(key, replies.alias("replies")).select(key, *summary(F.col("replies")))
    rows = chunk_rows(base, F.col("pieces"), key)
    called = generate(rows, prompt(F.col("chunk"), F.col("index"), F.col("total")), client)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("index", "reply"))), lambda s: s["reply"])
    return called.groupBy(key).agg(ordered.alias("replies")).select(key, *summary(F.col("replies")))


# --- roll-up ------------------------------------------------------------------------------------

ROLLUP_TYPE = (
    T.StructType()
    .add("content", T.StringType())
    .add("prompt_tokens", T.LongType())
    .add("completion_tokens", T.LongType())
    .add("total_tokens", T.LongType())
    .add("degraded", T.BooleanType())
    .add("degrade_reason", T.StringType())
)
_COUNTERS = ("prompt_tokens", "completion_tokens", "total_tokens")


def _rollup_column(client, summaries: Column, ask: Column, name: Column, kind: Column) -> Column:
    """Roll-up as a fold in the document's row, for clients made of columns."""
    rounds = F.ceil(F.size(summaries) / fv.ROUND_SIZE).cast("int")

    def bundle(number: Column) -> Column:
        return F.array_join(F.slice(summaries, (number - 1) * fv.ROUND_SIZE + 1, F.lit(fv.ROUND_SIZE)), "\n\n")

    def step(state: Column, number: Column) -> Column:
        prompt = F.when(
            rounds == 1, templates.final_prompt(ask, name, kind, bundle(number))
        ).otherwise(
            templates.round_prompt(ask, name, kind, bundle(number), number, rounds, state["previous"])
        )

        def merge(reply: Column) -> Column:
            failure = templates.render(
                fv.ROUND_FAILURE,
                first=(number - 1) * fv.ROUND_SIZE + 1,
                last=F.least(number * fv.ROUND_SIZE, F.size(summaries)),
                error=reply["error"],
            )
            failed = F.when(rounds == 1, reply["error"]).otherwise(failure)
            return F.struct(
                F.coalesce(reply["content"], state["previous"]).alias("previous"),
                *[(state[c] + F.coalesce(reply[c], F.lit(0))).alias(c) for c in _COUNTERS],
                F.when(reply["error"].isNotNull(), failed).alias("failed"),
            )

        return F.when(state["failed"].isNotNull(), state).otherwise(let(client.respond(prompt), merge))

    start = F.struct(
        F.lit("").alias("previous"),
        *[F.lit(0).cast("bigint").alias(c) for c in _COUNTERS],
        F.lit(None).cast("string").alias("failed"),
    )

    def finish(state: Column) -> Column:
        content = F.when(
            state["failed"].isNotNull(), templates.degraded_text(summaries, state["failed"])
        ).otherwise(state["previous"])
        return F.struct(
            content.alias("content"),
            *[state[c].alias(c) for c in _COUNTERS],
            state["failed"].isNotNull().alias("degraded"),
            state["failed"].alias("degrade_reason"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, step, finish)


def _rollup_one(reply, summaries: list[str], ask: str, name: str, kind: str) -> tuple:
    """The same rounds for one document with a Python client; calls are sequential by nature."""
    size, total = fv.ROUND_SIZE, len(summaries)
    rounds = -(-total // size)
    previous, used = "", [0, 0, 0]
    for number in range(1, rounds + 1):
        first, last = (number - 1) * size + 1, min(number * size, total)
        bundle = "\n\n".join(summaries[first - 1 : last])
        common = {"instructions": ask, "name": name, "kind": kind}
        if rounds == 1:
            prompt = fv.FINAL_PROMPT.format(bundle=bundle, **common)
        else:
            carried = fv.ROUND_PROMPT_PREVIOUS.format(previous=previous) if number > 1 and previous else ""
            head = fv.ROUND_PROMPT_HEAD.format(round=number, rounds=rounds, **common)
            prompt = head + carried + fv.ROUND_PROMPT_TAIL.format(bundle=bundle)
        content, *counts, error = reply(prompt)
        if error is not None:
            reason = error if rounds == 1 else fv.ROUND_FAILURE.format(first=first, last=last, error=error)
            blocks = "".join(
                fv.DEGRADED_CHUNK.format(index=i, summary=s) for i, s in enumerate(summaries, start=1)
            )
            text = fv.DEGRADED_HEAD.format(reason=reason) + blocks
            return (text.removesuffix("\n"), *used, True, reason)
        previous, used = content, [u + (c or 0) for u, c in zip(used, counts)]
    return (previous, *used, False, None)


def rolling_summary(
    client, summaries: Column, ask: Column, name: Column, kind: Column
) -> Column:
    """Chunk summaries to one answer in rounds of five; ``ROLLUP_TYPE``.

    Up to five summaries take one call. More run in rounds that carry the answer
    so far. A failed round gives all summaries below a notice instead. Rounds of
    one document follow each other; documents run side by side.
    """
    if client.inline:
        return _rollup_column(client, summaries, ask, name, kind)
    reply = client.reply

    def batches(parts):
        for summary_lists, asks, names, kinds in parts:
            rows = [
                _rollup_one(reply, list(s), a, n, k)
                for s, a, n, k in zip(summary_lists, asks, names, kinds)
            ]
            yield pd.DataFrame(rows, columns=ROLLUP_TYPE.names)

    four = tuple[pd.Series, pd.Series, pd.Series, pd.Series]
    batches.__annotations__ = {"parts": Iterator[four], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batches, ROLLUP_TYPE).asNondeterministic()(summaries, ask, name, kind)


# --- fallback --------------------------------------------------------------------------------------


def generate_with_fallback(df: DataFrame, prompt: Column, clients: list[tuple[str, object]]) -> DataFrame:
    """Try the clients in order; only rows that failed so far go to the next one.

    Every round is written before it is split into answered and open rows.
    """
    open_rows, answered = df, []
    for i, (name, client) in enumerate(clients):
        called = materialise(
            generate(open_rows, prompt, client).withColumn("used_model", F.lit(name)), "fallback"
        )
        if i == len(clients) - 1:
            answered.append(called)
            break
        answered.append(called.filter(F.col("reply.error").isNull()))
        open_rows = called.filter(F.col("reply.error").isNotNull()).drop("reply", "used_model")
    result = answered[0]
    for more in answered[1:]:
        result = result.unionByName(more)
    return result.withColumn("used_model", F.when(F.col("reply.error").isNull(), F.col("used_model")))


def resolve_fallback(attempts: DataFrame) -> DataFrame:
    """First success by priority per document, else the last error."""
    ok = F.col("ok")
    best = F.min_by(F.struct("model", "content"), F.when(ok, F.col("priority")))
    return attempts.groupBy("doc_id").agg(
        best.alias("best"), F.max_by("error", "priority").alias("last_error"), F.bool_or("ok").alias("ok")
    ).select(
        "doc_id",
        F.col("best.model").alias("used_model"),
        F.col("best.content").alias("content"),
        F.when(~F.col("ok"), F.col("last_error")).alias("error"),
    )


def fallback_events(attempts: DataFrame) -> DataFrame:
    """One failed hop per failed model that has a successor, and one success event when another model answered.

    A document has as many rows as there are models, which bounds the window.
    """
    per_doc = Window.partitionBy("doc_id")
    by_priority = per_doc.orderBy("priority")
    first_ok = F.min(F.when(F.col("ok"), F.col("priority"))).over(per_doc)
    seen = attempts.select(
        "*",
        first_ok.alias("first_ok"),
        F.lead("model").over(by_priority).alias("next_model"),
        F.lag("error").over(by_priority).alias("previous_error"),
        F.first("model").over(by_priority).alias("first_model"),
        F.row_number().over(by_priority).alias("n"),
    )
    tried = F.col("first_ok").isNull() | (F.col("priority") <= F.col("first_ok"))
    failed = ~F.col("ok") & F.col("next_model").isNotNull()
    recovered = F.col("ok") & (F.col("n") > 1)
    return seen.filter(tried & (failed | recovered)).select(
        "doc_id",
        F.when(F.col("ok"), F.col("first_model")).otherwise(F.col("model")).alias("from_model"),
        F.when(F.col("ok"), F.col("model")).otherwise(F.col("next_model")).alias("to_model"),
        F.coalesce(F.when(F.col("ok"), F.col("previous_error")).otherwise(F.col("error")), F.lit(fv.UNKNOWN_REASON)).alias("reason"),
        F.col("ok").alias("success"),
    )


def compare_models(answers: DataFrame, names: list[str]) -> DataFrame:
    """One row per document, one answer column per model."""
    return answers.groupBy("doc_id").pivot("model", names).agg(F.first("content", ignorenulls=True))


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the token counters, missing ones counted as zero."""
    return calls.groupBy(*by).agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in _COUNTERS]
    )
