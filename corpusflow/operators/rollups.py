"""Roll-up of chunk summaries as rows: a round is a table of calls, so a ledger and hooks see every one of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions import templates
from corpusflow.session import materialise

COUNTERS = ("prompt_tokens", "completion_tokens", "total_tokens")


def rolled_rows(docs: DataFrame, instructions: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs(doc_id, name, kind, summaries)`` to ``(doc_id, rollup)``, with what ``calls.rolling_summary`` gives.

    ``call`` adds ``reply`` to rows of ``doc_id``, ``index`` and ``prompt``; the index of round n is -n, so that a ledger tells
    rounds from chunks. The n-th rounds of all documents are one job over the documents that have one; what goes from round to
    round is the answer so far, not the summaries. A document without summaries gives no row; a failed
    round gives its document all summaries below a notice. ``doc_id`` must be unique; there are as many jobs as
    the longest document has rounds.
    """
    size, ask = fv.ROUND_SIZE, F.lit(instructions)
    docs = docs.filter(F.size("summaries") > 0).withColumn("rounds", F.ceil(F.size("summaries") / size).cast("int"))
    parts = F.transform(
        F.sequence(F.lit(1), F.col("rounds")),
        lambda n: F.struct(n.alias("number"), F.array_join(F.slice("summaries", (n - 1) * size + 1, F.lit(size)), "\n\n").alias("bundle")),
    )
    held = materialise(docs, "rollup-summaries")
    bundles = materialise(held.select("doc_id", "name", "kind", "rounds", F.size("summaries").alias("total"), F.inline(parts)), "rollup-bundles")
    zero = [F.lit(0).cast("bigint").alias(c) for c in COUNTERS]
    state, ended = None, []
    for number in range(1, (bundles.agg(F.max("rounds")).first()[0] or 0) + 1):
        mine = bundles.filter(F.col("number") == number)
        if state is None:
            mine = mine.select("*", F.lit("").alias("previous"), *zero)
        else:
            mine = mine.join(state.select("doc_id", "previous", *COUNTERS), "doc_id")
        last = templates.final_prompt(ask, F.col("name"), F.col("kind"), F.col("bundle"))
        one = templates.round_prompt(ask, F.col("name"), F.col("kind"), F.col("bundle"), F.col("number"), F.col("rounds"), F.col("previous"))
        asked = mine.select("doc_id", F.lit(-number).alias("index"), F.when(F.col("rounds") == 1, last).otherwise(one).alias("prompt"))
        answered = materialise(call(asked).select("doc_id", "reply"), "rollup-replies")
        error = F.col("reply.error")
        reason = templates.render(fv.ROUND_FAILURE, first=F.lit((number - 1) * size + 1), last=F.least(F.lit(number * size), F.col("total")), error=error)
        state = materialise(
            mine.join(answered, "doc_id").select(
                "doc_id",
                "rounds",
                F.coalesce("reply.content", "previous").alias("previous"),
                *[(F.col(c) + F.coalesce(F.col("reply")[c], F.lit(0))).alias(c) for c in COUNTERS],
                F.when(error.isNotNull(), F.when(F.col("rounds") == 1, error).otherwise(reason)).alias("failed"),
            ),
            "rollup-state",
        )
        over = F.col("failed").isNotNull() | (F.col("rounds") == number)
        ended.append(state.filter(over))
        state = state.filter(~over)
    if not ended:
        made = held.select("doc_id", F.lit("").alias("previous"), *zero, F.lit(None).cast("string").alias("failed"))
    else:
        made = ended[0]
        for more in ended[1:]:
            made = made.unionByName(more)
    failed = F.col("failed").isNotNull()
    content = F.when(failed, templates.degraded_text(F.col("summaries"), F.col("failed"))).otherwise(F.col("previous"))
    rollup = F.struct(content.alias("content"), *COUNTERS, failed.alias("degraded"), F.col("failed").alias("degrade_reason"))
    return held.select("doc_id", "summaries").join(made.drop("rounds"), "doc_id").select("doc_id", rollup.alias("rollup"))
