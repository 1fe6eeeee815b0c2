"""A durable ledger of model calls, so that neither a retry nor a restarted job repeats a finished one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.calls import REPLY_TYPE
from corpusflow.session import materialise

LEDGER_SCHEMA = "document string, chunk int, request string, attempt int, ok boolean, reply string"
KEYS = ["document", "chunk", "request"]


def request_digest(model: str, prompt: Column) -> Column:
    """Names what is asked of which model; the model's length keeps the two apart."""
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), prompt), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All calls of the folder ``ledger``, which is made if it isn't there."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def finished(calls: DataFrame) -> DataFrame:
    """The keys of the calls of a ledger that were answered, each once, however often it was written."""
    return calls.filter("ok").groupBy(*KEYS).agg(F.min("attempt").alias("attempt"))


def resumed_generate(calls: DataFrame, client, ledger: str, model: str, parallel: int | None = None) -> DataFrame:
    """Replies for ``calls(doc_id, index, prompt, ...)``; only those that the ledger has no answer for are called.

    A task adds its calls to the ledger when it ends, not when the job does, so a job that dies loses the calls of its
    running tasks only; ``parallel`` says how many tasks there are. Failed calls are kept too, as the
    history of a request, and are called again next time. The prompt is left behind; ``reply`` and ``attempt``,
    the run of the ledger that gave it, are added. Rows with one key and prompt share an answer. Of the ledger only the range
    of chunk numbers that is asked for is grouped and moved, so a round of a roll-up doesn't pay for the calls of the others.
    """
    spark = calls.sparkSession
    keyed = calls.select(
        "*", F.col("doc_id").cast("string").alias("document"), F.col("index").cast("int").alias("chunk"), request_digest(model, F.col("prompt")).alias("request")
    )
    keyed = materialise(keyed, "asked")
    known = read_ledger(spark, ledger)
    attempt = (known.agg(F.max("attempt")).first()[0] or 0) + 1
    low, high = keyed.agg(F.min("chunk"), F.max("chunk")).first()
    asked = F.col("chunk").between(F.lit(low).cast("int"), F.lit(high).cast("int"))
    # written, so that the anti-join has two plain sides
    done = materialise(finished(known.filter(asked)).select(*KEYS), "finished-calls")
    todo = keyed.select(*KEYS, "prompt").join(done, KEYS, "left_anti").groupBy(*KEYS).agg(F.first("prompt").alias("prompt"))
    todo = todo if parallel is None else todo.repartition(parallel)
    called = todo.withColumn("answer", client.respond(F.col("prompt"))).select(
        *KEYS, F.lit(attempt).alias("attempt"), F.col("answer.error").isNull().alias("ok"), F.to_json("answer").alias("reply")
    )
    # with this way of committing, a task's file is there as soon as the task has ended
    called.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(ledger)
    latest = read_ledger(spark, ledger).filter(asked).groupBy(*KEYS).agg(F.max(F.struct("ok", "attempt", "reply")).alias("latest"))
    latest = materialise(latest.select(*KEYS, "latest.attempt", F.from_json("latest.reply", REPLY_TYPE).alias("reply")), "ledger-replies")
    return keyed.drop("prompt").join(latest, KEYS).drop(*KEYS)
