"""A cache that lives: a log of entries, touches and tombstones that runs append to, and its compaction.

Nothing is changed in place. A reader takes the newest entry of each key, and what has happened to it since. Rows carry
a generation; compaction writes the state as the next generation and then one row that commits it, so a
compaction that dies halfway is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.keys import content_key
from corpusflow.operators import cache, calls
from corpusflow.session import materialise

#: kind: put, touch (``times`` of it), drop, commit
LOG_SCHEMA = "model string, text_hash string, kind string, at_ms long, times long, text string, result string, written_ms long, bucket int"
KEYS = ["model", "text_hash"]
COMMIT = "commit"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{LOG_SCHEMA}, generation int"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("generation").parquet(path)
    return spark.read.schema(schema).parquet(path)


def generation(spark: SparkSession, path: str) -> int:
    """The newest generation that was committed; the first one needs no commit."""
    return _stored(spark, path).filter(F.col("kind") == COMMIT).agg(F.max("generation")).first()[0] or 0


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows of the current generation; others are not scanned."""
    return _stored(spark, path).filter((F.col("generation") == generation(spark, path)) & (F.col("kind") != COMMIT)).drop("generation")


def append(rows: DataFrame, path: str, into: int | None = None, buckets: int = 64) -> None:
    """Adds log rows; missing columns are null, ``times`` is 1. Rows of a key share one of the ``buckets``."""
    given = set(rows.columns)
    defaults = {"times": F.lit(1), "written_ms": F.col("at_ms")}
    kinds = {f.split()[0]: f.split()[1] for f in LOG_SCHEMA.split(", ")}
    columns = [(F.col(c) if c in given else defaults.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds.items() if c != "bucket"]
    to = generation(rows.sparkSession, path) if into is None else into
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")
    rows.select(*columns, bucket, F.lit(to).alias("generation")).write.mode("append").partitionBy("generation").parquet(path)


def put(entries: DataFrame, path: str, now_ms: int) -> None:
    """Stores ``entries(model, text, result)``; the newest entry of a key counts and starts without touches."""
    append(entries.select("model", "text", "result", content_key(F.col("text")).alias("text_hash"), F.lit("put").alias("kind"), F.lit(now_ms).alias("at_ms")), path)


def touch(used: DataFrame, path: str, now_ms: int) -> None:
    """Notes that ``used(model, text_hash)`` were read, one row per key however often that was."""
    counted = used.groupBy(*KEYS).agg(F.count("*").alias("times"))
    append(counted.select("*", F.lit("touch").alias("kind"), F.lit(now_ms).alias("at_ms")), path)


def drop(keys: DataFrame, path: str, now_ms: int) -> None:
    """Tombstones for ``keys(model, text_hash)``: what was stored up to now is gone."""
    append(keys.select(*KEYS).distinct().select("*", F.lit("drop").alias("kind"), F.lit(now_ms).alias("at_ms")), path)


def _lean(log: DataFrame) -> DataFrame:
    """What ``entries`` gives but for the texts, of which only the number of characters moves; ``nameless``: the text of a null key."""
    nameless = F.when(F.col("model").isNull() | F.col("text_hash").isNull(), F.col("text")).alias("nameless")
    newest = F.max(F.when(F.col("kind") == "put", F.struct("written_ms", "result", nameless, F.length("text").alias("chars"))))
    gone = F.max(F.when(F.col("kind") == "drop", F.col("at_ms")))
    state = log.groupBy(*KEYS).agg(newest.alias("put"), gone.alias("gone"))
    live = state.filter(F.col("put").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("put.written_ms"))))
    live = materialise(live.select(*KEYS, "put.*"), "live-entries")
    # compacted entries bring the touches they had; later ones are rows of their own
    touches = log.filter(F.col("kind") == "touch").join(live.select(*KEYS, F.col("written_ms").alias("since")), KEYS).filter("at_ms >= since")
    used = touches.groupBy(*KEYS).agg(F.max("at_ms").alias("touched_ms"), F.sum("times").alias("times"))
    return live.join(used, KEYS, "left").select(
        "model", "text_hash", F.col("text_hash").alias("key"), "nameless", "chars", "result", "written_ms",
        F.coalesce("touched_ms", "written_ms").alias("last_access_ms"), F.coalesce("times", F.lit(0)).cast("long").alias("access_count"),
    )


def _with_texts(lean: DataFrame, log: DataFrame) -> DataFrame:
    """Adds the texts of the newest puts; the join goes where ``text`` isn't asked for, since a key has one row on its right side."""
    newest = F.max(F.struct("written_ms", "result", "text"))
    texts = log.filter(F.col("kind") == "put").groupBy(*KEYS).agg(newest.alias("newest")).select(*KEYS, F.col("newest.text").alias("named"))
    others = [c for c in lean.columns if c not in ("model", "text_hash", "key", "nameless", "chars")]
    return lean.join(texts, KEYS, "left").select("model", "text_hash", "key", F.coalesce("nameless", "named").alias("text"), *others)


def entries(log: DataFrame) -> DataFrame:
    """The state a log stands for: key (``text_hash``), model, text, result, written_ms, last_access_ms, access_count per live key.

    Of puts at one time the larger result counts, so readers agree. Touches before the entry was written belong to
    an older one. A tombstone ends entries written before it or at its time. All of it is aggregations that
    combine before the shuffle; a key that very many rows touch is a row per task there. Texts are moved once, and only if they are read.
    """
    return _with_texts(_lean(log), log)


def compact(spark: SparkSession, path: str, now_ms: int, ttl_ms: int = fv.CACHE_TTL_MS) -> int:
    """Writes the live, unexpired state as a new generation and commits it; gives its number.

    Runs that append meanwhile write to the old generation and are not seen afterwards, so compaction needs the log for
    itself. Old generations are folders of their own that may be removed.
    """
    log = read_log(spark, path)
    current = materialise(cache.unexpired(_lean(log), now_ms, ttl_ms), "compacted")
    new = (_stored(spark, path).agg(F.max("generation")).first()[0] or 0) + 1
    append(_with_texts(current, log).select(*KEYS, "text", "result", "written_ms", F.lit("put").alias("kind"), F.col("written_ms").alias("at_ms")), path, new)
    touched = current.filter("access_count > 0")
    append(touched.select(*KEYS, F.lit("touch").alias("kind"), F.col("last_access_ms").alias("at_ms"), F.col("access_count").alias("times")), path, new)
    append(spark.createDataFrame([(COMMIT, now_ms)], "kind string, at_ms long").select("*", *[F.lit("").alias(c) for c in KEYS]), path, new)
    return new


def evict(spark: SparkSession, path: str, max_entries: int, max_bytes: int, now_ms: int) -> DataFrame:
    """One round of eviction by last access: tombstones for the least recently used; gives ``entries`` with ``evicted``."""
    log = read_log(spark, path)
    marked = cache.evict_marked(materialise(_lean(log), "entries"), max_entries, max_bytes, text_chars=F.col("chars"))
    drop(marked.filter("evicted"), path, now_ms)
    return _with_texts(marked, log)


def generate(rows: DataFrame, client, path: str, model: str, now_ms: int, ttl_ms: int = fv.CACHE_TTL_MS) -> DataFrame:
    """``calls.cached_generate`` with a cache that learns: answers of new texts are stored, hits are touched.

    ``rows`` has ``text``, ``prompt`` and more; ``hit`` and ``reply`` are added, text and prompt left behind. Failed calls are not stored. Each
    distinct text is looked up, called and stored once; a hit counts one touch per row that has the text.
    """
    spark = rows.sparkSession
    state = materialise(entries(read_log(spark, path)).select(*KEYS, "result", "written_ms"), "cache-state")
    # a prompt that is the text itself is written once
    own = F.col("prompt").eqNullSafe(F.col("text"))
    asked = materialise(rows.withColumn("_own", own).withColumn("prompt", F.when(~F.col("_own"), F.col("prompt"))), "asked")
    asked = asked.withColumn("prompt", F.when(F.col("_own"), F.col("text")).otherwise(F.col("prompt"))).drop("_own")

    def learn(called: DataFrame) -> None:
        answered = called.filter(F.col("text_hash").isNotNull() & F.col("reply.error").isNull() & F.col("reply.content").isNotNull())
        put(answered.select("model", "text", F.col("reply.content").alias("result")), path, now_ms)

    done = materialise(calls.cached_generate(asked, client, state, model, now_ms, ttl_ms, learn), "cached-replies")
    touch(done.filter("hit"), path, now_ms)
    return done.drop(*KEYS)
