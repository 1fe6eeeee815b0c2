"""Cache tables: lookup, expiry, eviction, bulk load and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.operators.tables import global_rank


def fresh(written_ms: Column, now_ms: Column, ttl_ms: int = fv.CACHE_TTL_MS) -> Column:
    """Entries live up to and including the time to live, which is at least a minute."""
    return now_ms - written_ms <= max(ttl_ms, fv.CACHE_MIN_TTL_MS)


def lookup(calls: DataFrame, cache: DataFrame, keys: list[str], now_ms: int, ttl_ms: int = fv.CACHE_TTL_MS) -> DataFrame:
    """Left join with the cached result; an expired entry is a miss.

    Of several entries with one key the newest counts. The age test is a filter on
    the cache side, so expired rows are dropped before the join. The cache side is an
    aggregate, which adaptive execution can't split: ask with distinct keys, as
    ``calls.cached_generate`` does, where one key may be very frequent.
    """
    live = cache.filter(fresh(F.col("written_ms"), F.lit(now_ms), ttl_ms))
    live = live.groupBy(*keys).agg(F.max_by("result", F.struct("written_ms", "result")).alias("cached_result"))
    return calls.join(live, keys, "left").withColumn("hit", F.col("cached_result").isNotNull())


def unexpired(cache: DataFrame, now_ms: int, ttl_ms: int = fv.CACHE_TTL_MS, drop_model: str | None = None) -> DataFrame:
    """The cache without expired entries and, if asked, without one model's entries."""
    kept = cache.filter(fresh(F.col("written_ms"), F.lit(now_ms), ttl_ms))
    return kept if drop_model is None else kept.filter(F.col("model") != drop_model)


def eviction_count(size: Column, over_memory: Column) -> Column:
    """A tenth of the entries, at least one; a fifth when memory is short, unless that is zero."""
    tenth = F.greatest(F.lit(1), F.floor(size * 0.1))
    fifth = F.floor(size * 0.2)
    return F.when(over_memory & (fifth > 0), fifth).otherwise(tenth).cast("bigint")


def entry_bytes(columns: list[str], fixed: int) -> Column:
    """Two bytes per character of the given columns plus a fixed part."""
    chars = sum((F.length(c) for c in columns), F.lit(0))
    return (chars * 2 + fixed).cast("bigint")


def memory_estimate(cache: DataFrame) -> DataFrame:
    """Total bytes of chunk entries and of request entries over the same rows."""
    chunk = entry_bytes(["text", "result", "model"], 32)
    request = entry_bytes(["text", "result", "model", "endpoint"], 40)
    return cache.agg(F.count("*").alias("entries"), F.sum(chunk).alias("chunk_bytes"), F.sum(request).alias("request_bytes"))


def evict(cache: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """Mark the least recently used entries that one round of eviction drops.

    Size and bytes are one aggregate row; the rank over last access is exact and
    spread over all tasks.
    """
    totals = cache.agg(F.count("*").alias("_size"), F.sum(entry_bytes(["text", "result", "model"], 32)).alias("_bytes"))
    over = F.col("_bytes") > max_bytes
    due = (F.col("_size") >= max_entries) | over
    bound = totals.select(F.when(due, eviction_count(F.col("_size"), over)).otherwise(0)).scalar()
    ranked = global_rank(cache, [F.col("last_access_ms"), F.col("key")], "lru_rank")
    return ranked.withColumn("evicted", F.col("lru_rank") <= bound)


def lru_cutoff(cache: DataFrame, count: int, buckets: int = 4096, take: int = 10_000) -> tuple[int, str] | None:
    """Last access and key of the ``count``-th least recently used entry, None if there is none; ties go by key.

    Found by counting: a histogram of access times says which bucket holds the entry, and only that bucket is divided
    again. Entries of one time are divided by the characters of their keys. At most ``take`` entries are sorted in the end, and the driver holds
    one histogram at a time, so no row is shuffled. A null time counts as 0, a null key as empty.
    """
    found = cache.select(F.coalesce("last_access_ms", F.lit(0)).cast("bigint").alias("at"), F.coalesce("key", F.lit("")).alias("key"))
    low, high, size = found.agg(F.min("at"), F.max("at"), F.count("*")).first()
    if count <= 0 or not size:
        return None
    rest = min(count, size)

    def choose(group: Column) -> tuple:
        nonlocal rest, size
        for value, size in sorted((r[0], r[1]) for r in found.groupBy(group).count().collect()):
            if rest <= size:
                break
            rest -= size
        return value

    while size > take and low < high:
        width = (high - low) // buckets + 1
        low += width * choose(F.floor((F.col("at") - low) / width).cast("bigint"))
        high = min(high, low + width - 1)
        found = found.filter(F.col("at").between(low, high))
    prefix = ""
    while size > take:
        following = choose(F.substring("key", len(prefix) + 1, 1))
        if not following:  # repeated entries of one key
            return low, prefix
        prefix += following
        found = found.filter(F.col("key").startswith(prefix))
    last = found.orderBy("at", "key").limit(rest).agg(F.max(F.struct("at", "key"))).first()[0]
    return last["at"], last["key"]


def evict_marked(
    cache: DataFrame, max_entries: int, max_bytes: int, buckets: int = 4096, take: int = 10_000, text_chars: Column | None = None
) -> DataFrame:
    """``evicted`` per entry like ``evict``, without ranks: every entry is compared with the cut-off where it is.

    Rows with one key and time go together; an empty cache stays empty. ``text_chars`` gives the length of the text where
    the entries come without it.
    """
    total_bytes = entry_bytes(["text", "result", "model"], 32) if text_chars is None else entry_bytes(["result", "model"], 32) + text_chars * 2
    size, total = cache.agg(F.count("*"), F.sum(total_bytes)).first()
    over = (total or 0) > max_bytes
    due = max(1, size // 10) if size >= max_entries or over else 0
    if over and size // 5 > 0:
        due = size // 5
    cut = lru_cutoff(cache, due, buckets, take) if due else None
    if cut is None:
        return cache.withColumn("evicted", F.lit(False))
    at = F.coalesce("last_access_ms", F.lit(0))
    return cache.withColumn("evicted", (at < cut[0]) | ((at == cut[0]) & (F.coalesce("key", F.lit("")) <= cut[1])))


def bulk_entries(loads: DataFrame, now_ms: int) -> DataFrame:
    """Rows of parallel arrays to cache entries; a row whose arrays differ in length loads nothing."""
    same = (F.size("texts") == F.size("results")) & (F.size("texts") == F.size("token_counts"))
    zipped = F.arrays_zip("texts", "results", "token_counts")
    return loads.filter(same).select("model", F.inline(zipped)).select(
        "model",
        F.col("texts").alias("text"),
        F.col("results").alias("result"),
        F.col("token_counts").alias("token_count"),
        F.lit(now_ms).cast("bigint").alias("written_ms"),
    )


def access_stats(log: DataFrame, by: list[str]) -> DataFrame:
    """Hits, misses, evictions, hit rate and mean access time of an access log."""
    hits = F.count_if(F.col("outcome") == "hit")
    misses = F.count_if(F.col("outcome") == "miss")
    served = F.col("outcome") != "evict"
    return log.groupBy(*by).agg(
        hits.alias("hits"),
        misses.alias("misses"),
        (hits + misses).alias("accesses"),
        F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0)).alias("hit_rate"),
        F.count_if(F.col("outcome") == "evict").alias("evictions"),
        F.coalesce(F.avg(F.when(served, F.col("access_ms"))), F.lit(0.0)).alias("mean_access_ms"),
    )
