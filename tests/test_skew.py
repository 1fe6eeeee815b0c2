"""Hot keys: results stay whole and exact when one key holds most rows."""

import random

from pyspark.sql import functions as F

from corpusflow.functions.keys import content_key
from corpusflow.operators import cache, observability


def test_rate_waits_of_a_hot_caller_match_brute_force(spark):
    pick = random.Random(7)
    rows = [(i, pick.randrange(0, 900_000), "hot" if i % 3 else "cold") for i in range(600)]
    rows = list({(c, t): (i, t, c) for i, t, c in rows}.values())
    df = spark.createDataFrame(rows, "event_id long, ts_ms long, caller string")
    for bucket_ms in (60_000, 100_000, 3_600_000):
        got = {r.event_id: (r.in_window, r.wait_ms) for r in observability.rate_waits(df, "caller", bucket_ms=bucket_ms).collect()}
        assert len(got) == len(rows)
        for i, t, c in rows:
            recent = sorted(u for _, u, d in rows if d == c and t - 60_000 < u < t)
            wait = 60_000 - (t - recent[0]) + 100 if len(recent) >= 5 else 0
            assert got[i] == (len(recent), wait)


def test_lookup_keeps_every_copy_of_a_hot_text(spark):
    calls = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    keyed = calls.withColumn("text_hash", content_key(F.col("text"))).withColumn("model", F.lit("m"))
    stored = spark.createDataFrame([("hot", 0)], "t string, written_ms long").select(
        F.lit("m").alias("model"), content_key(F.col("t")).alias("text_hash"), "written_ms", F.lit("r").alias("result")
    )
    found = cache.lookup(keyed, stored, ["model", "text_hash"], 5)
    assert found.count() == 9000 and found.filter("hit").count() == 3000


def test_error_stats_of_one_hot_code(spark):
    events = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "HOT").otherwise("COLD").alias("code"),
        F.col("id").alias("ts_ms"), F.col("id").alias("event_id"), F.concat(F.lit("m"), "id").alias("message"),
    )
    catalog = spark.createDataFrame([("HOT", "network")], "code string, category string")
    got = {r.code: (r.n, r.first_ms, r.last_ms, r.last_message, r.category) for r in observability.error_stats(events, catalog).collect()}
    assert got == {"HOT": (3333, 1, 4999, "m4999", "network"), "COLD": (1667, 0, 4998, "m4998", None)}


def test_rates_need_no_sliding_frame(spark):
    """A sliding frame costs a row its whole window: rows times requests in a window."""
    df = spark.createDataFrame([(1, 5, 7)], "event_id long, ts_ms long, caller long")
    plan = observability.rate_waits(df, "caller")._jdf.queryExecution().analyzed().toString()
    frames = [f.split(",")[1].strip() for f in plan.split("specifiedwindowframe(")[1:]]
    assert frames and all(f.startswith("unboundedpreceding") for f in frames)
