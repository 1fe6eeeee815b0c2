"""Streams whose state ends by timers: late pieces, unfinished calls, time to live, hot keys."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusflow.operators import observability
from corpusflow.streaming import stateful

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def drops(spark, tmp_path, schema, batches):
    """A stream that gives one batch after the other."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


PIECE = 'data: {"choices":[{"delta":{"content":"%s"}}]}'
USAGE = 'data: {"choices":[],"usage":{"prompt_tokens":%d}}'
LINES = "call_id long, line_no long, line string, ts timestamp"


def test_no_call_is_lost(spark, tmp_path):
    batches = [
        [(1, 1, PIECE % "b", at(1)), (1, 0, PIECE % "a", at(0)), (2, 0, PIECE % "x", at(2)), (3, 0, USAGE % 4, at(3)), (4, 0, "data: {oops", at(3)), (6, 0, None, at(3))],
        [(1, 3, USAGE % 9, at(5)), (1, 2, USAGE % 3, at(4)), (2, 1, PIECE % "y", at(20)), (5, 0, PIECE % "q", at(25)), (5, 1, "data: [DONE]", at(25))],
        [(1, 4, PIECE % "c", at(30)), (1, 5, "data: [DONE]", at(31)), (None, 0, None, at(50))],
        [(2, 2, PIECE % "z", at(52)), (None, None, "data: [DONE]", at(60))],
        [(None, 0, None, at(4000))],
    ]
    live = drops(spark, tmp_path, LINES, batches)
    got = stateful.stateful_appended(stateful.call_stream(live, quiet_ms=60_000, late="10 seconds"), "calls").collect()
    assert sorted(((r.call_id, r.content, r.prompt_tokens, r.complete) for r in got), key=str) == [
        (1, "abc", 3, True), (2, "xyz", None, False), (3, "", 4, False), (4, "", None, False), (5, "q", None, True), (6, "", None, False),
    ]


ACCESSES = "access_id long, model string, text_hash string, answer string, ts timestamp"


def test_a_miss_is_a_hit_in_the_next_batch(spark, tmp_path):
    hot = [(1000 + k, "m", "hot", "h", at(k / 100)) for k in range(12_000)]  # two minutes of one key in one batch
    batches = [
        [(1, "m", "k", "v1", at(10)), (2, "m", "k", "v1", at(5)), (3, "n", "k", None, at(5)), (4, "m", None, "v", at(1))] + hot,
        [(5, "m", "k", "v2", at(65)), (6, "m", "k", "v2", at(66)), (7, "n", "k", "late answer", at(64)), (8, "m", "k", "v2", at(125))],
        [(9, "m", "k", "v3", at(4000)), (10, "m", "k", "v3", at(4001))],
    ]
    live = drops(spark, tmp_path, ACCESSES, batches)
    got = {r.access_id: (r.hit, r.result) for r in stateful.stateful_appended(stateful.living_cache_stream(live, 60_000, "5 minutes"), "ttl").collect()}
    assert {k: v for k, v in got.items() if k < 1000} == {
        2: (False, "v1"), 1: (True, "v1"), 3: (False, None), 5: (True, "v1"), 6: (False, "v2"), 7: (True, None), 8: (True, "v2"), 9: (False, "v3"), 10: (True, "v3"),
    }
    assert sorted(k for k, v in got.items() if k >= 1000 and not v[0]) == [1000, 7001] and len(got) == 9 + 12_000


def test_rates_of_a_hot_caller(spark, tmp_path):
    schema = "event_id long, ts timestamp, caller long"
    rows = [(k, at((k * 7919 % 100_000) / 500), 1) for k in range(40_000)] + [(50_000 + k, at(k), 2) for k in range(400)]
    rows.sort(key=lambda r: r[1])
    cut = len(rows) // 2
    live = drops(spark, tmp_path, schema, [rows[:cut], rows[cut:], [(-1, at(9999), 3)]])
    got = stateful.stateful_appended(stateful.rate_stream(live, "caller", window_ms=10_000, limit=5), "rate").filter("event_id >= 0")
    plain = spark.createDataFrame(rows, schema).withColumn("ts_ms", F.unix_millis("ts"))
    want = observability.rate_waits(plain, "caller", window_ms=10_000, limit=5, bucket_ms=10_000).select("event_id", "ts_ms", "in_window", "wait_ms")
    # where the cut falls between equal times, the first half can't know of the second
    same = {r.ts_ms for r in plain.filter(F.col("ts") == F.lit(rows[cut][1])).collect()}
    pick = ~F.col("ts_ms").isin(list(same))
    assert sorted(map(tuple, got.filter(pick).collect())) == sorted(map(tuple, want.filter(pick).collect())) and got.count() == len(rows)


class Handle:
    """Stands for a stateful processor's handle with empty state, and counts what is asked of it."""

    def __init__(self):
        self.asked = 0

    def __getattr__(self, name):
        def ask(*_):
            self.asked += 1

        return ask

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def exists(self):
        self.asked += 1
        return False


def test_misses_of_a_key_come_out_together():
    handle, cache = Handle(), stateful._Cache(60_000)
    cache.init(handle)
    rows = [Row(access_id=k, model="m", text_hash="k", answer="a", ts=None, ts_ms=100_000 * k) for k in range(25_000)]
    found = list(cache.handleInputRows(("m", "k"), iter(rows), None))
    assert [len(r.access_id) for r in found] == [10_000, 10_000, 5_000] and not any(any(r.hit) for r in found)
    assert [k for r in found for k in r.written_ms] == [100_000 * k for k in range(25_000)] and handle.asked <= 4


def test_a_call_that_ends_at_once_leaves_no_state():
    handle, calls = Handle(), stateful._Assembler(60_000)
    calls.init(handle)
    line = Row("line_no", "ts_ms", "piece", "done", "has_usage", "prompt", "completion", "total")
    rows = [line(1, 5, "b", False, True, 3, 2, None), line(0, 4, "a", False, True, 9, 9, 9), line(2, 6, None, True, False, None, None, None)]
    (found,) = calls.handleInputRows((7,), iter(rows), None)
    assert tuple(found) == (7, "ab", 9, 9, 9, True) and handle.asked == 1


def test_calls_beside_lines_without_a_call(spark, tmp_path):
    """Null ids must not turn the ids of others into floating point."""
    rows = [(None, 0, PIECE % "n", at(0))] + [(k, n, PIECE % f"{k}-{n}", at(n)) for k in range(1, 41) for n in range(2)]
    live = drops(spark, tmp_path, LINES, [rows, [(k, 2, "data: [DONE]", at(9)) for k in range(1, 41)] + [(None, 1, None, at(9))]])
    got = stateful.stateful_appended(stateful.call_stream(live, quiet_ms=60_000, late="10 seconds"), "calls").collect()
    assert sorted((r.call_id, r.content, r.complete) for r in got) == [(k, f"{k}-0{k}-1", True) for k in range(1, 41)]
