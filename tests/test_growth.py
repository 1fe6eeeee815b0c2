"""What a step writes, moves or holds must not grow with what it doesn't need."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow.functions import replies
from corpusflow.operators import cache_log, calls, layout, ledger
from corpusflow.operators.arrow_text import LazyTexts, text_pieces
from corpusflow.plans import queries_calls, views


def _spied(monkeypatch, *modules):
    """The tables that modules write meanwhile, by name."""
    seen = []
    for module in modules:
        real = module.materialise

        def noted(df, name, real=real):
            seen.append((name, real(df, name)))
            return seen[-1][1]

        monkeypatch.setattr(module, "materialise", noted)
    return seen


def test_a_round_reads_its_own_part_of_the_ledger(spark, tmp_path, monkeypatch):
    path, client = str(tmp_path / "ledger"), calls.CallableClient(lambda p: (p.upper(), 1, 1))
    kind = "doc_id long, index int, prompt string"
    ledger.resumed_generate(spark.createDataFrame([(d, i, f"{d} {i}") for d in range(20) for i in range(3)], kind), client, path, "m")
    seen = _spied(monkeypatch, ledger)
    rounds = spark.createDataFrame([(d, -1, f"round {d}") for d in range(20)] + [(None, None, "lost")], kind)
    for known in (0, 21):
        done = ledger.resumed_generate(rounds, client, path, "m").collect()
        assert {(r.doc_id, r.reply.content) for r in done} == {(d, f"ROUND {d}") for d in range(20)}
        tables = dict(seen)
        assert tables["finished-calls"].count() == min(known, 20) and tables["ledger-replies"].count() == 20
    assert ledger.read_ledger(spark, path).count() == 60 + 21 + 1


def test_pieces_of_a_batch_are_bounded_and_whole():
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else rng.choice("aé行") * rng.choice([0, 1, 7, 30, 90]) for _ in range(300)]
    column = pa.array(texts, pa.string())
    pieces = list(text_pieces(column, 100))
    assert [t for p in pieces for t in p.to_pylist()] == texts and len(pieces) > 20
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 100 for p in pieces)
    assert list(LazyTexts(column)) == texts and LazyTexts(column)[5] == texts[5] and len(LazyTexts(column)) == 300
    assert list(text_pieces(column.slice(0, 0))) == []


def test_replies_of_lazy_prompts(spark):
    rows = spark.createDataFrame([(k, None if k == 7 else "p" * k) for k in range(40)], "k int, prompt string").repartition(2)
    found = {r.k: r.reply for r in calls.generate(rows, F.col("prompt"), calls.CallableClient(lambda p: (p + "!", len(p), 1))).collect()}
    assert all(found[k].content == "p" * k + "!" and found[k].total_tokens == k + 1 and found[k].error is None for k in range(40) if k != 7)
    assert found[7].content is None and "NoneType" in found[7].error


def test_the_flaky_model_holds_no_texts():
    model = queries_calls._FlakyModel()
    found = calls.CallableClient(model, attempts=3, first_wait_ms=0).replies(["even" * 1000, "odd" * 999])
    assert [(r[0], r[-1]) for r in found] == [("2 " + "even" * 5, None), ("1 " + ("odd" * 7)[:20], None)]
    assert sum(len(name) for name in model.asked) <= 32
    assert calls.CallableClient(model).reply(None)[-1] == "argument of type 'NoneType' is not iterable"


def test_cache_steps_leave_texts_where_they_are(spark, tmp_path, monkeypatch):
    path, long = str(tmp_path / "cache"), "word " * 500
    seen = _spied(monkeypatch, cache_log, calls)
    rows = spark.createDataFrame([(k, f"{k % 6} {long}", f"{k % 6} {long}" if k % 6 < 3 else f"ask {k % 6}") for k in range(12)], "doc_id long, text string, prompt string")
    client = calls.CallableClient(lambda p: (p[:5], 1, 1))
    first = cache_log.generate(rows.filter("doc_id < 4"), client, path, "m", 1_000).collect()
    second = cache_log.generate(rows, client, path, "m", 2_000).collect()
    assert not any(r.hit for r in first) and {r.doc_id: r.hit for r in second} == {k: k % 6 < 4 for k in range(12)}
    assert {r.reply.content for r in second} == {"0 wor", "1 wor", "2 wor", "ask 3"[:5], "ask 4"[:5], "ask 5"[:5]}
    marked = cache_log.evict(spark, path, 1, 1 << 60, 3_000)
    assert {r.text for r in marked.collect()} == {f"{k} {long}" for k in range(6)} and marked.filter("evicted").count() == 1
    cache_log.compact(spark, path, 3_000)
    left = cache_log.entries(cache_log.read_log(spark, path))
    assert left.count() == 5 and {r.text for r in left.collect()} <= {f"{k} {long}" for k in range(6)}
    # prompts of texts that are their own are written once, other steps write no texts
    columns = {(name, c) for name, df in seen for c in df.columns}
    assert not {(n, c) for n, c in columns if c in ("text", "prompt", "call_prompt") and n not in ("asked", "replies")}
    assert ("replies", "call_prompt") not in columns
    assert all(df.filter("prompt = text").count() == 0 for name, df in seen if name == "asked")
    plan = left.select("key", "result")._jdf.queryExecution().optimizedPlan().toString()
    assert "named" not in plan


def test_debounced_long_arrays_and_nulls(spark):
    rng = random.Random(9)
    lists = [[(t, str(t)) for t in sorted(rng.randrange(10**7) for _ in range(60_000))], [], [(None, "x"), (101, "a"), (150, "b"), (None, None), (202, "c")], None, [(50, "early"), (100, "not yet")]]
    lists.append([(rng.randrange(-500, 3000), str(k)) for k in range(500)])

    def walked(pieces):
        sent, last = [], 0
        for at, text in pieces:
            if at is not None and at - last > 100:
                sent.append((at, text))
                last = at
        return sent

    rows = spark.createDataFrame(list(enumerate(lists)), "k int, pieces array<struct<at_ms:long,text:string>>").repartition(3)
    found = {r.k: r.sent for r in rows.select("k", replies.debounced(F.col("pieces")).alias("sent")).collect()}
    assert all((found[k] is None) if pieces is None else [tuple(p) for p in found[k]] == walked(pieces) for k, pieces in enumerate(lists))


def test_items_are_gathered_once(spark, sf_dir):
    items = views.page_items(spark, sf_dir)
    text = layout.items_to_lines(items)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("collect_list") == 1 and "Window" not in text
