"""Chunkers: cover the text, respect limits, and agree with plain references on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.operators import chunking
from corpusflow.operators.chunking import _TokenCounter, _token_spans

BLANKS = fv.BLANK_CHARS


def estimate(t):
    han = sum("一" <= ch <= "龥" for ch in t)
    words = sum(1 for w in t.translate({ord(b): " " for b in BLANKS}).split(" ") if w)
    return -(-han // 2) + max(-(-(len(t) - han) // 4), -(-3 * words // 4))


texts = st.text(alphabet="ab. \n中文#1:A", max_size=400)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(0, 400), st.integers(0, 400))
def test_counter_equals_estimate(t, a, b):
    a, b = sorted((min(a, len(t)), min(b, len(t))))
    assert _TokenCounter(t).count(a, b) == estimate(t[a:b])


@settings(max_examples=150, deadline=None)
@given(texts.filter(bool), st.integers(2, 60))
def test_token_spans_cover_the_text(t, limit):
    spans = _token_spans(t, limit)
    covered = [False] * len(t)
    for piece, start, end, tokens in spans:
        assert piece == t[start:end].strip(BLANKS)
        assert tokens == estimate(t[start:end]) <= limit
        covered[start:end] = [True] * (end - start)
    assert all(done or ch in BLANKS for done, ch in zip(covered, t))
    starts = [s[1] for s in spans]
    assert starts == sorted(set(starts))
    # linear work: a step is at least half of the chunk it leaves
    assert all(2 * (b[1] - a[1]) >= a[2] - a[1] for a, b in zip(spans, spans[1:]))


def test_token_chunk_rows(spark):
    sentence = "这是一个用于性能测试的中文句子内容。 "
    df = spark.createDataFrame([(1, sentence * 100), (2, "short"), (3, "")], "doc_id int, text string")
    rows = chunking.chunk_rows(df, chunking.token_chunks(F.col("text"), F.lit(100)), "doc_id").collect()
    by_doc = {d: sorted((r for r in rows if r.doc_id == d), key=lambda r: r["index"]) for d in (1, 2, 3)}
    long = by_doc[1]
    assert len(long) > 1 and long[0].is_first and long[-1].is_last and not long[0].is_last
    assert [r["index"] for r in long] == list(range(long[0].total)) and len({r.chunk_id for r in long}) == len(long)
    assert all(r.chunk.tokens <= 100 for r in long)
    assert by_doc[2][0].chunk.text == "short" and by_doc[2][0].is_first and by_doc[2][0].is_last
    assert by_doc[3][0].chunk.text == "" and by_doc[3][0].total == 1


def plain_text_chunks(t, size, count):
    if not t.strip(BLANKS):
        return [""]
    out, at = [], 0
    while at < len(t) and len(out) < count:
        window = t[at : at + size]
        keep = len(window)
        if at + size < len(t) and len(out) < count - 1:
            best = max(window.rfind(m) for m in ("\n\n", "。", "\f"))
            if best > len(window) * 0.5:
                keep = best + 1
        out.append(window[:keep].strip(BLANKS))
        at += keep
    return out


def test_text_chunks_match_plain_python(spark):
    samples = ["", " \n", "abc", "a\n\nb" * 40, "中文。" * 30, "x" * 95, "p\fq" * 33, ("word。\n\n" * 5 + "y" * 30) * 3]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, text string")
    for size, count in ((20, 3), (10, 20), (7, 50)):
        rows = df.select("i", chunking.text_chunks(F.col("text"), size, count).alias("c")).orderBy("i").collect()
        assert [[c.content for c in r.c] for r in rows] == [plain_text_chunks(s, size, count) for s in samples]


def test_dropped_text_is_counted(spark):
    df = spark.createDataFrame([("z" * 100,)], "text string")
    chunks = chunking.text_chunks(F.col("text"), 10, 3)
    assert df.select(chunking.dropped_chars(F.col("text"), chunks).alias("d")).first().d == 70


@pytest.mark.parametrize("pages", ["one page only", "a\fb\fc\fd"])
def test_page_ranges(spark, pages):
    df = spark.createDataFrame([(pages,)], "text string")
    got = df.select(chunking.page_range_chunks(F.col("text"), [(1, 2), (4, 9), (7, 8)]).alias("c")).first().c
    if "\f" in pages:
        assert [(c.content, c.start_page, c.end_page) for c in got] == [("a\n\nb", 1, 2), ("d", 4, 9)]
    else:
        assert [c.content for c in got] == [pages] * 3


def test_section_chunks_small_and_oversize(spark):
    samples = ["  tiny ", "# A\n\nx\n\n# B\n\n" + "y" * 25, "p" * 8 + "\n\n" + "q" * 8 + "\n\n" + "r" * 8]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, text string")
    got = [r.c for r in df.select("i", chunking.section_chunks(F.col("text"), 20).alias("c")).orderBy("i").collect()]
    assert got == [["tiny"], ["# A\n\nx", "# B\n\n" + "y" * 15, "y" * 10], ["p" * 8 + "\n\n" + "q" * 8, "r" * 8]]
