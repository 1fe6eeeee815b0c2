"""Plan shapes that must hold at any size."""

import pytest

from corpusflow.operators import layout
from corpusflow.plans import views
from corpusflow.plans.catalogue import QUERIES

ROW_LOCAL = ["interpret_corpus", "chunk_text", "chunk_pages", "chunk_sections", "chunk_tokens", "rolling_summary", "chunked_generate",
             "truncate_prompt", "build_sections", "extract_answer", "report_default", "classify_error"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def enough_splits(monkeypatch):
    """Plans as for an input with many splits: no spreading shuffle."""
    monkeypatch.setattr(views, "spread", lambda df, *keys: df)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "scan_", "read_"))))
def test_no_products_of_tables(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_work_does_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


def test_chunker_runs_once(spark, sf_dir):
    assert plan(QUERIES["chunk_tokens"](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["span_pairs"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,view))]" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    text = plan(QUERIES["bounded_history"](spark, sf_dir))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_clean_layout_shuffles_by_page_and_by_document(spark, sf_dir):
    text = plan(layout.clean_layout(views.page_items(spark, sf_dir)))
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text
