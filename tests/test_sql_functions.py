"""SQL functions give what the column functions give."""

from pyspark.sql import functions as F

from corpusflow.functions import errors, keys, models, replies, sql, text, urls
from corpusflow.operators import chunking
from corpusflow.plans import views


def same(df, call, column):
    got = df.select(F.expr(call).alias("a"), column.alias("b")).filter("NOT (a <=> b)")
    assert got.count() == 0, got.first()


def test_sql_functions_equal_columns(spark, sf_dir):
    names = sql.register(spark)
    assert "cf_answer_text" in names
    docs, c = views.documents(spark, sf_dir), F.col
    same(docs, "cf_token_estimate(text)", text.token_estimate(c("text")))
    same(docs, "cf_short_key(source, 'm')", keys.short_key(c("source"), F.lit("m")))
    for model in ("gpt-4o", "kimi-2.5", "", "x"):
        same(docs, f"cf_chunk_token_limit('{model}', 0)", models.chunk_token_limit(F.lit(model), F.lit(0)))
    points = views.endpoints(spark, sf_dir)
    same(points, "cf_chat_endpoint(endpoint, mode)", urls.chat_endpoint(c("endpoint"), c("mode")))
    faults = views.error_events(spark, sf_dir)
    same(faults, "cf_run_error_code(message)", errors.run_error(c("message"))["code"])
    same(faults, "cf_handler_error_code(message)", errors.handler_error_code(c("message")))
    raw = views.raw_replies(spark, sf_dir)
    same(raw, "cf_answer_text(raw)", replies.answer_text(replies.parse_json(c("raw"))))
    odd = spark.createDataFrame(
        [('{"output":[{"content":"a"},{"text":["b",{"text":"c"},1]},{"text":null,"content":"d"},"e",7]}',), ("[1]",), ("x",)], "raw string"
    )
    same(odd, "cf_answer_text(raw)", replies.answer_text(replies.parse_json(c("raw"))))
    assert odd.select(F.expr("cf_answer_text(raw)")).first()[0] == "abcde"


def test_token_chunks_from_sql(spark, sf_dir):
    sql.register(spark)
    views.documents(spark, sf_dir).createOrReplaceTempView("docs")
    rows = spark.sql("SELECT doc_id, inline(cf_token_chunks(text, 200)) FROM docs")
    assert rows.columns == ["doc_id", "text", "start", "end", "tokens"]
    assert rows.agg(F.max("tokens")).first()[0] <= 200


ODD_TEXTS = [
    None, "", " \n　", "x", "。" * 30, "a\fb\f\fc", "\n\n".join(["Abstract", "one two", "1. Next", "x" * 70, "第一章 起", "末"]),
    "\f".join(f"page {i}. " + "词。" * 20 for i in range(7)), "word " * 400, "# A\n\n# B\n\n" + "y" * 205,
]


def test_table_functions_equal_chunkers(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "id int, text string")
    c = F.col("text")
    pairs = [
        ("cf_chunk_text(text, 50)", chunking.text_chunks(c, 50), ["start", "chars", "content"]),
        ("cf_chunk_pages(text, array(named_struct('first', 2, 'last', 3), named_struct('first', 4, 'last', NULL)), 40)",
         chunking.page_range_chunks(c, [(2, 3), (4, None)], 40), ["start_page", "end_page", "chars", "content"]),
    ]
    for call, chunks, fields in pairs:
        want = chunking.chunk_rows(docs.filter("text IS NOT NULL"), chunks, "id").filter("chunk IS NOT NULL")
        want = want.select("id", "index", "total", *[f"chunk.{f}" for f in fields])
        got = spark.sql(f"SELECT id, c.* FROM {{docs}}, LATERAL {call} c", docs=docs).select(want.columns)
        assert want.count() > 10 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), call
    for size in (10, 60, 1000):
        want = chunking.chunk_rows(docs.filter("text IS NOT NULL"), chunking.section_chunks(c, size), "id").select("id", "index", "total", F.col("chunk").alias("content"))
        got = spark.sql(f"SELECT id, c.* FROM {{docs}}, LATERAL cf_chunk_sections(text, {size}) c", docs=docs)
        # an empty list of chunks is a row of nulls there and no row here
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.filter("content IS NOT NULL").collect())), size


def test_table_functions_are_inlined(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = spark.sql("SELECT id, c.* FROM {docs}, LATERAL cf_chunk_text(text) c", docs=docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not any(word in plan for word in ("Join", "Exchange", "Python", "Arrow"))
