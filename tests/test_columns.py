"""Column functions on the surveyed test vectors."""

import pytest
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions import errors, keys, labels, models, replies, templates, text, urls


def values(spark, rows, column, names="v"):
    """Results of one column expression over literal rows, in row order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names.split()])
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_token_estimate(spark):
    rows = [("",), ("中文文本",), ("hello world",), ("中 a",), ("a　b c",), ("😀",)]
    assert values(spark, rows, text.token_estimate(F.col("v"))) == [0, 3, 3, 3, 3, 1]


def test_token_estimate_matches_plain_python(spark):
    samples = ["x" * n + " " * m + "中" * k for n in (0, 1, 7) for m in (0, 3) for k in (0, 1, 6)]

    def plain(t):
        han = sum("一" <= ch <= "龥" for ch in t)
        words = len(t.split())
        return -(-han // 2) + max(-(-(len(t) - han) // 4), -(-3 * words // 4))

    got = values(spark, [(s,) for s in samples], text.token_estimate(F.col("v")))
    assert got == [plain(s) for s in samples]


@pytest.mark.parametrize(
    "raw, mode, expected",
    [
        ("https://api.example.com", "auto", "https://api.example.com/v1/chat/completions"),
        ("https://api.example.com/", "auto", "https://api.example.com/v1/chat/completions"),
        ("https://api.example.com/v1", "auto", "https://api.example.com/v1/chat/completions"),
        ("https://api.example.com/v1/", "auto", "https://api.example.com/v1/chat/completions"),
        ("https://api.example.com/V2", "auto", "https://api.example.com/V2/chat/completions"),
        ("https://api.example.com/v1/chat/completions", "auto", "https://api.example.com/v1/chat/completions"),
        ("https://api.example.com/completions", "auto", "https://api.example.com/completions"),
        ("https://api.example.com/proxy", "auto", "https://api.example.com/proxy/chat/completions"),
        ("https://API.Example.com/v1?x=1", "auto", "https://api.example.com/v1/chat/completions?x=1"),
        ("  https://api.example.com/v1  ", "manual", "https://api.example.com/v1"),
        ("not a url", "auto", "not a url"),
        ("", "auto", ""),
    ],
)
def test_chat_endpoint(spark, raw, mode, expected):
    assert values(spark, [(raw, mode)], urls.chat_endpoint(F.col("v"), F.col("m")), "v m") == [expected]


def test_model_limits(spark):
    names = ["gpt-4o", "gpt-3.5-turbo", "claude-3-opus-20240229", "mystery", "GPT-4O"]
    got = values(spark, [(n,) for n in names], models.model_token_limit(F.col("v")))
    assert got == [128000, 16384, 200000, 8192, 128000]


def test_adjusted_chunk_tokens(spark):
    rows = [("gpt-4o", 2000), ("", 0), ("gpt-4o", 0), ("gemini-1.5-pro", 0), ("claude-3-sonnet", 0), ("gpt-4", 0), ("kimi-2.5", 0), ("other", 0)]
    got = values(spark, rows, models.adjusted_chunk_tokens(F.col("v"), F.col("g")), "v g")
    assert got == [2000, 8192, 4096, 4096, 4096, 2048, 2048, 1024]


def test_handler_codes_follow_rule_order(spark):
    got = values(spark, [(t,) for t, _ in fv.HANDLER_ERROR_RULES], errors.handler_error_code(F.col("v")))
    shadowed = {"配置缺失": "CONFIG_ERROR", "文件未找到": "FILE_SYSTEM_ERROR", "文件权限": "FILE_SYSTEM_ERROR",
                "输入验证": "INPUT_ERROR", "输出路径": "OUTPUT_ERROR", "插件未找到": "PLUGIN_ERROR"}
    assert got == [shadowed.get(t, c) for t, c in fv.HANDLER_ERROR_RULES]
    assert values(spark, [("x",)], errors.handler_error_code(F.col("v"))) == ["UNKNOWN_ERROR"]


def test_run_errors(spark):
    rows = ["HTTP_403: no", "User-Cancelled by hand", "请求超时", "HTTP_504", "模型 Endpoint 无效", "文档解析失败: x", "INVALID_RESPONSE", "?"]
    got = values(spark, [(r,) for r in rows], errors.run_error(F.col("v"))["code"])
    assert got == ["AUTH_FAILED", "CANCELLED", "TIMEOUT", "TIMEOUT", "INVALID_ENDPOINT", "PARSE_FAILED", "INVALID_RESPONSE", "UNKNOWN"]


def test_rolling_hash_and_base36(spark):
    def plain(t):
        h = 0
        for ch in t:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h

    samples = ["", "a", "hello world", "中文分块", "x" * 300]
    assert values(spark, [(s,) for s in samples], keys.rolling_hash(F.col("v"))) == [plain(s) for s in samples]
    assert values(spark, [(-35,), (36,), (0,)], keys.base36(F.col("v"))) == ["-z", "10", "0"]


def test_output_names(spark):
    rows = [("a.b.txt",), (".hidden",), ("no ext",), ('x<y>:"z".pdf',), ("tab\tname.md",)]
    got = values(spark, rows, keys.output_name(F.col("v")))
    assert got == ["a.b_解读.md", ".hidden_解读.md", "no ext_解读.md", "x_y___z__解读.md", "tab_name_解读.md"]


def test_retry_delays(spark):
    assert values(spark, [(1,), (2,), (3,)], models.retry_delay(F.col("v"))) == [4000, 8000, 10000]


def test_duration_labels(spark):
    rows = [(0, 999), (0, 1000), (0, 59949), (0, 60000), (0, 125999), (500, 0)]
    got = values(spark, rows, labels.duration_label(F.col("a"), F.col("b"), F.lit(0)), "a b")
    assert got == ["999ms", "1.0s", "59.9s", "1m 0s", "2m 5s", "0ms"]


def test_first_place_only(spark):
    col = templates.part_prompt(F.col("v"), F.lit(2), F.lit(3), F.lit("{chunk}|{chunk}|{chunk_index}/{total_chunks}"))
    assert values(spark, [("a$1",)], col) == ["a$1|{chunk}|2/3"]


def test_degraded_text(spark):
    got = values(spark, [(["s1", "s2"],)], templates.degraded_text(F.col("v"), F.lit("why")))[0]
    assert got.startswith("由于长文汇总阶段失败") and got.endswith("## 分块 1\ns1\n\n## 分块 2\ns2\n")


def test_bounded_body_limits(spark):
    long = "\n\n".join(["a" * 700] * 40)
    rows = [(long,), ("b" * 20000,), ("short",)]
    got = values(spark, rows, templates.bounded_body(F.col("v")))
    assert [g.applied for g in got] == [True, True, False]
    assert all(g.final_length <= fv.PROMPT_BODY_CHARS for g in got)
    assert got[0].text.endswith(fv.TRUNCATION_NOTICE) and got[0].original_length == len(long)
    assert got[1].final_length == fv.PROMPT_BODY_CHARS


def test_direction_defaults_and_repeats(spark):
    rows = [("nothing",), ("主要研究方向：A\n主要研究方向：B\n子方向：a, b\n子方向：c, d\n置信度：bad\n置信度：1e-1x",)]
    first, second = values(spark, rows, replies.direction(F.col("v")))
    assert (first.main, first.subs, first.confidence) == ("未知", [], 0.7)
    assert (second.main, second.subs, second.confidence) == ("B", ["a", "b", "c"], 0.1)


def test_answer_shapes(spark):
    rows = [
        ('{"choices":[{"message":{"content":[{"text":"a"},"b",3]}}]}', "ab"),
        ('{"choices":[{"message":{"content":null},"delta":{"content":"d"}}]}', "d"),
        ('{"output":[{"content":[{"text":"x"}]},"y"]}', "xy"),
        ('{"content":7,"response":"r"}', "r"),
        ("[]", ""),
        ("nope", ""),
    ]
    got = values(spark, [(r,) for r, _ in rows], replies.answer_text(replies.parse_json(F.col("v"))))
    assert got == [e for _, e in rows]


def test_headings_do_not_depend_on_the_regex_engine(spark):
    """Word ends are those of Latin letters, digits and _; blanks are those of Unicode."""
    cases = {
        "第一章 起": False, "第一章": False, "第一章Intro": True, "第12节_": True, "第三节9": True, "第x章A": False,
        "Abstract": True, "abstract摘要": True, "Abstracts": False, "methods_": False, "Results: x": True, "method是": True,
        "#　题": True, "#题": False, "## 第 3 页": True, "CHAPTER 3 a": True, "section 4b": False, "Section 4，b": True,
        "IV.　x": True, "3.1 x": True, "3.1x": False, "KEY WORDS": True, "KEY": False, "A　B C": True, "Ⅳ. x": False, "ſection 1": False,
    }
    rows = spark.createDataFrame(list(cases.items()), "line string, want boolean")
    wrong = rows.withColumn("got", text.is_section_heading(F.col("line"))).filter("got <> want")
    assert [r.line for r in wrong.collect()] == []
    likely = {"Abstract摘要": True, "Abstract1": False, "##　a": True, "A B C": True, "A：B": False}
    rows = spark.createDataFrame(list(likely.items()), "line string, want boolean").withColumn("got", text.is_likely_heading(F.col("line")))
    assert [r.line for r in rows.filter("got <> want").collect()] == []
