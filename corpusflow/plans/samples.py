"""Fixed words that shape the derived inputs; used by the Spark views and the SQL views."""

from corpusflow import fixed_values as fv

EXTENSIONS = [".pdf", ".MD", ".txt", ".docx"]
HAN_FROM, HAN_TO = "aeio \n", "的一是了　\n"
DIRECTION_LABELS = fv.DIRECTION_LABELS
# name, model, priority, enabled
MODELS = [
    ("Primary", "gpt-4o", 0, True),
    ("Second", "claude-3-haiku-20240307", 1, True),
    ("Spare", "kimi-2.5", 2, True),
    ("Off", "gpt-4", 3, False),
]
MODEL_NAMES = [
    "gpt-4o", "GPT-4-Turbo", "gpt-3.5-turbo", "claude-3-opus-20240229", "gemini-1.5-pro", "kimi-2.5", "kimi-2",
    "local-7b", "",
]
CACHE_MODELS = ["gpt-4o", "kimi-2", "claude-3-haiku-20240307"]
ERROR_MESSAGES = [
    "HTTP_401: bad key", "HTTP_429", "HTTP_404 no route", "HTTP_503", "read timeout", "网络中断", "文档解析失败",
    "文档编码错误", "模型调用失败", "模型不存在", "配置缺失", "文件未找到", "文件权限不足", "权限不足", "并发冲突", "内存不足",
    "请求超时，已在 30000ms 后取消。请增大 Timeout (ms)，或缩短输入内容。", "输出路径错误", "插件未找到", "业务失败", "数据错误",
    "缓存失效", "性能下降", "弃用接口", "user-cancelled", "任务已取消", "HTTP_504", "Endpoint URL 格式无效",
    "Endpoint 返回的不是有效 JSON", "something else",
]
# @t is the turn's text as a JSON string, @n its length
REPLY_SHAPES = [
    '{"choices":[{"message":{"content":@t}}],"usage":{"prompt_tokens":@n,"completion_tokens":3,"total_tokens":@n}}',
    '{"choices":[{"message":{"content":"","reasoning":@t}}]}',
    '{"choices":[{"delta":{"content":[@t,{"text":@t},7]}}],"usage":{"prompt_tokens":@n}}',
    '{"choices":[{"delta":{"reasoning_content":@t}}]}',
    '{"choices":[{"text":@t}],"usage":{"input_tokens":@n,"output_tokens":5}}',
    '{"output_text":@t}',
    '{"output":[{"content":[{"text":@t},{"text":"!"}]},{"text":@t},@t]}',
    '{"error":{"message":@t}}',
    '{"result":@t,"usage":null}',
    '{"message":[@t,"."],"usage":{"promptTokens":1,"completionTokens":@n,"totalTokens":@n}}',
    '{"content":5,"answer":@t}',
    'no json @t',
    '{"choices":[]}',
]
ENDPOINT_PATHS = ["", "/", "/v1", "/V2/", "/v1/chat/completions", "/api/completions/", "/proxy", "/messages", "/v1/messages?x=1", "/v3?key=a#b"]
INSTRUCTIONS = "请总结本文的研究问题、方法与结论。"
NOW_MS = 1706659200000
DAY_MS = 24 * 60 * 60 * 1000

# openings of lines whose headings depend on word ends and on blanks outside ASCII; the long s, which the other engine folds, is in the tests only
HEADING_MARKS = [
    "第一章", "第一章 ", "第12节_", "第三节A", "Abstract", "abstract摘要 ", "methods_", "Results: ", "#　", "##\u00a0第 3 页", "###",
    "CHAPTER\u00a03 ", "section 4b", "IV.　", "3.1\u2003", "KEY\u00a0WORDS", "A　B C", "1.2.", "Ⅳ. ",
]
