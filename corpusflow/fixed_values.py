"""Values that outputs must match exactly: texts, tables, limits and patterns.

Nothing here is logic. Both the column functions and the SQL oracles read these
names, so that a wording or a limit is stated once.
"""

# --- fixed values: blanks ------------------------------------------------------
# The Unicode blanks that count as white space (tab..CR, space, NBSP, BOM, ...).
BLANK_CHARS = (
    "\t\n\x0b\x0c\r              "
    "    　﻿"
)
# The same set as a regex class body; valid in java.util.regex and in RE2.
BLANK = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
HAN_CLASS = r"[\x{4e00}-\x{9fa5}]"

# --- fixed values: sizes and limits --------------------------------------------
CHUNK_TOKEN_CAP = 1500
OVERLAP_TOKEN_CAP = 100
DEFAULT_MODEL_TOKENS = 8192
TEXT_CHUNK_SIZE = 8000
TEXT_CHUNK_COUNT = 20
CLIENT_CHUNK_SIZE = 6000
CLIENT_CHUNK_COUNT = 15
PROMPT_BODY_CHARS = 15000
PROMPT_MIN_TAIL = 80
SUMMARY_CHARS = 12000
SHRUNK_SUMMARY_CHARS = 3000
PREVIEW_CHARS = 120
ROUND_SIZE = 5
CACHE_TTL_MS = 24 * 60 * 60 * 1000
CACHE_MIN_TTL_MS = 60 * 1000
RATE_MAX_REQUESTS = 5
RATE_WINDOW_MS = 60000
RATE_WAIT_MARGIN_MS = 100
LINE_MERGE_GAP = 4
EDGE_MIN_REPEAT = 3
EDGE_MAX_CHARS = 120
HISTORY_SIZE = 1000
UI_LOG_SIZE = 200
NOTIFICATION_SIZE = 20
LOG_HISTORY_FLOOR = 100
REPORT_TOP = 10
MAX_SUB_DIRECTIONS = 3
MAX_KEYWORDS = 5
DEFAULT_CONFIDENCE = 0.7
PROGRESS_INTERVAL_MS = 100
RETRY_FIRST_MS = 2000
RETRY_MAX_MS = 10000
CLIENT_ATTEMPTS = 3
FINAL_STATUSES = [401, 403, 404]

# --- fixed values: models --------------------------------------------------------
MODEL_TOKEN_LIMITS = [
    ("gpt-4o", 128000),
    ("gpt-4o-mini", 128000),
    ("gpt-4-turbo", 128000),
    ("gpt-4", 8192),
    ("gpt-3.5-turbo", 16384),
    ("claude-3-opus-20240229", 200000),
    ("claude-3-sonnet-20240229", 200000),
    ("claude-3-haiku-20240307", 200000),
    ("gemini-1.5-pro", 1048576),
    ("gemini-1.5-flash", 1048576),
    ("kimi-2.5", 100000),
    ("kimi-2", 100000),
]
# (name parts, chunk tokens), first hit wins
MODEL_CHUNK_TOKENS = [
    (("gpt-4o", "gemini-1.5", "claude-3"), 4096),
    (("gpt-4", "kimi-2.5"), 2048),
]
MODEL_CHUNK_TOKENS_OTHER = 1024
# (name part, temperature, max tokens), first hit wins
MODEL_CALL_DEFAULTS = [
    ("gpt-4", 0.7, 2048),
    ("gpt-3.5", 0.8, 1024),
    ("claude", 0.6, 1500),
    ("kimi", 0.7, 1500),
]
MODEL_CALL_DEFAULT_OTHER = (0.7, 1024)
# (name part, top_p); a later hit replaces an earlier one
MODEL_TOP_P = [("gpt", 0.95), ("claude", 0.9), ("kimi", 0.9)]
TEMPERATURE_RANGE = (0.0, 2.0)
MAX_TOKENS_RANGE = (1, 4096)

# --- fixed values: file kinds and names --------------------------------------------
FILE_KINDS = ["pdf", "md", "txt"]
OUTPUT_SUFFIX = "_解读.md"
UNSAFE_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1F]'
BIB_ID_PREFIX = "zotero-"
BIB_NAME_PREFIX = "Zotero Item "

# --- fixed values: headings and paragraph patterns -----------------------------------
# word ends and blanks are spelled out: what a short form matches behind Chinese marks differs between regex engines
WORD_END = "(?:[^A-Za-z0-9_]|$)"
SECTION_HEADING_MAX = 120
SECTION_HEADING_PATTERNS = [
    f"^#{{1,6}}[{BLANK}]+",
    f"^##[{BLANK}]*第[{BLANK}]*[0-9]+[{BLANK}]*页$",
    f"(?i)^(abstract|introduction|background|methods?|materials? and methods?|results?"
    f"|discussion|conclusion|references|keywords){WORD_END}",
    f"(?i)^(chapter[{BLANK}]+[0-9]+|section[{BLANK}]+[0-9]+){WORD_END}",
    # a chapter mark counts where a Latin letter, a digit or _ follows at once
    "^(第[一二三四五六七八九十百零0-9]+章|第[一二三四五六七八九十百零0-9]+节)[A-Za-z0-9_]",
    f"^([0-9]+([.．][0-9]+)*[.．]?|[IVXLC]+[.．])[{BLANK}]+",
    f"^[A-Z][A-Z{BLANK}0-9,&/:-]{{3,}}$",
]
LIKELY_HEADING_MAX = 90
LIKELY_HEADING_PATTERNS = [
    f"(?i)^(abstract|introduction|conclusion|references|keywords){WORD_END}",
    f"^#+[{BLANK}]",
    f"^[A-Z][A-Z{BLANK}0-9,&/-]{{3,}}$",
]
PARAGRAPH_END_PATTERN = r"[.!?：:]$"
PARAGRAPH_START_PATTERNS = [r"^[-•*]\s", r"^\d+[.)]\s"]
PARAGRAPH_SPLIT = f"\\n[{BLANK}]*\\n"
PAGE_SPLIT = r"\f"
# the latest of the first, or the first found of the second, past the middle of a window
TEXT_BREAKS = ["\n\n", "。", "\f"]
PAGE_BREAKS = ["\n\n", "。\n", "。", "\n"]
# section marks tried in this order by the token chunker
CHUNK_SECTION_PATTERNS = [r"\n#\s", r"\n##\s", r"\n###\s", r"\n\d+\.\s", r"\n[A-Z][a-z]+\s*:"]
SENTENCE_ENDS = [". ", "! ", "? ", ".\n", "!\n", "?\n"]

# --- fixed values: prompts and reports --------------------------------------------------
TRUNCATION_NOTICE = (
    "\n\n[内容过长，已为模型调用自动截断。当前已优先保留前部完整段落，"
    "并在容量边界处截取剩余正文；如需完整分析，请分段处理原文。]"
)
DOCUMENT_PROMPT = (
    "你将阅读一篇文献或文本材料。请严格按照以下要求进行解读：\n\n{instructions}\n\n"
    "以下是文献内容：\n文件名：{name}\n文件类型：{kind}\n文献正文：\n{body}"
)
CHUNK_PROMPT = (
    "{instructions}\n\n补充要求：当前仅处理整篇文献的第 {index}/{total} 个分块。\n"
    "请只基于当前分块输出结构化阶段性解读，明确保留：研究目标、方法、数据/实验、关键发现、局限性。\n"
    "如果当前分块信息不完整，请明确说明“本分块未提供足够信息”。"
)
FINAL_PROMPT = (
    "你将收到一篇长文献分块解读后的阶段性结果，请综合它们输出最终完整解读。\n\n{instructions}\n\n"
    "补充要求：\n- 需要合并重复信息，消除前后冲突\n- 如果不同分块信息不一致，请明确指出\n"
    "- 输出时不要再按“分块 1/2/3”组织，而是生成面向整篇文献的一体化结论\n\n"
    "文件名：{name}\n文件类型：{kind}\n以下是各分块的阶段性解读：\n{bundle}"
)
ROUND_PROMPT_HEAD = (
    "你将收到一篇长文献分块解读后的阶段性结果，请综合它们输出汇总解读。\n\n{instructions}\n\n"
    "补充要求：\n- 需要合并重复信息，消除前后冲突\n- 如果不同分块信息不一致，请明确指出\n"
    "- 输出时按逻辑组织，保持连贯性\n\n文件名：{name}\n文件类型：{kind}\n"
    "汇总阶段：第 {round}/{rounds} 轮"
)
ROUND_PROMPT_PREVIOUS = "\n\n以下是前一轮的汇总结果（请与本轮新内容合并）：\n{previous}"
ROUND_PROMPT_TAIL = "\n\n以下是本轮待汇总的分块阶段性解读：\n{bundle}"
PART_PROMPT = (
    "【文档第 {index}/{total} 部分】\n\n{chunk}\n\n---\n\n请继续解读以上内容。"
    '如果这是开头部分，请说明"上文是文档的开头"；如果是中间部分，请说明"上文是文档的中间部分"；'
    '如果是结尾部分，请说明"上文是文档的结尾"。'
)
CHUNK_HEADER = "### 分块 {index}\n"
CHUNK_HEADER_PATTERN = r"^###\s+分块\s+\d+\s*"
DEGRADED_HEAD = (
    "由于长文汇总阶段失败，当前结果已自动降级为“分块摘要拼接版”。\n\n汇总失败原因：{reason}\n\n"
    "以下为各分块阶段性解读，可用于人工复核或后续再次汇总：\n\n"
)
DEGRADED_CHUNK = "## 分块 {index}\n{summary}\n\n"
ROUND_FAILURE = "汇总分块 {first}-{last} 时失败: {error}"
EMPTY_PREVIEW = "模型已返回成功响应，但内容为空。"
MERGE_SEPARATOR = "\n\n---\n\n"
PAGE_HEADER = "## 第 {page} 页\n"
DIRECTION_PROMPT = (
    "请分析以下论文的研究方向，并返回结构化的分析结果：\n\n### 摘要\n{abstract}\n\n### 引言\n{introduction}\n\n"
    "### 关键词\n{keywords}\n\n请按照以下格式返回分析结果：\n\n主要研究方向：[主要方向]\n"
    "子方向：[子方向1], [子方向2], [子方向3]\n"
    "核心关键词：[关键词1], [关键词2], [关键词3], [关键词4], [关键词5]\n置信度：[0-1之间的数值]\n\n要求：\n"
    "1. 主要研究方向要简洁明了，不超过10个字\n2. 子方向最多3个，每个不超过8个字\n"
    "3. 核心关键词最多5个，每个不超过5个字\n4. 置信度是你对分析结果的自信程度，范围0-1\n"
    "5. 只返回结构化结果，不要添加其他说明文字"
)
NO_ABSTRACT = "未提供摘要"
NO_INTRODUCTION = "未提供引言"
NO_KEYWORDS = "未提供关键词"
DIRECTION_LABELS = ["主要研究方向：", "子方向：", "核心关键词：", "置信度："]
UNKNOWN_DIRECTION = "未知"
RESEARCH_DIRECTIONS = [
    "机器学习", "自然语言处理", "计算机视觉", "人工智能", "数据挖掘", "信息检索", "推荐系统", "网络安全",
    "云计算", "物联网", "区块链", "大数据", "边缘计算", "量子计算", "人机交互",
]
REPORT_TITLE = "# 文献解读结果\n\n## 基本信息\n"
REPORT_FIELDS = ["- 源文件名：", "- 源文件路径：", "- 文件类型：", "- 使用模型：", "- 接口摘要：", "- 使用模板：",
                 "- 处理时间：", "- 是否截断正文："]
REPORT_CUT_DETAIL = "（原始正文长度：{original}，送模正文长度：{final}）"
REPORT_NO_TEMPLATE = "自由提示词"
REPORT_YES, REPORT_NO, REPORT_UNKNOWN, REPORT_NONE = "是", "否", "未知", "无"
REPORT_CHUNKING_OFF = "- 长文分块：未启用"
REPORT_CHUNKING_ON = "- 长文分块：已启用"
REPORT_CHUNKING_FIELDS = ["  - 分块数量: ", "  - 原始正文长度: ", "  - 汇总输入长度: ", "  - 最大Tokens: ",
                          "  - 是否降级输出: ", "  - 降级原因: "]
REPORT_DIRECTION = "- 研究方向分析："
REPORT_DIRECTION_FIELDS = ["  - 主要方向: ", "  - 子方向: ", "  - 核心关键词: ", "  - 置信度: "]
REPORT_USAGE_OFF = "- Token 统计：未提供"
REPORT_USAGE_ON = "- Token 统计："
REPORT_USAGE_FIELDS = ["  - promptTokens: ", "  - completionTokens: ", "  - totalTokens: "]
REPORT_BODY = "## 解读内容"
REPORT_APPENDIX = "## 分块阶段性摘要附录\n以下内容用于辅助核对长文汇总过程，保留各分块的阶段性解读结果。\n"
BATCH_TITLE = "# 批处理报告\n"
BATCH_FIELDS = ["- 生成时间：", "- 总任务数：", "- 已完成：", "- 失败：", "- 已取消：", "- 跳过已有输出："]
BATCH_ITEMS_TITLE = "\n## 任务明细\n"
BATCH_ITEM_FIELDS = ["### ", "- 状态：", "- 尝试次数：", "- 输出路径：", "- 错误码：", "- 错误信息："]

# --- fixed values: labels --------------------------------------------------------------
STATUS_LABELS = [("success", "已完成"), ("failed", "失败"), ("cancelled", "已取消"), ("running", "执行中"),
                 ("pending", "等待中")]
SKIPPED_LABEL = "已跳过（沿用已有输出）"
CHUNKING_LABELS = {
    "none": "暂无长文处理信息",
    "off": "本次任务未启用长文分块",
    "on": "已启用长文分块，共 {count} 个分块。",
    "degraded": "本次输出已触发降级。",
    "kept": "本次输出未触发降级。",
    "reason": "降级原因：",
}
ITEM_CHUNKING_LABELS = {
    "off": "长文状态：未启用分块",
    "on": "长文状态：已分块（{count} 段）",
    "kept": "；未降级",
    "degraded": "；已降级",
    "reason": "；已降级：",
}
LOG_LEVELS = ["debug", "info", "warn", "error"]
RETRY_MESSAGE = "第 {attempt} 次尝试失败：{message}"
CANCELLED_TEXT = "任务已取消"
UNKNOWN_REASON = "未知原因"

# --- fixed values: run errors ------------------------------------------------------------
# (code, texts that select it, replacement message or None to keep the raw one); first hit wins
CANCEL_MARKS = ["任务已取消", "user-cancelled", "cancelled"]
RUN_ERROR_RULES = [
    ("AUTH_FAILED", ["HTTP_401", "HTTP_403"], "鉴权失败：API Key 无效、无权限，或当前模型不允许访问。"),
    ("ENDPOINT_NOT_FOUND", ["HTTP_404"], "接口地址无效：未找到目标接口，请检查 Endpoint 与路径模式配置。"),
    ("RATE_LIMITED", ["HTTP_429"], "请求被限流：请稍后重试，或降低批处理并发数。"),
    ("TIMEOUT", ["请求超时", "HTTP_408", "HTTP_504"], None),
    ("INVALID_ENDPOINT",
     ["Endpoint 返回的是 HTML 页面", "Endpoint URL 格式无效", "模型 Endpoint 无效"], None),
    ("PARSE_FAILED", ["文档解析失败"], None),
    ("INVALID_RESPONSE", ["Endpoint 返回的不是有效 JSON", "INVALID_RESPONSE", "模型返回格式不兼容"],
     "模型返回格式不兼容：当前服务不是标准 OpenAI-compatible chat completions 响应。"),
]
# (text, code); first hit wins
HANDLER_ERROR_RULES = [
    ("HTTP_401", "API_KEY_ERROR"), ("HTTP_429", "API_RATE_LIMIT"), ("HTTP_404", "API_NOT_FOUND"),
    ("HTTP_503", "API_SERVICE_UNAVAILABLE"), ("timeout", "TIMEOUT_ERROR"), ("网络", "NETWORK_ERROR"),
    ("文档解析", "DOCUMENT_PARSE_ERROR"), ("文档编码", "DOCUMENT_ENCODING_ERROR"), ("模型调用", "MODEL_ERROR"),
    ("模型不存在", "MODEL_NOT_FOUND"), ("模型负载", "MODEL_OVERLOADED"), ("配置", "CONFIG_ERROR"),
    ("配置缺失", "CONFIG_MISSING"), ("文件", "FILE_SYSTEM_ERROR"), ("文件未找到", "FILE_NOT_FOUND"),
    ("文件权限", "FILE_PERMISSION_ERROR"), ("权限", "PERMISSION_ERROR"), ("并发", "CONCURRENCY_ERROR"),
    ("内存", "MEMORY_ERROR"), ("输入", "INPUT_ERROR"), ("输入验证", "INPUT_VALIDATION_ERROR"),
    ("输出", "OUTPUT_ERROR"), ("输出路径", "OUTPUT_PATH_ERROR"), ("插件", "PLUGIN_ERROR"),
    ("插件未找到", "PLUGIN_NOT_FOUND"), ("业务", "BUSINESS_ERROR"), ("数据", "DATA_ERROR"),
    ("缓存", "CACHE_ERROR"), ("性能", "PERFORMANCE_WARNING"), ("弃用", "DEPRECATION_WARNING"),
]
UNKNOWN_ERROR = ("UNKNOWN_ERROR", "未知错误", "请稍后重试，或联系系统管理员。", "error")
DEFAULT_RETRY_DELAY_MS = 1000
UNKNOWN_CATEGORY = "unknown"
# (code, message, details, suggestion, severity, category, retryable, delay ms)
ERROR_CATALOG = [
    ("NETWORK_ERROR", "网络连接失败", "无法连接到服务器，请检查您的网络连接后重试。",
     "检查网络连接，确保您的设备已连接到互联网。", "error", "network", True, 2000),
    ("TIMEOUT_ERROR", "请求超时", "服务器响应时间过长，可能是网络延迟或服务器负载过高。",
     "尝试增加超时时间，或检查网络连接。", "error", "network", True, 3000),
    ("NETWORK_UNSTABLE", "网络连接不稳定", "网络连接时断时续，可能导致操作失败。",
     "检查网络连接稳定性，或尝试使用有线网络。", "warning", "network", True, 1000),
    ("API_KEY_ERROR", "API Key 无效", "提供的API Key无效或已过期。", "请检查并更新您的API Key。",
     "error", "api", False, None),
    ("API_RATE_LIMIT", "API 调用频率限制", "您已达到API的调用频率限制，请稍后再试。",
     "等待一段时间后重试，或减少请求频率。", "error", "api", True, 5000),
    ("API_NOT_FOUND", "API 端点不存在", "请求的API端点不存在或已更改。", "请检查API端点地址是否正确。",
     "error", "api", False, None),
    ("API_SERVICE_UNAVAILABLE", "API 服务不可用", "API服务暂时不可用，可能是服务器维护或故障。",
     "稍后重试，或检查API服务状态。", "error", "api", True, 10000),
    ("DOCUMENT_PARSE_ERROR", "文档解析失败", "无法解析文档，可能是文档格式不支持或文件损坏。",
     "尝试使用其他格式的文档，或确保文件未损坏。", "error", "document", False, None),
    ("DOCUMENT_TOO_LARGE", "文档过大", "文档大小超过了系统处理限制。", "尝试分割文档，或使用更小的文档。",
     "error", "document", False, None),
    ("DOCUMENT_ENCODING_ERROR", "文档编码错误", "无法正确解析文档编码。", "尝试使用UTF-8编码的文档。",
     "error", "document", False, None),
    ("MODEL_ERROR", "模型调用失败", "模型处理请求时发生错误。", "检查模型配置，或尝试使用其他模型。",
     "error", "model", True, 2000),
    ("MODEL_NOT_FOUND", "模型不存在", "请求的模型不存在或不可用。", "检查模型名称是否正确，或尝试使用其他模型。",
     "error", "model", False, None),
    ("MODEL_OVERLOADED", "模型负载过高", "模型服务负载过高，暂时无法处理请求。", "稍后重试，或尝试使用其他模型。",
     "error", "model", True, 5000),
    ("SYSTEM_ERROR", "系统错误", "系统内部发生错误。", "请稍后重试，或联系系统管理员。",
     "error", "system", True, 1000),
    ("SYSTEM_RESOURCE_ERROR", "系统资源错误", "系统资源不足，无法完成操作。", "关闭不必要的应用程序，或增加系统资源。",
     "error", "system", False, None),
    ("CONFIG_ERROR", "配置错误", "系统配置无效或不完整。", "检查并更新系统配置。",
     "error", "config", False, None),
    ("CONFIG_MISSING", "配置缺失", "系统缺少必要的配置项。", "检查并添加缺失的配置项。",
     "error", "config", False, None),
    ("FILE_SYSTEM_ERROR", "文件系统错误", "文件系统操作失败，可能是权限不足或磁盘空间不足。", "检查文件权限和磁盘空间。",
     "error", "file", False, None),
    ("FILE_NOT_FOUND", "文件未找到", "请求的文件不存在。", "检查文件路径是否正确。",
     "error", "file", False, None),
    ("FILE_PERMISSION_ERROR", "文件权限错误", "没有足够的权限访问文件。", "检查文件权限设置。",
     "error", "file", False, None),
    ("PERMISSION_ERROR", "权限错误", "没有足够的权限执行操作。", "检查系统权限设置。",
     "error", "permission", False, None),
    ("CONCURRENCY_ERROR", "并发错误", "并发操作冲突，可能是多个操作同时访问同一资源。", "稍后重试操作。",
     "error", "concurrency", True, 1000),
    ("MEMORY_ERROR", "内存错误", "系统内存不足，无法完成操作。", "关闭不必要的应用程序，或增加系统内存。",
     "error", "system", False, None),
    ("INPUT_ERROR", "输入错误", "输入数据无效或不完整。", "检查输入数据是否正确。",
     "error", "input", False, None),
    ("INPUT_VALIDATION_ERROR", "输入验证错误", "输入数据未通过验证。", "检查输入数据是否符合要求。",
     "error", "input", False, None),
    ("OUTPUT_ERROR", "输出错误", "无法写入输出文件。", "检查输出路径权限和磁盘空间。",
     "error", "output", False, None),
    ("OUTPUT_PATH_ERROR", "输出路径错误", "输出路径不存在或无法访问。", "检查输出路径是否正确。",
     "error", "output", False, None),
    ("PLUGIN_ERROR", "插件错误", "插件加载或执行失败。", "检查插件是否兼容，或禁用有问题的插件。",
     "error", "plugin", False, None),
    ("PLUGIN_NOT_FOUND", "插件未找到", "请求的插件不存在。", "检查插件名称是否正确。",
     "error", "plugin", False, None),
    ("PERFORMANCE_WARNING", "性能警告", "操作执行时间过长，可能影响系统性能。", "考虑优化操作或增加系统资源。",
     "warning", "performance", None, None),
    ("DEPRECATION_WARNING", "弃用警告", "使用了已弃用的功能，可能在未来版本中被移除。", "更新代码以使用推荐的替代方案。",
     "warning", "deprecation", None, None),
    ("INFO_MESSAGE", "信息提示", "操作执行信息。", "", "info", "info", None, None),
    ("BUSINESS_ERROR", "业务逻辑错误", "业务逻辑执行失败。", "检查业务参数是否正确。",
     "error", "business", False, None),
    ("DATA_ERROR", "数据错误", "数据处理失败。", "检查数据是否正确。", "error", "data", False, None),
    ("CACHE_ERROR", "缓存错误", "缓存操作失败。", "检查缓存配置。", "error", "cache", True, 1000),
]
