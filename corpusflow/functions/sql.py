"""The main functions for SQL users, as temporary SQL functions.

Bodies are plain SQL over built-ins, so they are inlined into the plan. The
token chunker comes as an Arrow function: ``SELECT id, inline(cf_token_chunks(text, 1500)) FROM docs``,
the other chunkers as table functions (``table_sql``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusflow import fixed_values as fv
from corpusflow.functions.table_sql import register_tables
from corpusflow.operators.chunking import _token_chunks


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rules(pairs: list[tuple[list[str], str]], subject: str, default: str) -> str:
    whens = [
        f"WHEN {' OR '.join(f'contains({subject}, {_text(t)})' for t in texts)} THEN {_text(code)}"
        for texts, code in pairs
    ]
    return f"CASE {' '.join(whens)} ELSE {_text(default)} END"


def _chunk_tokens() -> str:
    families = " ".join(
        f"WHEN {' OR '.join(f'contains(lower(model), {_text(p)})' for p in parts)} THEN {tokens}"
        for parts, tokens in fv.MODEL_CHUNK_TOKENS
    )
    family = (
        f"CASE WHEN coalesce(length(model), 0) = 0 THEN {fv.DEFAULT_MODEL_TOKENS} {families} "
        f"ELSE {fv.MODEL_CHUNK_TOKENS_OTHER} END"
    )
    return f"least(CASE WHEN given > 0 THEN given ELSE {family} END, {fv.CHUNK_TOKEN_CAP})"


_URL = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)(.*)$"
_PATH = f"regexp_replace(regexp_extract(trim(raw), r'{_URL}', 2), '/+$', '')"
_STRING = "CASE WHEN schema_of_variant({0}) = 'STRING' THEN try_variant_get({0}, '$', 'string') END"
_INNER_TEXT = _STRING.format("try_variant_get(i, '$.text', 'variant')")
_ITEM_TEXT = f"coalesce({_STRING.format('i')}, {_INNER_TEXT}, '')"
_PLACES = ["choices[0].message.content", "choices[0].message.reasoning", "choices[0].delta.content",
           "choices[0].delta.reasoning_content", "choices[0].text", "output_text"]
_FIELDS = ["content", "result", "response", "answer", "text", "message"]


def _definitions(p: str) -> dict[str, str]:
    """Function header and body by header, in dependency order."""
    word, han = f"[!-~À-ɏ[^{fv.BLANK}]]++", fv.HAN_CLASS

    def at(place: str) -> str:
        return f"{p}reply_content(try_variant_get(v, '$.{place}', 'variant'))"

    nested = "try_variant_get(i, '$.content', 'variant')"
    items = (
        "flatten(transform(try_variant_get(v, '$.output', 'array<variant>'), i -> "
        f"CASE WHEN startswith(schema_of_variant({nested}), 'ARRAY') THEN try_variant_get({nested}, '$', 'array<variant>') "
        "ELSE array(i) END))"
    )
    # the first of text, content and the item itself that is there
    present = [f"CASE WHEN schema_of_variant({x}) <> 'VOID' THEN {x} END" for x in ("try_variant_get(i, '$.text', 'variant')", nested)]
    picked = f"transform({items}, i -> coalesce({', '.join(present)}, i))"
    listed = f"array_join(transform(try_variant_get(q, '$', 'array<variant>'), i -> {_ITEM_TEXT}), '')"
    value = f"CASE WHEN startswith(schema_of_variant(q), 'ARRAY') THEN {listed} ELSE {_STRING.format('q')} END"
    output = f"nullif(array_join(transform({picked}, q -> coalesce({value}, '')), ''), '')"
    signed = (
        "aggregate(filter(split(t, ''), c -> length(c) > 0), 0L, (h, c) -> pmod(h * 31 + ascii(c), 4294967296L), "
        "h -> CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)"
    )
    return {
        f"{p}token_estimate(t STRING) RETURNS BIGINT": (
            f"coalesce(ceil(regexp_count(t, r'{han}') / 2) + greatest("
            f"ceil((length(t) - regexp_count(t, r'{han}')) / 4), ceil(regexp_count(t, r'{word}') * 0.75)), 0)"
        ),
        f"{p}chunk_token_limit(model STRING, given INT) RETURNS INT": _chunk_tokens(),
        f"{p}rolling_hash(t STRING) RETURNS BIGINT": signed,
        f"{p}short_key(t STRING, model STRING) RETURNS STRING": (
            f"concat(model, ':', CASE WHEN {p}rolling_hash(t) < 0 THEN '-' ELSE '' END, "
            f"lower(conv(CAST(abs({p}rolling_hash(t)) AS STRING), 10, 36)))"
        ),
        f"{p}chat_endpoint(raw STRING, mode STRING) RETURNS STRING": (
            f"CASE WHEN mode = 'manual' OR try_parse_url(trim(raw), 'PROTOCOL') IS NULL OR NOT trim(raw) RLIKE r'{_URL}' "
            f"THEN trim(raw) ELSE concat(lower(regexp_extract(trim(raw), r'{_URL}', 1)), CASE WHEN {_PATH} = '' "
            f"THEN '/v1/chat/completions' WHEN {_PATH} RLIKE '(?i)/completions$' THEN {_PATH} "
            f"ELSE concat({_PATH}, '/chat/completions') END, regexp_extract(trim(raw), r'{_URL}', 3)) END"
        ),
        f"{p}run_error_code(message STRING) RETURNS STRING": (
            f"CASE WHEN {' OR '.join(f'contains(lower(message), {_text(m)})' for m in fv.CANCEL_MARKS)} THEN 'CANCELLED' ELSE "
            + _rules([(texts, code) for code, texts, _ in fv.RUN_ERROR_RULES], "message", "UNKNOWN")
            + " END"
        ),
        f"{p}handler_error_code(message STRING) RETURNS STRING": _rules(
            [([t], code) for t, code in fv.HANDLER_ERROR_RULES], "message", fv.UNKNOWN_ERROR[0]
        ),
        f"{p}reply_content(v VARIANT) RETURNS STRING": (
            f"nullif(CASE WHEN startswith(schema_of_variant(v), 'ARRAY') THEN array_join(transform("
            f"try_variant_get(v, '$', 'array<variant>'), i -> {_ITEM_TEXT}), '') ELSE {_STRING.format('v')} END, '')"
        ),
        f"{p}reply_answer(v VARIANT) RETURNS STRING": (
            f"coalesce({', '.join(at(x) for x in _PLACES)}, {output}, {', '.join(at(x) for x in _FIELDS)}, '')"
        ),
        f"{p}answer_text(raw STRING) RETURNS STRING": f"{p}reply_answer(try_parse_json(raw))",
    }


def register(spark: SparkSession, prefix: str = "cf_") -> list[str]:
    """Create the functions in this session and return their names."""
    names = []
    for header, body in _definitions(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {header} RETURN {body}")
        names.append(header.split("(")[0])
    spark.udf.register(f"{prefix}token_chunks", _token_chunks)
    return [*names, f"{prefix}token_chunks", *register_tables(spark, prefix)]
