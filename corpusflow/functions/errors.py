"""Error codes from raw messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv


def _mentions(message: Column, texts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [message.contains(t) for t in texts])


def run_error(message: Column) -> Column:
    """``struct<code, message>``; rules are tried in order on the raw message."""

    def outcome(code: str, text: str | None) -> Column:
        kept = message if text is None else F.lit(text)
        return F.struct(F.lit(code).alias("code"), kept.alias("message"))

    chain = F.when(
        _mentions(F.lower(message), fv.CANCEL_MARKS), outcome("CANCELLED", fv.CANCELLED_TEXT)
    )
    for code, texts, replacement in fv.RUN_ERROR_RULES:
        chain = chain.when(_mentions(message, texts), outcome(code, replacement))
    return chain.otherwise(outcome("UNKNOWN", None))


def handler_error_code(message: Column) -> Column:
    """First matching rule wins; a later, longer text can be shadowed by a shorter one."""
    first_text, first_code = fv.HANDLER_ERROR_RULES[0]
    chain = F.when(message.contains(first_text), first_code)
    for text, code in fv.HANDLER_ERROR_RULES[1:]:
        chain = chain.when(message.contains(text), code)
    return chain.otherwise(fv.UNKNOWN_ERROR[0])
