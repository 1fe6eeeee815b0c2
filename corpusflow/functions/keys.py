"""Cache keys, content hashes and output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.text import let, strip

_WORD = 4294967296


def rolling_hash(text: Column) -> Column:
    """Signed 32-bit ``h * 31 + code`` hash over the characters of ``text``.

    Kept for parity with stored keys; new tables should key on ``content_key``.
    """
    codes = F.filter(F.split(text, ""), lambda ch: F.length(ch) > 0)
    unsigned = F.aggregate(
        codes,
        F.lit(0).cast("bigint"),
        lambda h, ch: F.pmod(h * 31 + F.ascii(ch), F.lit(_WORD).cast("bigint")),
    )
    return let(unsigned, lambda h: F.when(h >= _WORD // 2, h - _WORD).otherwise(h))


def base36(value: Column) -> Column:
    """Signed base-36 text with lower-case digits."""
    digits = F.lower(F.conv(F.abs(value).cast("string"), 10, 36))
    return F.when(value < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def short_key(text: Column, model: Column) -> Column:
    """``model:hash`` with the 32-bit hash in base 36."""
    return F.concat(model, F.lit(":"), base36(rolling_hash(text)))


def hex_hash(text: Column) -> Column:
    return F.lower(F.hex(F.abs(rolling_hash(text))))


def content_key(text: Column) -> Column:
    """Collision-safe key of the whole text."""
    return F.sha2(text, 256)


def request_key(
    model: Column,
    endpoint: Column,
    prompt: Column,
    temperature: Column,
    max_tokens: Column,
    prefix_only: bool = False,
) -> Column:
    """Key of a model request.

    The whole prompt is hashed; ``prefix_only`` keeps the first 100 characters
    instead, which collides for long shared instructions.
    """
    part = F.substring(prompt, 1, 100) if prefix_only else content_key(prompt)
    return F.concat_ws(
        "|",
        model,
        endpoint,
        part,
        F.coalesce(temperature.cast("string"), F.lit("0.7")),
        F.coalesce(max_tokens.cast("string"), F.lit("1000")),
    )


def normalize_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    name = F.element_at(F.split(normalize_slashes(path), "/"), -1)
    return F.coalesce(F.nullif(name, F.lit("")), path)


def safe_name(name: Column) -> Column:
    return strip(F.regexp_replace(name, fv.UNSAFE_NAME_CHARS, "_"))


def drop_extension(name: Column) -> Column:
    """Remove the last extension unless the dot is the first character."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def output_name(source_name: Column) -> Column:
    return F.concat(safe_name(drop_extension(source_name)), F.lit(fv.OUTPUT_SUFFIX))


def join_path(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, r"[\\/]+$", ""), F.lit("/"), name)


def file_kind(name: Column) -> Column:
    """pdf, md, txt or null from the extension."""
    lower = F.lower(name)
    kind = F.lit(None).cast("string")
    for k in reversed(fv.FILE_KINDS):
        kind = F.when(lower.endswith(f".{k}"), k).otherwise(kind)
    return kind
