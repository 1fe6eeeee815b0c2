"""Columns that depend on the model name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.text import token_estimate


def _contains_any(name: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in parts])


def model_token_limit(model: Column) -> Column:
    """Context size by exact, case-insensitive name."""
    limits = F.create_map(*[F.lit(x) for pair in fv.MODEL_TOKEN_LIMITS for x in pair])
    return F.coalesce(F.try_element_at(limits, F.lower(model)), F.lit(fv.DEFAULT_MODEL_TOKENS))


def adjusted_chunk_tokens(model: Column, given: Column) -> Column:
    """Tokens per chunk: a positive request wins, else the model family decides."""
    name = F.lower(model)
    family = F.when(F.coalesce(F.length(model), F.lit(0)) == 0, fv.DEFAULT_MODEL_TOKENS)
    for parts, tokens in fv.MODEL_CHUNK_TOKENS:
        family = family.when(_contains_any(name, parts), tokens)
    return F.when(given > 0, given).otherwise(family.otherwise(fv.MODEL_CHUNK_TOKENS_OTHER))


def chunk_token_limit(model: Column, given: Column) -> Column:
    return F.least(adjusted_chunk_tokens(model, given), F.lit(fv.CHUNK_TOKEN_CAP))


def chunk_count(text: Column, model: Column, given: Column) -> Column:
    return F.ceil(token_estimate(text) / chunk_token_limit(model, given)).cast("bigint")


def _first_hit(model: Column, rules, value_at: int, other) -> Column:
    name = F.lower(model)
    out = F.when(name.contains(rules[0][0]), rules[0][value_at])
    for rule in rules[1:]:
        out = out.when(name.contains(rule[0]), rule[value_at])
    return out.otherwise(other)


def call_temperature(model: Column, given: Column) -> Column:
    default = _first_hit(model, fv.MODEL_CALL_DEFAULTS, 1, fv.MODEL_CALL_DEFAULT_OTHER[0])
    return F.coalesce(given, default)


def call_max_tokens(model: Column, given: Column) -> Column:
    default = _first_hit(model, fv.MODEL_CALL_DEFAULTS, 2, fv.MODEL_CALL_DEFAULT_OTHER[1])
    return F.when(given > 0, given).otherwise(default)


def call_top_p(model: Column) -> Column:
    """A later matching family replaces an earlier one; null when none matches."""
    name = F.lower(model)
    hits = [F.when(name.contains(part), F.lit(p)) for part, p in reversed(fv.MODEL_TOP_P)]
    return F.coalesce(*hits)


def clamp(value: Column, bounds: tuple) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(value, F.lit(bounds[1])))


def retry_delay(attempt: Column) -> Column:
    """Wait after failed attempt n: the first delay doubled n times, capped."""
    doubled = F.lit(fv.RETRY_FIRST_MS) * F.pow(F.lit(2), attempt)
    return F.least(doubled, F.lit(float(fv.RETRY_MAX_MS))).cast("bigint")


def retry_allowed(status: Column, attempt: Column) -> Column:
    return ~status.isin(*fv.FINAL_STATUSES) & (attempt < fv.CLIENT_ATTEMPTS)


def enabled_by_priority(models: Column, part: str) -> Column:
    """Enabled models whose name of the model holds ``part``, by priority, then name; orders inside the row."""
    chosen = F.filter(models, lambda m: m["enabled"] & F.contains(m["model"], F.lit(part)))
    keyed = F.transform(chosen, lambda m: F.struct(m["priority"].alias("priority"), m["name"].alias("name"), m["model"].alias("model")))
    return F.array_sort(keyed)
