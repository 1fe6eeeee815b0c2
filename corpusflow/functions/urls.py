"""Endpoint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import let, strip, strip_left

# scheme://authority, path, then query and fragment
_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)([^?#]*)(.*)$"


def is_url(c: Column) -> Column:
    return F.try_parse_url(strip(c), F.lit("PROTOCOL")).isNotNull()


def is_non_empty(c: Column) -> Column:
    return F.length(strip(c)) > 0


def _chat_path(path: Column) -> Column:
    p = F.regexp_replace(path, r"/+$", "")
    return (
        F.when(p == "", F.lit("/v1/chat/completions"))
        .when(p.rlike(r"(?i)/completions$"), p)
        .otherwise(F.concat(p, F.lit("/chat/completions")))
    )


def chat_endpoint(raw: Column, mode: Column) -> Column:
    """Complete an endpoint to the chat path; manual mode and bad URLs stay as given."""

    def complete(t: Column) -> Column:
        ok = is_url(t) & t.rlike(_URL)
        head, path, rest = (F.regexp_extract(t, _URL, i) for i in (1, 2, 3))
        return F.when((mode == "manual") | ~ok, t).otherwise(
            F.concat(F.lower(head), _chat_path(path), rest)
        )

    return let(strip(raw), complete)


def messages_endpoint(raw: Column) -> Column:
    """Complete an endpoint to the messages path."""
    base = F.regexp_replace(raw, r"/+$", "")
    return (
        F.when(base.endswith("/messages"), base)
        .when(base.rlike(r"(?i)/v\d+$"), F.concat(base, F.lit("/messages")))
        .otherwise(F.concat(base, F.lit("/v1/messages")))
    )


def endpoint_summary(raw: Column) -> Column:
    """``scheme://host/path`` or a fixed mark for an invalid endpoint."""
    path = F.coalesce(F.nullif(F.regexp_extract(raw, _URL, 2), F.lit("")), F.lit("/"))
    return F.when(
        is_url(raw) & raw.rlike(_URL), F.concat(F.lower(F.regexp_extract(raw, _URL, 1)), path)
    ).otherwise(F.lit("invalid-endpoint"))


def sniff_payload(text: Column) -> Column:
    """html, sse or other from the first characters of a payload."""
    head = F.lower(F.substring(strip_left(text), 1, 200))
    return (
        F.when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
        .when(head.startswith("data:"), "sse")
        .otherwise("other")
    )
