"""Columns over model replies: answers, errors, usage and direction answers."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.text import let, strip

_CHOICE_PATHS = ["message.content", "message.reasoning", "delta.content", "delta.reasoning_content", "text"]
_OTHER_FIELDS = ["content", "result", "response", "answer", "text", "message"]


def parse_json(raw: Column) -> Column:
    """VARIANT, or null for text that is no JSON."""
    return F.try_parse_json(raw)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text_or_null(v: Column) -> Column:
    """The string held by a variant; null for every other type."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _content(v: Column) -> Column:
    """A string, or the joined strings and ``text`` fields of an array; null when empty."""

    def item_text(item: Column) -> Column:
        inner = F.try_variant_get(item, "$.text", "variant")
        return F.coalesce(_text_or_null(item), _text_or_null(inner), F.lit(""))

    items = F.try_variant_get(v, "$", "array<variant>")
    joined = F.array_join(F.transform(items, item_text), "")
    value = F.when(_kind(v).startswith("ARRAY"), joined).otherwise(_text_or_null(v))
    return F.nullif(value, F.lit(""))


def _field(v: Column, path: str) -> Column:
    return _content(F.try_variant_get(v, path, "variant"))


def _output_items(v: Column) -> Column:
    """Texts of the ``output`` array; an item with a content array is replaced by that array."""

    def flat(item: Column) -> Column:
        nested = F.try_variant_get(item, "$.content", "variant")
        is_array = F.coalesce(_kind(nested).startswith("ARRAY"), F.lit(False))
        return F.when(is_array, F.try_variant_get(nested, "$", "array<variant>")).otherwise(F.array(item))

    def text_of(item: Column) -> Column:
        pick = [F.try_variant_get(item, p, "variant") for p in ("$.text", "$.content")]
        present = [F.when(_kind(p) != "VOID", p) for p in pick]
        return F.coalesce(_content(F.coalesce(*present, item)), F.lit(""))

    output = F.try_variant_get(v, "$.output", "variant")
    items = F.when(_kind(output).startswith("ARRAY"), F.try_variant_get(output, "$", "array<variant>"))
    joined = F.array_join(F.transform(F.flatten(F.transform(items, flat)), text_of), "")
    return F.nullif(joined, F.lit(""))


def answer_text(v: Column) -> Column:
    """Answer of a parsed reply: the first non-empty of the known places, else empty."""
    choices = [_field(v, f"$.choices[0].{p}") for p in _CHOICE_PATHS]
    others = [_field(v, f"$.{f}") for f in _OTHER_FIELDS]
    return F.coalesce(*choices, _field(v, "$.output_text"), _output_items(v), *others, F.lit(""))


def error_text(v: Column) -> Column:
    """``error.message`` when it is a non-empty string."""
    return F.nullif(_text_or_null(F.try_variant_get(v, "$.error.message", "variant")), F.lit(""))


def usage(v: Column, root: str = "$.usage") -> Column:
    """``struct<prompt, completion, total>``; null without a usage object."""
    node = F.try_variant_get(v, root, "variant")

    def counter(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"{root}.{n}", "bigint") for n in names])

    return F.when(
        _kind(node).startswith("OBJECT"),
        F.struct(
            counter("prompt_tokens", "promptTokens", "input_tokens").alias("prompt"),
            counter("completion_tokens", "completionTokens", "output_tokens").alias("completion"),
            counter("total_tokens", "totalTokens").alias("total"),
        ),
    )


def sse_data(line: Column) -> Column:
    """Payload of a ``data:`` line; null for other lines and for the end mark."""
    t = strip(line)
    payload = strip(F.substring(t, 6, 2**31 - 1))
    return F.when(t.startswith("data:") & (payload != "[DONE]") & (payload != ""), payload)


def sse_event(line: Column) -> Column:
    """Event name of an ``event:`` line; null for other lines."""
    t = strip(line)
    return F.when(t.startswith("event:"), strip(F.substring(t, 7, 2**31 - 1)))


def direction(answer: Column) -> Column:
    """``struct<main, subs, keywords, confidence>`` from labelled answer lines.

    The last main line wins, lists grow over repeated lines and are capped, and
    the confidence accepts a numeric prefix.
    """
    main, subs, keywords, confidence = fv.DIRECTION_LABELS

    def from_lines(lines: Column) -> Column:
        def values(label: str) -> Column:
            hits = F.filter(lines, lambda x: x.startswith(label))
            return F.transform(hits, lambda x: F.substring(x, len(label) + 1, 2**31 - 1))

        def listed(label: str, cap: int) -> Column:
            split = F.transform(values(label), lambda x: F.transform(F.split(x, ","), strip))
            return F.slice(F.flatten(split), 1, cap)

        number = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
        numbers = F.filter(
            F.transform(
                values(confidence), lambda x: F.regexp_extract(x, number, 1).try_cast("double")
            ),
            lambda n: n.isNotNull(),
        )
        return F.struct(
            F.coalesce(strip(F.try_element_at(values(main), F.lit(-1))), F.lit(fv.UNKNOWN_DIRECTION)).alias(
                "main"
            ),
            listed(subs, fv.MAX_SUB_DIRECTIONS).alias("subs"),
            listed(keywords, fv.MAX_KEYWORDS).alias("keywords"),
            F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(fv.DEFAULT_CONFIDENCE)).alias(
                "confidence"
            ),
        )

    return let(F.transform(F.split(answer, "\n"), strip), from_lines)


def direction_tags(text: Column) -> Column:
    """The known research directions a text mentions, in their fixed order."""
    return F.filter(
        F.array(*[F.lit(d) for d in fv.RESEARCH_DIRECTIONS]), lambda label: text.contains(label)
    )


def debounced(pieces: Column, interval_ms: int = fv.PROGRESS_INTERVAL_MS) -> Column:
    """Pieces of ``array<struct<at_ms, text>>`` sent on: more than the interval after the last one sent.

    Only the times go to Python, where one pass over each array finds the places of the pieces to send; a fold of columns would copy
    what was sent so far for every piece. A null time is never due.
    """

    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for times in batches:
            ends, places = [0], array("i")
            offsets, values = times.offsets.to_pylist(), times.values.fill_null(-(2**63)).to_numpy()
            for row in range(len(times)):
                last = 0
                for place, at in enumerate(values[offsets[row] : offsets[row + 1]].tolist()):
                    if at - last > interval_ms:
                        places.append(place)
                        last = at
                ends.append(len(places))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            yield pc.if_else(times.is_valid(), found, pa.scalar(None, found.type)) if times.null_count else found

    walk.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    due = F.arrow_udf(walk, "array<int>")(F.transform(pieces, lambda p: p["at_ms"].cast("bigint")))
    both = F.struct(pieces.alias("pieces"), due.alias("due"))
    return let(both, lambda b: F.transform(b["due"], lambda place: F.get(b["pieces"], place)))
