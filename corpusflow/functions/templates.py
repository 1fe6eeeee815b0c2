"""Fill named places of a fixed text with columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.text import paragraphs, let, strip, strip_right

_PLACE = re.compile(r"\{(\w+)\}")


def render(template: str, **values: Column) -> Column:
    """Concatenate the literal pieces of ``template`` with the given columns."""
    pieces = _PLACE.split(template)
    parts = [
        F.lit(piece) if i % 2 == 0 else values[piece].cast("string")
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*parts)


def fill_first(template: Column, place: str, value: Column) -> Column:
    """Replace only the first occurrence of ``place``, with the value taken literally."""
    at = F.locate(place, template)
    filled = F.concat(
        F.substring(template, F.lit(1), at - 1),
        value,
        F.substring(template, at + len(place), F.length(template)),
    )
    return F.when(at > 0, filled).otherwise(template)


def part_prompt(chunk: Column, number: Column, total: Column, template: Column | None = None) -> Column:
    """Prompt for one part: the user's template if given, else the fixed frame."""
    framed = F.when(total == 1, chunk).otherwise(
        render(fv.PART_PROMPT, index=number, total=total, chunk=chunk)
    )
    if template is None:
        return framed
    filled = fill_first(template, "{chunk}", chunk)
    filled = fill_first(filled, "{chunk_index}", number.cast("string"))
    filled = fill_first(filled, "{total_chunks}", total.cast("string"))
    return F.when(F.length(template) > 0, filled).otherwise(framed)


def bounded_body(text: Column, skip: bool = False, budget: int = fv.PROMPT_BODY_CHARS) -> Column:
    """Prompt body under a length budget as ``struct<text, applied, original_length, final_length>``.

    Whole paragraphs are kept while they fit; the first one that does not fit is
    cut if enough room is left. The kept prefix is found on the paragraph
    lengths alone, so the text is joined once.
    """

    def whole(body: Column) -> Column:
        size = F.length(body).cast("bigint")
        return F.struct(
            body.alias("text"),
            F.lit(False).alias("applied"),
            size.alias("original_length"),
            size.alias("final_length"),
        )

    def cut(body: Column) -> Column:
        room = budget - len(fv.TRUNCATION_NOTICE)

        def from_parts(parts: Column) -> Column:
            start = F.struct(
                F.lit(0).alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full")
            )

            def step(state: Column, part: Column) -> Column:
                need = state["used"] + F.length(part) + F.when(state["kept"] > 0, 2).otherwise(0)
                fits = ~state["full"] & (need <= room)
                return F.struct(
                    F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"),
                    F.when(fits, need).otherwise(state["used"]).alias("used"),
                    (~fits).alias("full"),
                )

            def joined(state: Column) -> Column:
                left = room - state["used"] - F.when(state["kept"] > 0, 2).otherwise(0)
                head = F.slice(parts, F.lit(1), state["kept"])
                following = F.get(parts, state["kept"])
                tail = F.array(strip_right(F.substring(following, F.lit(1), left)))
                kept = F.when(
                    state["full"] & (left > fv.PROMPT_MIN_TAIL), F.concat(head, tail)
                ).otherwise(head)
                return F.concat(strip_right(F.array_join(kept, "\n\n")), F.lit(fv.TRUNCATION_NOTICE))

            return let(F.aggregate(parts, start, step), joined)

        def result(final: Column) -> Column:
            return F.struct(
                final.alias("text"),
                F.lit(True).alias("applied"),
                F.length(body).cast("bigint").alias("original_length"),
                F.length(final).cast("bigint").alias("final_length"),
            )

        return let(let(paragraphs(body), from_parts), result)

    def build(body: Column) -> Column:
        if skip:
            return whole(body)
        return F.when(F.length(body) <= budget, whole(body)).otherwise(cut(body))

    return let(strip(text), build)


def document_prompt(instructions: Column, name: Column, kind: Column, body: Column) -> Column:
    return render(fv.DOCUMENT_PROMPT, instructions=instructions, name=name, kind=kind, body=body)


def chunk_instructions(instructions: Column, number: Column, total: Column) -> Column:
    return render(fv.CHUNK_PROMPT, instructions=instructions, index=number, total=total)


def final_prompt(instructions: Column, name: Column, kind: Column, bundle: Column) -> Column:
    return render(fv.FINAL_PROMPT, instructions=instructions, name=name, kind=kind, bundle=bundle)


def round_prompt(
    instructions: Column,
    name: Column,
    kind: Column,
    bundle: Column,
    number: Column,
    rounds: Column,
    previous: Column,
) -> Column:
    """Prompt of one roll-up round; the previous summary appears from round two on."""
    head = render(
        fv.ROUND_PROMPT_HEAD,
        instructions=instructions,
        name=name,
        kind=kind,
        round=number,
        rounds=rounds,
    )
    carried = F.when(
        (number > 1) & (F.length(previous) > 0), render(fv.ROUND_PROMPT_PREVIOUS, previous=previous)
    ).otherwise(F.lit(""))
    return F.concat(head, carried, render(fv.ROUND_PROMPT_TAIL, bundle=bundle))


def degraded_text(summaries: Column, reason: Column) -> Column:
    """All chunk summaries in order below a fixed notice."""
    blocks = F.transform(
        summaries, lambda s, i: render(fv.DEGRADED_CHUNK, index=i + 1, summary=s)
    )
    head = render(fv.DEGRADED_HEAD, reason=reason)
    # each block ends with a blank line; the last one keeps a single line end
    return F.regexp_replace(F.concat(head, F.array_join(blocks, "")), r"\n\z", "")


def direction_prompt(abstract: Column, introduction: Column, keywords: Column) -> Column:
    def given(c: Column, default: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    return render(
        fv.DIRECTION_PROMPT,
        abstract=given(abstract, fv.NO_ABSTRACT),
        introduction=given(introduction, fv.NO_INTRODUCTION),
        keywords=given(keywords, fv.NO_KEYWORDS),
    )


def merged_results(results: Column) -> Column:
    """Join the non-blank results in order."""
    kept = F.filter(results, lambda r: F.length(strip(r)) > 0)
    return F.array_join(kept, fv.MERGE_SEPARATOR)
