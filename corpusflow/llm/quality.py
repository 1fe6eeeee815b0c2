"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusflow.llm import common

#: Share of a text's word characters, in percent, that words inside repeated n-grams may hold.
NGRAM_LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Share of the characters of a text's lines, in percent, that repetitions of earlier lines may hold.
LINE_LIMIT = 30
MIN_WORDS = 10
MAX_REPEAT_WORDS = 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["line_chars", "dup_line_chars", *[f"dup_{n}_chars" for n in NGRAM_LIMITS]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Which of the keys stood before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and verdicts of a block of texts."""
    data, offsets = common.text_bytes(column)
    n = len(offsets) - 1
    per_text = lambda of, weights=None: np.bincount(of, weights, minlength=n).astype(np.int64)
    starts, ends, of = common.words(data, offsets)
    chars_before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = chars_before[ends] - chars_before[starts]
    out = {"n_words": per_text(of), "word_chars": per_text(of, chars)}
    out["n_symbols"] = per_text(np.searchsorted(offsets, np.flatnonzero(_SYMBOL[data]), side="right") - 1)

    # lines that hold a word
    is_break = data == 10
    line_starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(is_break) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_of = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_of + 1]) if len(line_starts) else line_starts
    line_ends = line_ends - ((line_ends > line_starts) & is_break[line_ends - 1]) if len(line_starts) else line_ends
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_of = line_starts[with_word], line_ends[with_word], line_of[with_word]
    line_codes = common.codes(data, line_starts, line_ends)
    again = _earlier(line_of * (len(line_codes) + 1) + line_codes)
    line_chars = chars_before[line_ends] - chars_before[line_starts]
    out["n_dup_lines"] = per_text(line_of[again])
    out["line_chars"] = per_text(line_of, line_chars)
    out["dup_line_chars"] = per_text(line_of[again], line_chars[again])

    # rolling hashes of growing length; only places that repeat with n words can repeat with n + 1
    word = common.mix(common.codes(data, starts, ends))
    rolled = np.zeros(len(word), np.uint64)
    place = np.arange(len(word))
    last_word = np.cumsum(out["n_words"])[of] if len(of) else of
    lengths = sorted(NGRAM_LIMITS)
    for size in range(1, lengths[-1] + 1):
        fits = place + size <= last_word[place]
        place, rolled = place[fits], rolled[fits] * _BASE + word[place[fits] + size - 1]
        if size < lengths[0]:
            continue
        twice = _repeated(rolled ^ common.mix(of[place]))
        place, rolled = place[twice], rolled[twice]
        depth = np.bincount(place, minlength=len(word) + 1) - np.bincount(place + size, minlength=len(word) + 1)
        covered = np.cumsum(depth)[: len(word)] > 0
        if size == 5:
            out["n_repeat_words"] = per_text(of[covered])
        if size in NGRAM_LIMITS:
            out[f"dup_{size}_chars"] = per_text(of[covered], chars[covered])

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_WORDS * out["n_words"])
    repeats = 100 * out["dup_line_chars"] > LINE_LIMIT * out["line_chars"]
    for size, limit in NGRAM_LIMITS.items():
        repeats |= 100 * out[f"dup_{size}_chars"] > limit * out["word_chars"]
    out["kept"] = ~(out["base_failed"] | repeats)
    return out


def quality_rules(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` per row, without a shuffle.

    A text fails if it has under 10 words, if over 20 % of its words lie in repeated 5-word windows, if
    repeated lines hold over 30 % of its line characters, or if words in repeated n-grams (5 to 10
    words) hold more than the share in ``NGRAM_LIMITS``. Null and empty texts have no words and fail;
    each repeated row is judged on its own; no rows give no rows; other columns are not read.
    """
    kind = documents.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind)]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in MORE]
    )
    names = schema.fieldNames()[1:]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "_text"):
            found = measure(block.column("_text"))
            yield pa.RecordBatch.from_arrays([block.column("_key"), *[pa.array(found[c]) for c in names]], [key, *names])

    return documents.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(judge, schema)


def keep_good(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns as they are."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, text):
            yield block.filter(pa.array(measure(block.column(text))["kept"]))

    return documents.mapInArrow(judge, documents.schema)
