"""Text columns in Python tasks, a bounded piece at a time: a batch of Arrow has thousands of rows, however long their texts are."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into Python strings at a time, about; a longer text is a piece of its own.
PIECE_BYTES = 1_000_000


def text_pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Slices of a string column, without copies, whose texts have ``limit`` bytes at most, or are one text.

    What the pieces of a batch have left is given back behind its last one, since workers live on and share an executor's memory.
    """
    sizes = pc.binary_length(texts)
    start, held = 0, 0
    for at, size in enumerate(sizes.to_pylist()):
        if at > start and held + (size or 0) > limit:
            yield texts.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    if start < len(texts):
        yield texts.slice(start)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class LazyTexts:
    """A string column as a sequence that makes its Python strings when they are asked for and holds none."""

    def __init__(self, texts: pa.Array):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, at: int) -> str | None:
        return self.texts[at].as_py()

    def __iter__(self) -> Iterator[str | None]:
        for piece in text_pieces(self.texts):
            yield from piece.to_pylist()
