"""Token ids of whole texts from the ids of their white-space chunks.

Both BPE vocabularies split a text at white space before any merge, so the ids
of a text are the ids of its chunks put together. A batch of texts is cut into
chunks with numpy, Arrow finds the distinct ones, and only chunks that this
worker has not met yet go through the tokenizer library. The memo is bounded:
when it holds ``MEMO_CHUNKS`` entries, those of one block only are dropped, or
all if that leaves more than half of it.

Texts where the cut is not certain (white space outside ASCII, text that is not
in composed form, anything that may hold a special string) go to the library
whole. The result is the library's for every text.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from codecs import charmap_decode
from collections import defaultdict
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa

MEMO_CHUNKS = 400_000

_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]|<\\|")

#: Bytes of which one is in every match of ``_ODD`` outside ASCII; a text that has one is looked at closely.
_ODD_BYTES = [*(chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, 0x3000, 0xFEFF)), b"\xe2\x80", b"\xe2\x81"]
_ODD_ASCII = ["<|", "\x1c", "\x1d", "\x1e", "\x1f"]
#: Marks that are neither letters, digits nor the apostrophe of contractions: a run of them is one piece.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Bytes as the characters that stand for them in byte-level vocabularies: printable ones are themselves, others follow 255.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_SHOWN = "".join(chr(b if b in _PRINTED else 256 + _HIDDEN.index(b)) for b in range(256))

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _is_odd(text: str, raw: bytes) -> bool:
    """Whether the cut is not certain: ``_ODD`` matches, or the text is not in composed form."""
    if any(c in text for c in _ODD_ASCII):
        return True
    if text.isascii():
        return False
    return any(b in raw for b in _ODD_BYTES) and _ODD.search(text) is not None or not unicodedata.is_normalized("NFC", text)


class ChunkEncoder:
    """``encode(texts)`` gives (ids, lengths) for a list of texts without nulls.

    ``keeps_space``: a chunk carries the one blank in front of it and other
    white space has ids of its own (byte-level vocabulary). Otherwise white
    space is dropped and case is folded by the vocabulary.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keeps_space = keeps_space
        self._forget()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks behind the known ones; one word of letters goes straight to the vocabulary's merges."""
        merges, folds = self.tokenizer.model.tokenize, not self.keeps_space
        found: list[list[int] | None] = []
        rest = []
        for chunk in chunks:
            blank = chunk[0] == " "
            word = chunk if blank or not folds else chunk.rstrip(_MARKS)
            if not (word[1:] if blank else word).isalpha() or folds and not word.isascii() and word != word.lower():
                rest.append(len(found))
                found.append(None)
                continue
            ids = [token.id for token in merges(charmap_decode(word.encode(), "strict", _SHOWN)[0])]
            found.append(ids if len(word) == len(chunk) else ids + self._of_marks(chunk[len(word) :]))
        for k, ids in zip(rest, self._library([chunks[k] for k in rest])):
            found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ends.frombytes((len(self.flat) + np.cumsum(sizes)).tobytes())
        self.flat.extend(chain.from_iterable(found))

    def _of_marks(self, marks: str) -> list[int]:
        """Ids of a run of marks; texts end in few different ones."""
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = [token.id for token in self.tokenizer.model.tokenize(marks)]
        return self.marks[marks]

    def _forget(self) -> None:
        #: The number of each chunk, counted from 1 as they are first asked for; its ids are flat[ends[number - 1]:ends[number]].
        self.memo: dict[str, int] = defaultdict(count(1).__next__)
        self.flat, self.ends = array("I"), array("q", [0])
        self.met = np.zeros(MEMO_CHUNKS + 1, np.uint8)  # blocks of each number, two at most
        self.marks: dict[str, list[int]] = {}

    def _drop_rare(self) -> None:
        """Keeps the chunks that two blocks or more had, if that leaves room enough."""
        memo, met = self.memo, self.met
        ends, flat = np.array(self.ends, np.int64), np.array(self.flat, np.uint32)
        often = np.flatnonzero(met > 1)
        self._forget()
        if len(often) > MEMO_CHUNKS // 2:
            return
        # numbers follow the order in which chunks came into the memo
        for chunk in compress(memo, (met[1 : len(memo) + 1] > 1).tolist()):
            self.memo[chunk]
        sizes = ends[often] - ends[often - 1]
        upto = np.cumsum(sizes)
        if len(often):
            self.flat.frombytes(flat[np.arange(int(upto[-1])) + np.repeat(ends[often - 1] - (upto - sizes), sizes)].tobytes())
            self.ends.frombytes(upto.tobytes())

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Marks every byte at which a chunk begins."""
        space = _SPACE[data]
        n = len(data)
        cut = np.zeros(n, bool)
        cut[1:] |= _LETTER[data[:-1]] & _STOP[data[1:]]
        cut[1:] |= space[:-1] != space[1:]
        if self.keeps_space:
            first = np.zeros(n + 1, bool)
            first[starts] = True  # a text begins here (the end counts too)
            first[n] = True
            # the last white-space byte before a word is a chunk of its own, or joins the word if it is a blank
            last = np.zeros(n, bool)
            last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
            cut |= last
            blank = np.flatnonzero(last & (data == 32))
            cut[blank + 1] = False
        cut[starts[starts < n]] = True
        return cut

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        odd = [_is_odd(t, r) for t, r in zip(texts, raw)]
        raw = [b"" if o else r for r, o in zip(raw, odd)]
        sizes = np.array([len(r) for r in raw], np.int64)
        text_ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        if len(data):
            begin = np.flatnonzero(self._cuts(data, text_ends - sizes))
            chunk_text = np.searchsorted(text_ends, begin, side="right")
            if not self.keeps_space:
                data = _LOWER[data]
                word = ~_SPACE[data[begin]]
            else:
                word = np.ones(len(begin), bool)
            offsets = np.append(begin, len(data)).astype(np.int64)
            chunks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
            if not word.all():
                chunks, chunk_text = chunks.filter(pa.array(word)), chunk_text[word]
            coded = chunks.dictionary_encode()
            ids, sizes_out = self._of_chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False))
            per_text = np.bincount(chunk_text, weights=sizes_out, minlength=len(texts)).astype(np.int64)
        else:
            ids, per_text = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if any(odd):
            parts = np.split(ids, np.cumsum(per_text)[:-1])
            whole = self._library([t for t, o in zip(texts, odd) if o])
            for k, own in zip([k for k, o in enumerate(odd) if o], whole):
                parts[k] = np.array(own, np.uint32)
            ids, per_text = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, per_text

    def _of_chunks(self, distinct: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks ``distinct[index]``, and how many each has."""
        if len(self.memo) + len(distinct) > MEMO_CHUNKS:
            self._drop_rare()
        known = len(self.memo)
        if known + len(distinct) >= len(self.met):  # a block of very many chunks
            self.met = np.append(self.met, np.zeros(known + len(distinct) + 1 - len(self.met), np.uint8))
        at = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        self._learn([distinct[k] for k in np.flatnonzero(at > known).tolist()])
        self.met[at] = np.minimum(self.met[at], 1) + 1
        at = at[index]
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32)
        begins, sizes = ends[at - 1], ends[at] - ends[at - 1]
        if not len(sizes):
            return np.zeros(0, np.uint32), sizes
        upto = np.cumsum(sizes)
        return flat[np.arange(int(upto[-1])) + np.repeat(begins - (upto - sizes), sizes)], sizes
