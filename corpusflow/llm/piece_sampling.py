"""SentencePiece encoding by sampling segmentations, and lossless decoding.

Forward filtering sums the weights of all ways to reach each place of the piece lattice; backward
sampling walks from the end and draws each piece with its posterior weight. No piece of the
vocabularies crosses the start of a blank-led word, so a text's lattice falls into those of its words: those
are filtered once per distinct word of a block, and the walks of all words of a block run side by side in numpy.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import common

BLANK = "\u2581"
#: Stands for byte b among the symbols of a text: a private character, never a piece.
_BYTE = 0x10FF00
_CODES = 0x110000
_LETTER = np.array([chr(i).isalpha() for i in range(128)])
_SHIFT = np.int64(21)  # a code point has 21 bits
#: Words of more symbols are filtered and walked alone; the rounds over all words are as many as the longest of them has.
LONG_WORD = 256


class PieceModel:
    """Pieces and weights of a SentencePiece model file.

    A model whose scores are merge ranks gets Zipf's law, weight 1 / (rank + 2); one whose scores are
    log-probabilities keeps them. ``sharpness`` is the inverse temperature: 0 draws evenly from all ways.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        scores = [model.get_score(i) for i in range(size)]
        ranked = all(float(s).is_integer() for s in scores)
        pieces: dict[str, tuple[int, float]] = {}
        shown: list[bytes] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                shown.append(b"")
            elif model.is_byte(i):
                value = int(piece[3:5], 16)
                pieces[chr(_BYTE + value)] = (i, 0.0)
                shown.append(bytes([value]))
            else:
                logp = -math.log(min(-scores[i], size) + 2) if ranked else scores[i]
                pieces[piece] = (i, sharpness * logp)
                shown.append(piece.replace(BLANK, " ").encode())
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece crosses the start of a word")
        self.single = {c for c in pieces if len(c) == 1 and ord(c) < _BYTE} - {BLANK}
        # a full stop or comma behind a letter is cut off where no piece crosses the two
        self.stops = not any(re.search("[A-Za-z][.,]", p) for p in pieces)
        self.longest = max(map(len, pieces))
        self._trie(pieces)
        self.shown_lengths = np.array([len(b) for b in shown], np.int64)
        self.shown_ends = np.cumsum(self.shown_lengths)
        self.shown_bytes = np.frombuffer(b"".join(shown), np.uint8)

    def _trie(self, pieces: dict[str, tuple[int, float]]) -> None:
        """Prefixes of pieces as nodes; a step is the key (node, character), looked up in a sorted array."""
        prefixes = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        number = {p: k + 1 for k, p in enumerate(prefixes)}
        self.piece = np.array([-1] + [pieces.get(p, (-1, 0))[0] for p in prefixes], np.int32)
        self.weight = np.array([0.0] + [pieces.get(p, (-1, 0.0))[1] for p in prefixes])
        self.first = np.zeros(_CODES, np.int32)
        steps = []
        for p, k in number.items():
            if len(p) == 1:
                self.first[ord(p)] = k
            else:
                steps.append(((number[p[:-1]] << 21) | ord(p[-1]), k))
        steps.sort()
        self.step_keys = np.array([s[0] for s in steps] + [np.iinfo(np.int64).max], np.int64)
        self.step_nodes = np.array([s[1] for s in steps] + [0], np.int32)

    def _symbols(self, text: str) -> str:
        """The text behind one more blank; what is no piece, and a blank mark of the text itself, as bytes."""
        others = {c: "".join(chr(_BYTE + b) for b in c.encode()) for c in set(text) - self.single - {" "}}
        if others and ord(max(others)) >= _BYTE:
            # the text has characters that look like those for bytes, so all must be put in at once
            return " " + text.translate({ord(c): symbols for c, symbols in others.items()})
        for c, symbols in others.items():
            text = text.replace(c, symbols)
        return " " + text

    def _words(self, symbols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, where words begin, and the text of each word."""
        ends = np.cumsum([len(s) for s in symbols]).astype(np.int64)
        codes = np.frombuffer("".join(symbols).encode("utf-32-le"), np.int32)
        blank, single = codes == 32, codes >= _BYTE
        codes = np.where(blank, np.int32(ord(BLANK)), codes)
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin |= single
        begin[1:] |= single[:-1]
        if self.stops:
            begin[1:] |= ((codes[1:] == 44) | (codes[1:] == 46)) & (codes[:-1] < 128) & _LETTER[codes[:-1] & 127]
        starts = ends - np.diff(ends, prepend=0)
        begin[starts[starts < len(codes)]] = True
        at = np.flatnonzero(begin)
        return codes, at, np.searchsorted(ends, at, side="right")

    def _edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that match inside the words: start, end, trie node; by end, then length."""
        word_end = np.repeat(ends, np.diff(ends, prepend=0))
        at = np.arange(len(codes))
        node = self.first[codes]
        found = []
        for n in range(1, self.longest + 1):
            hit = self.piece[node] >= 0
            found.append((at[hit], at[hit] + n, node[hit]))
            more = at + n < word_end[at]
            at, node = at[more], node[more]
            key = (node.astype(np.int64) << _SHIFT) | codes[at + n]
            k = np.searchsorted(self.step_keys, key)
            known = self.step_keys[k] == key
            at, node = at[known], self.step_nodes[k[known]]
            if not len(at):
                break
        start, end, node = (np.concatenate(x) for x in zip(*found))
        order = _stable(end, len(codes))
        return start[order], end[order], node[order]

    def _lattice(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of distinct words.

        Gives the edges by end: start, piece, and the end plus the share of the end's edges up to this one.
        A place is numbered by the symbols before it and the words before its word, so each word has one more than symbols.
        """
        sizes = np.diff(ends, prepend=0)
        start, end, node = self._edges(codes, ends)
        word = np.searchsorted(ends, start, side="right")
        depth = end - (ends - sizes)[word]  # of the end in its word
        start, end = start + word, end + word
        new_end = np.concatenate([[True], end[1:] != end[:-1]])
        nth = np.arange(len(end)) - np.maximum.accumulate(np.where(new_end, np.arange(len(end)), 0))
        alpha = np.zeros(len(codes) + len(ends))
        top, total = np.full(len(alpha), -np.inf), np.zeros(len(alpha))
        weight, reach = self.weight[node], np.zeros(len(end))
        # long words one by one, so that their depth costs the others nothing
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            last = int(ends[k]) + k
            own = slice(*np.searchsorted(end, [last - int(sizes[k]) + 1, last + 1]).tolist())
            reach[own] = _filtered(start[own], end[own], weight[own])
            total[end[own]] = reach[own]  # the last of an end's edges stays
        order = _stable(nth, int(nth.max()) + 1)
        if (sizes > LONG_WORD).any():
            order = order[sizes[word[order]] <= LONG_WORD]
        order = order[_stable(depth[order], int(depth.max()) + 1)]
        key = depth[order] * (self.longest + 1) + nth[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        upto = np.append(edge, len(order))
        for a, b in zip(*(x.tolist() for x in _groups(depth[order[edge]]))):
            groups = [order[x:y] for x, y in zip(upto[a:b], upto[a + 1 : b + 1])]
            scores = [alpha[start[g]] + weight[g] for g in groups]  # the ends of a group are distinct
            for g, score in zip(groups, scores):
                top[end[g]] = np.maximum(top[end[g]], score)
            for g, score in zip(groups, scores):
                total[end[g]] += np.exp(score - top[end[g]])
                reach[g] = total[end[g]]
            own = end[groups[0]]
            alpha[own] = top[own] + np.log(total[own])
        reach = end + reach / total[end]
        reach[np.append(np.flatnonzero(new_end)[1:], len(end)) - 1] = end[new_end] + 1.0
        return start, self.piece[node], reach

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and how many each has. ``keys`` seed the draws."""
        # a text gets the leading blank that decoding takes away again
        codes, at, of = self._words([self._symbols(t) if t else "" for t in texts])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        stops = np.append(at[1:], len(codes))
        offsets = np.append(at, len(codes)).astype(np.int64) * 4
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))]).dictionary_encode()
        distinct = coded.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[1 : len(distinct) + 1] // 4
        starts, pieces, reach = self._lattice(np.frombuffer(distinct.buffers()[2], np.int32)[: ends[-1]], ends)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = (ends - np.diff(ends, prepend=0))[index] + index  # the place at which the word begins
        node = first + (stops - at)
        text_start = np.searchsorted(of, np.arange(len(texts)))
        behind = at - at[np.minimum(text_start, len(at) - 1)][of]  # symbols of the text before the word
        seed = common.mix(keys)[of]
        word = np.arange(len(at))
        drawn = []
        long = np.flatnonzero(stops - at > LONG_WORD)
        for w in long.tolist():
            drawn += self._walk(w, int(first[w]), int(node[w]), int(behind[w]), seed[w], starts, pieces, reach)
        short_rounds = len(drawn)
        word = word[stops - at <= LONG_WORD]
        while len(word):
            own = node[word]
            draw = common.mix(seed[word] ^ common.mix(behind[word] + own - first[word]))
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(reach, own + u, side="right")
            drawn.append((word, pieces[edge]))
            node[word] = starts[edge]
            word = word[starts[edge] > first[word]]
        per_word = np.bincount(np.concatenate([w for w, _ in drawn]), minlength=len(at))
        last = np.cumsum(per_word) - 1
        ids = np.empty(int(last[-1]) + 1, np.int32)
        for w, walked in drawn[:short_rounds]:
            ids[last[w[0]] - np.arange(len(walked))] = walked
        for step, (w, piece) in enumerate(drawn[short_rounds:]):  # a word's walk came from its end
            ids[last[w] - step] = piece
        return ids, np.bincount(of, per_word, minlength=len(texts)).astype(np.int64)

    @staticmethod
    def _walk(w: int, first: int, node: int, behind: int, seed: np.uint64, starts: np.ndarray, pieces: np.ndarray, reach: np.ndarray) -> list[tuple]:
        """The pieces of one long word from its end on, drawn as all others are."""
        draw = common.mix(seed ^ common.mix(behind + np.arange(node - first + 1)))
        u = ((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
        low = int(np.searchsorted(reach, first, side="right"))
        high = int(np.searchsorted(reach, node + 1.0, side="right"))
        own, begin, walked = reach[low:high].tolist(), starts[low:high].tolist(), []
        while node > first:
            edge = bisect_right(own, node + u[node - first])
            walked.append(low + edge)
            node = begin[edge]
        return [(np.full(len(walked), w), pieces[walked])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts one behind the other, and their offsets."""
        sizes = self.shown_lengths[ids]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        at = np.arange(total) + np.repeat(self.shown_ends[ids] - upto, sizes)
        data = self.shown_bytes[at]
        ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(counts)])]
        some = counts > 0
        keep = np.ones(total, bool)
        keep[ends[:-1][some]] = False  # the leading blank
        return data[keep], ends - np.concatenate([[0], np.cumsum(some)])


def _filtered(start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Forward filtering of one word, place by place: per edge the sum up to it of its end's ways, over the largest of them."""
    base = int(start.min())
    s, e, w = (start - base).tolist(), (end - base).tolist(), weight.tolist()
    alpha, reach, at = [0.0] * (e[-1] + 1), [], 0
    while at < len(s):
        place, scores = e[at], []
        while at < len(s) and e[at] == place:
            scores.append(alpha[s[at]] + w[at])
            at += 1
        top, total = max(scores), 0.0
        for score in scores:
            total += math.exp(score - top)
            reach.append(total)
        alpha[place] = top + math.log(total)
    return np.array(reach)


def _stable(keys: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of keys from 0 to ``bound``; 16 bits at a time, for which numpy counts."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    shift = 16
    while bound >> shift:
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return at, np.append(at[1:], len(keys))


def _row_keys(key: str):
    """A seed per row: the hash of the key's text form; a null key has one of its own."""
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))


def encode(documents: DataFrame, path: str, seed: int = 0, sharpness: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) per row: a segmentation drawn from the piece lattice.

    The draw depends on the key, ``seed`` and the text alone, so it is the same on any cluster and after a
    lost task. Null texts give null, empty ones an empty array; repeated rows give the same ids; a
    row's work and memory grow with its own text; no rows give no rows; other columns are not read.
    """
    kind = documents.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.per_worker((path, sharpness, "pieces"), lambda: PieceModel(path, sharpness))
        for block in common.blocks(batches, "text", 2_000_000):
            column = block.column("text")
            keys = block.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, counts = model.encode(["" if t is None else t for t in column.to_pylist()], common.mix(keys ^ np.uint64(seed)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [key, "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), _row_keys(key).alias("seed"))
    return rows.mapInArrow(work, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` per row of ``ids``: the text that was encoded, to the byte; null ids give null."""
    kind = encoded.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.per_worker((path, 1.0, "pieces"), lambda: PieceModel(path))
        for batch in batches:
            for block in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                column = block.column("ids")
                counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
                data, offsets = model.decode(column.flatten().to_numpy(zero_copy_only=False), counts)
                texts = common.strings(data, offsets).cast(pa.string())
                texts = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([block.column("key"), texts], [key, "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(work, f"`{key}` {kind}, text string")


def round_trips(documents: DataFrame, path: str, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass: ``key``, ``n_ids``, ``ids`` and whether the text came back (``lossless``)."""
    kind = documents.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.per_worker((path, 1.0, "pieces"), lambda: PieceModel(path))
        for block in common.blocks(batches, "text", 2_000_000):
            column = block.column("text")
            keys = block.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            texts = ["" if t is None else t for t in column.to_pylist()]
            ids, counts = model.encode(texts, common.mix(keys ^ np.uint64(seed)))
            back = common.strings(*model.decode(ids, counts))
            same = pa.compute.equal(back, pa.array(texts, pa.large_string()))
            missing = column.is_null()
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(missing.to_numpy(zero_copy_only=False), False))
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), same], [key, "n_ids", "ids", "lossless"]
            )

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), _row_keys(key).alias("seed"))
    return rows.mapInArrow(work, f"`{key}` {kind}, n_ids long, ids array<int>, lossless boolean")
