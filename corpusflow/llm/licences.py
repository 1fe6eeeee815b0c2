"""Licence scan: normalised blocks of text, and runs of its lines, against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD_PERCENT = 80

# Fixed values, the ones the SQL knows: short notices and licence texts as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_GNU_NOTICE = (
    "{it} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {it} is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU {kind} General Public License for more details. You should have received a copy of the GNU {kind} General Public License "
    "along with {it}. If not, see https://www.gnu.org/licenses/."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TEXTS = Path(__file__).parent / "licence_texts"

# Whole licences and longer notices; the files are the publishers' texts.
FULL_TEMPLATES: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_DISCLAIMER),
    ("AGPL-3.0", _GNU_NOTICE.format(it="This program", colon=":", kind="Affero", version=3)),
    ("GPL-2.0", _GNU_NOTICE.format(it="This program", colon=":", kind="", version=2)),
    ("LGPL-2.1", _GNU_NOTICE.format(it="This library", colon=";", kind="Lesser", version="2.1")),
    ("LGPL-3.0", _GNU_NOTICE.format(it="This program", colon=":", kind="Lesser", version=3)),
    *((path.stem, path.read_text("utf-8")) for path in sorted(_TEXTS.glob("*.txt"))),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9]+"


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of the normalised text."""
    words = re.findall(WORD, text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(size: int, percent: int = THRESHOLD_PERCENT) -> tuple[int, int]:
    """Least and most bigrams of a block whose Dice coefficient with ``size`` bigrams can reach ``percent``.

    2 * min(a, b) / (a + b) bounds the coefficient, so a >= t / (2 - t) * b and a <= (2 - t) / t * b.
    """
    return -(-percent * size // (200 - percent)), (200 - percent) * size // percent


def _own_block(grams: str, block: str, last: str) -> str:
    """The best template of a block, given its distinct bigrams: (block, last, dice, license, score), license null if none."""
    one = "struct(size(filter(q, p -> array_contains(p.of, t.t))) AS h, size(q) AS a, t.n AS n, t.license AS license)"
    scored = f"transform(filter(near, t -> size(q) BETWEEN t.low AND t.high), t -> {one})"
    better = "IF(b.h * 2.0D / (b.a + b.n) > acc.dice AND b.h * 2.0D / (b.a + b.n) * 100 >= %PERCENT%, struct(b.h * 2.0D / (b.a + b.n) AS dice, b.license AS license, b.h * (b.h * 2.0D / (b.a + b.n)) AS score), acc)"
    best = f"aggregate({scored}, struct(0.0D AS dice, CAST(NULL AS string) AS license, 0.0D AS score), (acc, b) -> {better})"
    return f"element_at(transform(array({grams}), q -> element_at(transform(array({best}), b -> struct(CAST({block} AS int) AS block, CAST({last} AS int) AS last, b.dice AS dice, b.license AS license, b.score AS score)), 1)), 1)"


def _run_of_start() -> str:
    """The best run of template ``t`` from line ``x.line`` on, whose first place is ``x.at``: one pass over the bigrams that are new behind ``s``, judging each run where its last line ends."""
    score = "(acc.h * 1.0D * (acc.h * 2.0D / (acc.a + t.n)))"
    fits = "acc.last > s AND acc.a BETWEEN t.low AND t.high AND acc.h >= t.low AND NOT (s <= first_line AND acc.last >= last_line) AND acc.h * 2.0D / (acc.a + t.n) * 100 >= %PERCENT%"
    judged = f"IF({fits} AND {score} > acc.best.score, struct(CAST(s AS int) AS block, acc.last AS last, acc.h * 2.0D / (acc.a + t.n) AS dice, t.license AS license, {score} AS score), acc.best)"
    zero = "struct(0 AS a, 0 AS h, CAST(s AS int) AS last, struct(CAST(s AS int) AS block, CAST(s AS int) AS last, 0.0D AS dice, CAST(NULL AS string) AS license, 0.0D AS score) AS best)"
    step = f"struct(acc.a + 1 AS a, acc.h + IF(array_contains(p.of, t.t), 1, 0) AS h, p.l2 AS last, IF(p.l2 > acc.last, {judged}, acc.best) AS best)"
    # every bigram counts once, so those behind the template's upper bound can't be in a run that fits
    of_line = f"aggregate(slice(filter(slice(pos, s_at, size(pos)), p -> p.prev < s), 1, t.high + 1), {zero}, (acc, p) -> {step}, acc -> {judged})"
    return re.sub(r"\bs\b", "x.line", of_line).replace("s_at", "x.at")


RUN_OF_START = _run_of_start()


def _numbered(table: Sequence[tuple]) -> str:
    """The numbers of the templates that have the bigram ``g``."""
    holders: dict[str, list[int]] = {}
    for k, (_, own, *_) in enumerate(table):
        for g in own:
            holders.setdefault(g, []).append(k)
    groups: dict[tuple, list[str]] = {}
    for g, ks in holders.items():
        groups.setdefault(tuple(ks), []).append(g)
    cases = " ".join(f"WHEN g IN ({_listed(gs)}) THEN array({', '.join(map(str, ks))})" for ks, gs in groups.items())
    return f"CASE {cases} END"


def _listed(grams: Sequence[str]) -> str:
    return ", ".join(f"'{g}'" for g in grams)


def scan(
    documents: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES + FULL_TEMPLATES,
    percent: int = THRESHOLD_PERCENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key``, ``n_blocks`` and ``found``: the licences of every line, of runs of lines and of the whole text.

    ``n_blocks`` is the number of lines. ``found`` is an array of (block, last, dice, license): block 0 is the whole text
    of several lines, others are the lines ``block`` to ``last``. A line and the whole text have their best template
    if that reaches ``percent``, equal ones by name. For every template and first line the run of two lines or more (but
    less than the text) that reaches ``percent`` and has the most shared bigrams times Dice is a candidate; of candidates
    that share a line the first by that product stays, and one that shares a line with a found line stays only above
    its product. Of those that stay, runs of the whole text's licence go if the whole text has more of it.

    Case, punctuation and anything but ASCII letters and digits are not compared. A block that reaches ``percent`` shares
    at least as many bigrams as the template's lower bound, and so does its text: other texts are done after
    one look at each bigram. Everything happens inside the row, so nothing is shuffled and no key is hot; a text
    near a template takes time with its words times its lines that share a bigram with it. Null and empty
    texts find nothing; repeated rows give repeated results; no rows give no rows; other columns are not read.
    """
    table = sorted(((name, template_bigrams(t)) for name, t in templates), key=lambda t: t[0])
    table = [(name, grams, *size_bounds(len(grams), percent)) for name, grams in table if grams]
    kind = "array<struct<block:int,last:int,dice:double,license:string>>"
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = documents.select(F.col(key).alias(key), folded.alias("_f"))
    n_blocks = "CAST(length(_f) - length(replace(_f, '\n', '')) + 1 AS BIGINT) AS n_blocks"
    if not table:
        return rows.selectExpr(f"`{key}`", n_blocks, f"CAST(array() AS {kind}) AS found")
    known = _listed(list(dict.fromkeys(g for _, own, *_ in table for g in own)))
    near = ", ".join(
        f"IF(size(hits) >= {a} AND size(filter(hits, g -> g IN ({_listed(g)}))) >= {a}, named_struct('t', {k}, 'license', '{name}', 'n', {len(g)}, 'low', {a}, 'high', {b}), NULL)"
        for k, (name, g, a, b) in enumerate(table)
    )
    of = f"IF(g IN ({known}), {_numbered(table)}, NULL)"
    none = "CAST(array() AS array<int>)"
    words = f"regexp_extract_all(_f, '({WORD})')"
    line_words = f"regexp_extract_all(l, '({WORD})')"
    pairs = "slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, size(w))"
    steps = [
        {"w": words},
        {"hits": f"array_distinct(filter(zip_with({pairs}, (a, b) -> concat(a, ' ', b)), g -> g IN ({known})))", "w": None},
        {"near": f"filter(array({near}), t -> t IS NOT NULL)", "hits": None},
        # from here on only texts near a template have words
        {"w": f"CASE WHEN size(near) > 0 THEN flatten(transform(split(_f, '\n'), (l, i) -> transform({line_words}, w -> struct(w, i + 1 AS line)))) END"},
        {"pos": f"zip_with({pairs}, (a, b) -> struct(concat(a.w, ' ', b.w) AS g, a.line AS l1, b.line AS l2))", "w": None},
        {"pos": "array_sort(transform(pos, (x, i) -> struct(x.g AS g, i AS i, x.l1 AS l1, x.l2 AS l2)))"},
        # where the bigram began last before, 0 if nowhere: a bigram is new in a run that begins behind that line
        {"prev": "zip_with(pos, slice(concat(array(CAST(NULL AS struct<g:string,i:int,l1:int,l2:int>)), pos), 1, size(pos)), (x, y) -> IF(x.g = y.g, y.l1, 0))"},
        {"pos": "zip_with(pos, prev, (x, y) -> struct(x.g AS g, x.i AS i, x.l1 AS l1, x.l2 AS l2, coalesce(y, 0) AS prev))", "prev": None},
        {"pos": f"transform(array_sort(pos, (a, b) -> a.i - b.i), x -> struct(x.l1 AS l1, x.l2 AS l2, x.prev AS prev, coalesce(element_at(transform(array(x.g), g -> {of}), 1), {none}) AS of))"},
        {"last_line": "array_max(transform(pos, x -> x.l2))", "first_line": "array_min(transform(pos, x -> x.l1))", "lines": "size(split(_f, '\n'))"},
        {"firsts": "transform(pos, p -> p.l1)"},
        {"starts": "array_distinct(transform(filter(pos, p -> size(p.of) > 0), p -> p.l1))"},
        {"whole": f"filter(transform(IF(lines > 1, array(pos), array()), q -> {_own_block('filter(q, p -> p.prev = 0)', '0', 'lines')}), x -> x.license IS NOT NULL)"},
        {"single": f"filter(transform(starts, s -> {_own_block('filter(pos, p -> p.l1 = s AND p.l2 = s AND p.prev < s)', 's', 's')}), x -> x.license IS NOT NULL)"},
        # the lines that begin a bigram of a template: the line, its first place, the templates of its bigrams
        {"begins": "transform(starts, s -> struct(s AS line, CAST(array_position(firsts, s) AS int) AS at, array_distinct(flatten(transform(filter(pos, p -> p.l1 = s), p -> p.of))) AS of))", "firsts": None},
        {"runs": f"flatten(transform(near, t -> transform(filter(begins, s -> array_contains(s.of, t.t)), x -> {RUN_OF_START})))"},
        {"runs": f"""aggregate(array_sort(filter(runs, r -> r.license IS NOT NULL AND r.dice * 100 >= {percent}), (a, b) -> CASE
            WHEN a.score > b.score THEN -1 WHEN a.score < b.score THEN 1 WHEN a.block <> b.block THEN a.block - b.block
            WHEN a.last <> b.last THEN a.last - b.last WHEN a.license < b.license THEN -1 WHEN a.license > b.license THEN 1 ELSE 0 END),
            CAST(array() AS array<struct<block:int,last:int,dice:double,license:string,score:double>>),
            (kept, r) -> IF(exists(kept, k -> k.block <= r.last AND k.last >= r.block)
                OR exists(single, k -> k.block BETWEEN r.block AND r.last AND k.score >= r.score), kept, array_append(kept, r)))"""},
        # only now, so that a part of the whole text's licence still keeps a lesser one from its lines
        {"runs": "filter(runs, r -> NOT exists(whole, k -> k.license = r.license AND k.score >= r.score))"},
        {"found": f"CAST(transform(array_sort(concat(whole, single, runs)), x -> struct(x.block AS block, x.last AS last, x.dice AS dice, x.license AS license)) AS {kind})"},
    ]
    have = [f"`{key}`", "_f"]
    for step in steps:
        kept = [c for c in have if c not in step]
        new = {c: e for c, e in step.items() if e is not None}
        rows = rows.selectExpr(*kept, *(f"{e.replace('%PERCENT%', str(percent))} AS {c}" for c, e in new.items()))
        have = [*kept, *new]
    return rows.selectExpr(f"`{key}`", n_blocks, f"coalesce(found, CAST(array() AS {kind})) AS found")
