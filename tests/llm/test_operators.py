"""The operators against brute force, on whole small tables and on a table of odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import components, fingerprints, language, licences, packing, passages, piece_sampling, quality, sharding, shingle_join, suffixes, token_counts
from corpusflow.llm.chunk_memo import ChunkEncoder
from corpusflow.llm.queries import ORACLES, QUERIES
from corpusflow.session import scratch_path
from tests.oracle import compare, oracle_connection

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and blank texts, ties, repeated rows, near copies, a very long text."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    near = base.copy()
    near[60] = "other"
    far = base[:70] + [rng.choice(words) for _ in range(50)]
    long = " ".join(rng.choice(words) + str(k) for k in range(60_000))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "One two THREE"), (7, " ".join(base)), (8, " ".join(near)),
        (9, " ".join(far)), (10, " ".join(base)), (10, " ".join(base)), (11, "11 22 ... !!"), (12, long), (None, " ".join(base)), (None, None),
        (13, "Ünïcödé ▁ words 日本語 \U0001f600 é <|endoftext|> it's\r\n\x00x"), (14, "line of words here\n" * 40), (15, "é" * 80), (16, "x" + "é" * 90),
        (17, "Released under the MIT License.\n" + " ".join(base[:30])), (18, " ".join(["a b c d e f g h i j k"] * 12)), (19, "a,b." * 30),
        (20, "shared passage " + " ".join(base[20:60]) + " tail"),
    ]
    return [(i, t, [None, "en", "de"][k % 3], None if k % 4 == 0 else f"s{k % 3}", None, k, f"n{k}", None, float(k)) for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, name string, row string, size double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), oracle_connection(sf_dir), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_quality_rules", "op5_shingle_join", "op7_shards", "op8_passages"])
def test_matches_sql_on_odd_rows(spark, odd, tmp_path, name):
    """Rows without a key and repeated keys have rules of their own, which the SQL doesn't know."""
    plain = odd.where("doc_id IS NOT NULL AND doc_id <> 12").dropDuplicates(["doc_id"])
    plain.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle_connection.__globals__["duckdb"].connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None


def test_empty_tables(spark, empty):
    path, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    for made in (
        piece_sampling.encode(empty, public_tokenizers.path("piece_bpe_32k.model")),
        licences.scan(empty),
        quality.quality_rules(empty),
        quality.keep_good(empty),
        fingerprints.edited_likeness(empty),
        shingle_join.link(empty),
        shingle_join.one_per_component(empty),
        token_counts.token_counts(empty, path, scratch_path(spark, "none")),
        sharding.shard_documents(empty, 4),
        passages.dedup(empty),
        passages.cut_documents(empty),
        language.identify(empty),
        language.keep_known(empty, 0.4),
        packing.pack(empty, word),
    ):
        assert made.count() == 0


# 1


def test_sampled_pieces_come_back(odd, documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for table in (odd, documents):
        encoded = piece_sampling.encode(table, path, seed=3)
        texts = {(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()}
        assert {(r.doc_id, r.text) for r in piece_sampling.decode(encoded, path).collect()} == texts
    rows = piece_sampling.round_trips(odd, path, seed=3).collect()
    assert all(r.lossless for r in rows if r.ids is not None)
    assert sorted(map(str, rows)) == sorted(map(str, piece_sampling.round_trips(odd.coalesce(1), path, seed=3).collect()))


def test_draws_follow_the_lattice():
    model = piece_sampling.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    word = "theme"
    pieces = {p: 0 for p in ()}
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    size = sp.get_piece_size()
    pieces = {sp.id_to_piece(i): 1 / (min(-sp.get_score(i), size) + 2) for i in range(size) if not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i)}

    def ways(s):
        if not s:
            yield (), 1.0
        for n in range(1, len(s) + 1):
            if s[:n] in pieces:
                for rest, w in ways(s[n:]):
                    yield (s[:n], *rest), w * pieces[s[:n]]

    want = dict(ways("▁" + word))
    total = sum(want.values())
    n = 20_000
    ids, counts = model.encode([word] * n, np.arange(n, dtype=np.uint64))
    got = Counter(tuple(sp.id_to_piece(int(i)) for i in part) for part in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(got) <= set(want)
    for way, w in want.items():
        assert abs(got[way] / n - w / total) < 0.02


# 4


def test_fingerprints_estimate_jaccard(odd, documents):
    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    for table in (documents, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = sorted(((r.doc_id, r.text or "") for r in table.collect()), reverse=True)
        found = {r.doc_id: r for r in fingerprints.edited_likeness(table).collect()}
        prints, off = {}, []
        for k, (i, t) in enumerate(texts):
            following, cut = texts[(k + 1) % len(texts)][1], len(t) // 3
            edited, r = t[: len(t) - cut] + following[:cut], found[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            for other, near in ((edited, r.near_edited), (following, r.near_next)):
                a, b = shingles(t), shingles(other)
                off.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
        assert np.abs(off).max() < 0.16 and abs(np.mean(off)) < 0.02
    assert fingerprints.edited_likeness(odd).count() == odd.count()


@pytest.mark.parametrize("ranges", [1, 2, 7, 1000])
def test_next_rows_over_ranges(spark, ranges):
    keys = random.Random(3).sample(range(-(10**12), 10**12), 300)
    rows = spark.createDataFrame([(k, f"t{k}", k % 5) for k in keys], "k long, t string, tie long").repartition(4)
    order = sorted(keys, reverse=True)
    want = {k: f"t{n}" for k, n in zip(order, order[1:] + order[:1])}
    assert {r.k: r.next_t for r in fingerprints.with_next(rows, "k", "tie", ["t"], ranges).collect()} == want
    one = fingerprints.with_next(rows.where(F.col("k") == keys[0]), "k", "tie", ["t"], ranges).collect()
    assert [r.next_t for r in one] == [f"t{keys[0]}"]


def test_ranges_follow_the_size():
    assert [fingerprints.n_ranges(s) for s in (0, 10**9, 10**12, 10**14)] == [256, 256, 3726, 100_000]


# 5


def test_join_on_odd_rows(odd):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.link(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (8, 116, 7), (10, 116, 7), (None, 116, 7), (None, 0, None)} <= rows
    left = sorted(r.doc_id or -1 for r in shingle_join.one_per_component(odd).select("doc_id").collect())
    assert left == sorted([-1, -1, 1, 2, 3, 4, 5, 7, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20])
    assert shingle_join.one_per_component(odd).columns == odd.columns


def test_join_of_one_large_group(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for k in range(300):
        text = base.copy()
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(200)] = rng.choice(words)
        rows.append((k, " ".join(text)))
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in (t.split() for _, t in rows)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    got = {r.doc_id: r.component_id for r in shingle_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: root(k) for k in range(300)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 100 for k in range(100, 141)} | {k: 7 for k in (7, *range(200, 260))}


# 6 and 10


def test_ids_are_the_librarys():
    texts = ["", " ", "  a  b\n\n c \n", "it's a's 'tis \"it's\", x,y ..., a. b", "<|endoftext|> a <|ENDOFTEXT|>x", "Ünïcödé, ß. Σ ΟΔΟΣ İx a̸", "a\r\n\r\nb\t\tc", "日本 語。、x", "a 1.5,3 4", "é  x", "\x1cx \x85"]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = ChunkEncoder(public_tokenizers.path(name), keeps)
        ids, lengths = encoder.encode(texts)
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_counts_use_the_cache(spark, odd, documents):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "cache")
    tokenizer = Tokenizer.from_file(path)
    for table in (documents, documents, odd):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(table, path, cache).collect())
        assert got == Counter((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
    plan = token_counts.token_counts(documents, path, cache)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Initial Plan")[-1]  # both sides of the last join are plain, so a hot text can be split
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()  # nothing is counted twice


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing_keeps_every_id_and_the_mixture(request, which):
    from tokenizers import Tokenizer

    table = request.getfixturevalue(which)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(table, path, window=256).collect()
    want = Counter()
    for r in table.collect():
        want[(r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], np.uint32).tobytes())] += 1
    by, of, sources = defaultdict(list), defaultdict(list), Counter()
    for p in pieces:
        by[p.doc_id].append(p)
        of[p.sequence_id].append(p)
        sources[p.source] += p.length
    assert sum(sources.values()) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    for (key, ids), n in want.items():
        if len([k for k, _ in want if k == key]) == 1 and n == 1:
            at = 0
            for p in sorted(by[key], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
                at += p.length
            assert at == len(ids) // 4
    for k, own in of.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or k == max(of)
        mixture = Counter()
        for p in own:
            mixture[p.source] += p.length
        if at == 256:
            assert all(abs(mixture[s] - 256 * n / sum(sources.values())) <= len(sources) + 1 for s, n in sources.items())


# 7


def test_shards_of_repeated_rows(odd):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == odd.count()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_shards_are_even(documents):
    sizes = Counter()
    for r in sharding.shard_documents(documents, 8).collect():
        sizes[r.shard] += r.size
    largest = max(len((r.text or "").encode()) + 8 for r in documents.collect())
    assert max(abs(s - sum(sizes.values()) / 8) for s in sizes.values()) <= largest


# 8


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 8)):
            letters = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))]
            texts.append((letters[:5] * 6 if rng.random() < 0.3 else letters) + [0])
        offsets = np.cumsum([0, *map(len, texts)])
        found = suffixes.suffix_arrays(np.array(sum(texts, [])), offsets)
        for t, o in zip(texts, offsets):
            assert (found[o : o + len(t)] - o).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def _cut_by_hand(rows: list[tuple[int, bytes]]) -> dict[int, list[bool]]:
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    gone = {}
    for i, t in rows:
        gone[i] = [False] * len(t)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[i][p : p + 50] = [True] * 50
    return gone


@pytest.mark.parametrize("crowd", [passages.MAX_STRINGS, 1])
def test_passages_by_hand(spark, monkeypatch, crowd):
    """Also with all anchors compared window by window."""
    monkeypatch.setattr(passages, "MAX_STRINGS", crowd)
    rng = random.Random(5)
    shared = ["".join(rng.choice("ab é") for _ in range(rng.randint(40, 120))) for _ in range(6)]
    rows = [(k * 3, "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abc ") for _ in range(60)) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    got = {r.doc_id: r for r in passages.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    gone = _cut_by_hand([(i, t.encode()) for i, t in rows])
    for i, t in rows:
        mask, r = gone[i], got[i]
        assert r.n_removed == sum(mask)
        assert r.n_spans == sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        assert bytes(r.kept) == bytes(b for b, m in zip(t.encode(), mask) if not m)


def test_cut_documents_keep_their_columns(odd):
    cut = passages.cut_documents(odd)
    assert cut.columns == odd.columns
    rows = {(r.doc_id, r.id): r for r in cut.collect()}
    assert len(rows) == odd.count()
    assert rows[(10, 9)].text == "" and rows[(10, 9)].n_chars == 0 and rows[(1, 0)].text is None
    whole = {(r.doc_id, r.id): r.text for r in odd.collect()}
    assert rows[(None, 13)].text == whole[(None, 13)] and rows[(7, 6)].text == whole[(7, 6)]
    assert rows[(20, 22)].text == "shared passagetail"


# 9


def test_language_of_held_out_rows(documents):
    rows = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_language_of_odd_rows(odd):
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 11))
    assert all(r.lang_pred in ("en", "de") for r in rows if r.doc_id in (4, 7, 12))
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_names_that_clash(spark, odd, monkeypatch):
    """Two sets or two texts with one name take other ones, and nothing else changes."""
    joined, cut = (sorted(map(str, f(odd).collect())) for f in (shingle_join.link, passages.dedup))

    def few(digests):
        """A third of all names are one."""
        return lambda *args: (lambda name, check: (np.where((name % 3 == 0) & ~np.isin(np.uint64(2), args[-1]), 2, name), check))(*digests(*args))

    monkeypatch.setattr(shingle_join, "_names", few(shingle_join._names))
    monkeypatch.setattr(passages, "_digests", few(passages._digests))
    assert sorted(map(str, shingle_join.link(odd).collect())) == joined
    assert sorted(map(str, passages.dedup(odd).collect())) == cut
