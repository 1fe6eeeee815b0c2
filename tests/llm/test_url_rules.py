"""URL filters against plain set counts, on planted token combinations and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from corpusflow.llm import url_rules
from corpusflow.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, path string, tokens string, verdict string"


def tokens(url: str | None) -> set[str]:
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return set()
    host, path, tail = re.match(r"([^/?#]*)([^?#]*)((?s:.*))", rest).groups()
    query, _, fragment = tail.partition("#")
    fold = lambda x: re.sub("[0-9]+", "#", x)
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    kinds = [("s:", lower(scheme).split("\n")), ("h:", lower(host).split(".")), ("p:", path.split("/")), ("q:", query[1:].split("&")), ("f:", fragment.split("\n"))]
    return {kind + fold(x) for kind, parts in kinds for x in parts if x}


def brute_rules(labelled: list[tuple], least: int, percent: int, most: int) -> dict[tuple, tuple]:
    counts = Counter(t for url, _ in labelled for t in tokens(url))
    every, bad = Counter(), Counter()
    for url, blocked in labelled:
        own = sorted((counts[t], t) for t in tokens(url) if counts[t] >= least)[:most]
        for size in range(1, len(own) + 1):
            for some in combinations(sorted(t for _, t in own), size):
                every[some] += 1
                bad[some] += blocked
    return {c: (n, bad[c]) for c, n in every.items() if bad[c] >= least and 100 * bad[c] >= percent * n}


def planted(n: int) -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        host = rng.choice(["shop", "news", "m.news", "blog"]) + "." + rng.choice(["one", "two"]) + ".com"
        path = "/" + rng.choice(["en", "de"]) + "/" + rng.choice(["a", "b"]) + str(rng.randint(1, 99))
        query = rng.choice(["", "?ref=x", "?ref=x&go=1", "#top"])
        url = rng.choice(["http", "https"]) + "://" + host + path + query
        rows.append((url, ("shop" in host and "ref=x" in query) or rng.random() < 0.05))
    return rows + rows[:40] + [rows[0]] * 100


@pytest.fixture(scope="module")
def labelled():
    return planted(400) + [("no scheme", True), ("", True)]


def test_mined_rules(spark, labelled):
    frame = spark.createDataFrame([*labelled, (None, True), (labelled[0][0], None)], "url string, blocked boolean")
    for least, percent, most in ((20, 60, 10), (8, 90, 3)):
        got = url_rules.mine(frame, least, 0.0, percent, most).collect()
        want = brute_rules(labelled, least, percent, most)
        assert {tuple(r.tokens): (r.urls, r.blocked_urls) for r in got} == want
        assert len(got) == len(want)
    assert ("h:shop", "q:ref=x") in brute_rules(labelled, 20, 60, 10)
    assert not url_rules.mine(frame.limit(0)).collect() and not url_rules.mine(frame.limit(3)).collect()


def test_verdicts(spark, labelled):
    rng = random.Random(4)
    urls = [u for u, _ in labelled[::3]] + [
        None, "", "x", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://www.example.com/en", "http://wwww.example.com/en/", "http://example.com/en/?q", "http://example.com/de/",
        "http://Éxample.net/fr/x", "http://net/es/", "http://nnet/es/", "http://a.net/es", "http://a.net?/es/", "http://a.org/http://b.com/x", "http://u:p@a.com:80/", "http://shop.one.org/?ref=x",
        "http://shop.org\n/en?ref=x#a#b", "http://" + "a." * 5000 + "shop/?ref=x", "http://com", "http://com/",
    ]
    urls += ["http://shop.hot.org/?ref=x"] * 300
    rows = [(k if k % 9 else None, u, "", "h", "p", "t", "v") for k, u in enumerate(urls)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    got = url_rules.judge(pages, spark.createDataFrame(labelled, "url string, blocked boolean"), URL_RULES, min_urls=20, min_share=0.0)
    mined = brute_rules(labelled, 20, url_rules.MIN_CONFIDENCE_PERCENT, url_rules.MAX_TOKENS)
    want = Counter()
    for key, url, *_ in rows:
        rest = (url or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0])) if fits else (None, None)
        own = tokens(url)
        best = max(((bad / n, n, c) for c, (n, bad) in mined.items() if own.issuperset(c)), default=None)
        want[key, host, path, rule, verdict or ("block" if best else "allow"), " ".join(best[2]) if best else None] += 1
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert any(k[3] is None and k[4] == "block" for k in want)


def test_empty_tables(spark):
    pages, labels = spark.createDataFrame([], PAGES), spark.createDataFrame([], "url string, blocked boolean")
    assert url_rules.judge(pages, labels, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/", "", "", "", "", "")], PAGES)
    assert [tuple(r) for r in url_rules.judge(one, labels, []).collect()] == [(1, "a.org", "/", None, "allow", None, None)]


def test_labels_meet_pages(spark):
    pages = spark.createDataFrame([(k, u, "", "", "", "", "") for k, u in enumerate(["http://a/en/7?x", "http://a/8.html", "http://a/x9", "http://a/99999999999999999999", None, "http://a/b/7/8"])], PAGES)
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, None, None), (9, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, url_rules.labelled_pages(pages, labels).collect()))
    assert got == [("http://a/8.html", False), ("http://a/b/7/8", True), ("http://a/en/7?x", True)]


def test_no_python_in_the_plan(spark, labelled):
    pages = spark.createDataFrame([(1, "http://a.org/", "", "", "", "", "")], PAGES)
    frame = url_rules.judge(pages, spark.createDataFrame(labelled, "url string, blocked boolean"), URL_RULES)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_no_frequent_token_is_left_out(spark):
    """Eleven tokens that always stand together make a combination of eleven."""
    labelled = [(f"http://a.b.c.d.e.f.g.h/i/j/{k}z", True) for k in range(30)]
    frame = spark.createDataFrame([(u.replace("/" + u.rsplit("/", 1)[1], ""), b) for u, b in labelled], "url string, blocked boolean")
    got = url_rules.mine(frame, 20, 0.0, 50)
    assert max(len(r.tokens) for r in got.collect()) == 11 and got.count() == 2**11 - 1
