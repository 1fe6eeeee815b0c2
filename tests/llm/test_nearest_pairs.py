"""Pairs of the shingle join between components: one for every two components first, all that are left then."""

from collections import Counter

from pyspark.sql import functions as F

from corpusflow.llm import shingle_join


def test_two_large_components_give_one_pair_first(spark):
    rows = [(1, 60, 1, 0, i, i % 3, 100, [int(i > 2), *[0] * 7]) for i in range(1, 61)]
    kinds = "part long, sets long, least long, salt long, name long, component long, n long, sketch array<long>"
    rest = spark.createDataFrame(rows, kinds).repartition(3)
    assert shingle_join._across(rest, False).count() == 3 * 20 * 20
    first = shingle_join._across(rest, True).collect()
    assert Counter(tuple(sorted((r.a % 3, r.b % 3))) for r in first) == {(0, 1): 1, (0, 2): 1, (1, 2): 1}
    assert (1, 2) in {(r.a, r.b) for r in first}  # the only two with equal sketches across components 1 and 2 have the least names


def test_links_past_the_nearest_pair_are_found(spark):
    """Chains of near copies, whose ends are far apart, beside texts that are just too unlike: as by brute force."""
    words = lambda *swaps: " ".join(f"x{j}" if j in swaps else f"w{j}" for j in range(120))
    texts = [words(*range(0, k)) for k in range(0, 40, 2)] + [words(*range(80 - k, 80)) for k in range(0, 40, 3)] + [words(k, 60) for k in range(0, 50, 5)]
    found = {r.doc_id: r.component_id for r in shingle_join.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.col("doc_id"), "component_id").collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    low = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for k, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    low[i] = min(low[i], low[k])
    assert found == dict(enumerate(low))
