"""Licence runs of lines against brute force over all runs."""

import textwrap

import pytest

from corpusflow.llm import licences

FILLER = "Lorem ipsum dolor sit amet, the notes of a project in many words.\nAnother line of it, with nothing to see.\n"


def wrapped(name, k=-1):
    text = [t for n, t in licences.TEMPLATES + licences.FULL_TEMPLATES if n == name][k]
    return textwrap.fill(text, 70) if "\n" not in text else text


NOTICES = {
    "MIT": wrapped("MIT"), "ISC": wrapped("ISC"), "BSD-2-Clause": wrapped("BSD-2-Clause"), "BSD-3-Clause": wrapped("BSD-3-Clause"),
    "GPL-3.0": textwrap.fill([t for n, t in licences.TEMPLATES if n == "GPL-3.0"][1], 60),
    "AGPL-3.0": wrapped("AGPL-3.0"), "CC0-1.0": wrapped("CC0-1.0"), "Apache-2.0": wrapped("Apache-2.0"), "GPL-2.0": wrapped("GPL-2.0"),
}


@pytest.fixture(scope="module")
def found(spark):
    texts = {n: "Copyright 2020 Someone\n\n" + t + "\n\n" + FILLER * 30 for n, t in NOTICES.items()}
    texts["two"] = FILLER * 5 + NOTICES["MIT"] + "\n" + FILLER * 40 + NOTICES["BSD-3-Clause"] + "\n" + FILLER * 5
    texts["none"] = FILLER * 50
    table = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(8)
    return texts, {r.doc_id: r for r in licences.scan(table).collect()}


@pytest.mark.parametrize("name", NOTICES)
def test_a_wrapped_notice_at_the_head_of_a_longer_text_is_found(found, name):
    _, rows = found
    assert [f.license for f in rows[name].found if f.block and f.dice > 0.9 and f.last > f.block] == [name]


def test_two_notices_of_a_text_and_a_text_without(found):
    texts, rows = found
    assert [f.license for f in rows["two"].found] == ["MIT", "BSD-3-Clause"]
    assert rows["none"].found == [] and rows["none"].n_blocks == len(texts["none"].split("\n"))


def test_runs_have_the_dice_of_brute_force(found):
    texts, rows = found
    for name in ("MIT", "ISC", "two"):
        lines = texts[name].split("\n")
        for f in rows[name].found:
            grams = set(licences.template_bigrams("\n".join(lines[max(f.block - 1, 0) : f.last])))
            dice = max(2 * len(grams & set(o)) / (len(grams) + len(o)) for n, t in licences.TEMPLATES + licences.FULL_TEMPLATES if n == f.license for o in [licences.template_bigrams(t)])
            assert abs(dice - f.dice) < 1e-12
        best = {}
        for label, t in licences.TEMPLATES + licences.FULL_TEMPLATES:
            own = set(licences.template_bigrams(t))
            for a in range(len(lines)):
                for b in range(a + 2, min(a + 40, len(lines)) + 1):
                    grams = set(licences.template_bigrams("\n".join(lines[a:b])))
                    dice = 2 * len(grams & own) / (len(grams) + len(own))
                    if dice >= 0.8:
                        best[label] = max(best.get(label, 0), len(grams & own) * dice)
        assert {f.license for f in rows[name].found} <= set(best)
        top = max(best, key=best.get)
        assert top in {f.license for f in rows[name].found}


def test_a_whole_licence_is_that_licence_only(spark):
    """Each template as it stands, and once more behind other text; equal texts of several names are found by the first."""
    texts = [(k, n, t) for k, (n, t) in enumerate(licences.TEMPLATES + licences.FULL_TEMPLATES)]
    rows = [(k, t) for k, _, t in texts] + [(1000 + k, FILLER * 200 + "\n" + (t if "\n" in t else textwrap.fill(t, 70)) + "\n\n" + FILLER * 200) for k, _, t in texts]
    found = {r.doc_id: {f.license for f in r.found} for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    for k, name, text in texts:
        same = {n for _, n, t in texts if licences.template_bigrams(t) == licences.template_bigrams(text)}
        assert found[k] == {min(same)}, name
        assert found[1000 + k] == {min(same)}, name
