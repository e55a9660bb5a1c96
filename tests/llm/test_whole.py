"""The two passes over lines, and the weights of the exemplars' tokens."""

from math import log

import pytest

from lodestrata.llm import boilerplate, furniture, residue

ARTICLE = "The editor reads the report before the next visit, because the readers asked for it. It was not easy."
LABELS = furniture.Labels([furniture.key("part", x) for x in ("home", "contact", "pricing", "privacy", "print this page", "keep reading")])


def _labels(text):
    return boilerplate.Classifier(residue.Exemplars(), LABELS).label(text.split("\n"), "A page", set())


def test_short_lines_inherit_from_both_sides():
    assert _labels(f"Home\nWidget Finder\nGadgets\n\nContact\n{ARTICLE}\nPricing\nThe mascots of it\nPrivacy") == [False, False, False, None, False, True, False, False, False]
    assert _labels(f"{ARTICLE}\nMinor checklist\n{ARTICLE}") == [True, True, True]


def test_between_article_and_furniture_common_words_decide():
    assert _labels(f"Home\nThe weather of the week\n- one item\nname | size | age\nContact\n{ARTICLE}") == [False, True, True, True, False, True]
    assert _labels(f"{ARTICLE}\nA part of the whole\nPrint this page\n{ARTICLE}\nWidget Finder\nContact") == [True, True, False, True, False, False]


def test_wrapped_lines_go_on():
    assert _labels(f"{ARTICLE} {ARTICLE[:-30]}\nasked. Fine\nPrint this page") == [True, True, False]


def test_pairs_of_japanese_are_counted(spark):
    texts = ["本文を入力してください。", "入力した本文", "Page not found", None]
    base = spark.createDataFrame([(None if i else "a.example", t) for i, t in enumerate(texts)], "site string, text string")
    fitted = boilerplate.Crawl(base).exemplars
    weight = lambda n: log((3 + 1) / (n + 0.5)) + 0.1
    assert [fitted.weights[t] for t in ("入力", "して", "found", "アク")] == pytest.approx([weight(2), weight(1), weight(1), weight(0)])
