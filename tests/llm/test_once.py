"""What the lines of a page cost: each distinct line is taken apart once, and plain sentences and parts are told without a search."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import boilerplate, furniture, residue

LONG = "The editor reads the report before the next visit and the readers ask for more of it, because it was not easy for them at all"
PAGES = [
    ("a", f"Home | About us\n{LONG}\nTags: oven, pantry\n Home  |  About us\nBy Ada"), ("a", f"{LONG}\nHome | About us\nTags: pan\nPage 3 of 12"), ("b", f"{LONG}\n\nHome\nTags: oven, pantry"),
    (None, f"Home | About us\n{LONG}"), ("b", ""), ("b", "ab\n12345\nFoto: É. Ö.\nТеги: печь"), ("a", None),
]


def _block():
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in PAGES], pa.string()), pa.array([t for _, t in PAGES], pa.string())], ["site", "text"])


def test_each_distinct_line_is_taken_apart_once(monkeypatch):
    seen = Counter()
    features = furniture.features
    monkeypatch.setattr(boilerplate, "_FEATURES", {})
    monkeypatch.setattr(furniture, "features", lambda form: seen.update([form]) or features(form))
    got = boilerplate.page_features(_block(), {})
    assert seen[furniture.normal(LONG)] == 1 and set(seen.values()) == {1}
    want = Counter()
    for site, text in PAGES:
        on_page = set()
        for form in {x.strip(" ") for x in furniture.normal(text or "").split("\n")}:
            if sum(map(str.isalpha, form)) >= 3:
                a, b, c = features(form)
                on_page |= {(boilerplate.LINE, form, 0)} | {(boilerplate.PART, form, k) for k in a} | {(boilerplate.SINGLE, form, k) for k in b} | {(boilerplate.LEAD, None, k) for k in c}
        if site:
            want.update((site, sort, form, k) for sort, form, k in on_page)
    met = boilerplate.Forms([t for _, t in PAGES])
    lines = dict(zip(met.keys.tolist(), met.distinct, strict=True))
    rows = [tuple(r.values()) for r in got.to_pylist()]
    assert {(site, sort, lines.get(line), feature): n for site, sort, line, feature, n in rows if sort != boilerplate.TOKEN} == want
    assert [n for *_, sort, _, feature, n in rows if sort == boilerplate.TOKEN and feature == furniture.key("token", "")] == [5]


def test_a_sentence_of_other_words_is_told_without_its_tokens(monkeypatch):
    index = residue.Exemplars()
    text = ["Enable JavaScript to run this app.", "", f"JavaScript came up again when {LONG.lower()}."]
    want = index.of_lines(text)
    made = []
    tokens = residue.tokens
    monkeypatch.setattr(residue, "tokens", lambda s: made.append(s) or tokens(s))
    assert residue.Exemplars().of_lines(text[2:]) == [None] == want[2:]
    assert text[2] not in made


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab0 .!?|>/:-—•é。", max_size=30))
def test_parts_are_those_of_the_expression(text):
    s = furniture.skeleton(furniture.normal(text).strip(" "))
    assert furniture.parts(s) == [x for x in (y.strip(furniture._EDGE) for y in furniture._PARTS.split(s)) if x]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .!?…。！？\t　\xa0'é`\"", max_size=30))
def test_sentences_are_those_of_the_expression(line):
    want = residue._ENDS.split(residue._QUOTES.sub(residue._masked, line))
    assert [x.strip() for x in residue.sentences(line) if x.strip()] == [x.strip() for x in want if x.strip()]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aÀΣ09 \t\r\né١\x0b", max_size=40))
def test_normal_form(text):
    assert furniture.normal(text) == re.sub("[ \t\r]+", " ", re.sub("[0-9]+", "0", text.lower()))


@pytest.mark.parametrize("text", ["Das ist für alle, die den Text lesen", "Это не то, что мы знали", "これはテキストです", "naïve café 12 déjà-vu", "日本 Ж x"])
def test_words_of_any_script(text):
    low = text.lower()
    want = "".join(c if c.isalnum() else " " for c in low.encode("ascii", "ignore").decode()).split() + residue._CYRILLIC.findall(low)
    want += [w[i:i + 2] for w in residue._WIDE.findall(low) for i in range(max(1, len(w) - 1))]
    assert residue._raw(text) == want
