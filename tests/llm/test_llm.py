"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd input."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import boilerplate, furniture, garbled, leakage, packing, reading_level, repeated_lines, residue, splitting

PAGES = "id long, normalized_url string, title string, text_content string, site string, text string, page_id string, hot int"


def pages(spark, rows):
    """Rows (id, url, title, text) with further columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], PAGES)


ODD = [(1, None, None, None), (2, "https://a.example/1", "", ""), (3, "not a url", "t", "one line"), (4, "https://a.example/1", "t", "\n\n \t\n"), (4, "https://a.example/1", "t", "\n\n \t\n"), (5, "https://a.example/2", "t", "long " * 60_000)]


def test_blocks_keep_every_row_once():
    import pyarrow as pa

    from lodestrata.llm.codepoints import blocks

    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 5, 40, 900]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts, pa.string())], ["i", "text"])
    cut = list(blocks(iter([batch, batch.slice(0, 0)]), "text", 500))
    assert [i for b in cut for i in b.column("i").to_pylist()] == list(range(300))
    assert all(sum(len(t or "") for t in b.column("text").to_pylist()) <= 500 + 900 for b in cut)


# --- repeated lines

def brute_repeated(rows):
    site = lambda u: (m.group(1) or None) if u and (m := re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", u)) else None
    form = lambda x: re.sub("[ \t\r]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    size, on, cases = {}, {}, []
    for k, (i, u, _, t) in enumerate(rows):
        if (s := site(u)) is None:
            continue
        size[s] = size.get(s, 0) + 1
        for no, line in enumerate((t or "").split("\n"), 1):
            f = form(line)
            if sum(map(str.isalpha, f)) >= 3:
                on.setdefault((s, f), set()).add(k)
                cases.append((i, no, s, f))
    return sorted((i, no) for i, no, s, f in cases if len(on[s, f]) >= 5 and len(on[s, f]) >= 0.05 * size[s])


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(2)
    common = ["Share this", "Über uns", "Seite 3 von 9", "© 2020 Site", "A long standing line " * 12, "ab", "  Menu  \r"]
    rows = []
    for i in range(260):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randrange(9))]
        rows.append((i, f"https://{'big' if rng.random() < 0.8 else 'small'}.example/{i}", "t", rng.choice(["\n".join(lines), None]) if rng.random() < 0.1 else "\n".join(lines)))
    got = sorted(map(tuple, repeated_lines.repeated_lines(pages(spark, rows + ODD)).collect()))
    assert got == brute_repeated(rows + ODD) and got


def test_arrays_by_join_are_those_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeated_lines, "SLICE_ROWS", 7)
    texts = spark.createDataFrame([(i, f"s{i % 3 if i < 60 else 0}" if i % 11 else None, str(i)) for i in range(200)], "page_id long, site string, text string")
    values = spark.createDataFrame([(f"s{k % 2}", k) for k in range(9)], "site string, line long")
    totals = texts.where("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("site_rows"))
    a, b = (sorted((r.page_id, r.site, tuple(sorted(r.hot or ()))) for r in repeated_lines.with_arrays(texts, values, totals, "line", most).collect()) for most in (1000, 3))
    assert a == b and len(a) == 200


def test_without_repeated_lines(spark):
    rows = [(i, "https://a.example/x", "t", f"Share this\nown {'abc'[i % 3] * (i + 3)}") for i in range(6)] + [(9, None, "t", None)]
    out = {r.page_id: r for r in repeated_lines.without_repeated_lines(pages(spark, rows)).collect()}
    assert out[0].text == "own aaa" and out[0].removed_lines == 1 and out[9].text is None


@pytest.mark.parametrize("operator", [repeated_lines.repeated_lines, repeated_lines.without_repeated_lines, boilerplate.furniture_lines, boilerplate.articles, residue.residue_fields, garbled.garbled_fields])
def test_page_operators_on_empty_and_odd_tables(spark, operator):
    assert operator(pages(spark, [])).collect() == []
    out = operator(pages(spark, ODD)).collect()
    if out and "text" in out[0].__fields__:  # rows that share an id stay apart, null texts stay null
        assert sorted((r.page_id, r.text is None) for r in out) == [(1, True), (2, False), (3, False), (4, False), (4, False), (5, False)]


# --- splitting

@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?。\n\t\r-é😀", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_round_trip(text, limit, overlap):
    got = splitting.pieces(text, limit, overlap)
    assert "".join(text[a + again:b] for a, b, again, _ in got) == text
    for k, (a, b, again, forced) in enumerate(got):
        assert b - a <= limit and 0 <= again <= overlap
        if k:
            assert a >= got[k - 1][0]
    assert any(f for *_, f in got) == (splitting.longest_unbroken(text) > limit)


def test_split_oversized(spark):
    df = spark.createDataFrame([(1, "x" * 6000, "c"), (2, "word " * 900, "c"), (3, None, "c"), (4, "", "c"), (5, "y" * 2600, "c"), (2, "word " * 900, "c")], "id long, text string, piece_no string")
    out = splitting.split_oversized(df, id_col="id", text_col="text").collect()
    assert {r.record_id for r in out} == {1, 2} and all(len(r.text) <= 2600 for r in out)
    kinds = dict((r.record_id, r.cut_kind) for r in splitting.oversized(splitting.split_oversized(df, id_col="id", text_col="text").select(F.lit("chunk").alias("record_kind"), "*")).collect())
    assert kinds == {1: "forced", 2: "natural"}


# --- packing

@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_pack_histogram_places_all(histogram):
    patterns = packing.pack_histogram(histogram, 50)
    placed = {}
    for pack, count in patterns:
        assert sum(pack) <= 50 and count > 0
        for length in pack:
            placed[length] = placed.get(length, 0) + count
    assert placed == histogram
    assert len(patterns) <= 2 * 50


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, "ä" * rng.randrange(60)) for i in range(300)] + [(400, None), (401, ""), (402, "é" * 500), (403, "same"), (403, "same")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, bucket string")
    kinds = spark.createDataFrame([("s", 64), ("l", 256)], "container_kind string, capacity_tokens int")
    out = packing.pack(docs, kinds).collect()
    load, total = {}, {}
    for r in out:
        load[r.container_kind, r.container_no] = load.get((r.container_kind, r.container_no), 0) + r.n_tokens
        total[r.container_kind, r.doc_id] = total.get((r.container_kind, r.doc_id), 0) + r.n_tokens
    caps = {"s": 64, "l": 256}
    assert all(n <= caps[k] for (k, _), n in load.items())
    size = {i: len(t.encode()) + 1 for i, t in rows if t is not None} | {403: 10}
    assert total == {(k, i): n for k in caps for i, n in size.items()}
    assert {(r.container_kind, r.doc_id) for r in out if r.n_pieces > 1} == {(k, i) for k in caps for i, n in size.items() if n > caps[k] and i != 403}
    assert packing.pack(docs.limit(0), kinds).count() == 0


# --- leakage

def brute_leaks(docs, items, n=12):
    w = {i: leakage.words(t or "") for i, t in items}
    grams = {i: {" ".join(x[k:k + n]) for k in range(len(x) - n + 1)} for i, x in w.items()}
    out = set()
    for d, t in docs:
        x = leakage.words(t or "")
        mine = {" ".join(x[k:k + n]) for k in range(len(x) - n + 1)}
        out |= {(d, i) for i, g in grams.items() if g & mine}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "be", "a", "Straße", "x9", "the", "over", "naïve", "12", "ω"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.randrange(8, 40))) for i in range(40)] + [(90, None), (91, "short"), (92, " ".join("a" * 14))]
    docs = []
    for d in range(200):
        text = sentence(rng.randrange(0, 60))
        if rng.random() < 0.6:
            w = (rng.choice(items[:40])[1] or "").split()
            a = rng.randrange(max(1, len(w) - 8))
            part = w[a:a + rng.randrange(8, 20)]
            text += " " + rng.choice([" ".join(part), ",\n".join(part).upper(), " — ".join(p[:1] + "­" + p[1:] for p in part)]) + " " + sentence(5)
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, "a " * 40_000)]
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, item_text string"), block_items=15).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 20


def test_leaks_of_items_with_a_stock_opening(spark, monkeypatch):
    """Stock openings shorter and longer than a passage, in many items and in very long texts."""
    rng = random.Random(9)
    sentence = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "the", "over", "kappa"]) for _ in range(n))
    short, long = "Read the text and answer the question in full", "Read the following passage with great care and then answer each of the questions"
    items = [(i, f"{short if i % 3 else long}. {sentence(14)}") for i in range(400)]
    docs = [(d, f"{sentence(4)} {rng.choice([short, long, ''])}. {sentence(6)} {' '.join(items[rng.randrange(400)][1].split()[-rng.randrange(9, 16):])} end") for d in range(60)]
    docs += [(100, f"{short}. " * 3_000), (101, f"x{long}y"), (102, f"{long} " * 300)]
    index = leakage.ItemIndex(items, leakage.Q, leakage.EDITS, leakage.RUN_WORDS)
    got = {(docs[t][0], i) for t, i, *_ in index.search([t for _, t in docs])}
    assert got == brute_leaks(docs, items) and index.common.any() and index.stock


def test_leaks_of_4000_items_of_one_opening():
    opening = "Read the text and answer the question in full with the words of the text"
    items = [(i, f"{opening[:46]} {i} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(4_000)]
    index = leakage.ItemIndex(items, leakage.Q, leakage.EDITS, leakage.RUN_WORDS)
    found = index.search([f"{opening[:46]}, " * 20_000 + items[77][1]])
    assert {i for _, i, *_ in found} == {77}


def test_pairs_of_levels():
    rng = np.random.default_rng(3)
    level = rng.integers(1, 6, 20_000)
    a, b = reading_level.LevelModel.pairs(level, 60)
    assert (level[a] > level[b]).all() and len(a) <= 60 * 20_000 and len(np.union1d(a, b)) == 20_000
    few = np.array([1, 1, 2, 3])
    a, b = reading_level.LevelModel.pairs(few, 60)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}


def test_slots_by_join_are_those_by_broadcast(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "x" * (7 if i % 3 == 0 else rng.randrange(60))) for i in range(900)], "doc_id long, text string")
    kinds = spark.createDataFrame([("s", 64), ("l", 256)], "container_kind string, capacity_tokens int")
    a, b = (sorted(map(tuple, packing.pack(docs, kinds, most_broadcast=n).collect())) for n in (10_000, 0))
    assert a == b and len(a) == 1800
    with pytest.raises(ValueError, match="two capacities"):
        packing.pack(docs, kinds.union(spark.createDataFrame([("s", 65)], kinds.schema)))


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    assert leakage.leaked_items(docs, items).collect() == []


# --- reading level

def test_reading_level_held_out(spark, sf_dir):
    rows = [(r.reading_level, r.sample_text) for r in spark.read.parquet(f"{sf_dir}/reading_samples.parquet").orderBy("sample_id").collect()]
    random.Random(1).shuffle(rows)
    right = 0
    for part in range(5):
        model = reading_level.LevelModel.fit([r for i, r in enumerate(rows) if i % 5 != part])
        _, level = model.score([t for _, t in rows[part::5]])
        right += int((np.floor(level + 0.5) == [k for k, _ in rows[part::5]]).sum())
    assert right / len(rows) >= 0.95


def test_reading_levels_of_odd_texts(spark, sf_dir):
    samples = spark.read.parquet(f"{sf_dir}/reading_samples.parquet")
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "12 34 — !", 1.0), (4, "The cat sat. " * 30_000, 1.0), (4, "The cat sat. " * 30_000, 1.0)], "doc_id long, text string, score double")
    out = reading_level.reading_levels(docs, samples).collect()
    assert [r.doc_id for r in out] == [4, 4] and all(1 <= r.reading_level <= 5 for r in out)
    assert reading_level.reading_levels(docs.limit(0), samples).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    x = rng.normal(size=80)
    ends, values = reading_level._isotonic(x, x + rng.normal(size=80))
    assert (np.diff(values) >= 0).all() and (np.diff(ends) >= 0).all()


# --- garbled text

CLEAN = ["Der fleißige Prüfer ergänzt das nötige Gerät für das übliche Rezept", "La méthode proposée vérifie le reçu détaillé à la fin de l'été", "A café owner’s résumé — “quoted” words… cost €30", "Опытный читатель хранит полный текст без лишних затрат", "公開された記録は検査の後で信頼できる証拠を確認した。"]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251")]


def test_garbled_fields_are_found_and_restored(spark):
    rows, damaged = [], {}
    for i in range(600):
        text = CLEAN[i % len(CLEAN)]
        if i % 12 == 0:
            made, read = WRONG[(i // 12) % len(WRONG)]
            bad = "".join(garbled_byte(b, read) for b in text.encode(made))
            damaged[i] = text
            rows.append((i, "https://a.example/x", "plain", f"{CLEAN[0]}\n{bad}"))
        else:
            rows.append((i, "https://a.example/x", "NÃO, MAÇÃ", f"{text}\n{CLEAN[0]}"))
    rows.append((999, "https://a.example/x", "lost �", None))
    out = {(r.page_id, r.field_name): r for r in garbled.garbled_fields(pages(spark, rows)).collect()}
    assert set(out) == {(i, "text_content") for i in damaged} | {(999, "title")}
    assert sum(out[i, "text_content"].restored == f"{CLEAN[0]}\n{t}" for i, t in damaged.items()) >= 0.9 * len(damaged)


def garbled_byte(b, read):
    try:
        return bytes([b]).decode(read)
    except UnicodeDecodeError:
        return chr(b)


def test_readings_invert_each_codec():
    for text in CLEAN:
        for codec in ("cp1252", "cp437", "mac_roman", "cp1251"):
            bad = "".join(garbled_byte(b, codec) for b in text.encode())
            assert garbled.utf8_readings(bad, codec)[0] == text


# --- boilerplate and residue

@pytest.mark.parametrize(("line", "kind"), [
    ("Home | About us | Contact", "furniture"), ("Home > Guides > A page of its own", "furniture"), ("By Ada Byron", "furniture"), ("Tags: oven, pantry", "furniture"),
    ("The banner read \"We use cookies to measure how pages are read\", and the editor kept it.", "article"), ("- an item of a list", "article"), ("passage | helpful | package", "article"),
    ("# list, page, tags", "short and worded like a link"), ("## A heading of its own", "article"), ("A short line of its own", "short"), ("bob92 wrote: I did the same, thanks!", "attributed"), ("Home | " * 80, "furniture"),
])
def test_first_pass(line, kind):
    known = [furniture.key("part", x) for x in ("home", "about us", "contact", "guides")] + [furniture.key("opening", "by"), furniture.key("lead", "tags")]
    assert furniture.Labels(known).first_pass(furniture.normal(line).strip(" "))[0] == kind


def test_placeholders_and_quotations():
    index = residue.Exemplars()
    assert index.unfilled("Dear {{ name }},") and index.unfilled("${price} | Site") and index.unfilled("TODO: write headline")
    assert not index.unfilled("In the template language, `{{ name }}` prints the name.") and not index.unfilled("Aceptar todo | Rechazar")


@pytest.mark.parametrize(("text", "kinds"), [
    ("The requested URL was not\nfound on this server.", ["error", "error"]), ("410 Gone", ["error"]), ("Pagina web\n\n404 Not Found", [None, None, "error"]),
    ("We're sorry but app doesn't work properly without JavaScript enabled. Please enable it to continue.", ["script"]),
    ("Sorry, this page no longer exists. It has moved. Access denied. Request id 8b90afd5ec", ["error"]),
    ("The pump was not found in the cellar, so the gardener looked for another one on the server of the town.", [None]),
])
def test_windows_of_residue(text, kinds):
    assert residue.Exemplars(weights={t: 1.0 for t in ("the", "was", "on", "not", "it", "is", "this", "a")}, other=4.0).of_lines(text.split("\n")) == kinds


def test_article_lines_and_residue(spark):
    article = "The editor reads the report before the next visit, because the readers asked for it. It was not easy. "
    rows = [
        (1, "https://a.example/1", "A page", f"Home | About us | Contact\n{article * 2}\nKeep reading\nWhy Every Site Needs A Map\nTerms of use | Privacy"),
        (2, "https://a.example/2", "404 Not Found", "Home | About us | Contact\nSorry, this page has moved or no longer exists."),
        (3, "https://a.example/3", "A page", f"Please enable JavaScript to view this page.\n{article * 2}"),
        (4, "https://a.example/4", "A page", "Please enable JavaScript to view this page."),
        (5, "https://a.example/5", "{{title}}", f"{article} Dear [[name]], hello."),
        (6, "https://a.example/6", "A page", f"A reply such as \"Page not found\" told the editor to leave it out. {article * 2}"),
    ]
    menus = [(100 + i, "https://b.example/x", "t", f"Home | About us | Contact\nOf its own: number {'abcdefgh'[i] * 9} is here, and it is the only one.\nKeep reading\nTerms of use | Privacy") for i in range(8)]
    df = pages(spark, rows + menus)
    found = sorted(tuple(r) for r in boilerplate.furniture_lines(df).collect() if r.page_id < 100)
    assert found == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 1), (3, 1)]
    assert sorted((r.page_id, r.field_name) for r in residue.residue_fields(df).collect()) == [(2, "text_content"), (2, "title"), (4, "text_content"), (5, "text_content"), (5, "title")]
    assert {r.page_id: r.text for r in boilerplate.articles(df).collect()}[1] == article * 2


def test_furniture_in_words_of_no_list(spark):
    """Menus, bylines, teasers and footers of a language that no list of this package knows, on sites of 12 pages and of 3."""
    rng = random.Random(8)
    noun = ["huis", "tuin", "brood", "fiets", "water", "markt", "lamp", "boek", "straat", "molen", "kaas", "regen"]
    verb = ["maakt", "koopt", "zoekt", "draagt", "leest", "bouwt"]
    sentence = lambda: f"Een {rng.choice(noun)} {rng.choice(verb)} en {rng.choice(verb)} een {rng.choice(noun)} op de {rng.choice(noun)}, maar die {rng.choice(noun)} is {rng.choice(verb)} {rng.randrange(99)} keer."
    rows, truth = [], set()
    for i in range(180):
        site = i % 12 if i < 144 else 12 + i % 12
        menu = rng.choice([["Voorpagina", "Bedrijven", "Beleggers"], ["Voorpagina", "Vacatures", "Over de krant"]])
        lines = [(" | ".join(menu), True), ("Direct naar de inhoud", True), (f"Geschreven door {rng.choice('ABCDE')}. Jansma", True), (f"Een {rng.choice(noun)} voor de {rng.choice(noun)}", False)]
        lines += [(sentence(), False) for _ in range(rng.randrange(2, 6))] + [(f"- {rng.choice(noun)} en {rng.choice(noun)}", False)]
        lines += [("Meest gelezen verhalen", True)] + [(f"Waarom een {rng.choice(noun)} de {rng.choice(noun)} {rng.choice(verb)}", True) for _ in range(2)]
        lines += [(f"© {rng.randrange(2010, 2024)} Alle rechten voorbehouden aan de krant", True), ("Privacy | Colofon", True)]
        rows.append((i, f"https://site{site}.example/{i}", "t", "\n".join(x for x, _ in lines)))
        truth |= {(i, no) for no, (_, bad) in enumerate(lines, 1) if bad}
    got = {tuple(r) for r in boilerplate.furniture_lines(pages(spark, rows)).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


# --- registered queries

def test_against_sql(spark, sf_dir):
    from lodestrata.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import same

    for name, sql in ORACLE_SQL.items():
        same(spark, QUERIES[name], sql, sf_dir)


def test_all_run(spark, sf_dir):
    from lodestrata.llm.queries import ORACLE_SQL, QUERIES

    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        QUERIES[name](spark, sf_dir).collect()
