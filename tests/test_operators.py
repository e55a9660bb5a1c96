import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import components, crawl, dedup, evaluate, evidence, index, ranking, retrieval


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {n: find(n) for e in edges for n in e}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    loops = components.connected_components(spark.createDataFrame([(1, None), (2, 2)], "src long, dst long"))
    assert sorted(map(tuple, loops.collect())) == [(1, 1), (2, 2)]


def test_frontier_order_with_exploration(spark):
    rows = [(i, "j", f"u{i}", 1, s) for i, s in enumerate([0.9, 0.8, 0.7, 0.6, 0.5, 0.4])]
    links = spark.createDataFrame(rows, "id long, crawl_job_id string, normalized_target_url string, target_depth int, relevance_score double")
    got = [r.url for r in crawl.frontier_order(links, 0.5).orderBy("position").collect()]
    left, want = [u for _, _, u, _, _ in rows], []
    for step in range(1, len(rows) + 1):
        want.append(left.pop() if step % 2 == 0 and len(left) > 1 else left.pop(0))
    assert got == want


def test_positions_equal_one_sort(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.7 else "b", rng.randrange(40) / 8, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s double, id long")
    got = {(r.g, r.id): r.pos for r in ranking.positions(df, ["g"], F.floor("s"), [F.col("s").desc(), "id"], "pos", descending=True).collect()}
    for g in "ab":
        for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            assert got[g, i] == k


def test_fuse(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, x int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, y int")
    best = ranking.fuse([(a, "x", 1.0), (b, "y", 1.0)], ["id"]).orderBy(F.desc("rrf"), "id").collect()
    assert [r.id for r in best] == [2, 1, 3]


def test_duplicates_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (2, "x")], "id long, h string")
    got = sorted(((r.id, r.duplicate_of) for r in dedup.mark_duplicates(df, ["h"], "id").collect()), key=str)
    assert got == sorted([(1, None), (2, 1), (2, 1), (3, None), (4, None)], key=str)


def test_difference(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    a = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, v string")
    assert sorted(map(tuple, dedup.difference(e, a, ["k"], ["v"]).collect())) == [(1, "missing"), (2, "different"), (4, "unexpected")]


@pytest.mark.parametrize(("relations", "status"), [
    ([("SUPPORT", 1, True), ("SUPPORT", 2, True)], "CORROBORATED"),
    ([("SUPPORT", 1, True), ("SUPPORT", 1, True)], "SUPPORTED"),
    ([("SUPPORT", 1, True), ("CONTRADICTION", 2, True)], "CONTESTED"),
    ([("CONTRADICTION", 2, False)], "INSUFFICIENT"),
    ([("PARTIAL", 2, False)], "PARTIALLY_SUPPORTED"),
    ([("SUPPORT", 1, True), ("SUPPORT", 2, False)], "INSUFFICIENT"),
    ([("NEUTRAL", 1, True)], "INSUFFICIENT"),
])
def test_decide(spark, relations, status):
    df = spark.createDataFrame([("c", *r) for r in relations], "claim string, relation string, source_group long, cited boolean")
    assert evidence.decide(df).first().status == status


def test_merge_guards(spark):
    never = [("It rose 5%", "It rose 6%"), ("It works", "It never works"), ("dataset A wins", "dataset B wins"), ("version 1 wins", "version 2 wins"), ("in 2020 it fell", "in 2021 it fell")]
    df = spark.createDataFrame(never, "a string, b string")
    assert not any(r[0] for r in df.select(evidence.safe_to_merge(F.col("a"), F.col("b"))).collect())
    assert df.select(evidence.safe_to_merge(F.col("a"), F.col("a"))).first()[0]


def test_sentence_spans():
    text = "As Smith et al. wrote, it holds. Really?\n\nNext line"
    assert [text[a:b] for a, b in evidence.spans(text)] == ["As Smith et al. wrote, it holds.", "Really?", "Next line"]
    assert evidence.spans("") == []


def test_sections(spark):
    text = "Intro here.\n\n# First\n\nBody one.\n \n## Deep\nnot a heading\n\n# Second\nBody two.\n\n### no heading\n\n## Third\r\n\r\nend"
    df = spark.createDataFrame([(1, text, "T"), (2, None, None), (3, "", "x"), (4, " \n\n ", "x"), (5, "plain", None)], "id long, text string, title string")
    got = [(r.id, r.block_no, r.heading, r.body) for r in index.sections(df, id_col="id", text_col="text", title_col="title").orderBy("id", "block_no").collect()]
    assert got == [(1, 0, "T", "Intro here."), (1, 2, "First", "Body one."), (1, 3, "First", "## Deep\nnot a heading"), (1, 4, "Second", "Body two."), (1, 5, "Second", "### no heading"), (1, 7, "Third", "end"), (5, 0, "", "plain")]


def test_chunks(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 30))).capitalize() + "."
    docs = [(i, "\n\n".join([f"# Part {k}\n\n" + "\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(3)) for k in range(rng.randrange(1, 4))]), "T") for i in range(20)]
    df = spark.createDataFrame(docs + [(90, None, "T"), (91, "", None), (92, "w " * 500, "T"), (93, "tail", "T")], "id long, text string, title string")
    rows = index.chunks(df, id_col="id", text_col="text", title_col="title", target=40, most=50, overlap=8, least=10).orderBy("id", "chunk_no").collect()
    by = {}
    for r in rows:
        assert r.words == len(r.body.split()) <= 50
        by.setdefault(r.id, []).append(r)
    for i, text, _ in docs + [(92, "w " * 500, "T"), (93, "tail", "T")]:
        words = [w for block in text.split("\n\n") if not block.startswith("# ") for w in block.split()]
        assert [r.chunk_no for r in by[i]] == list(range(len(by[i])))
        at = 0
        for before, r in zip([None, *by[i]], by[i], strict=False):  # each chunk goes on where the last ended, or up to 8 words before, under one heading
            own = r.body.split()
            again = next(k for k in range(min(8, at) + 1) if words[at - k:at - k + len(own)] == own and (k == 0 or before.heading == r.heading))
            at += len(own) - again
        assert at == len(words)
    assert set(by) == {*range(20), 92, 93} and len(by[92]) == 10


def test_short_tail_joins_under_one_heading():
    words = lambda n: ["w"] * n
    assert [len(w) for _, w in index.pack_units([("a", words(38)), ("a", words(5))], 40, 50, 0, 10)] == [43]
    assert [len(w) for _, w in index.pack_units([("a", words(38)), ("b", words(5))], 40, 50, 0, 10)] == [38, 5]
    assert [len(w) for _, w in index.pack_units([("a", words(38)), ("a", words(15))], 40, 60, 6, 10)] == [38, 21]


def test_upkeep(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "id long, document_id long")
    sources = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 2, 20), (4, 3, 20), (5, 2, 30)], "id long, chunk_id long, document_id long")
    got = {r.id: (r.action, r.new_document_id) for r in index.upkeep(chunks, sources, spark.createDataFrame([(10,)], "document_id long")).collect()}
    assert got == {1: ("pruned", None), 2: ("rehomed", 20), 3: ("kept", None), 4: ("pruned", None)}


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(6)
    sets = [(i, sorted({f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 8))})) for i in range(80)]
    got = {(r.a, r.b): round(r.overlap, 9) for r in evaluate.similar_sets(spark.createDataFrame(sets, "id long, s array<string>"), 0.5).collect()}
    full = {i: set(x) for i, x in sets}
    empty = [i for i, x in full.items() if not x]
    want = {(a, b): round(len(full[a] & full[b]) / len(full[a] | full[b]), 9) for a in full for b in full if a < b and full[a] and full[b] and len(full[a] & full[b]) >= 0.5 * len(full[a] | full[b])}
    assert got == want | {(empty[0], b): 1.0 for b in empty[1:]}


GRAPH_NODES = [(f"n{i}", "A" if i % 3 else "B") for i in range(9)]
GRAPH_EDGES = [("e1", "x", "n0", "n1"), ("e2", "x", "n0", "n1"), ("e3", "x", "n1", "n2"), ("e4", "y", "n0", "n3"), ("e5", "x", "n3", "n2"), ("e6", "x", "n2", "n4"), ("e7", "x", "n4", "n5"), ("e8", "x", "n7", "gone")]


def _graph(spark):
    return spark.createDataFrame(GRAPH_NODES, "node_id string, node_type string"), spark.createDataFrame(GRAPH_EDGES, "edge_id string, edge_type string, src string, dst string")


def test_views_with_filters_and_caps(spark):
    n, e = _graph(spark)
    seeds = spark.createDataFrame([("n0",), ("n4",), ("n7",)], "node string")
    see = lambda **k: {r.seed: (r.nodes, r.edges, r.truncated) for r in components.view(n, e, seeds, 2, **k).collect()}
    assert see(direction="out") == {"n0": (4, 5, False), "n4": (2, 1, False), "n7": (1, 0, False)}
    assert see(direction="out", most_nodes=2) == {"n0": (2, 2, True), "n4": (2, 1, False), "n7": (1, 0, False)}
    assert see(direction="out", node_types=["A"]) == {"n0": (3, 3, False), "n4": (2, 1, False), "n7": (1, 0, False)}
    assert see(direction="out", edge_types=["y"]) == {"n0": (2, 1, False), "n4": (1, 0, False), "n7": (1, 0, False)}


def test_listed_paths(spark):
    _, e = _graph(spark)
    pairs = spark.createDataFrame([("n0", "n2"), ("n0", "n5"), ("n1", "n1"), ("n5", "n0")], "source string, target string")
    got = {}
    for r in components.list_paths(e, pairs, 4, 2).collect():
        got.setdefault((r.source, r.target), []).append(r.path)
    assert {k: sorted(v) for k, v in got.items()} == {("n0", "n2"): [["e1", "e3"], ["e2", "e3"]], ("n0", "n5"): [["e1", "e3", "e6", "e7"], ["e2", "e3", "e6", "e7"]], ("n1", "n1"): [[]]}


def _carried(monkeypatch):
    """Rows of each table that a search cuts."""
    rows, cut = [], components.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(components, "cut", counted)
    return rows


FAN_EDGES = [(f"{end}{i}", *(("s", f"m{i}") if end == "a" else (f"m{i}", f"t{i}"))) for i in range(40) for end in "ab"]
FAN_PAIRS = [("s", f"t{i}") for i in range(40)]


def test_listed_paths_of_a_source_share_the_search(spark, monkeypatch):
    rows = _carried(monkeypatch)
    e, pairs = spark.createDataFrame(FAN_EDGES, "edge_id string, src string, dst string"), spark.createDataFrame(FAN_PAIRS, "source string, target string")
    got = {(r.source, r.target): (r.path, r.hops) for r in components.list_paths(e, pairs, 3, 3).collect()}
    assert got == {("s", f"t{i}"): ([f"a{i}", f"b{i}"], 2) for i in range(40)}
    assert sum(rows) < 200


def _all_paths(edges, source, most_hops):
    """The shortest paths from a node to each other, as edge ids."""
    best, level = {source: [()]}, {source: [()]}
    for _ in range(most_hops):
        new = {}
        for e, a, b in edges:
            if a in level and b not in best:
                new.setdefault(b, []).extend((*p, e) for p in level[a])
        best |= new
        level = new
    return best


@pytest.mark.parametrize("small", [0, 10_000])
def test_listed_paths_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_FRONT", small, raising=False)
    rng = random.Random(8)
    edges = [(f"e{i:02}", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for i in range(34)]
    ends = [(f"n{a}", f"n{b}") for a in range(0, 14, 2) for b in range(14)] + [("n0", "n0"), ("n2", "n5"), ("n0", "none"), (None, "n1"), ("n1", None)]
    pairs = spark.createDataFrame(ends, "source string, target string")
    got = sorted((r.source, r.target, tuple(r.path), r.hops) for r in components.list_paths(spark.createDataFrame(edges, "edge_id string, src string, dst string"), pairs, 3, 2).collect())
    want = sorted((a, b, p, len(p)) for a, b in set(ends) if a for p in sorted(_all_paths(edges, a, 3).get(b, []))[:2])
    assert {h for *_, h in want} == {0, 1, 2, 3}
    assert got == want


def test_counted_paths_of_a_source_share_the_search(spark, monkeypatch):
    rows = _carried(monkeypatch)
    e, pairs = spark.createDataFrame(FAN_EDGES, "edge_id string, src string, dst string"), spark.createDataFrame(FAN_PAIRS, "source string, target string")
    got = sorted(map(tuple, components.shortest_paths(e, pairs, 3).collect()))
    assert got == sorted(("s", f"t{i}", 2, 1) for i in range(40))
    assert sum(rows) < 200


@pytest.mark.parametrize("small", [0, 10_000])
def test_counted_paths_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_FRONT", small, raising=False)
    rng = random.Random(9)
    edges = [(f"e{i:02}", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for i in range(34)]
    edges += [(f"f{i:02}", a, b) for i, (_, a, b) in enumerate(edges[:12])]
    ends = [(f"n{a}", f"n{b}") for a in range(0, 14, 2) for b in range(14)] + [("n0", "n0"), ("n2", "n5"), ("n0", "none"), (None, "n1"), ("n1", None)]
    pairs = spark.createDataFrame(ends, "source string, target string")
    got = sorted(map(tuple, components.shortest_paths(spark.createDataFrame(edges, "edge_id string, src string, dst string"), pairs, 3).collect()))
    want = sorted((a, b, len(ways[0]), len(ways)) for a, b in set(ends) if a and (ways := _all_paths(edges, a, 3).get(b)))
    assert {h for _, _, h, _ in want} == {0, 1, 2, 3} and max(n for *_, n in want) > 3
    assert got == want


def test_snapshots_are_replaced_verified_and_dropped(spark, tmp_path):
    from lodestrata.sources.snapshots import Snapshots

    n, e = _graph(spark)
    n = n.withColumn("label", F.col("node_id"))
    store = Snapshots(spark, str(tmp_path))
    store.replace("one", n, e)
    assert [x.count() for x in store.load("one")] == [9, 8]
    new = spark.createDataFrame([("n0", "B", "other"), ("n99", "A", "new")], "node_id string, node_type string, label string")
    counts = {(r.element, r.kind): (r.created, r.reused, r.removed) for r in store.upsert("one", new, e.limit(0), "two").collect()}
    assert counts == {("node", "A"): (1, 6, 0), ("node", "B"): (0, 3, 0), ("edge", "x"): (0, 7, 0), ("edge", "y"): (0, 1, 0)}
    assert {r.node_id: r.label for r in store.load("two")[0].collect()}["n0"] == "other"
    n.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/nodes/snapshot_id=one")
    with pytest.raises(ValueError, match="not as it was written"):
        store.load("one")
    store.drop("two")
    with pytest.raises(ValueError, match="not as it was written"):
        store.load("two")
    with pytest.raises(ValueError, match="not a name"):
        store.replace("../x", n, e)


def test_lexical_scores_against_brute_force(spark):
    from math import log

    rng = random.Random(4)
    word = lambda: rng.choice(["red", "blue", "green", "dark-grey", "x1"])
    rows = [(i, "g" if i % 4 else "h", i // 3, " ".join(word() for _ in range(2)), None, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    passages = spark.createDataFrame(rows, "passage_id long, grp string, document_id long, title string, heading string, text string")
    terms = retrieval.query_terms(spark.createDataFrame([("q", "g", "Red dark-grey red none")], "id string, grp string, question string"), id_col="id", text_col="question", group_col="grp")
    got = {r.passage_id: r.score for r in retrieval.scored(retrieval.lexical_index(passages, terms, {"title": 2, "heading": 1, "text": 1}), terms).collect()}
    bags = {i: (t + " ") .split() * 2 + x.split() for i, g, _, t, _, x in rows if g == "g"}
    mean = sum(map(len, bags.values())) / len(bags)
    want = {}
    for i, bag in bags.items():
        for t in ("red", "dark-grey", "none"):
            if tf := bag.count(t):
                df = sum(t in b for b in bags.values())
                want[i] = want.get(i, 0) + log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
    assert got == pytest.approx(want)


def test_dense_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [])], "id long, e array<double>")
    got = retrieval.dense_topk(df, df.where("id % 50 = 0"), 5, id_col="id", vector_col="e").collect()
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for q in (0, 50, 100):
        s = n @ n[q]
        want = [i for i in sorted(range(120), key=lambda i: (-round(s[i], 6), i)) if i not in (q, 7)][:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "query_id string, id string, grade int")
    m = evaluate.ranking_metrics(ranked, relevant, 2).first()
    assert (m.recall, m.precision, m.mrr, m.hit) == (0.5, 0.5, 0.5, True)


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, hash string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "key long, hash string")
    assert dict(index.incremental(old, new).collect()) == {1: "removed", 2: "skipped", 3: "changed", 4: "added"}


def test_frontier_order_with_ties_against_a_queue(spark):
    rng = random.Random(11)
    for k, rate in ((2, 0.5), (3, 1 / 3), (5, 0.2), (1, 1.0)):
        rows = [(100 * j + i, f"j{j}", f"u{i}", rng.randrange(3), rng.choice([0.0, 0.2, 0.5, 0.9])) for j in range(12) for i in range(rng.randrange(1, 30))]
        links = spark.createDataFrame(rows, "id long, crawl_job_id string, normalized_target_url string, target_depth int, relevance_score double")
        got = {}
        for r in crawl.frontier_order(links, rate).orderBy("crawl_job_id", "position").collect():
            got.setdefault(r.crawl_job_id, []).append((r.url, r.explore))
        for job in {r[1] for r in rows}:
            left = [(s, d, i, u) for i, x, u, d, s in rows if x == job]
            want, step = [], 0
            while left:
                step += 1
                explore = step % k == 0 and len(left) > 1
                one = min(left, key=(lambda x: x) if explore else (lambda x: (-x[0], *x[1:])))
                left.remove(one)
                want.append((one[3], explore))
            assert got[job] == want


def test_attach_keeps_hot_keys_apart(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}", None) for i in range(60)] + [(90, None, 1)], "id long, h string, first long")
    per = df.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    got = sorted((r.id, r.h or "", r.least) for r in dedup.attach(df, per, ["h"], "n", hot_rows=10).collect())
    least = {"hot": 1, **{f"k{i % 7}": min(j for j in range(60) if j % 2 == 0 and j % 7 == i % 7) for i in range(0, 60, 2)}}
    assert [(a, b) for a, b, _ in got] == sorted((i, "hot" if i % 2 else f"k{i % 7}") for i in range(60)) + [(90, "")]
    assert all(c == least.get(b) for _, b, c in got)


def test_medians_of_sliced_groups(spark):
    import statistics

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(100) / 16])) for _ in range(200)] + [("none", None)]
    got = {r.g: r.median for r in evaluate.distribution(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("a", "b", None):
        assert got[g] == round(statistics.median([v for x, v in rows if x == g and v is not None]), 6)
    assert got["none"] is None


@pytest.mark.parametrize(("a", "b"), [("it rises if heated", "it rises if cooled"), ("it is faster", "it is slower"), ("loads improve", "loads worsen"), ("higher yield", "a yield")])
def test_merge_guards_of_condition_and_direction(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert not df.select(evidence.safe_to_merge(F.col("a"), F.col("b"))).first()[0] and df.select(evidence.safe_to_merge(F.col("a"), F.col("a"))).first()[0]


def test_spans_join_abbreviations_over_lines():
    text = "See fig.\n3 of Dr. Who vs. the rest. Next!  Last"
    assert [text[a:b] for a, b in evidence.spans(text)] == ["See fig.\n3 of Dr. Who vs. the rest.", "Next!", "Last"]
