"""The main body of pages whose text also holds menus, notices, teasers and footers.

Two passes over the lines of a page. The first classifies each line by itself. It is furniture if its site repeats it,
if labels make up half of it (its link density), if it opens like such lines or ends with the page's title after other
parts; it is article if it is long enough and dense enough in common words, or has the marks of a heading, a list item
or a table row. In the second pass the lines left undecided inherit the label of the nearest decided lines on both
sides; where these differ, a short line without any common word is worded like a link and goes with the furniture, as
does a sentence with somebody's name before it after the article, and any other line with the article. A page whose article has not begun keeps its short lines: they are its headings.

The labels are learned from the crawl (see ``furniture``): one pass counts lines and their parts by site, its result is
written to the shared folder and gives both the repeated lines of each site and the labels of the whole crawl.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import furniture as K
from lodestrata.llm.codepoints import map_text
from lodestrata.llm.repeated_lines import site_of, standing_numbers, with_arrays
from lodestrata.llm.residue import EXEMPLARS, SCRIPT, Exemplars, surfaces, token_set, tokens
from lodestrata.sources.checkpoints import cut

#: Fewer characters of article than this (about two sentences) beside a notice or message, and that stands in its place.
LEAST_ARTICLE = 160
#: A line is repeated by its site if it is on so many of its pages, and on this share of its rows.
MIN_PAGES, MIN_SHARE = 5, 0.05
#: Repeated lines that an opening or shape must be found on.
LEAST_LINES = 5

#: What is counted: whole lines, parts by pages, openings and shapes by lines, leading words by pages, tokens of exemplars and texts over all sites.
LINE, PART, SINGLE, LEAD, TOKEN = 0, 1, 2, 3, 4
#: What is added to a sort for its uses over all sites, and the sort of the number of all uses.
USES, ALL_USES = 10, 20


_INDENTS = (" ", "\t")

#: What a task has found for the lines it has met.
_FEATURES: dict[str, tuple[list[int], list[int], list[int]]] = {}


class Forms:
    """The lines of a block of texts: their normal ``forms`` by text; ``row``, ``no`` (from 1) and ``hash`` of those with three letters, as ``Lines`` has them but with a hash of their own; ``distinct`` forms by their ``keys``, and ``which`` of them each line is."""

    def __init__(self, texts: list[str | None]) -> None:
        self.forms = [[x.strip(" ") for x in K.normal(t).split("\n")] if t else [""] for t in texts]
        known: dict[str, int] = {"": -1}
        self.distinct: list[str] = []
        rows, nos, which = [], [], []
        for row, own in enumerate(self.forms):
            for no, form in enumerate(own, 1):
                k = known.get(form)
                if k is None:
                    k = known[form] = len(self.distinct) if three_letters(form) else -1
                    if k >= 0:
                        self.distinct.append(form)
                if k >= 0:
                    rows.append(row)
                    nos.append(no)
                    which.append(k)
        self.row, self.no, self.which = (np.array(x, np.int64) for x in (rows, nos, which))
        keys = np.fromiter((K.key("line", x) for x in self.distinct), np.int64, len(self.distinct))
        order = np.argsort(keys)
        self.keys, self.distinct = keys[order], [self.distinct[k] for k in order.tolist()]
        self.which = np.argsort(order)[self.which]
        self.hash = self.keys[self.which]


def three_letters(form: str) -> bool:
    return form[:3].isalpha() and len(form) > 2 or sum(map(str.isalpha, form[:20])) > 2 or sum(map(str.isalpha, form)) > 2


def page_features(block: pa.RecordBatch, vocabulary: dict[str, str]) -> pa.RecordBatch:
    """site, sort, line, feature, n: the pages of the block that hold each; leading words are counted apart from their lines, tokens apart from sites."""
    texts = block.column("text").to_pylist()
    lines = Forms(texts)
    sites = block.column("site").dictionary_encode()
    code = np.asarray(sites.indices.fill_null(-1)).astype(np.int64)
    good = code[lines.row] >= 0
    # each distinct line is taken apart once, each page that holds it counts once
    own = [_features(form) for form in lines.distinct]
    page, which = _distinct(lines.row[good], lines.which[good], len(own))
    pairs, held = _distinct(code[page], which, len(own), counts := [])
    columns = [[pairs], [np.full(len(pairs), LINE)], [lines.keys[held]], [np.zeros(len(pairs), np.int64)], counts]
    for sort, values in ((PART, [x[0] for x in own]), (SINGLE, [x[1] for x in own])):
        again, feature = _expanded(values, held)
        for column, x in zip(columns, (pairs[again], np.full(len(again), sort), lines.keys[held[again]], feature, counts[0][again]), strict=True):
            column.append(x)
    again, feature = _expanded([x[2] for x in own], which)
    leads, which = np.unique(feature, return_inverse=True)
    page, which = _distinct(page[again], which, len(leads))
    pairs, held = _distinct(code[page], which, len(leads), counts)
    for column, x in zip(columns, (pairs, np.full(len(pairs), LEAD), np.zeros(len(pairs), np.int64), leads[held]), strict=False):
        column.append(x)
    seen_tokens: Counter[str] = Counter({"": sum(map(bool, texts))})
    for t, forms in zip(texts, lines.forms, strict=True):
        if t:
            seen_tokens.update(token_set(t, vocabulary, "\n".join(forms)))
    extra = len(seen_tokens)
    columns[1].append(np.full(extra, TOKEN))
    columns[2].append(np.zeros(extra, np.int64))
    columns[3].append(np.fromiter((K.key("token", t) for t in seen_tokens), np.int64, extra))
    columns[4].append(np.fromiter(seen_tokens.values(), np.int64, extra))
    code, sort, line, feature, n = map(np.concatenate, columns)
    site = pa.concat_arrays([sites.dictionary.take(pa.array(code)), pa.nulls(extra, pa.string())])
    return pa.RecordBatch.from_arrays([site, pa.array(sort.astype(np.int8)), pa.array(line), pa.array(feature), pa.array(n)], ["site", "sort", "line", "feature", "n"])


def _features(form: str) -> tuple[list[int], list[int], list[int]]:
    own = _FEATURES.get(form)
    if own is None:
        if len(_FEATURES) > 200_000:
            _FEATURES.clear()
        own = K.features(form)
        if any(own):
            _FEATURES[form] = own
    return own


def _distinct(a: np.ndarray, b: np.ndarray, many: int, counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays, the second of numbers below ``many``; how often each is there is added to ``counts``."""
    both, n = np.unique(a * many + b, return_counts=True)
    if counts is not None:
        counts.append(n)
    return both // max(1, many), both % max(1, many)


def _expanded(values: list[list[int]], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``which`` its list of values, all in a row, and the place in ``which`` that each comes from."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.fromiter(chain.from_iterable(values), np.int64, int(size.sum()))
    first = np.cumsum(size) - size
    many = size[which]
    again = np.repeat(np.arange(len(which)), many)
    return again, flat[np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[which], many)]


class Crawl:
    """What the whole crawl says of lines: ``hot`` (site, line) of repeated lines, ``totals`` (site, site_rows), the labels, and the exemplars with their weights."""

    def __init__(self, base: DataFrame, labelled: dict[str, str] = EXEMPLARS) -> None:
        stems = {t for lines in labelled.values() for t in tokens(lines)}
        vocabulary = surfaces(stems)
        self.totals = base.where(F.col("site").isNotNull()).groupBy("site").agg(F.count("*").alias("site_rows"))
        counted = map_text(base.where(F.length("text") > 0).select("site", "text"), lambda block: page_features(block, vocabulary), "site string, sort byte, line long, feature long, n long", "text")
        counted = counted.groupBy("site", "sort", "line", "feature").agg(F.sum("n").alias("n"))
        # one shuffle of what the pages hold gives all three: what a site may repeat, how often each feature is used, and all uses
        weight = F.when(F.col("sort") == SINGLE, 1).when(F.col("sort").isin(PART, LEAD), F.col("n")).otherwise(0)
        often = counted.where((F.col("n") >= MIN_PAGES) | (F.col("sort") == TOKEN))
        uses = counted.groupBy("sort", "feature").agg(F.sum(weight).alias("n"), F.max("sort").alias("kind")).where((F.col("n") >= 2) & F.col("kind").isin(PART, SINGLE, LEAD))
        uses = uses.select(F.lit(None).cast("string").alias("site"), (F.col("kind") + USES).cast("byte").alias("sort"), F.lit(0).cast("long").alias("line"), "feature", "n")
        all_ = counted.agg(F.sum(weight).alias("n")).select(F.lit(None).cast("string").alias("site"), F.lit(ALL_USES).cast("byte").alias("sort"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("feature"), F.coalesce("n", F.lit(0)).alias("n"))
        stats = cut(often.unionByName(uses).unionByName(all_))
        repeated = stats.where(F.col("sort") < TOKEN).join(self.totals, "site").where(F.col("n") >= MIN_SHARE * F.col("site_rows"))
        self.hot = repeated.where(F.col("sort") == LINE).select("site", "line")
        on = repeated.where(F.col("sort") != LINE).groupBy((F.col("sort") + USES).cast("byte").alias("sort"), "feature").agg(F.sum(weight).alias("on_repeated"))
        total = stats.where(F.col("sort") == ALL_USES).first()["n"]
        rate = F.when(F.col("sort") == PART + USES, K.RATE["part"]).when(F.col("sort") == LEAD + USES, K.RATE["lead"]).otherwise(K.RATE["opening"])
        good = (F.col("n") >= K.LABEL_SHARE * total) & (F.col("on_repeated") >= rate * F.col("n")) & (F.col("on_repeated") >= F.when(F.col("sort") == SINGLE + USES, LEAST_LINES).otherwise(1))
        rows = stats.where(F.col("sort").between(USES, ALL_USES - 1)).join(on, ["sort", "feature"]).where(good).select("feature").toArrow()  # at most 1 / LABEL_SHARE rows
        self.labels = K.Labels(rows["feature"].to_numpy() if rows.num_rows else np.empty(0, np.int64))
        met = {r[0]: r[1] for r in stats.where(F.col("sort") == TOKEN).select("feature", "n").collect()}  # at most the exemplars' vocabulary
        self.exemplars = Exemplars.weighted(labelled, {t: met[k] for t in stems if (k := K.key("token", t)) in met}, met.get(K.key("token", ""), 0))


class Classifier:
    """Labels of a page's lines; remembers what it found for lines it has met."""

    def __init__(self, exemplars: Exemplars, labels: K.Labels) -> None:
        self.exemplars, self.labels = exemplars, labels

    def label(self, lines: list[str], title: str | None, standing: set[int], residue: list[str | None] | None = None, forms: list[str] | None = None) -> list[bool | None]:
        """For each line whether it belongs to the article; None for blank ones. ``standing`` holds the numbers, from 1, of the lines the site repeats."""
        return [None if w is None else good for good, w in self.reasons(lines, title, standing, residue, forms)]

    def reasons(self, lines: list[str], title: str | None, standing: set[int], residue: list[str | None] | None = None, forms: list[str] | None = None) -> list[tuple[bool | None, str | None]]:
        """(article, what decided it) of each line; ``residue`` and the normal ``forms`` are computed if they are not given."""
        n = len(lines)
        forms = [x.strip(" ") for x in K.normal("\n".join(lines)).split("\n")] if forms is None else forms
        residue = self.exemplars.of_lines(lines, forms) if residue is None else residue
        headline = K.skeleton(K.normal(title or "").strip(" ")).strip(" .,:;*-+#|/>()[]!?•·\"'")
        kinds: list[str | None] = [None] * n
        why: list[str | None] = [None] * n
        for i, form in enumerate(forms):
            if not form or form.isspace():
                continue
            if residue[i]:
                kinds[i], why[i] = K.GOOD, "residue"
            elif i + 1 in standing:
                kinds[i], why[i] = K.BAD, "repeated by the site"
            else:
                kind, reason, s = self.labels.first_pass(form)
                kinds[i], why[i] = kind, reason
                if headline and headline[:5] in s and kind not in (K.BAD, K.NEAR) and reason != "structure" and (t := K.title_part(s, headline)):
                    kinds[i], why[i] = (K.GOOD, "the title") if t == "whole" else (K.BAD, "trail to the title")
                elif lines[i][:1] in _INDENTS and kind in (K.SHORT, K.LINK, K.NEAR) and lines[i].startswith(("    ", "\t")):
                    kinds[i], why[i] = K.GOOD, "structure"
        self._notices(lines, kinds, why, residue)
        return self._inherit(lines, forms, kinds, why)

    @staticmethod
    def _notices(lines: list[str], kinds: list[str | None], why: list[str | None], residue: list[str | None]) -> None:
        """A script notice beside a full article is furniture."""
        notices = [i for i, r in enumerate(residue) if r == SCRIPT]
        if notices and sum(len(lines[i].strip()) for i, k in enumerate(kinds) if k == K.GOOD and residue[i] != SCRIPT and not headlike(lines[i])) >= LEAST_ARTICLE:
            for i in notices:
                kinds[i], why[i] = K.BAD, "notice"

    @staticmethod
    def _inherit(lines: list[str], forms: list[str], kinds: list[str | None], why: list[str | None]) -> list[tuple[bool | None, str | None]]:
        n = len(lines)
        before: list[str | None] = [None] * n
        after: list[str | None] = [None] * n
        last = None
        for i, k in enumerate(kinds):
            before[i] = last
            if k == K.GOOD or k == K.BAD:
                last = k
        last, body = None, -1  # the last line that is article
        for i in range(n - 1, -1, -1):
            after[i] = last
            k = kinds[i]
            if k == K.GOOD or k == K.BAD:
                last = k
                if body < 0 and k == K.GOOD:
                    body = i
        out: list[tuple[bool | None, str | None]] = []
        begun = False
        for i, k in enumerate(kinds):
            if k is None:
                out.append((None, None))
                continue
            if k == K.GOOD or k == K.BAD:
                good = k == K.GOOD
            elif i and out[i - 1][0] and lines[i].lstrip()[:1].islower() and not forms[i - 1].endswith(K.END):
                good = True  # a wrapped line goes on
            else:
                sides = {x for x in (before[i], after[i]) if x}
                if len(sides) == 1:
                    good = sides != {K.BAD} or k == K.SHORT and before[i] is not None and not begun and body > i
                else:  # what is said by somebody after the article is a comment
                    good = not sides or k == K.SHORT or k == K.NEAR and before[i] == K.BAD
            begun = begun or k == K.GOOD
            out.append((good, why[i]))
        return out


def headlike(line: str) -> bool:
    s = line.strip()
    return len(s) < 100 and not s.endswith((".", "!", "。")) and s.count("|") < 2 and not s.startswith(("- ", "* ", "• "))


def judged(pages: DataFrame, *, id_col: str = "id", url_col: str = "normalized_url", title_col: str = "title", text_col: str = "text_content") -> tuple[DataFrame, Classifier]:
    """The pages (page_id, site, title, text, hot: the lines their site repeats), and the classifier of the crawl."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), site_of(F.col(url_col)).alias("site"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    crawl = Crawl(base)
    classifier = Classifier(crawl.exemplars, crawl.labels)
    return with_arrays(base, crawl.hot, crawl.totals, "line"), classifier


def line_labels(pages: DataFrame, **columns: str) -> DataFrame:
    """(page_id, line_no, article) of every non-blank line.

    Null and empty texts have no lines; lines are parted by line feeds and numbered from 1, blank ones included;
    a text of one very long line is one line; repeated rows are judged each; further columns are ignored; an empty
    table gives an empty result.
    """
    rows, classifier = judged(pages, **columns)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        at, no, article = [], [], []
        title, text = (block.column(c).to_pylist() for c in ("title", "text"))
        lines = Forms(text)
        for k, own in enumerate(standing_numbers(text, block.column("hot"), lines)):
            for i, good in enumerate(classifier.label(text[k].split("\n"), title[k], own, forms=lines.forms[k])):
                if good is not None:
                    at.append(k)
                    no.append(i + 1)
                    article.append(good)
        return pa.RecordBatch.from_arrays([block.column("page_id").take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(article, pa.bool_())], ["page_id", "line_no", "article"])

    return map_text(rows.where(F.length("text") > 0).select("page_id", "title", "text", "hot"), run, "page_id long, line_no int, article boolean", "text")


def furniture_lines(pages: DataFrame, **columns: str) -> DataFrame:
    """(page_id, line_no) of every non-blank line that is not part of the article."""
    return line_labels(pages, **columns).where(~F.col("article")).select("page_id", "line_no")


def articles(pages: DataFrame, **columns: str) -> DataFrame:
    """(page_id, text, removed_lines): each page's text with the lines of its article only; null texts stay null.

    Lines are judged and cut in the same task, row by row: rows that share an id stay apart.
    """
    rows, classifier = judged(pages, **columns)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        title, text = (block.column(c).to_pylist() for c in ("title", "text"))
        kept: list[str | None] = []
        removed: list[int] = []
        normal = Forms(text)
        for k, own in enumerate(standing_numbers(text, block.column("hot"), normal)):
            if text[k] is None:
                kept.append(None)
                removed.append(0)
                continue
            lines = text[k].split("\n")
            labels = classifier.label(lines, title[k], own, forms=normal.forms[k])
            kept.append("\n".join(x for x, good in zip(lines, labels, strict=True) if good is not False))
            removed.append(sum(good is False for good in labels))
        return pa.RecordBatch.from_arrays([block.column("page_id"), pa.array(kept, pa.string()), pa.array(removed, pa.int32())], ["page_id", "text", "removed_lines"])

    return map_text(rows.select("page_id", "title", "text", "hot"), run, "page_id long, text string, removed_lines int", "text")
