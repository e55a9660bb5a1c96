"""Evaluation items that leak into training texts.

Q-gram lemma filtering: two stretches of ``n`` characters within ``e`` edits share at least n + 1 - q (1 + e)
q-grams whose diagonals (position in the document less position in the item) lie within e of each other. The q-grams
of every document are looked up in an index of the items' q-grams, counted in overlapping diagonal bands, and a band
is kept if its count reaches the bound for the item's shortest passage that matters. Kept bands are verified by a
banded local alignment, and what aligns long enough is checked for a whole run of equal words.

Common q-grams, which stand in many items, would give as many postings for each place they stand at in a document. Rarer
ones are looked up first, and the common ones only for the items these have brought in. A passage of nothing but common
q-grams is found by its exact words instead, so nothing is lost.

The items are a stated query set: they are taken in blocks of at most ``block_items``, each of which goes to the
tasks as one index, and each block runs against all documents in one pass without a shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.codepoints import map_text, rolling, table_of, to_array, to_text

Q, EDITS, BAND = 16, 1, 8
RUN_WORDS = 12
#: A q-gram of more items than this (a stock instruction's) brings in no item by itself.
COMMON = 64
#: Items of one index; with it the index is bounded by the longest items, not by their number.
BLOCK_ITEMS = 4_000
_MATCH, _MISMATCH, _GAP = 1, -3, -3
_BREAK = 0x110005  # between two texts; no character has this number
_FILTER_BITS = 22


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case, without soft hyphens and zero-width spaces."""
    return re.findall(r"[^\W_]+", text.lower().replace("­", "").replace("​", ""))


def normal_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as words with one space between, and where each text begins; each is followed by a break."""
    low = [(t or "").lower() for t in texts]
    points = to_array("\n".join(low) + "\n").copy()
    breaks = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1) - 1
    wordy = table_of("isalnum")[points]
    invisible = (points == 0xAD) | (points == 0x200B)
    points[~wordy] = 32
    points[breaks] = _BREAK
    points = points[~invisible]
    space = points == 32
    again = np.zeros(len(points), np.bool_)
    again[1:] = space[1:] & (space[:-1] | (points[:-1] == _BREAK))
    again[0] = space[0]
    points = points[~again]
    ends = np.flatnonzero(points == _BREAK)
    return points, np.append(0, ends[:-1] + 1)


class ItemIndex:
    """The q-grams of one block of items, with the counting bound of each item."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: int, run_words: int) -> None:
        self.q, self.edits, self.run_words = q, edits, run_words
        split = [(i, w) for i, t in items if len(w := words(t)) >= run_words]
        self.ids = np.fromiter((i for i, _ in split), np.int64, len(split))
        self.texts = [" ".join(w) for _, w in split]
        self.windows = [frozenset(" ".join(w[k:k + run_words]) for k in range(len(w) - run_words + 1)) for _, w in split]
        # no document can share less of an item than its shortest window
        self.shortest = np.fromiter((min(map(len, s)) for s in self.windows), np.int64, len(split))
        bound = self.shortest + 1 - q * (1 + edits)
        self.bound = np.where(bound >= 1, bound, np.maximum(1, self.shortest + 1 - q))
        grams, owner, place = [], [], []
        self.points = [to_array(t) for t in self.texts]
        for k, p in enumerate(self.points):
            at = np.arange(q - 1, len(p))
            grams.append(rolling(p, q)[q - 1:])
            owner.append(np.full(len(at), k))
            place.append(at)
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        self.owner = np.concatenate(owner)[order].astype(np.int32) if grams else np.empty(0, np.int32)
        self.place = np.concatenate(place)[order].astype(np.int32) if grams else np.empty(0, np.int32)
        self.grams, self.first = np.unique(h, return_index=True)
        self.many = np.diff(np.append(self.first, len(h)))
        self.common = self.many > COMMON
        self.n_common = np.bincount(self.owner[np.repeat(self.common, self.many)], minlength=len(split))
        self._commons: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: Passages of ``run_words`` words all of whose q-grams are common, with the items that hold them, and the fewest characters of one.
        self.stock: dict[str, list[int]] = {}
        if self.common.any():
            self._find_stock()
        self.least_stock = min(map(len, self.stock), default=0)
        self.filter = np.zeros(1 << _FILTER_BITS, np.bool_)
        self.filter[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def _find_stock(self) -> None:
        for k, p in enumerate(self.points):
            at = np.searchsorted(self.grams, rolling(p, self.q)[self.q - 1:])
            rare = np.append(0, np.cumsum(~self.common[at]))
            space = np.flatnonzero(p == 32)
            begin, end = np.append(0, space + 1), np.append(space, len(p))
            n = len(begin) - self.run_words + 1
            for a, b in zip(begin[:n].tolist(), end[self.run_words - 1:].tolist(), strict=True):
                if b - a >= self.q and rare[b - self.q + 1] == rare[a]:
                    self.stock.setdefault(to_text(p[a:b]), []).append(k)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "filter"} | {"_commons": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.filter = np.zeros(1 << _FILTER_BITS, np.bool_)
        self.filter[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def candidates(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first diagonal) of the bands that hold enough shared q-grams."""
        h = rolling(points, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        at = at[at >= self.q - 1]
        found = np.searchsorted(self.grams, h[at])
        found[found == len(self.grams)] = 0
        hit = self.grams[found] == h[at]
        at, found = at[hit], found[hit]
        rare = ~self.common[found]
        at, item, place = self._postings(at[rare], found[rare])
        text = np.searchsorted(starts, at, "right") - 1
        if not rare.all():
            more = self._common_postings(h, starts, len(points), text, item)
            at, item, place = (np.concatenate([x, y]) for x, y in zip((at, item, place), more, strict=True))
            text = np.searchsorted(starts, at, "right") - 1
        diagonal = at - place
        band = diagonal // BAND
        beside = (diagonal - band * BAND) < self.edits  # belongs to the band before as well: bands overlap
        text, item, band = (np.concatenate([x, x[beside] - d]) for x, d in ((text, 0), (item, 0), (band, 1)))
        order = np.lexsort((band, item, text))
        text, item, band = text[order], item[order], band[order]
        new = np.ones(len(text), np.bool_)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(text)))
        begin = begin[count >= self.bound[item[begin]]]
        return text[begin], item[begin], band[begin] * BAND

    def _postings(self, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the texts, item, place in the item) of each item that holds the q-gram found at each place."""
        many = self.many[gram]
        posting = np.repeat(self.first[gram] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))
        return np.repeat(at, many), self.owner[posting].astype(np.int64), self.place[posting].astype(np.int64)

    def _common_postings(self, h: np.ndarray, starts: np.ndarray, size: int, text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_postings``, of the common q-grams, for the pairs of text and item that rarer ones have brought in."""
        ends = np.append(starts[1:], size)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
        pair, rare = np.unique(text * len(self.ids) + item, return_counts=True)
        # a shared passage has its bound of q-grams from the rarer ones met here and the item's own common ones
        k = pair % len(self.ids)
        for x in pair[(self.n_common[k] > 0) & (rare + self.n_common[k] >= self.bound[k])].tolist():
            t, k = divmod(x, len(self.ids))
            values, place = self._own_common(k)
            a = int(starts[t]) + self.q - 1
            here = h[a:int(ends[t])]
            lo, hi = np.searchsorted(values, here, "left"), np.searchsorted(values, here, "right")
            n = hi - lo
            which = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
            out.append((np.repeat(np.arange(len(here)) + a, n), np.full(len(which), k, np.int64), place[which]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _own_common(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The common q-grams of an item in order, and where they end in it; remembered by the task."""
        found = self._commons.get(k)
        if found is None:
            own = rolling(self.points[k], self.q)[self.q - 1:]
            at = np.flatnonzero(self.common[np.searchsorted(self.grams, own)])
            order = np.argsort(own[at], kind="stable")
            found = self._commons[k] = own[at][order], (at[order] + self.q - 1).astype(np.int64)
        return found

    def stock_passages(self, points: np.ndarray, starts: np.ndarray) -> dict[int, set[str]]:
        """For each text the passages of common q-grams alone that it holds, by their exact words."""
        found: dict[int, set[str]] = {}
        if not self.stock:
            return found
        h = rolling(points, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        gram = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        at = at[(self.grams[gram] == h[at]) & self.common[gram] & (at >= self.q - 1)]
        if not len(at):
            return found
        new = np.append(True, np.diff(at) > 1)
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        for a, b in zip((first - self.q + 1).tolist(), (last + 1).tolist(), strict=True):
            if b - a < self.least_stock:
                continue
            t = int(np.searchsorted(starts, a, "right")) - 1
            while a > starts[t] and points[a - 1] != 32:
                a -= 1
            while points[b] not in (32, _BREAK):
                b += 1
            w = to_text(points[a:b]).split()
            held = {x for i in range(len(w) - self.run_words + 1) if (x := " ".join(w[i:i + self.run_words])) in self.stock}
            if held:
                found.setdefault(t, set()).update(held)
        return found

    def align(self, points: np.ndarray, item: np.ndarray, diagonal: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Best local alignment score of each item along its band, all candidates at once; ``lo`` and ``hi`` bound the texts."""
        n, width = len(item), BAND + 2 * self.edits
        size = np.fromiter((len(self.points[k]) for k in item), np.int64, n)
        longest = int(size.max()) if n else 0
        chars = np.zeros((n, longest), np.uint32)
        for r, k in enumerate(item):
            chars[r, :size[r]] = self.points[k]
        score, best = np.zeros((n, width), np.int32), np.zeros(n, np.int32)
        column = diagonal[:, None] - self.edits + np.arange(width)
        slope = (np.arange(width) * -_GAP).astype(np.int32)
        for j in range(longest):
            i = column + j
            inside = (i >= lo[:, None]) & (i < hi[:, None]) & (j < size)[:, None]
            same = inside & (points[np.clip(i, 0, len(points) - 1)] == chars[:, j:j + 1])
            new = np.maximum(score + np.where(same, _MATCH, _MISMATCH), 0)
            new[:, :-1] = np.maximum(new[:, :-1], score[:, 1:] + _GAP)
            new = np.maximum.accumulate(new + slope, axis=1) - slope
            score = np.where(inside, new, 0).astype(np.int32)
            np.maximum(best, score.max(axis=1), out=best)
        return best

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, alignment score, shared windows, windows of the item) of each pair that shares a run of words."""
        if not len(self.ids):
            return []
        points, starts = normal_points(texts)
        text, item, diagonal = self.candidates(points, starts)
        stock = self.stock_passages(points, starts)
        if not len(text) and not stock:
            return []
        ends = np.append(starts[1:], len(points)) - 1
        score = self.align(points, item, diagonal, starts[text], ends[text])
        good = score >= self.shortest[item]
        found: dict[tuple[int, int], tuple[int, set[str]]] = {}
        for t, k, d, s in zip(text[good].tolist(), item[good].tolist(), diagonal[good].tolist(), score[good].tolist(), strict=True):
            a, b = max(int(starts[t]), d - self.edits), min(int(ends[t]), d + BAND + self.edits + len(self.points[k]))
            while a > starts[t] and points[a - 1] != 32:
                a -= 1
            while b < ends[t] and points[b] != 32:
                b += 1
            w = to_text(points[a:b]).split()
            shared = {x for i in range(len(w) - self.run_words + 1) if (x := " ".join(w[i:i + self.run_words])) in self.windows[k]}
            if shared:
                before = found.get((t, k), (0, set()))
                found[t, k] = (max(s, before[0]), shared | before[1])
        for t, held in stock.items():
            for x in held:
                for k in self.stock[x]:
                    s, shared = found.get((t, k), (0, set()))
                    found[t, k] = (max(s, len(x)), shared | {x})
        return [(t, int(self.ids[k]), s, len(shared), len(self.windows[k])) for (t, k), (s, shared) in found.items()]


def leaked_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "item_text", run_words: int = RUN_WORDS, edits: int = EDITS, q: int = Q, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, shared_windows, item_windows): documents that share ``run_words`` consecutive words with an item.

    ``score`` is that of the best banded alignment, ``shared_windows`` of ``item_windows`` says how much of the item is
    given away. Null and empty texts, and items of fewer words, have no case; a repeated row gives its cases again;
    no documents or no items give an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score int, shared_windows int, item_windows int"
    kept = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")).where(F.length("item_text") >= 2 * run_words - 1)
    total = kept.count()
    blocks = max(1, -(-total // block_items))
    side = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= 2 * run_words - 1)
    results = []
    for b in range(blocks):
        part = kept if blocks == 1 else kept.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in part.orderBy("item_id").collect()], q, edits, run_words))

        def run(block: pa.RecordBatch, index=index) -> pa.RecordBatch | None:
            rows = index.value.search(block.column("text").to_pylist())
            if not rows:
                return None
            at, item, score, shared, whole = zip(*rows, strict=True)
            doc = block.column("doc_id").take(pa.array(at))
            return pa.RecordBatch.from_arrays([doc, pa.array(item, pa.int64()), pa.array(score, pa.int32()), pa.array(shared, pa.int32()), pa.array(whole, pa.int32())], ["doc_id", "item_id", "score", "shared_windows", "item_windows"])

        results.append(map_text(side, run, schema, "text"))
    return reduce(DataFrame.unionByName, results)
