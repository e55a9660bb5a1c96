"""Lines that one site repeats in many of its pages.

Content-defined chunking: a rolling hash over the last 16 characters cuts each line into chunks wherever its low
bits vanish, so equal content gives equal chunks wherever it stands. The distinct pages of each (site, chunk) are
counted; a line all of whose chunks are repeated excessively is a candidate, and candidates are then counted as
whole lines. A line feed ends a chunk too, because what has to be reported and cut out are lines: without that a
line of a few characters would hang together with its neighbours and never be counted. A line that is repeated has
all of its chunks repeated at least as often, so the candidates hold every true case.

Skew: chunk counts are pre-aggregated before they are shuffled. What a site repeats is short (a chunk that is on 5
percent of a site's pages leaves room for at most 20 such chunks per chunk of a page), so it goes back to the pages
as one array per site: to all tasks while the arrays are small in all, else by a join in which large sites are sliced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.codepoints import hash_segments, map_text, rolling, table_of, to_array
from lodestrata.sources.checkpoints import cut

WINDOW, MASK = 16, 63
#: Hashes of repeated chunks or lines of all sites together that may go to every task (16 MB).
MOST_BROADCAST = 1_000_000
#: Rows of a site that are joined with its array in one slice, where arrays are not broadcast.
SLICE_ROWS = 50_000

_ALIKE = bytes.maketrans(b"123456789\t\r", b"000000000  ")


def site_of(url: Column) -> Column:
    """The host of a URL as it is written; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", host)


def normal_text(text: str) -> str:
    """Lower case, one sign for each run of digits, one blank for each run of blanks."""
    low = text.lower().encode("utf-8", "surrogatepass").translate(_ALIKE)  # bytes of these values are ASCII characters in UTF-8
    for twice, once in ((b"00", b"0"), (b"  ", b" ")):
        while twice in low:
            low = low.replace(twice, once)
    return low.decode("utf-8", "surrogatepass")


class Lines:
    """The lines of a block of texts: ``row``, ``no`` (from 1), ``hash`` of the normal form, and their chunks."""

    def __init__(self, texts: list[str | None]) -> None:
        normal = [normal_text(t) if t else "" for t in texts]
        counts = np.fromiter((t.count("\n") + 1 for t in normal), np.int64, len(normal))
        points = to_array("\n".join(normal) + "\n")
        # a space at either end of a line does not count
        feed = points == 10
        space = points == 32
        edge = np.empty(len(points), np.bool_)
        edge[0], edge[1:] = True, feed[:-1]
        last = np.append(feed[1:], True)
        keep = ~(space & (edge | last))
        points = points[keep]
        ends = np.flatnonzero(points == 10)
        starts = np.append(0, ends[:-1] + 1)
        row = np.repeat(np.arange(len(normal)), counts)
        first = np.append(0, np.cumsum(counts)[:-1])
        no = np.arange(len(row)) - np.repeat(first, counts) + 1
        letters = np.add.reduceat(table_of("isalpha")[points], starts, dtype=np.int64)
        good = letters >= 3
        # the characters of the lines that count, without their feeds
        width = ends - starts
        inside = np.repeat(good, width + 1)
        inside[ends] = False
        self.row, self.no = row[good], no[good]
        self.points = points[inside]
        self.starts = np.append(0, np.cumsum(width[good])[:-1]) if good.any() else np.empty(0, np.int64)
        self.hash = hash_segments(self.points, self.starts)

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """The line of each chunk, and its hash."""
        if not len(self.starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = len(self.points)
        width = np.diff(np.append(self.starts, n))
        within = np.arange(n) - np.repeat(self.starts, width)
        h = rolling(self.points, WINDOW)
        cut = ((h >> np.uint64(40)) & np.uint64(MASK)) == 0
        cut &= within >= WINDOW - 1  # only the line's own characters decide
        begin = np.zeros(n, np.bool_)
        begin[self.starts] = True
        begin[1:] |= cut[:-1]
        starts = np.flatnonzero(begin)
        return np.searchsorted(self.starts, starts, "right") - 1, hash_segments(self.points, starts)


def _page_chunks(block: pa.RecordBatch) -> pa.RecordBatch:
    """site, chunk: each chunk once for a page."""
    lines = Lines(block.column("text").to_pylist())
    line, chunk = lines.chunks()
    row = lines.row[line]
    order = np.lexsort((chunk, row))
    row, chunk = row[order], chunk[order]
    new = np.ones(len(row), np.bool_)
    new[1:] = (row[1:] != row[:-1]) | (chunk[1:] != chunk[:-1])
    return pa.RecordBatch.from_arrays([block.column("site").take(pa.array(row[new])), pa.array(chunk[new])], ["site", "chunk"])


def _held(row: np.ndarray, value: np.ndarray, arrays: pa.ListArray) -> np.ndarray:
    """Whether each value is in the array of its row, by one sort."""
    values, offsets = np.asarray(arrays.flatten()), np.asarray(arrays.offsets) - arrays.offsets[0].as_py()
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    both_row, both = np.concatenate([owner, row]), np.concatenate([values, value])
    order = np.lexsort((np.arange(len(both)), both, both_row))
    sr, sv = both_row[order], both[order]
    new = np.ones(len(sr), np.bool_)
    new[1:] = (sr[1:] != sr[:-1]) | (sv[1:] != sv[:-1])
    group = np.cumsum(new) - 1
    known = np.zeros(group[-1] + 1 if len(group) else 0, np.bool_)
    known[group[order < len(owner)]] = True
    out = np.empty(len(both), np.bool_)
    out[order] = known[group]
    return out[len(owner):]


def _candidates(block: pa.RecordBatch) -> pa.RecordBatch:
    """site, line: the lines of each page all of whose chunks are in the row's array ``hot``, once for a page."""
    lines = Lines(block.column("text").to_pylist())
    line, chunk = lines.chunks()
    every = np.ones(len(lines.row), np.bool_)
    np.logical_and.at(every, line, _held(lines.row[line], chunk, block.column("hot")))
    at = np.flatnonzero(every)
    rows, hashes = lines.row[at], lines.hash[at]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(at), np.bool_)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return pa.RecordBatch.from_arrays([block.column("site").take(pa.array(rows[new])), pa.array(hashes[new])], ["site", "line"])


def standing_numbers(texts: list[str | None], hot: pa.ListArray, lines: Lines | None = None) -> list[set[int]]:
    """For each text of a block the numbers of its lines that are in the row's array."""
    lines = lines or Lines(texts)
    out: list[set[int]] = [set() for _ in texts]
    held = _held(lines.row, lines.hash, hot)
    for row, no in zip(lines.row[held].tolist(), lines.no[held].tolist(), strict=True):
        out[row].add(no)
    return out


def _hot(counted: DataFrame, totals: DataFrame, what: str, min_pages: int, min_share: float) -> DataFrame:
    """(site, what) on enough pages of the site."""
    often = counted.where(F.col("n") >= min_pages).join(totals, "site")
    return often.where(F.col("n") >= min_share * F.col("site_rows")).select("site", what)


def repeated_lines(pages: DataFrame, *, id_col: str = "id", url_col: str = "normalized_url", text_col: str = "text_content", min_pages: int = 5, min_share: float = 0.05) -> DataFrame:
    """(page_id, line_no) of every line that its site repeats excessively.

    Two lines are the same after lower-casing, one sign for each run of digits and one space for each run of blanks.
    A line counts if it has three letters, is on ``min_pages`` pages of the site and on ``min_share`` of all its rows;
    a page counts once however often it has the line. Null or empty texts have no lines but count as rows; rows
    without a host have no site and no case; equal rows count each; an empty table gives an empty result. Further
    columns are ignored, whatever their names.
    """
    base = _sited(pages, id_col, url_col, text_col)
    often, totals = _often(base, min_pages, min_share)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(block.column("text").to_pylist())
        at = np.flatnonzero(_held(lines.row, lines.hash, block.column("hot")))
        return pa.RecordBatch.from_arrays([block.column("page_id").take(pa.array(lines.row[at])), pa.array(lines.no[at].astype(np.int32))], ["page_id", "line_no"])

    rows = with_arrays(base.where(F.col("site").isNotNull() & (F.length("text") >= 3)), often, totals, "line")
    return map_text(rows.where(F.col("hot").isNotNull()).select("page_id", "text", "hot"), run, "page_id long, line_no int", "text")


def _sited(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), site_of(F.col(url_col)).alias("site"), F.col(text_col).alias("text"))


def _often(base: DataFrame, min_pages: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """((site, line) of the lines repeated excessively, (site, site_rows)): candidates by chunks, then counted as whole lines."""
    sited = base.where(F.col("site").isNotNull())
    totals = sited.groupBy("site").agg(F.count("*").alias("site_rows"))
    texts = sited.where(F.length("text") >= 3).select("site", "text")
    chunks = map_text(texts, _page_chunks, "site string, chunk long", "text")
    hot = cut(_hot(chunks.groupBy("site", "chunk").agg(F.count("*").alias("n")), totals, "chunk", min_pages, min_share))
    rows = with_arrays(texts, hot, totals, "chunk").where(F.col("hot").isNotNull())
    found = map_text(rows.select("site", "text", "hot"), _candidates, "site string, line long", "text")
    return cut(_hot(found.groupBy("site", "line").agg(F.count("*").alias("n")), totals, "line", min_pages, min_share)), totals


def with_arrays(texts: DataFrame, values: DataFrame, totals: DataFrame, what: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``texts`` with ``hot``: the values (site, ``what``) of the row's site as an array, null where there are none.

    Up to ``most_broadcast`` values (16 bytes each) go to all tasks, and no text is moved. Beyond that texts and arrays
    are joined by site, sites of more than ``SLICE_ROWS`` rows in slices.
    """
    arrays = values.groupBy("site").agg(F.collect_list(what).alias("hot"))
    if values.count() <= most_broadcast:
        return texts.join(F.broadcast(arrays), "site", "left")
    big = totals.where(F.col("site_rows") > SLICE_ROWS).select("site", F.ceil(F.col("site_rows") / SLICE_ROWS).cast("int").alias("slices"))
    left = texts.join(big, "site", "left").withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("slices"))).cast("int")).drop("slices")
    right = arrays.join(big, "site", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1))).drop("slices")
    return left.join(right, ["site", "slice"], "left").drop("slice")


def without_repeated_lines(pages: DataFrame, *, id_col: str = "id", url_col: str = "normalized_url", text_col: str = "text_content", min_pages: int = 5, min_share: float = 0.05) -> DataFrame:
    """(page_id, text, removed_lines): each page's text without the lines its site repeats excessively.

    A text that is null stays null; a text of nothing but repeated lines becomes empty. Lines are cut row by row where
    they are found: rows that share an id stay apart.
    """
    base = _sited(pages, id_col, url_col, text_col)
    often, totals = _often(base, min_pages, min_share)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column("text").to_pylist()
        drop = standing_numbers(texts, block.column("hot"))
        kept = [t if not d else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in d) for t, d in zip(texts, drop, strict=True)]
        return pa.RecordBatch.from_arrays([block.column("page_id"), pa.array(kept, pa.string()), pa.array([len(d) for d in drop], pa.int32())], ["page_id", "text", "removed_lines"])

    rows = with_arrays(base, often, totals, "line")
    return map_text(rows.select("page_id", "text", "hot"), run, "page_id long, text string, removed_lines int", "text")
