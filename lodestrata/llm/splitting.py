"""Cutting oversized texts at natural boundaries.

Recursive bisection: a span that is too long is cut at the strongest boundary near its midpoint, and both halves are
cut again while they exceed the limit less the overlap; then each piece takes over the end of the one before. A
stretch without any boundary is left whole as long as it fits the limit (it then takes over less), so the only
forced cuts are those within a stretch that no limit could hold.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.codepoints import map_text

LIMIT, OVERLAP = 2_600, 320

#: Boundaries by strength, strongest first; a text may be cut at the end of a match, and before one of the last kind.
_BOUNDARIES = (
    (4.0, re.compile(r"\n[ \t\r]*\n\s*")),
    (3.0, re.compile(r"\n")),
    (2.0, re.compile(r"(?:[.!?]+[\"'”’»)\]]*(?=[ \t\r\n]))[ \t\r]*|[。！？]+[」』）]*")),
    (1.0, re.compile(r"[ \t\r]+")),
    (0.5, re.compile(r"[.!?。！？]+")),
)
#: What a cut gives away in strength when it lies at the end of the span rather than at its midpoint.
_DISTANCE = 3.0


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where ``text`` may be cut, ascending, and how strong each place is."""
    best: dict[int, float] = {}
    for strength, pattern in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            best[m.end()] = strength
            if strength == 0.5:
                best.setdefault(m.start(), 0.25)
            elif strength == 1.0:
                best[m.start()] = max(0.5, best.get(m.start(), 0))
    best.pop(0, None)
    best.pop(len(text), None)
    at = np.fromiter(sorted(best), np.int64, len(best))
    return at, np.fromiter((best[i] for i in at.tolist()), np.float64, len(at))


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, bool]]:
    """Where ``text`` is cut, ascending, and whether the cut is forced."""
    at, strength = boundaries(text)
    found: list[tuple[int, bool]] = []
    spans = [(0, len(text))] if len(text) > limit else []
    while spans:
        a, b = spans.pop()
        i, j = np.searchsorted(at, a, "right"), np.searchsorted(at, b, "left")
        middle, half = (a + b) / 2, (b - a) / 2
        if i < j:
            k = i + int(np.argmax(strength[i:j] - _DISTANCE * np.abs(at[i:j] - middle) / half))
            cut, forced = int(at[k]), False
        elif b - a <= limit:
            continue
        else:
            cut, forced = int(middle), True
        found.append((cut, forced))
        spans += [(x, y) for x, y in ((a, cut), (cut, b)) if y - x > limit - overlap]
    return sorted(found)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, repeated, forced) of each piece: ``text[start:end]``, whose first ``repeated`` characters end the piece before."""
    edges = [(0, False), *cuts(text, limit, overlap)]
    out = []
    for k, (a, forced) in enumerate(edges):
        b = edges[k + 1][0] if k + 1 < len(edges) else len(text)
        again = min(overlap, limit - (b - a), a - edges[k - 1][0]) if k else 0
        if 0 < again < a:  # begin the repeated part at a word, if it has one
            space = re.search(r"\s(?=\S)", text[a - again:a])
            if space and not text[a - again - 1].isspace():
                again -= space.end()
        out.append((a - again, b, again, forced))
    return out


def longest_unbroken(text: str) -> int:
    """The most characters in a row without a blank, a line break or a mark that ends a sentence."""
    return max(map(len, re.split(r"[ \t\r\n.!?。！？]", text)))


def split_oversized(df: DataFrame, *, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(record_id, piece_no, start, n_repeated, text, cut_kind) of every text of more than ``limit`` code points.

    Pieces are numbered from 0, hold at most ``limit`` characters, and each after the first begins with
    ``n_repeated`` <= ``overlap`` characters from the end of the one before; without these they join to the text.
    ``cut_kind`` says how the piece's beginning was cut: ``start``, ``natural`` or ``forced``. Null, empty and short
    texts have no pieces; equal rows give equal pieces each; further columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for record, text in zip(block.column("record_id").to_pylist(), block.column("text").to_pylist(), strict=True):
            for k, (a, b, again, forced) in enumerate(pieces(text, limit, overlap)):
                out.append((record, k, a, again, text[a:b], "forced" if forced else "natural" if k else "start"))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["record_id", "piece_no", "start", "n_repeated", "text", "cut_kind"])

    long = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    return map_text(long, run, "record_id long, piece_no int, start int, n_repeated int, text string, cut_kind string", "text")


def split_records(pages: DataFrame, chunks: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of both kinds of records, under ``record_kind`` page or chunk."""
    kind: Column = F.lit("page").alias("record_kind")
    a = split_oversized(pages, id_col="id", text_col="text_content", limit=limit, overlap=overlap).select(kind, "*")
    b = split_oversized(chunks, id_col="id", text_col="text", limit=limit, overlap=overlap).select(F.lit("chunk").alias("record_kind"), "*")
    return a.unionByName(b)


def oversized(pieces_: DataFrame) -> DataFrame:
    """(record_kind, record_id, cut_kind) of each text that was cut: forced if any of its cuts is."""
    forced = F.max((F.col("cut_kind") == "forced").cast("int"))
    return pieces_.groupBy("record_kind", "record_id").agg(F.when(forced == 1, "forced").otherwise("natural").alias("cut_kind"))
