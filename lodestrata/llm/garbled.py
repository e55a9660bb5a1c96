"""Text that was read in the wrong character encoding.

How often two characters stand side by side is counted over the whole corpus. From it comes the pointwise mutual
information of each pair: in rightly written text it stays within a band, while the pairs that a wrong reading makes
are either almost never seen or locked together like the bytes they were. Pairs outside the band score positive, pairs
inside it negative, and the maximum-scoring segments of each text are its improbable runs. Only inside those runs are
inverse mappings tested: the characters go back to the bytes of the encoding they were wrongly read in, and these are
read as what they should have been. A mapping is taken if its result is more usual in the corpus than what stood
there; it is tried again on its own result, for text damaged twice.

Only pairs with a character outside ASCII are counted. The model is that of two million such pairs: counts of a larger
corpus are scaled down to that many, and a pair then met less than once is one that two million pairs would not have
shown. Judgements are thus alike at every size above, and the model has at most two million entries. How often each
character begins or ends a pair is summed over all pairs, before any is left out.
"""

from __future__ import annotations

import re
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.codepoints import map_text, to_array
from lodestrata.sources.checkpoints import cut

#: The share of all counted pairs that is one count of the model; bounds it.
RAREST = 5e-7
#: Mutual information (natural logarithm) of usual pairs.
BAND = (-1.5, 0.8)
#: What a pair within ASCII adds to a segment.
PLAIN = -0.7
DROP = 4.0
#: What each pair of a field gains once damage is proven in it: its improbable runs become wider and more.
DOUBT = 2.5

#: Encodings in which UTF-8 is wrongly read; single bytes without a character there stand for themselves.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866")
#: Other wrong readings: read as the first, written in the second.
LEGACY = (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "shift_jis"), ("cp1252", "euc_jp"), ("cp1252", "gbk"), ("cp1252", "euc_kr"))

#: A run whose pairs are, in the mean, this share of all pairs (as a logarithm) or more is written as it should be.
USUAL = 9.0

_LOST = 0xFFFD
_HIGH = re.compile(r"[^\x00-\x7f]")
_WORD = re.compile(r"\S*[^\x00-\x7f\s]\S*")
_LINE = re.compile(r"[^\n]*[^\x00-\x7f\n][^\n]*")
_PRIOR, _LEGACY_GAIN = 1.2, 1.5


@cache
def byte_of(codec: str) -> dict[str, int]:
    """The byte behind each character of a single-byte encoding; unused bytes stand for the control with their number."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


@cache
def bytes_of(codec: str) -> dict[str, tuple[int, ...]]:
    """The bytes that may lie behind each character, also if its case was changed after the damage."""
    exact = byte_of(codec)
    out: dict[str, tuple[int, ...]] = {c: (b,) for c, b in exact.items()}
    for c, b in exact.items():
        for other in (c.lower(), c.upper()):
            if len(other) == 1 and other != c and ord(other) > 0x7F and b not in out.get(other, ()):
                out[other] = (*out.get(other, ()), b)
    return out


class Model:
    """Pair counts, sorted by key ``a << 21 | b``, and what follows from them."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], total: float) -> None:
        (self.keys, self.counts), (self.left_of, self.left), (self.right_of, self.right) = (self._sorted(*x) for x in (pairs, left, right))
        self.total = max(1.0, total)
        #: Mean logarithm of counts below which a whole run may stand in another legacy encoding.
        self.rare = log(self.total) - USUAL
        self._known: dict[int, float] = {}
        self._chars: dict[int, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_chars": {}}

    @staticmethod
    def _sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], counts[order]

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], 0.0)

    def information(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pointwise mutual information of pairs that hold a character outside ASCII, with one half added to the counts."""
        n = self._find(self.keys, self.counts, (a << 21) | b) + 0.5
        expected = (self._find(self.left_of, self.left, a) + 0.5) * (self._find(self.right_of, self.right, b) + 0.5) / self.total
        return np.log(n / (expected + 0.5))

    def pair(self, a: str, b: str) -> float:
        """Logarithm of the pair's count; what a task asks for is remembered, the model is not copied."""
        k = (ord(a) << 21) | ord(b)
        found = self._known.get(k)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = self._known[k] = log(float(self._find(self.keys, self.counts, np.array([k]))[0]) + 0.5)
        return found

    def char(self, c: str) -> float:
        """Logarithm of how often a character outside ASCII is met."""
        found = self._chars.get(ord(c))
        if found is None:
            k = np.array([ord(c)])
            n = max(self._find(self.left_of, self.left, k)[0], self._find(self.right_of, self.right, k)[0])
            found = self._chars[ord(c)] = log(float(n) + 0.5)
        return found

    def usual(self, text: str, without: set[int] = frozenset()) -> float:
        """Mean of ``pair`` over the pairs of ``text`` that hold a character outside ASCII, but for those that begin at ``without``."""
        values = [self.pair(text[i], text[i + 1]) for i in range(len(text) - 1) if i not in without and (text[i] > "\x7f" or text[i + 1] > "\x7f")]
        return sum(values) / len(values) if values else 0.0


def pair_counts(block: pa.RecordBatch) -> pa.RecordBatch:
    """pair, n over the column ``text``; a line feed parts the texts."""
    points = to_array("\n".join(t for t in block.column("text").to_pylist() if t)).astype(np.int64)
    a, b = points[:-1], points[1:]
    take = (a > 0x7F) | (b > 0x7F)
    keys, n = np.unique((a[take] << 21) | b[take], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])


def fit(fields: DataFrame, rarest: float = RAREST) -> Model:
    """The model of all texts in the column ``text``."""
    counted = cut(map_text(fields.select("text"), pair_counts, "pair long, n long", "text").groupBy("pair").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    scale = min(1.0, 1.0 / (rarest * total)) if total else 1.0
    columns = []
    for key, part in ((F.col("pair"), counted.where(F.col("n") * scale >= 1)), (F.shiftright("pair", 21), counted), (F.col("pair").bitwiseAND(0x1FFFFF), counted)):
        rows = part.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 1 / rarest pairs, or the characters there are
        columns.append((rows["key"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(float) * scale) if rows.num_rows else (np.empty(0, np.int64), np.empty(0)))
    return Model(*columns, total * scale)


def improbable_runs(text: str, model: Model, doubt: float = 0.0) -> list[tuple[int, int]]:
    """(start, end) of the maximum-scoring segments of ``text``, widened to whole words and parted at line feeds: lines are damaged one by one.

    ``doubt`` is added to the score of each pair: what is known of the field beforehand.
    """
    points = to_array(text).astype(np.int64)
    high = points > 0x7F
    if not high.any():
        return []
    if len(points) == 1:
        return [(0, 1)]
    a, b = points[:-1], points[1:]
    at = np.flatnonzero(high[:-1] | high[1:])
    info = model.information(a[at], b[at])
    score = np.clip(np.maximum(info - BAND[1], BAND[0] - info) + doubt, -2.0, 4.0)
    score[(a[at] == _LOST) | (b[at] == _LOST)] = 4.0
    runs: list[tuple[int, int]] = []
    total = best = 0.0
    start = end = last = -1
    for k, s in zip(at.tolist(), score.tolist(), strict=True):
        if total > 0:
            total += PLAIN * (k - last - 1)  # the plain pairs between
        if total <= 0 or best - total > DROP:
            if best > 0:
                runs.append((start, end))
            total = best = 0.0
            start = k
        total += s
        if total > best:
            best, end = total, k + 2
        last = k
    if best > 0:
        runs.append((start, end))
    out: list[tuple[int, int]] = []
    for i, j in runs:
        while i and not text[i - 1].isspace():
            i -= 1
        while j < len(text) and not text[j].isspace():
            j += 1
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return [(m.start(), m.end()) for i, j in out for m in _LINE.finditer(text, i, j)]


@cache
def _sequences(codec: str) -> re.Pattern[str]:
    """What may be a UTF-8 sequence read in ``codec``."""
    table = bytes_of(codec)

    def those(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, of in table.items() if any(low <= b < high for b in of)) + "]"

    more = those(0x80, 0xC0)
    return re.compile(f"{those(0xE0, 0xF0)}{more}{{2}}|{those(0xC2, 0xE0)}{more}|{those(0xF0, 0xF5)}{more}{{3}}")


@cache
def _character(codec: str, found: str) -> str | None:
    """The character whose UTF-8 bytes are read as ``found`` in ``codec``; of several, the first."""
    table = bytes_of(codec)
    lead = [b for b in table[found[0]] if {2: 0xC2 <= b < 0xE0, 3: 0xE0 <= b < 0xF0, 4: 0xF0 <= b < 0xF5}[len(found)]]
    tail = [next(b for b in table[c] if 0x80 <= b < 0xC0) for c in found[1:]]
    for b in lead:
        try:
            char = bytes([b, *tail]).decode()
        except UnicodeDecodeError:
            continue
        if char.isprintable() or char in "\xa0\xad　​" or "\x80" <= char < "\xa0":  # a control may be a byte of damage below
            return char
    return None


def utf8_readings(run: str, codec: str) -> tuple[str, list[tuple[int, int, str]]]:
    """``run`` with every UTF-8 sequence put back that was read in ``codec``; where each was, its length and its character."""
    out, sequences, last, at = [], [], 0, 0
    pattern = _sequences(codec)
    while m := pattern.search(run, at):
        i, found = m.start(), m.group()
        char = _character(codec, found)
        if char is None and len(found) == 3:  # the shorter reading, if the longer one is none
            char, found = (_character(codec, found[:2]), found[:2]) if any(0xC2 <= b < 0xE0 for b in bytes_of(codec)[found[0]]) else (None, found)
        if char is None:
            at = i + 1
            continue
        out += [run[last:i], char]
        sequences.append((i, len(found), char))
        last = at = i + len(found)
    return "".join(out) + run[last:], sequences


@cache
def _as_bytes(codec: str) -> dict[int, int]:
    return {ord(c): b for c, b in byte_of(codec).items()}


def legacy_reading(run: str, read_as: str, written_in: str) -> str | None:
    try:
        return run.translate(_as_bytes(read_as)).encode("latin-1").decode(written_in)
    except UnicodeError:
        return None


def _gain(model: Model, before: str, run: str, after: str, new: str, sequences: list[tuple[int, int, str]]) -> float:
    """How much more usual ``new`` is in its place than ``run``, as a difference of logarithms.

    Each sequence of bytes is held against the character it makes, by the rarer of its inner pairs; the pairs at its
    ends are held against those of the new text. That the bytes fit together at all speaks for damage.
    """
    inner: set[int] = set()
    gain = 0.0
    for i, k, char in sequences:
        pairs = [model.pair(run[j], run[j + 1]) for j in range(i, i + k - 1)]
        inner.update(range(len(before) + i, len(before) + i + k - 1))
        known = model.char(char) if char > "\x7f" else 0.0
        gain += min(3.0, max(-6.0, known - min(pairs))) + (_PRIOR if known > 0 or k > 2 else -_PRIOR)
    own = gain / len(sequences) if sequences else 0.0
    return own + 0.5 * (model.usual(before + new + after) - model.usual(before + run + after, inner))


def restored(run: str, before: str, after: str, model: Model) -> str | None:
    """The original wording of ``run``, as far as an inverse mapping gives a more usual one; None if none does."""
    text, changed = run, False
    for _ in range(3):
        best: tuple[float, str] | None = None
        if text.isascii():
            break
        for codec in READ_AS:
            new, sequences = utf8_readings(text, codec)
            if sequences:
                gain = _gain(model, before, text, after, new, sequences)
                rank = gain * len(sequences)
                if gain > 0 and (best is None or rank > best[0]):
                    best = (rank, new)
        if not changed and len(high := set(_HIGH.findall(text))) >= 3 and (old := model.usual(before + text + after)) < model.rare:
            for read_as, written_in in LEGACY:
                if not high <= byte_of(read_as).keys():
                    continue
                new = legacy_reading(text, read_as, written_in)
                if new is not None and new != text and all(c.isprintable() or c.isspace() for c in new):
                    gain = model.usual(before + new + after) - old
                    rank = gain * sum(c > "\x7f" for c in new)
                    if gain > _LEGACY_GAIN + 8 / sum(c > "\x7f" for c in text) and (best is None or rank > best[0]):
                        best = (rank, new)
        if best is None:
            break
        text, changed = best[1], True
    return text if changed else None


def repair(text: str, model: Model, memory: dict | None = None) -> tuple[str, int, int]:
    """(text with the original wording, runs put back, characters lost for good).

    Both come from improbable runs alone. If one run is put back, the runs of the field are sought again with less
    trust in its pairs, first as they stand and then word by word within them.
    """
    if text.isascii():
        return text, 0, 0
    memory = {} if memory is None else memory
    if len(memory) > 50_000:
        memory.clear()

    def over(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
        out, last, fixed = [], 0, 0
        for i, j in runs:
            key = text[max(0, i - 1):i], text[i:j], text[j:j + 1]
            if key not in memory:
                memory[key] = restored(key[1], key[0], key[2], model)
            if memory[key] is not None:
                out += [text[last:i], memory[key]]
                last = j
                fixed += 1
        return "".join(out) + text[last:], fixed

    runs = improbable_runs(text, model)
    lost = sum(text.count("\ufffd", i, j) for i, j in runs)
    new, fixed = over(text, runs)
    if not fixed:
        return new, 0, lost
    by_run, n = over(text, improbable_runs(text, model, DOUBT))
    words = [(i + m.start(), i + m.end()) for i, j in improbable_runs(by_run, model, DOUBT) for m in _WORD.finditer(by_run[i:j])]
    by_word, m = over(by_run, words)
    return (by_word, max(fixed, n + m), lost) if n + m else (new, fixed, lost)


def garbled_fields(pages: DataFrame, *, id_col: str = "id", title_col: str = "title", text_col: str = "text_content", rarest: float = RAREST) -> DataFrame:
    """(page_id, field_name, restored, runs, lost) of every field that holds wrongly read characters.

    ``restored`` is the field with the original wording put back, ``runs`` how many runs that took and ``lost`` how
    many characters are gone (a replacement sign stands for them); a field with losses alone is a case too. Null, empty
    and ASCII fields have no case; repeated rows give a case each; further columns are ignored. Very long texts are
    read whole. An empty table gives an empty result.
    """
    fields = pages.select(F.col(id_col).cast("long").alias("page_id"), F.explode(F.array(F.struct(F.lit("title").alias("field_name"), F.col(title_col).alias("text")), F.struct(F.lit("text_content").alias("field_name"), F.col(text_col).alias("text")))).alias("f")).select("page_id", "f.field_name", "f.text")
    fields = fields.where(F.length("text") < F.octet_length("text"))
    model = pages.sparkSession.sparkContext.broadcast(fit(fields, rarest))
    memory: dict = {}

    def run(block: pa.RecordBatch) -> pa.RecordBatch | None:
        at, rows = [], []
        for k, text in enumerate(block.column("text").to_pylist()):
            new, fixed, lost = repair(text, model.value, memory)
            if fixed or lost:
                at.append(k)
                rows.append((new, fixed, lost))
        if not rows:
            return None
        take = pa.array(at)
        new, fixed, lost = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([block.column("page_id").take(take), block.column("field_name").take(take), pa.array(new, pa.string()), pa.array(fixed, pa.int32()), pa.array(lost, pa.int32())], ["page_id", "field_name", "restored", "runs", "lost"])

    return map_text(fields, run, "page_id long, field_name string, restored string, runs int, lost int", "text")
