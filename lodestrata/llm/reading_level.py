"""How demanding each text is to read, on the scale of graded examples.

A linear ranker is learned from pairs of graded texts: its weights order the more demanding text of a pair higher,
from features of syntax (length and build of sentences) and vocabulary (word length and form, and how demanding the
graded texts are that use a word). Isotonic regression turns scores into levels. A document is scored window by
window over its prose, and the median window, by words, stands for it: a passage brought in from elsewhere does not
move the median as long as it is the smaller part.

The graded examples are a bounded sample (``most_samples``) and are fitted on the driver; every document is scored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.codepoints import map_text

#: Graded samples that are fitted at most; more are refused, not cut off.
MOST_SAMPLES = 20_000
WINDOW_WORDS = 40
#: Texts of other levels that each graded text is compared with at most, evenly spread over them.
PAIRS_PER_SAMPLE = 60

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: A sentence ends at its mark, or at a line break before a capital where a mark is left out.
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|\n\s*(?=[A-Z])")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]{1,64}@\S+")
_ITEM = re.compile(r"\s*(?:[-*•+·–]|\d{1,3}[.)]|[a-z][.)]|#{1,6}\s|>|\|)\s*")
_VOWELS = re.compile(r"[aeiouyà-ÿ]+")
_SUFFIX = re.compile(r"(?:tion|sion|ment|ness|ity|ism|ence|ance|ology|ical|ative|ization|isation|ously|ably|ibly|ically)s?$")
_SUBORDINATE = frozenset("although though because since whereas while unless until whether which whose whom that if when where notwithstanding insofar inasmuch thereby upon whereby lest provided".split())
_PERSONAL = frozenset("i you he she we they my your his her our their me him us them it".split())
_LINKING = frozenset("and then so but or".split())


def word_shape(word: str) -> list[float]:
    n = len(word)
    syllables = max(1, len(_VOWELS.findall(word)) - (word.endswith("e") and not word.endswith("le") and n > 3))
    return [1.0, n, n >= 7, n >= 11, syllables, syllables >= 3, bool(_SUFFIX.search(word)), word in _SUBORDINATE, word in _PERSONAL, word in _LINKING, "-" in word]


N_SHAPE = 11


class Vocabulary(dict):
    """The number of each word form, given when it is first met, and a row of figures for each; the last two say what the graded texts know of it."""

    def __init__(self, graded: dict[str, tuple[float, float]]) -> None:
        self.graded = graded
        self.rows = np.empty((1024, N_SHAPE + 2))

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[k] = [*word_shape(word), *self.graded.get(word, (0.0, 0.0))]
        self[word] = k
        return k

    def index(self, words: list[str]) -> np.ndarray:
        if len(self) > 200_000:  # bounds memory; the rows are made again as they are needed
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def prose(text: str) -> list[str]:
    """The paragraphs of running text: without headings, list items, table rows and lines of mostly figures. If nothing is left, all lines."""
    joined: list[str] = []
    if "//" in text or "@" in text or "www." in text:
        text = _ADDRESS.sub(" ", text)
    for block in re.split(r"\n[ \t\r]*\n", text):
        lines = [x for x in block.split("\n") if x.strip() and not _ITEM.match(x) and x.count("|") < 2]
        kept = "\n".join(lines)
        if len(kept) >= 40 and re.search(r"[.!?][\"'”’)\]]*\s*(?:$|\s)", kept):
            joined.append(kept)
    return joined or [x for x in text.split("\n") if x.strip()]


def windows(text: str, most: int = WINDOW_WORDS) -> list[tuple[list[str], int, int]]:
    """(words, sentences, inner marks) of runs of whole sentences with at least ``most`` words, where the paragraph has them."""
    out: list[tuple[list[str], int, int]] = []
    for paragraph in prose(text):
        words: list[str] = []
        sentences = marks = 0
        begun = len(out)
        for s in _SENTENCE.split(paragraph):
            w = _WORD.findall(s.lower())
            if not w:
                continue
            words += w
            sentences += 1
            marks += s.count(",") + s.count(";") + s.count(":")
            if len(words) >= most:
                out.append((words, sentences, marks))
                words, sentences, marks = [], 0, 0
        if words and len(out) > begun and len(words) < most // 2:
            a, b, c = out[-1]
            out[-1] = (a + words, b + sentences, c + marks)
        elif words:
            out.append((words, sentences, marks))
    return out


def features(parts: list[tuple[list[str], int, int]], vocabulary: Vocabulary) -> np.ndarray:
    """A row for each window."""
    if not parts:
        return np.empty((0, N_SHAPE + 5))
    ids = vocabulary.index(list(chain.from_iterable(words for words, _, _ in parts)))
    counts = np.fromiter((len(w) for w, _, _ in parts), np.int64, len(parts))
    sums = np.add.reduceat(vocabulary.rows[ids], np.append(0, np.cumsum(counts)[:-1]), axis=0)
    n = counts[:, None].astype(float)
    sentences = np.fromiter((s for _, s, _ in parts), np.float64, len(parts))
    marks = np.fromiter((m for _, _, m in parts), np.float64, len(parts))
    known = sums[:, N_SHAPE + 1]
    level = np.where(known > 0, sums[:, N_SHAPE] / np.maximum(known, 1e-9), 0.0)
    return np.column_stack([sums[:, 1:N_SHAPE] / n, level, known / counts, np.log(counts / sentences), marks / sentences, marks / counts, counts])


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: the ends of its steps, lower and upper, and their values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, top = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2], top]
    return np.array([x for b in blocks for x in b[2:]]), np.array([b[0] for b in blocks for _ in range(2)])


class LevelModel:
    """Ranker and calibration; ``fit`` on (level, text) pairs."""

    def __init__(self, graded: dict[str, tuple[float, float]], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cuts: np.ndarray, levels: np.ndarray) -> None:
        self.graded, self.mean, self.scale, self.weights, self.cuts, self.levels = graded, mean, scale, weights, cuts, levels
        self._vocabulary: Vocabulary | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_vocabulary": None}

    @staticmethod
    def vocabulary(samples: list[tuple[int, list]]) -> dict[str, tuple[float, float]]:
        """For each word its mean level over the graded texts that use it, times a weight for how sure that is, and that weight."""
        seen: dict[str, dict[int, int]] = {}
        for level, parts in samples:
            for w in {w for words, _, _ in parts for w in words}:
                by = seen.setdefault(w, {})
                by[level] = by.get(level, 0) + 1
        out = {}
        for w, by in seen.items():
            n = sum(by.values())
            mean = sum(k * v for k, v in by.items()) / n
            spread = sum(v * (k - mean) ** 2 for k, v in by.items()) / n
            weight = n / (n + 1.0) / (0.1 + spread)
            out[w] = (mean * weight, weight)
        return out

    @staticmethod
    def pairs(level: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(higher, lower) text of each graded pair: every text with at most ``most`` of other levels, evenly spread over these. Memory is in line with the texts."""
        order = np.argsort(level, kind="stable")
        begin = np.searchsorted(level[order], level, "left")
        end = np.searchsorted(level[order], level, "right")
        a, b = [], []
        for i in range(len(level)):
            others = len(level) - int(end[i] - begin[i])
            n = min(most, others)
            # a different start for each text, so that all texts are met alike
            at = ((np.arange(n) * others) // max(1, n) + i * 7919) % max(1, others)
            at = at + np.where(at >= begin[i], end[i] - begin[i], 0)
            j = order[at]
            a.append(np.where(level[j] > level[i], j, i))
            b.append(np.where(level[j] > level[i], i, j))
        return np.concatenate(a), np.concatenate(b)

    @classmethod
    def fit(cls, samples: list[tuple[int, str]], ridge: float = 1e-3, rounds: int = 60, pairs_per_sample: int = PAIRS_PER_SAMPLE) -> LevelModel:
        """Weights by logistic loss on the differences of graded pairs; calibration on the texts' own median scores."""
        samples = [(k, p) for k, t in samples if k is not None and t and (p := windows(t))]
        if len({k for k, _ in samples}) < 2:
            raise ValueError("graded samples of at least two levels are needed")
        graded = cls.vocabulary(samples)
        every = [features(p, Vocabulary(graded)) for _, p in samples]
        # a word's own text must not vouch for it: held-out vocabulary features, in five parts of all levels
        met: dict[int, int] = {}
        fold = []
        for k, _ in samples:
            fold.append(met.get(k, 0) % 5)
            met[k] = met.get(k, 0) + 1
        for part in range(5):
            v = Vocabulary(cls.vocabulary([s for s, f in zip(samples, fold, strict=True) if f != part]))
            for i, f in enumerate(fold):
                if f == part:
                    every[i] = features(samples[i][1], v)
        stacked = np.concatenate(every)[:, :-1]
        mean, scale = stacked.mean(0), stacked.std(0) + 1e-9
        x = [(f[:, :-1] - mean) / scale for f in every]
        level = np.array([k for k, _ in samples])
        a, b = cls.pairs(level, pairs_per_sample)
        count = np.fromiter(map(len, x), np.int64, len(x))
        first = np.append(0, np.cumsum(count)[:-1])
        rows = np.concatenate(x)
        diff = rows[first[a] + (a + b) % count[a]] - rows[first[b] + (a + b) % count[b]]
        w = np.zeros(diff.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff * p[:, None]).mean(0) + ridge * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        scores = np.concatenate([f @ w for f in x])
        cuts, levels = _isotonic(scores, np.repeat(level, [len(f) for f in x]).astype(float))
        return cls(graded, mean, scale, w, cuts, levels)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, calibrated levels) of the median windows of all ``texts``; nan without words."""
        if self._vocabulary is None:
            self._vocabulary = Vocabulary(self.graded)
        each = [windows(t) if t else [] for t in texts]
        f = features([p for parts in each for p in parts], self._vocabulary)
        s = (f[:, :-1] - self.mean) / self.scale @ self.weights
        text = np.repeat(np.arange(len(each)), np.fromiter(map(len, each), np.int64, len(each)))
        order = np.lexsort((s, text))
        s, text, n = s[order], text[order], np.cumsum(f[order, -1])
        out = np.full(len(each), np.nan)
        if len(text):
            owner, first = np.unique(text, return_index=True)
            before = np.append(0, n)[first]
            after = n[np.append(first[1:], len(n)) - 1]
            out[owner] = s[np.searchsorted(n, (before + after) / 2)]
        return out, self.level(out)

    def level(self, scores: np.ndarray) -> np.ndarray:
        """The isotonic fit at ``scores``, straight between the end of one step and the beginning of the next."""
        return np.interp(scores, self.cuts, self.levels)


def fit_levels(samples: DataFrame, *, level_col: str = "reading_level", text_col: str = "sample_text", most_samples: int = MOST_SAMPLES) -> LevelModel:
    rows = samples.select(F.col(level_col).cast("int"), F.col(text_col)).dropna().orderBy(F.col(text_col)).limit(most_samples + 1).collect()
    if len(rows) > most_samples:
        raise ValueError(f"more than {most_samples} graded samples")
    return LevelModel.fit([(r[0], r[1]) for r in rows])


def reading_levels(docs: DataFrame, samples: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_samples: int = MOST_SAMPLES) -> DataFrame:
    """(doc_id, score, level, reading_level) of each text with at least one word.

    ``level`` is the calibrated value, ``reading_level`` the step next to it. Null texts and texts without words have
    no row; a repeated row gets its level each time; an empty table gives an empty result; further columns are
    ignored. Texts in the language of the samples are assumed; the caller selects them.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_levels(samples, most_samples=most_samples))

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        score, level = model.value.score(block.column("text").to_pylist())
        good = ~np.isnan(score)
        ids = block.column("doc_id").filter(pa.array(good))
        score, level = score[good], level[good]
        return pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array(level), pa.array(np.floor(level + 0.5).astype(np.int32))], ["doc_id", "score", "level", "reading_level"])

    side = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return map_text(side, run, "doc_id long, score double, level double, reading_level int", "text")
