"""What a line of a page looks like: its form, the parts of it that may be links, its length and its common words.

Pages come as text, without their links, so the labels that menus, footers and notices are made of are learned from the
crawl itself. A line that a site repeats on many of its pages is furniture; what such lines are made of (their parts
between separators, the words short lines open with, the shapes of their dates and numbers) is counted over all sites,
on repeated lines and on others. A part found on repeated lines often enough is a *label*, and the share of a line
that labels make up stands for its link density, also on sites of a few pages and in lines that are not repeated.

Matching is done on the ASCII skeleton of a line where that has letters: accents, and what a wrong encoding made of
them, fall away alike.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from lodestrata.llm.repeated_lines import normal_text

# Common words, for the stop-word density of running text.
STOP = frozenset("the of and to in a is that it for was on are as with his they at be this have from or had by but not what all were when we there can an your which their if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know and our you i he because often every also during without "
    "der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ihre des "
    "le la les de des du et un une en à est que qui dans pour au par sur ne se pas plus ce il avec sont son aux ou mais comme on tout nous sa fait été même si leurs cette ces sans "
    "el los las y del que se con por su para como más pero sus al lo este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está una sin sobre "
    "o os e da do em um uma no na que com não mais as dos como mas foi ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois "
    "и в не на я что тот быть с а весь это как она по но они к у ты из мы за вы так же от сказать этот который мочь человек о один еще бы такой только себя свое какой когда уже для вот кто да говорить год в во до без после том".split())

_PLAIN_STOP = frozenset(w.encode("ascii") for w in STOP if w.isascii())

#: Longest line that is taken apart, longest line whose opening and shape count, in characters of the normal form.
PART_CHARS, SHORT_CHARS = 100, 60
#: Least share of all counted parts that one needs to become a label: there are at most 100,000 labels.
LABEL_SHARE = 1e-5
#: Least share of a label's occurrences on repeated lines, by its sort; a site repeats a leading word that half its uses lie in.
RATE = {"part": 0.2, "lead": 0.5, "opening": 0.1, "shape": 0.1}

_LETTERS = re.compile("[A-Za-z][^A-Za-z]*[A-Za-z]")
_PARTS = re.compile(r"[|>/:]+|(?<= )-+(?= )|(?<=[.!?]) ")
_SIGNS = (">", "/", ":", " - ", ". ", "! ", "? ")
_PLAIN = (*((sign, "|") for sign in "•·›»→"), ("–", "-"), ("—", "-"), ("：", ":"))
_EDGE = " .,:;*-+#|/>()[]!?•·\"'"
_APART = bytes(c if c < 128 and chr(c).isalpha() else 32 for c in range(256))
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile("[぀-ヿ]")
END = (".", "!", "?", "。", "！", "？", "…", '."', ".”", ".)", '!"', '?"', "!”", "?”", "！」", "。」")
#: Headings, list items, quotations, captions, references, questions and answers, by the marks they begin with.
_STRUCTURE = re.compile(r"\s*(?:#{1,6} |[-*•+] |\d+[.)] |\[|[qa]: ?|>|figure \d|table \d)", re.I)
_ATTRIBUTED = re.compile(r"\S{3,}(?: \S+){0,5}: ")
_CRUMB = re.compile(r"[|>/]")


def normal(text: str) -> str:
    """Lower case, one sign for each run of digits, one blank for each run of blanks; line feeds stay."""
    return normal_text(text)


def skeleton(form: str) -> str:
    """The ASCII characters of a form, or the form itself if these are the smaller part or hold hardly a letter; separators of any script become ``|``, dashes ``-``."""
    if form.isascii():
        return form
    for sign, plain in _PLAIN:
        if sign in form:
            form = form.replace(sign, plain)
    s = " ".join(form.encode("ascii", "ignore").decode("ascii").split())
    return s if len(s) > 0.4 * len(form) and _LETTERS.search(s) else form


def is_divided(s: str) -> bool:
    """Whether a skeleton may have several parts; a quick look that spares most lines the search."""
    return "|" in s or ": " in s or " -" in s or ". " in s or "/" in s or ">" in s or "! " in s or "? " in s or ":" in s


def parts(s: str) -> list[str]:
    """The parts of a skeleton between separators and sentence ends, as ``_PARTS`` has them; marks at their ends are cut off, so plain replacement tells them apart."""
    if " --" in s:
        split = _PARTS.split(s)
    else:
        for sign in _SIGNS:
            if sign in s:
                s = s.replace(sign, "|")
        split = s.split("|")
    return [x for x in [y.strip(_EDGE) for y in split] if x]


def is_structure(form: str) -> bool:
    """A line with the marks of a heading, list item, table row, quotation, caption, reference or question; tags, as lists of single words without common ones, are none."""
    if form.count("|") >= 2:
        return True
    first = form[:1]
    if first.isalpha() and first not in "qaftQAFT" or not _STRUCTURE.match(form):
        return False
    return not ("," in form and "0" not in form and STOP.isdisjoint(form.translate(_COMMAS).split()))


_COMMAS = str.maketrans(",#", "  ")


def key(sort: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(sort + value) - (1 << 63)


def opening_of(s: str, form: str) -> list[int]:
    """Keys of what a short line without an end mark opens with: its first two words, and its first if that is a common word (before a name, as in a byline)."""
    if len(form) > SHORT_CHARS or form.endswith(END):
        return []
    words = s.strip(_EDGE).split(" ")
    out = [key("opening", " ".join(words[:2]))] if len(words) > 1 else []
    return out + [key("opening", words[0])] if words[0] in STOP else out


def shape_of(s: str, form: str) -> list[int]:
    """Key of where a short line has its words, digits and marks."""
    return [key("shape", _WORD.sub("w", s.strip(_EDGE)))] if "0" in form and len(form) <= SHORT_CHARS and form.count("|") < 2 else []


def lead_of(s: str, form: str) -> list[int]:
    """Key of the words before a colon that a line opens with."""
    i = s.find(": ")
    return [key("lead", s[:i].strip(_EDGE))] if 2 < i <= 40 and not is_structure(form) else []


def features(form: str) -> tuple[list[int], list[int], list[int]]:
    """Keys of the parts, of opening and shape, and of the leading words of a line; nothing of lines beyond ``PART_CHARS``, or of one part beyond ``SHORT_CHARS``."""
    if not form or len(form) > PART_CHARS:
        return [], [], []
    s = skeleton(form)
    if len(form) > SHORT_CHARS and not is_divided(s):
        return [], [], []
    whole = s.strip(_EDGE)
    split = parts(s)
    own = {key("part", x) for x in ((whole, *split) if len(split) > 1 else split) if len(x) > 1 or x > "　"}
    if is_structure(form):
        return sorted(own), [], []
    return sorted(own), [*opening_of(s, form), *shape_of(s, form)], lead_of(s, form)


#: What the first pass says of a line.
BAD, GOOD, SHORT, LINK, NEAR = "furniture", "article", "short", "short and worded like a link", "attributed"


class Labels:
    """The labels of a crawl, and the first pass over a line by them."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(np.asarray(keys, np.int64))
        self._set: frozenset[int] | None = None
        self._seen: dict[str, tuple[str, str, str]] = {}

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "_set": None, "_seen": {}}

    def __contains__(self, k: int) -> bool:
        return k in self.known

    @property
    def known(self) -> frozenset[int]:
        if self._set is None:
            self._set = frozenset(self.keys.tolist())
        return self._set

    def density(self, s: str, split: list[str]) -> float:
        """The share of a line's characters that labels and lone numbers make up."""
        if len(split) == 1:
            return float(self.holds(split[0]))
        if self.holds(s.strip(_EDGE)):
            return 1.0
        total = sum(map(len, split))
        return sum([len(x) for x in split if x == "0" or self.holds(x)]) / total if total else 0.0

    def holds(self, part: str) -> bool:
        return len(part) <= PART_CHARS and xxhash.xxh3_64_intdigest("part" + part) - (1 << 63) in (self._set or self.known)

    def first_pass(self, form: str) -> tuple[str, str, str]:
        """(class, reason, skeleton) of a line by itself, without its page's title and its site's repeated lines."""
        found = self._seen.get(form)
        if found is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            s = skeleton(form)
            found = self._seen[form] = (*self._judge(form, s), s)
        return found

    def _judge(self, form: str, s: str) -> tuple[str, str]:
        split = parts(s)
        if split and self.density(s, split) >= 0.5:
            return BAD, "link density"
        structure = is_structure(form)
        if not structure:
            if len(split) > 1:
                crumbs = len(split) > 2 and len(_CRUMB.findall(s)) > 1
                if (crumbs or len(form) <= 120 and ": " in s) and self.holds(split[0]):
                    return BAD, "led by a label"
                if ": " in s and any(k in self for k in lead_of(s, form)) and STOP.isdisjoint(w.strip(_EDGE) for w in s.split(": ", 1)[1].split()):
                    return BAD, "list after a label"
            if len(form) <= SHORT_CHARS and (any(k in self for k in opening_of(s, form)) or any(k in self for k in shape_of(s, form))):
                return BAD, "opening or shape"
        if structure:
            return GOOD, "structure"
        end = form.endswith(END)
        if end:
            if _ATTRIBUTED.match(form):
                return NEAR, "inherited"
            if len(form) > 80:  # however dense
                return GOOD, "stop-word density"
        density = common_share(form)
        if end and density >= 0.1 or len(form) >= 75 and density >= 0.15:
            return GOOD, "stop-word density"
        return (LINK if density == 0 and len(form) <= SHORT_CHARS else SHORT), "inherited"


def common_share(form: str) -> float:
    """The share of common words in a form; of Japanese, which parts no words, by its syllable signs."""
    if form.isascii():
        plain = form.encode("ascii").translate(_APART).split()
        return sum(map(_PLAIN_STOP.__contains__, plain)) / max(1, len(plain))
    words = _WORD.findall(form)
    kana = len(_KANA.findall(form)) / max(1, len(form))
    return max(sum(map(STOP.__contains__, words)) / max(1, len(words)), 0.3 if kana > 0.25 else 0.1 if kana > 0.1 else 0.0)


def title_part(s: str, title: str) -> str | None:
    """``whole`` if a line is the page's title, ``trail`` if it ends with it after other parts, else None; both as skeletons without marks at their ends."""
    if len(title) < 5 or title[:5] not in s:
        return None
    line = s.strip(_EDGE)
    if len(line) < 5:
        return None
    if title.startswith(line):
        return "whole"
    if len(line) <= 300:
        for m in _PARTS.finditer(line):
            tail = line[m.end():].strip(_EDGE)
            if len(tail) > 4 and title.startswith(tail) and m.end() > 1:
                return "trail"
    return None
