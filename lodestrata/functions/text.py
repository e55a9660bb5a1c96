"""Text expressions; all JVM-side. Words are runs of letters, digits and underscores of any script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and words of the evidence rules.
NUMBER = r"(?<![\p{L}\p{N}_])[+-]?\d+(?:[.,]\d+)?%?(?![\p{L}\p{N}_])"
NEGATION = r"\b(no|not|never|without|fails?|decreases?|increases?|less|more)\b"
INSTRUCTION = r"(?i)\b(?:ignore (?:all )?(?:previous|prior) instructions|mark confidence|system prompt|create the claim|reveal (?:secrets?|environment)|execute (?:this|commands?))\b"
YEAR = r"\b((?:19|20)\d{2})\b"
DATASET = r"(\bdataset\s+[\p{L}\p{N}_.-]+)"
VERSION = r"(\bversion\s+[\p{L}\p{N}_.-]+)"
CONDITION = r"(\b(?:if|when|under|provided that)\b[^.,;]*)"
OPPOSITES = (("higher", "lower"), ("faster", "slower"), ("improve", "worsen"))
MARKED_YEARS = ("2020", "2021", "2022", "2023", "2024", "2025", "2026")
#: White space of all scripts, as Unicode and the reference have it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

_FOLDED = [(c, c.casefold()) for c in map(chr, range(0x80, 0x110000)) if c.lower() == c != c.casefold()]


#: SQL of the folded text and of the claim form. SQL engines have lower case alone; what folds further in Latin and Greek is named.
_FOLD = "replace(replace(replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ'), 'µ', 'μ'), 'ſ', 's')"
_SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+"
FOLDED_SQL = _FOLD.replace("{0}", f"trim(regexp_replace({{0}}, '{_SPACE_SQL}', ' ', 'g'), ' ')")
CLAIM_SQL = _FOLD.replace("{0}", f"rtrim(trim(regexp_replace({{0}}, '{_SPACE_SQL}', ' ', 'g'), ' '), '. ')")


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squeeze_all(text: Column) -> Column:
    """As ``squeeze``, for the white space of all scripts."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def casefold(text: Column) -> Column:
    """Unicode's full case folding: lower case, then the letters that fold further, of which ASCII has none."""
    low = F.lower(text)
    one = [(c, f) for c, f in _FOLDED if len(f) == 1]
    more = F.array(*[F.lit(c + f) for c, f in _FOLDED if len(f) > 1])
    moved = F.translate(low, "".join(c for c, _ in one), "".join(f for _, f in one))
    folded = F.aggregate(more, moved, lambda t, x: F.replace(t, F.substring(x, 1, 1), F.substring(x, 2, 9)))
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(folded)


def content_hash(text: Column) -> Column:
    """SHA-256 of the case-folded text with single blanks for white space."""
    return F.sha2(casefold(squeeze_all(text)), 256)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the exact parts, a line feed between; null parts count as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def normalize_claim(text: Column) -> Column:
    return casefold(F.rtrim(squeeze_all(text), F.lit(". ")))


def query_key(text: Column) -> Column:
    """Queries that differ in case and white space alone have one key."""
    return casefold(squeeze_all(text))


def short_id(*parts: Column) -> Column:
    """36 characters that depend on the parts alone."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 36)


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a zero character between."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def tokens(text: Column) -> Column:
    """Lexical tokens: words, also joined by single dots or hyphens."""
    word = r"[a-z0-9_\p{L}\p{N}]++"  # ASCII first and possessive: half the time
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({word}(?:[-.]{word})*+)"), F.lit(1))


def claim_terms(text: Column) -> Column:
    """Distinct terms of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_%-]+)"), F.lit(1)), lambda t: F.length(t) > 2))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))


def marks(text: Column, pattern: str) -> Column:
    """The distinct matches of ``pattern`` in the lower-case text, sorted, without final marks."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda x: F.rtrim(x, F.lit(".,;:!?")))))


def suspicious(text: Column) -> Column:
    """Whether a text gives instructions to its reader's model."""
    return text.rlike(INSTRUCTION)


def clean_passage(text: Column) -> Column:
    """The text without the sentences that give instructions."""
    sentences = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.array_join(F.filter(sentences, lambda s: ~s.rlike(INSTRUCTION) & (F.trim(s) != "")), " ")


def word_set(text: Column) -> Column:
    """Distinct words in lower case without marks at their ends."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(squeeze(text)), " "), lambda w: F.btrim(w, F.lit(".,:;!?()[]{}"))), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; two empty sets are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def label(text: Column, most: int = 160) -> Column:
    return F.substring(squeeze(text), 1, most)


def name_uuid(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
