"""Column functions on text: cleaning, tokens, names and display labels. All stay in the JVM, but for names with characters
beyond ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.schemas import DEFAULT, STOP_WORDS

# Characters that cleaning replaces by one character, removes, or spells out.
_ONE_TO_ONE = {
    "\u00a0": " ", "\u2007": " ", "\u202f": " ",
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"',
    "\u2013": "-", "\u2014": "-", "\u2212": "-",
}
_REMOVED = "\u00ad\u200b\ufeff"
# One by one: Java looks characters of such a class up, and compares ranges one after the other.
_CONTROL = "[" + "".join(rf"\x{c:02X}" for c in [*range(0x20), 0x7F] if c not in (9, 10, 13)) + "]"
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl"}

# Shapes of lines (page markers, rules, headings, citation entries, bibliography headings).
PAGE_MARKER = r"(?i)^\s*(?:page\s+)?\d+\s*(?:of|/)\s*\d+\s*$"
RULE_LINE = r"^\s*[-=_*~]{3,}\s*$"
HEADING_LINE = r"^(?:\d+(?:\.\d+)*[.)]?\s+|[#*•-]\s*)?[A-Z][\w &/'-]{0,58}$"
CITATION_ENTRY = r"(?i)^(?:\[\d+\]|arXiv:|https?://|doi:)"
REFERENCE_HEADING = r"(?i)^[ \t]*(?:\d+(?:\.\d+)*[.)]?[ \t]*)?(references?|bibliography|works cited|literature cited)[ \t]*:?[ \t]*$"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"


# --- cleaning -------------------------------------------------------------------------------------------------------


def only_if(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where needed(text), else text as it is: a quick look saves the patterns that go over every character. The
    text is bound once, by a transform over an array of one."""
    return F.get(F.transform(F.array(text), lambda x: F.when(needed(x), change(x)).otherwise(x)), F.lit(0))


def fix_characters(text: Column) -> Column:
    """One-to-one repairs, removals and ligatures, then control characters other than tab, newline and return."""

    def repaired(x: Column) -> Column:
        out = F.translate(x, "".join(_ONE_TO_ONE) + _REMOVED, "".join(_ONE_TO_ONE.values()))
        for bad, good in _LIGATURES.items():
            out = F.replace(out, F.lit(bad), F.lit(good))
        return out

    out = only_if(text, lambda x: F.octet_length(x) > F.length(x), repaired)
    return only_if(out, lambda x: x.rlike(_CONTROL), lambda x: F.regexp_replace(x, _CONTROL, ""))


def fold_newlines(text: Column) -> Column:
    return only_if(text, lambda x: F.contains(x, F.lit("\r")), lambda x: F.regexp_replace(x, "\r\n?", "\n"))


def dehyphenate(text: Column) -> Column:
    """Joins a word that was broken by a hyphen at a line end."""
    return only_if(text, lambda x: F.contains(x, F.lit("-\n")), lambda x: F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2"))


def ends_like(x: Column, pattern: str) -> Column:
    """Whether the first or last character of x is like a pattern of white space. Bytes are looked at first: those of
    characters are only found by counting all of them."""
    shown = lambda at: F.substring(x.cast("binary"), at, 1).between(F.lit(b"\x21"), F.lit(b"\x7e"))
    return ~(shown(1) & shown(-1)) & F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(pattern)


def strip(text: Column) -> Column:
    return only_if(text, lambda x: ends_like(x, r"(?U)\s"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks to one, no blanks at line ends, at most one blank line."""
    has = lambda x, *parts: reduce(or_, [F.contains(x, F.lit(p)) for p in parts])
    # a newline comes first in the pattern, as it is rare
    beside = lambda x: x.rlike(r"(?U)\n(?:[^\S\n]|(?<=[^\S\n]\n))") | ends_like(x, r"(?U)[^\S\n]")

    def ends(x: Column) -> Column:
        out = F.regexp_replace(x, r"(?U)(^|\n)[^\S\n]+", "$1")
        return F.regexp_replace(out, r"(?U)[^\S\n]+(\n|$)", "$1")

    out = only_if(text, lambda x: has(x, "  ", "\t", "\f", "\x0b"), lambda x: F.regexp_replace(x, r"[ \t\f\x0B]+", " "))
    out = only_if(out, beside, ends)
    return only_if(out, lambda x: has(x, "\n\n\n"), lambda x: F.regexp_replace(x, "\n{3,}", "\n\n"))


def clean_basic(text: Column) -> Column:
    """Everything but furniture. Newlines are folded before hyphens are joined, so `-\\r\\n` joins too."""
    return collapse_whitespace(dehyphenate(fold_newlines(fix_characters(text))))


def normalize_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def is_rule(line: Column) -> Column:
    return line.rlike(RULE_LINE)


def is_page_marker(line: Column) -> Column:
    return line.rlike(PAGE_MARKER)


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING_LINE)


def is_citation_entry(line: Column) -> Column:
    return strip(line).rlike(CITATION_ENTRY)


def is_reference_heading(line: Column) -> Column:
    return line.rlike(REFERENCE_HEADING)


# --- tokens ---------------------------------------------------------------------------------------------------------


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct tokens without stop words; bare digits stay."""
    return F.array_except(tokens(text), F.array(*[F.lit(w) for w in STOP_WORDS]))


def coverage(question_terms: Column, context_terms: Column) -> Column:
    """Share of the question's terms found in the context; 1 if the question has none."""
    hits = F.size(F.array_intersect(question_terms, context_terms))
    return F.when(F.size(question_terms) == 0, F.lit(1.0)).otherwise(hits / F.size(question_terms))


def word_count(text: Column) -> Column:
    return F.get(F.transform(F.array(strip(text)), lambda x: F.when(F.length(x) == 0, F.lit(0)).otherwise(F.size(F.split(x, r"(?U)\s+")))), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def truncate(text: Column, limit: int, suffix: str = "...") -> Column:
    cut = F.regexp_replace(F.substring(text, 1, max(0, limit - len(suffix))), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(suffix)))


def snippet(text: Column, limit: int = DEFAULT.snippet_chars) -> Column:
    return truncate(normalize_whitespace(text), limit)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# --- names ----------------------------------------------------------------------------------------------------------


def fingerprint(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def basename(name: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"([^/]*)/*$", 1)


def file_extension(name: Column) -> Column:
    """Lower-case suffix; none for names that only begin with a dot or end in one."""
    return F.lower(F.regexp_extract(basename(name), r"[^.]\.([^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"(?<=[^.])\.[^.]+$", "")


def _letters() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII character and marks, by the Unicode data: e-acute to e."""
    found = {}
    for code in range(0x80, 0x10000):
        form = unicodedata.normalize("NFKD", chr(code))
        if form[0] < "\x80" and all(unicodedata.combining(c) for c in form[1:]):
            found[chr(code)] = form[0]
    return found


_LETTERS = _letters()


def plain_letters(text: Column, mark: str = "") -> Column:
    """Letters without their accents, and wide or raised ones as plain ones; `mark` follows each that is replaced."""
    other = "[" + "".join(rf"\u{ord(c):04X}" for c in _LETTERS) + "]"
    marked = F.regexp_replace(text, f"({other})", "$1" + mark) if mark else text
    return F.translate(marked, "".join(_LETTERS), "".join(_LETTERS.values()))


@F.arrow_udf(T.StringType())
def _compatible(names: pa.Array) -> pa.Array:
    return pa.array([None if n is None else unicodedata.normalize("NFKD", n) for n in names.to_pylist()], pa.string())


def decomposed(text: Column) -> Column:
    """The compatibility form: accents part from their letters, ligatures and fractions into several. Only texts with
    characters beyond ASCII leave the JVM."""
    return F.coalesce(_compatible(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def safe_filename(name: Column, fallback: str = "upload") -> Column:
    """Base name of safe characters, of the decomposed name: accents become underscores."""
    base = F.regexp_replace(decomposed(strip(basename(name))), r"[^A-Za-z0-9._-]+", "_")
    base = F.regexp_replace(F.regexp_replace(base, "_{2,}", "_"), r"^[._]+|[._]+$", "")
    base = F.substring(base, 1, 180)
    return F.when(F.length(base) > 0, base).otherwise(F.lit(fallback))


def stored_doc_id(stored: Column) -> Column:
    found = F.regexp_extract(stored, r"(?i)^(doc_[0-9a-f]{6,32})_(.+)$", 1)
    return F.when(found != "", found)


def stored_name(stored: Column) -> Column:
    found = F.regexp_extract(stored, r"(?i)^(doc_[0-9a-f]{6,32})_(.+)$", 2)
    return F.when(found != "", found).otherwise(stored)


def title_context(name: Column) -> Column:
    """`Experiment_5_DAV.docx` -> `Experiment 5 DAV Experiment 5 DAV`; the bare stem if it has no word."""
    spaced = F.regexp_replace(stem(name), "(?<=[a-z0-9])(?=[A-Z])", " ")
    spaced = F.regexp_replace(spaced, "(?<=[A-Z])(?=[A-Z][a-z])", " ")
    words = F.trim(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " "))
    return F.when(words == "", stem(name)).otherwise(F.concat(words, F.lit(" "), words))


def human_size(size: Column) -> Column:
    scaled = lambda n, unit: F.concat(F.format_string("%.1f", size / float(1024**n)), F.lit(f" {unit}"))
    return (
        F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def slugify(value: Column, limit: int = 64) -> Column:
    ascii_ = F.regexp_replace(decomposed(value), r"[^\x00-\x7F]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(ascii_, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    slug = F.substring(slug, 1, limit)
    return F.regexp_replace(F.when(slug == "", F.lit("item")).otherwise(slug), "_+$", "")


def generated_id(prefix: str, *parts: Column) -> Column:
    """A stable id from what identifies the row."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256), 1, 12))


# --- display --------------------------------------------------------------------------------------------------------


def format_duration(ms: Column) -> Column:
    minutes = F.floor(ms / 60000)
    seconds = F.round((ms % 60000) / 1000).cast("int")
    return (
        F.when(ms.isNull(), F.lit("-"))
        .when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms")))
        .when(ms < 60000, F.format_string("%.2f s", ms / 1000))
        .otherwise(F.format_string("%dm %ds", minutes, seconds))
    )


def relative_time(at: Column, now: Column) -> Column:
    """`3 minutes ago`, `yesterday`, `in 2 hours`; `never` for null."""
    seconds = F.round(F.unix_millis(now.cast("timestamp")) / 1000 - F.unix_millis(at.cast("timestamp")) / 1000).cast("long")
    named = {"day": ("yesterday", "tomorrow"), "week": ("last week", "next week"), "month": ("last month", "next month"), "year": ("last year", "next year"), "hour": (None, None), "minute": (None, None)}

    def label(unit: str, size: int) -> Column:
        n = F.round(seconds / size).cast("long")
        many = lambda k: F.concat(k.cast("string"), F.lit(f" {unit}"), F.when(k == 1, F.lit("")).otherwise(F.lit("s")))
        out = F.when(n > 0, F.concat(many(n), F.lit(" ago"))).when(n < 0, F.concat(F.lit("in "), many(-n)))
        zero = F.lit({"minute": "this minute", "hour": "this hour", "day": "today", "week": "this week", "month": "this month", "year": "this year"}[unit])
        past, future = named[unit]
        if past:
            out = F.when(n == 1, F.lit(past)).when(n == -1, F.lit(future)).otherwise(out)
        return F.when(n == 0, zero).otherwise(out)

    size = F.abs(seconds)
    steps = [("minute", 60, 3600), ("hour", 3600, 86400), ("day", 86400, 604800), ("week", 604800, 2592000), ("month", 2592000, 31536000)]
    out = F.when(at.isNull(), F.lit("never")).when(seconds < 45, F.lit("just now"))
    for unit, unit_size, below in steps:
        out = out.when(size < below, label(unit, unit_size))
    return out.otherwise(label("year", 31536000))


def truncate_filename(name: Column, limit: int = 28) -> Column:
    ext = F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)
    bare = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    kept = F.substring(bare, F.lit(1), F.greatest(F.lit(6), F.lit(limit - 1) - F.length(ext)))
    return F.when(F.length(name) <= limit, name).otherwise(F.concat(kept, F.lit("..."), ext))


def score_tone(score: Column) -> Column:
    return F.when(score >= 0.5, "strong").when(score >= 0.3, "decent").otherwise("weak")


def confidence_label(confidence: Column, grounded: Column) -> Column:
    return (
        F.when(~grounded, "Not grounded in documents")
        .when(confidence >= 0.70, "High confidence")
        .when(confidence >= 0.45, "Moderate confidence")
        .when(confidence >= 0.25, "Low confidence")
        .otherwise("Very low confidence")
    )


def highlight(text: Column, query: Column) -> Column:
    """array<struct<text, hit>>: the text in parts, those that equal a query term of three letters or more marked."""
    found = F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda t: F.length(t) > 2))

    def marked(terms: Column) -> Column:
        # a place whose letter begins no term is left at once
        first = F.array_join(F.array_distinct(F.transform(terms, lambda t: F.substring(t, 1, 1))), "")
        pattern = F.concat(F.lit("(?i)(?=["), first, F.lit("])("), F.array_join(terms, "|"), F.lit(")"))
        out = F.regexp_replace(text, F.when(F.size(terms) == 0, F.lit("(?!)")).otherwise(pattern), F.lit("\u0001$1\u0001"))
        parts = F.filter(F.split(out, "\u0001"), lambda p: p != "")
        return F.transform(parts, lambda p: F.struct(p.alias("text"), F.array_contains(terms, F.lower(p)).alias("hit")))

    # the terms are bound once, not made again for every part
    return F.get(F.transform(F.array(found), marked), F.lit(0))
