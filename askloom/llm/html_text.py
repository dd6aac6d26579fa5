"""Operator 8: main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element; empty ones are left out, and so are those of elements that hold no
article text by their role (menus, headers, footers, sidebars, scripts, controls, hidden parts, reader comments). A line
weighs its text outside links; a h1, and a line of an article element, weighs its whole text. Hints make weights smaller,
by HINT each: a class, id or role that marks the line's element (or, outside article elements, a line that begins with a
statement of rights), a form around it, and lying outside the article element where the page has one. The lines with the same hints, in page order, are one distribution: sums over WINDOW neighbouring
weights surge where text begins and dive to nothing where it ends, and the lines from the first to the last weighty line
between surge and dive are kept, lines of links between them included. Text without hints surges at any weight; text with
hints only if a sum reaches SURGE of the page's largest. So a marked or outer block goes beside an article, but stays where
it holds the page's text.

Defined results: null or empty HTML gives an empty text; markup that is cut off ends with the page; long pages, broken ones
too, are read whole, in time that grows with their length; repeated rows each get their text; a column with the name of the result is replaced, others stay as they are; an
empty table gives an empty result.
"""

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, HINT, SURGE = 3, 1 / 32, 1 / 4

# HTML element names by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that leave the head open; others open the body.
IN_HEAD = frozenset("base basefont bgsound html head link meta".split())
DROPPED = frozenset("nav footer aside form button select datalist dialog menu head object svg math canvas audio video map".split())
RAW = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp"
#: Words of a class, id or role token that mark what is not article text. A token counts if all its words are among these
#: and QUALIFIERS: cookie-notice and site-header count, no-sidebar and related-work don't.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "comment comments commentlist respond disqus reply replies share sharing social related recommended newsletter subscribe "
    "subscription signup login footer masthead pagination pager toolbar complementary contentinfo search".split()
)

QUALIFIERS = frozenset(
    "site page main global left right top bottom upper lower inner outer primary secondary first last user reader box block area "
    "container wrapper wrap list bar section links icons buttons".split()
)
#: Marks of other people's or other pages' text: article elements inside are not this page's.
OTHERS = frozenset("comment comments commentlist respond disqus reply replies related recommended".split())

#: A line that states rights: it counts as marked outside article elements.
_RIGHTS = re.compile(r"(?:copyright\b|\(c\)|\xa9)", re.I)
_NAME_END = re.compile(r"[\s/>]|\Z")
_ATTRS = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">])*+>""")
_RAW = re.compile(rf"(?:{RAW})\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in RAW.split("|")}
_PLAIN = re.compile(r"[^<>]*")
_REFERENCE = re.compile(r"&#([0-9]{1000,});?")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


class Tags:
    """The tags of a page from left to right, in time that grows with the page, however broken it is: what doesn't close is
    looked for once, and `<` that begins no tag is text."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.name_end, self.ends = page, page.rfind(">"), -1, None

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(begin, end, name, whether it ends an element, attributes); the name is empty for what is only markup."""
        at, page = 0, self.page
        while (at := page.find("<", at)) >= 0:
            found = self.tag(at)
            if found is None:
                at += 1
                continue
            yield at, *found
            at = found[0]

    def tag(self, at: int) -> tuple[int, str, bool, str] | None:
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (len(page) if end < 0 else end + 3), "", False, ""
        first = at + 1 + page.startswith("/", at + 1)
        ending = first > at + 1
        letter = page[first : first + 1]
        if letter.isascii() and letter.isalpha():
            raw = None if ending or self.last < at else _RAW.match(page, first)
            if raw:
                begin = page.find(">", raw.end()) + 1
                return _RAW_END[raw[0].lower()].search(page, begin).end(), "", False, ""
            if self.last >= at:
                if self.name_end <= first:
                    self.name_end = _NAME_END.search(page, first).start()
                end = self.attributes_end(self.name_end)
                if end >= 0:
                    return end + 1, page[first : self.name_end].lower(), ending, page[self.name_end : end]
            end = _PLAIN.match(page, first).end()
            if end == len(page) or page[end] == ">":
                return min(end + 1, len(page)), "", False, ""
        if page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < len(page):
            end = page.find(">", at) if self.last >= at else -1
            return (len(page) if end < 0 else end + 1), "", False, ""
        return None

    def attributes_end(self, at: int) -> int:
        """Where the `>` outside quotes is, or -1. After one search in vain, all places are known from a pass from the end:
        there are three states, outside and in either quotes."""
        if self.ends is None:
            if found := _ATTRS.match(self.page, at):
                return found.end() - 1
            self.places = [m.start() for m in re.finditer("[\"'>]", self.page)]
            out = double = single = -1
            self.ends = [-1] * (len(self.places) + 1)
            for k in range(len(self.places) - 1, -1, -1):
                c = self.page[self.places[k]]
                out, double, single = (self.places[k] if c == ">" else double if c == '"' else single), (out if c == '"' else double), (out if c == "'" else single)
                self.ends[k] = out
        return self.ends[bisect_left(self.places, at)]


def _kind(name: str, attrs: str, in_article: bool) -> str:
    """Why an element is dropped: `hard`, `form`, `mark` (a class, id or role), or not at all: an empty string."""
    if name == "form":
        return "form"
    if name in DROPPED or (name == "header" and not in_article):
        return "hard"
    if not attrs.strip() or name in ("html", "body", "article", "main"):
        return ""
    kind = ""
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "hard"
        if key not in ("class", "id", "role") or (key == "id" and name in HEADINGS):
            continue
        for token in value.split():
            words = set(re.split(r"[^a-z]+", token)) - {""}
            marks = words & MARKS
            if "header" in words and not in_article and name not in HEADINGS:
                marks.add("header")
            if not marks or words - marks - MARKS - QUALIFIERS:
                continue
            if marks & OTHERS:
                return "hard"
            # the id of a section in an article is usually made from its heading
            if not (key == "id" and name == "section" and in_article):
                kind = "mark"
    return kind


def lines_of(page: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines of the stripped page; their lengths (whole, and outside links: all of it in a h1); and whether they lie in an
    element (hard) of a role without article text, in a form, in a marked element, in an article element."""
    lines: list[str] = []
    lengths: list[tuple[int, int]] = []
    parts: list[str] = []
    plain: list[str] = []  # the parts outside links
    link = False
    stack: list[tuple[str, str, tuple[int, int] | None]] = []  # open blocks, why they are dropped, and what an article set aside
    opened: dict[str, int] = {}
    count = {"": 0, "hard": 0, "form": 0, "mark": 0}
    article, flags = 0, []  # flags: (hard, form, mark, article) of each line

    def folded(pieces: list[str]) -> str:
        text = "".join(pieces)
        if "&" in text:  # numbers of a thousand digits and more are no characters, unless they are mostly zeros
            text = html.unescape(_REFERENCE.sub(lambda m: f"&#{m[1].lstrip('0') or '0'};" if len(m[1].lstrip("0")) < 9 else "\ufffd", text))
        return " ".join(text.split())

    def flush() -> None:
        nonlocal link
        text = folded(parts)
        if text:
            whole = len(plain) == len(parts) or (stack and stack[-1][0] == "h1")
            lines.append(text)
            lengths.append((len(text), len(text if whole else folded(plain))))
            flags.append((count["hard"] > 0, count["form"] > 0, count["mark"] > 0 or (not article and bool(_RIGHTS.match(text))), article > 0))
        parts.clear()
        plain.clear()
        link = False

    def close(depth: int) -> None:
        nonlocal article
        while len(stack) > depth:
            name, kind, aside = stack.pop()
            opened[name] -= 1
            count[kind] -= 1
            if aside is not None:
                article -= 1
                count["form"] = aside[0]
                count["mark"] = aside[1]

    at = 0
    for begin, end, name, ending, attrs in Tags(page):
        text = page[at:begin]
        at = end
        if stack and stack[-1][0] == "head" and ((text and not text.isspace()) or (name and not ending and name not in IN_HEAD)):
            flush()
            close(len(stack) - 1)
        if text:
            parts.append(text)
            if not link:
                plain.append(text)
        if not name:
            continue
        if name == "a":
            link = not ending
        elif name in ("br", "td", "th", "img", "input"):
            parts.append(" ")
            plain.append(" ")
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if ending:
            if opened.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
        else:
            if name in BLOCKS and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if name == "li" and stack and stack[-1][0] == "li":
                close(len(stack) - 1)
            kind = _kind(name, attrs, article > 0)
            if name in BLOCKS or kind:
                if kind and name not in BLOCKS:
                    flush()
                aside = None
                if name in ("article", "main"):
                    aside = (count["form"], count["mark"])
                    article += 1
                    count["form"] = 0
                count[kind] += 1
                stack.append((name, kind, aside))
                opened[name] = opened.get(name, 0) + 1
    if stack and stack[-1][0] == "head" and page[at:].strip():
        close(len(stack) - 1)
    if page[at:]:
        parts.append(page[at:])
        if not link:
            plain.append(page[at:])
    flush()
    return lines, np.array(lengths, np.int64).reshape(-1, 2), np.array(flags, bool).reshape(-1, 4)


def window_sums(weights: np.ndarray) -> np.ndarray:
    """The sum of each weight and its neighbours, WINDOW in all."""
    total = np.concatenate([[0], np.cumsum(weights)])
    middle, half = np.arange(len(weights)), WINDOW // 2
    return total[np.minimum(middle + half + 1, len(weights))] - total[np.maximum(middle - half, 0)]


def distributions(lengths: np.ndarray, flags: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of hints, lines, their weights) of each kind of line that may be article text."""
    hard, form, mark, article = flags.T
    whole, plain = lengths.T
    clear, wrapped = ~hard & ~form & ~mark, ~hard & ~form & mark & article
    # an article element bounds the text, unless it is in a marked wrapper and lighter than what is not
    bounded = (clear & article).any() or plain[wrapped].sum() > plain[clear].sum()
    outside = bounded & ~article
    hints = form.astype(int) + mark + outside
    weights = np.where(article, whole, plain) * HINT**hints
    kind = np.where(hard, -1, form + 2 * mark + 4 * outside)
    return [(int(hints[at[0]]), at, weights[at]) for k in range(8) if len(at := np.flatnonzero(kind == k))]


def main_lines(lines: list[str], lengths: np.ndarray, flags: np.ndarray) -> list[str]:
    """The lines between surge and dive points of their distributions, in page order."""
    found = [(hints, at, weights, window_sums(weights)) for hints, at, weights in distributions(lengths, flags)]
    least = SURGE * max((sums.max() for *_, sums in found), default=0)
    keep = np.zeros(len(lines), bool)
    for hints, at, weights, sums in found:
        live = np.concatenate([[False], sums > 1e-9, [False]])
        for surge, dive in zip(np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(~live[1:] & live[:-1]), strict=True):
            heavy = surge + np.flatnonzero(weights[surge:dive])
            if len(heavy) and (not hints or sums[surge:dive].max() >= least):
                keep[at[heavy[0] : heavy[-1] + 1]] = True
    return [line for line, k in zip(lines, keep, strict=True) if k]


def extract(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(main_lines(*lines_of(page)))


@F.arrow_udf(T.StringType())
def _extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([extract(x.as_py()) for x in pages], pa.string())


def extract_text(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """pages(html, anything else) -> the other columns and the main text. Only the pages go to Python."""
    others = [F.col(f"`{c}`") for c in pages.columns if c not in (column, name)]
    return pages.select(*others, _extracted(F.col(f"`{column}`")).alias(name))
