"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; elements that are no text of the page by their tag or by a class that
says just that (navigation, footers, forms, adverts, comments) are left out. The first pass classes a block by the
density of stop words, its length and its density of links. The second pass gives ambiguous blocks the label of their
nearest decided neighbours, looked for inside the article first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

# Tags and names with a meaning, and common words of four languages.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th"
    " thead title tr ul".split()
)
CONTAINER = frozenset("article aside blockquote dd details dialog div dl fieldset figure footer form header hgroup li main menu nav ol section table td ul head".split())
RAW = frozenset("script style noscript template iframe textarea noembed noframes".split())  # without a closing tag they take the rest of the page
SKIPPED = RAW | frozenset("svg canvas object select button audio video".split())
APART = frozenset("nav footer aside form menu dialog head".split())
SCOPES = frozenset(("article", "main"))
COMMENTS = frozenset("comment comments disqus respond".split())
WORDS_APART = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent disclaimer"
    " footer header menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted promotion related replies"
    " share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
WORDS_NEUTRAL = frozenset("area bar block body bottom box container form inner item items left list main page post primary right secondary section site top wrap wrapper".split())
ROLES_APART = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we"
    " der die und das den von zu mit ist des im dem nicht ein eine als auch es an auf für sich er werden aus bei sie nach wie sind oder war nur"
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son sa aux ont mais cette"
    " el y los las del se por con una su al lo como más o pero sus le ha sin sobre este entre cuando muy hasta hay donde desde todo".split()
)

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile("[>\"']")
_HINT = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[-_]+")


@dataclass
class Block:
    """text; linked: characters of it in links; heading; scopes: the articles around it by number, the innermost last."""

    text: str
    linked: int
    heading: bool
    scopes: tuple[int, ...]


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag; the name of comments and declarations is empty.

    A tag ends at the next > outside quotation marks. Where there is none the marks of the rest of the page mean nothing,
    so every character is looked at a bounded number of times. A tag that never ends takes the rest of the page.
    """
    at, n, last = 0, len(html), html.rfind(">")
    final = {q: html.rfind(q) for q in "\"'"}
    quotes = True
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        m = _NAME.match(html, start + 1)
        if not m:
            at = start + 1
            continue
        end = -1
        if quotes:
            here = m.end()
            while True:
                sign = _QUOTE.search(html, here)
                if not sign:
                    break
                if sign[0] == ">":
                    end = sign.start()
                    break
                if sign.start() >= final[sign[0]]:
                    break
                here = html.find(sign[0], sign.end()) + 1
            quotes = end >= 0
        if end < 0 and m.end() <= last:
            end = html.find(">", m.end())
        at = n if end < 0 else end + 1
        yield start, at, m[1].lower(), html[start + 1] == "/", html[m.end() : n if end < 0 else end]
        at = max(at, start + 1)


def _says(value: str, words: frozenset[str]) -> bool:
    """Whether a class or id is one of the words, alone or with neutral ones."""
    for name in value.split():
        parts = set(_PART.split(name)) - {""}
        if parts & words and parts <= words | WORDS_NEUTRAL:
            return True
    return False


def _set_apart(name: str, attributes: str, in_scope: bool) -> str:
    """Why an element is left out: its tag, that it isn't shown, comments, its class; empty if it isn't."""
    if name in APART or (name == "header" and not in_scope):
        return "tag"
    for key, value in _HINT.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            return "unseen"
        if key in ("class", "id") and _says(value, COMMENTS):
            return "comments"
        if name not in SCOPES and ((key == "role" and value in ROLES_APART) or (key in ("class", "id") and _says(value, WORDS_APART))):
            return "class"
    return ""


def blocks(html: str, left_out: list[str] | None = None) -> Iterator[Block]:
    """The blocks of a page with text, in page order, without those left out; their texts go into left_out."""
    stack: list[tuple[str, str, list[str]]] = []
    open_names: Counter[str] = Counter()
    apart: list[str] = []
    scopes: tuple[int, ...] = ()
    number = 0
    parts: list[str] = []
    link = heading = False
    linked = at = 0
    unclosed: set[str] = set()
    last = html.rfind(">") + 1

    def flush() -> Iterator[Block]:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not apart:
                yield Block(text, linked, heading, scopes)
            elif text and left_out is not None:
                left_out.append(text)
            parts.clear()
        linked = 0

    def seen(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = html[at:end]
            parts.append(piece)
            if link:
                linked += len(" ".join(unescape(piece).split()))

    for start, end, name, closing, attributes in tags(html):
        if start < at:
            continue
        seen(start)
        at = end
        if name in SKIPPED:
            if not closing and not attributes.rstrip().endswith("/") and name not in unclosed:
                close = _closing(name).search(html, at, max(at, last))
                if close:
                    at = close.end()
                elif name in RAW:
                    at = len(html)
                else:
                    unclosed.add(name)
            parts.append(" ")
        elif name == "a":
            link = not closing
        elif name in BLOCK:
            yield from flush()
            link = False
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing
            if name in CONTAINER and not closing:
                why = _set_apart(name, attributes, bool(scopes))
                stack.append((name, apart, scopes))
                open_names[name] += 1
                if name in SCOPES:
                    number += 1
                    scopes = (*scopes[-7:], number)
                    apart = [w for w in apart if w != "class"]  # a wrapper's class says nothing of the article in it
                if why:
                    apart = [*apart[-7:], why]
            elif name in CONTAINER and open_names[name]:
                while True:
                    n, apart, scopes = stack.pop()
                    open_names[n] -= 1
                    if n == name:
                        break
        elif name in ("br", "img", "input"):
            parts.append(" ")
    seen(len(html))
    yield from flush()


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>", re.I)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: lengths in characters, shares of stop words and of linked characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.30
    links: float = 0.2
    links_high: float = 0.5


_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_EDGES = ".,;:!?()[]\"'#$%&*|-…«»“”„¿¡"


def first_pass(b: Block, rules: Rules) -> str:
    """good, bad, near (most likely good) or short, the last two being ambiguous.

    Signs of scripts without spaces count as three characters. Few stop words alone make no block bad, as the lists
    are of four languages; they leave it to its neighbours.
    """
    length = len(b.text) + 2 * len(_WIDE.findall(b.text))
    share = b.linked / max(1, len(b.text))
    words = [w.strip(_EDGES).lower() for w in b.text.split()]
    stop = sum(w in STOP_WORDS for w in words) / len(words)
    if share > rules.links_high or (share > rules.links and (length <= rules.long or stop < rules.stop_low)):
        return "bad"
    if not b.scopes and length < rules.long and ("©" in b.text or "all rights reserved" in b.text.lower()):
        return "bad"
    if length < rules.short:
        return "bad" if b.linked else "short"
    if stop >= rules.stop_high:
        return "good" if length > rules.long else "near"
    return "near" if stop >= rules.stop_low or length > rules.long else "short"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is kept: short and near blocks take the label of their nearest decided neighbours.

    Inside an article only its own blocks are neighbours, and one without any decided block is kept; where neighbours
    differ, all but a heading before a bad block are kept. Outside, the ends of the page count as bad: neighbours that
    differ keep a near block, a heading before a good block, and a short block if a near one lies between it and the
    bad neighbour. On a page without a decided block near blocks are kept.
    """
    n = len(found)
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    own: dict[int, list[int]] = {}
    for i in decided:
        for scope in found[i].scopes:
            own.setdefault(scope, []).append(i)
    nears = [i for i, x in enumerate(labels) if x == "near"]
    keep = []
    for i in range(n):
        if labels[i] in ("good", "bad"):
            keep.append(labels[i] == "good")
            continue
        scope = next((s for s in reversed(found[i].scopes) if s in own), None)
        if scope is None and found[i].scopes:
            keep.append(True)
            continue
        among = own[scope] if scope is not None else decided
        at = bisect_left(among, i)
        before, after = (among[at - 1] if at else None), (among[at] if at < len(among) else None)
        left, right = (labels[k] == "good" if k is not None else None for k in (before, after))
        if scope is not None:
            if left is None or right is None or left == right:
                keep.append(bool(left if right is None else right))
            else:
                keep.append(right or not found[i].heading)
        elif not decided:
            keep.append(labels[i] == "near")
        elif bool(left) == bool(right):
            keep.append(bool(left))
        elif labels[i] == "near":
            keep.append(True)
        else:
            low, high = (-1 if before is None else before, i) if not left else (i, n if after is None else after)
            between = bisect_left(nears, low + 1) < bisect_left(nears, high)
            keep.append((found[i].heading and bool(right)) or between)
    return keep


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """Kept blocks of a page in their order, joined by a line feed; empty if there are none or the page is null."""
    found = list(blocks(html or ""))
    keep = second_pass(found, [first_pass(b, rules) for b in found])
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def decisions(html: str | None, rules: Rules = Rules()) -> Counter[str]:
    """How many blocks of a page markup leaves out, the first pass decides and the second pass decides."""
    out: list[str] = []
    found = list(blocks(html or "", out))
    labels = Counter("first pass" if first_pass(b, rules) in ("good", "bad") else "second pass" for b in found)
    return labels + Counter({"markup": len(out)})


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """(id, url, text, n_chars) of every row; ids and urls, null or repeated ones too, pass through. Other columns are
    not looked at. The time for a page grows with its length, whatever its marks; repeated blocks are kept each."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in it:
            for i, url, html in zip(*b.columns, strict=True):
                text = main_text(html.as_py(), rules)
                yield i.as_py(), url.as_py(), text, len(text)

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(lambda it: batches(schema, rows(it), 256), "id long, url string, text string, n_chars long")
