"""Main text of web pages, with a host suffix array for the boilerplate that markup doesn't name.

A page is cut into blocks. Elements that are menus, headers, footers, asides or forms by tag or role, and those whose class or id says
so in all its words, are boilerplate. A page that declares its article by an element or a role gives the text of that element; inside
it, an element of doubtful name (related, notice, legal, ...) stays unless it is made of links or repeats on the host, and so does what
stands beside a nested article within main. On a page without a declared article repetition decides every block.

What repeats is found by a suffix array with the longest common prefixes of neighbours, built by prefix doubling over the token
streams of a host's pages laid end to end, block ends included. A stretch of the array whose neighbours have LONG
tokens or more in common is a repeated substring; one on PAGES distinct pages or more is boilerplate, and blocks it covers by half or
more are dropped. Arrays are built in chunks, each giving one row per distinct substring of LONG tokens with its number
of pages, and the rows are added up over all chunks: a longer repeat is the union of those in it. So a
host with a third of all pages is spread over all tasks, and its footer is one row per chunk. The sure text of
declared articles takes no part: that passages of articles repeat does not make them boilerplate.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

LONG, PAGES, CHUNK = 8, 3, 400_000
#: Strength from which an element or a role, rather than a class name, declares the article.
SURE = 2

RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|canvas|audio|video"
_OTHER = rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+(?:>|\Z).*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
#: Quotes that follow = hide a >. No part is tried twice, so pages of tags that never end take linear time.
TAG = re.compile(rf"{_OTHER}|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)", re.S | re.I)
#: For the rest of a page from a tag on that doesn't end: quotes hide nothing, and the next < ends a tag too.
PLAIN = re.compile(rf"{_OTHER}|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)(>|(?=<)|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title nav footer aside form button dialog menu fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name boilerplate by themselves, and those that do so inside an article only with another sign.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup signin login comment comments commentlist respond disqus reply replies "
    "pagination pager paywall topbar".split()
)
DOUBTFUL = frozenset("promo promotion banner widget widgets notice notices share sharing social related recommended reactions toolbar skip copyright legal disclaimer hidden".split())
#: Words that may stand beside such a word in a name; ad-hoc or related-work name something else.
STRUCTURE = frozenset(
    "area bar block body bottom box btn button buttons card cell center col column container content desktop fixed form global group icon icons inner item items left link links list mobile outer "
    "page panel post posts article articles primary right row secondary section site slot space strip text title top unit wrap wrapper".split()
)
#: Elements whose ids are anchors made from what they say.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p li td th tr dt dd figure blockquote pre article main".split())
BODIES = frozenset("articlebody article-body article-content post-content post-body entry-content story-body main-content page-content article post entry".split())
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m.group(1).rpartition("@")[2].lower() if m else ""


class Block:
    """A block's text, the strongest article around it, whether markup says it is boilerplate, the doubtful element that it is in, and how many of its characters are links."""

    __slots__ = ("doubt", "dropped", "inside", "links", "text")

    def __init__(self, text: str, inside: int, dropped: bool, doubt: int | None, links: int):
        self.text, self.inside, self.dropped, self.doubt, self.links = text, inside, dropped, doubt, links


def named(value: str) -> int:
    """2 if a name among these says boilerplate by itself, 1 if it may, 0 if not. All words of the name must agree."""
    most = 0
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", name) if w and not w.isdigit()]
        if words and all(w in NAMES or w in DOUBTFUL or w in STRUCTURE for w in words):
            most = max(most, 2 if any(w in NAMES for w in words) else int(any(w in DOUBTFUL for w in words)))
    return most


def _kind(tag: str, attributes: str, inside: int) -> tuple[int, bool, bool]:
    """(strength of the article an element declares, whether it is boilerplate, whether it may be)."""
    dropped, doubtful = tag in DROPPED or (tag == "header" and not inside), False
    strength = 3 if tag == "article" else 2 if tag == "main" else 0
    if attributes.strip():
        says = 0
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                dropped |= value in ROLES and not (value == "banner" and inside)
                strength = max(strength, 2 * (value == "main"), 3 * (value == "article"))
            elif name in ("class", "id") and tag not in ("html", "body"):
                if not (name == "id" and tag in ANCHORED):
                    says = max(says, named(value), 2 * ("header" in re.split(r"[\s_-]+", value) and not inside))
                strength = max(strength, bool(set(value.split()) & BODIES))
            elif name == "itemprop" and value == "articlebody":
                strength = 3
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                dropped = True
        if says and (strength < SURE or inside):  # the first declared article is never named away; one inside it, a comment, may be
            dropped |= says == 2 or inside < SURE
            doubtful = says == 1 and inside >= SURE
    return strength, dropped, doubtful


def blocks(page: str | None) -> list[Block]:
    """Blocks in page order, white space made one, none empty."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int | None]] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name, in the stack
    solid: list[int] = []  # places of open blocks other than paragraphs
    inside, dropped, doubt, doubts, at, links = 0, False, None, 0, 0, 0
    parts: list[str] = []

    def end() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, inside, dropped, doubt, links))
        links = 0

    def cut(i: int) -> None:
        for k in range(len(stack) - 1, i - 1, -1):
            places[stack[k][0]].pop()
        del stack[i:]
        while solid and solid[-1] >= i:
            solid.pop()

    def said(some: str) -> None:
        nonlocal links
        parts.append(entities.unescape(some) if "&" in some else some)
        if places.get("a"):
            links += len(some.strip())

    pattern, done = TAG, False
    while not done:
        done = True
        for m in pattern.finditer(page, at):
            if pattern is TAG and m.group(5) == "":  # the tag goes on to the end of the page
                pattern, done = PLAIN, False
                if m.start() > at:
                    said(page[at : m.start()])
                at = m.start()
                break
            if m.start() > at:
                said(page[at : m.start()])
            at = m.end()
            if m.group(3) is None or (pattern is PLAIN and m.group(5) != ">"):
                continue
            tag = m.group(3).lower()
            if tag not in INLINE:
                end()
            if m.group(2):
                if places.get(tag):
                    i = places[tag][-1]
                    if max((places.get(t) or [-1])[-1] for t in ("article", "main")) > i and tag in INLINE | {"p", "li"}:
                        continue  # a stray end tag doesn't close an article
                    if tag in INLINE and (stack[i][2] or stack[i][3] is not None):
                        end()
                    cut(i)
            elif tag not in VOID and not m.group(4).endswith("/"):
                if tag not in INLINE and tag not in ("html", "body") and places.get("p") and (solid or [-1])[-1] < places["p"][-1]:
                    cut(places["p"][-1])  # a block ends an open paragraph
                around, off, open_doubt = stack[-1][1:] if stack else (0, False, None)
                strength, drop, doubtful = _kind(tag, m.group(4), around)
                if (drop and not off or doubtful) and tag in INLINE:
                    end()
                if doubtful and open_doubt is None:
                    open_doubt, doubts = doubts, doubts + 1
                places.setdefault(tag, []).append(len(stack))
                if tag not in INLINE and tag != "p":
                    solid.append(len(stack))
                stack.append((tag, max(around, strength), off or drop, open_doubt))
            inside, dropped, doubt = stack[-1][1:] if stack else (0, False, None)
    if at < len(page):
        said(page[at:])
    end()
    return out


def declared(found: list[Block]) -> int:
    """The strongest article that has text of its own; 0 for none."""
    return max((b.inside for b in found if not b.dropped), default=0)


def linked(found: list[Block]) -> set[int]:
    """Doubtful elements half of whose characters or more are links."""
    size: dict[int, list[int]] = {}
    for b in found:
        if b.doubt is not None:
            own = size.setdefault(b.doubt, [0, 0])
            own[0], own[1] = own[0] + len(b.text), own[1] + b.links
    return {d for d, (n, links) in size.items() if 2 * links >= n}


def verdicts(found: list[Block], strength: int) -> list[bool | None]:
    """For each block whether it stays; None where repetition on the host decides.

    Without a declared article that is each block in the strongest article that markup doesn't drop. With one its own text stays;
    what stands beside a nested article within main, and what is in an element of doubtful name, stays unless it is made of links or repeats.
    """
    dense = linked(found)
    out: list[bool | None] = []
    for b in found:
        if b.dropped or (b.inside < strength and (strength < SURE or b.inside < SURE)):
            out.append(False)
        elif strength < SURE:
            out.append(None)
        elif b.inside < strength:
            out.append(False if 2 * b.links >= len(b.text) else None)
        else:
            out.append(True if b.doubt is None else False if b.doubt in dense else None)
    return out


def stream(found: list[Block], strength: int) -> tuple[list[str], list[int]]:
    """Tokens outside the text of a declared article, each block with an end token, and the block of each."""
    tokens, owner = [], []
    for i, (b, stays) in enumerate(zip(found, verdicts(found, strength))):
        if stays:
            continue
        own = [*b.text.split(), "\x00"]
        tokens += own
        owner += [i] * len(own)
    return tokens, owner


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their suffixes, longest common prefix of each with the one before), by prefix doubling.

    The ranks of every doubled width are kept: two suffixes agree on so many symbols when their ranks are equal.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks, width = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)], 1
    while width < n and int(ranks[-1].max()) + 1 < n:
        after = np.full(n, -1, np.int64)
        after[:-width] = ranks[-1][width:]
        ranks.append(np.unique(ranks[-1] * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.flatnonzero((x < n) & (y < n))
        equal = inside[ranks[k][x[inside]] == ranks[k][y[inside]]]
        common[equal] += 1 << k
    return order, np.concatenate(([0], common))


def repeated_prefixes(streams: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the concatenation of (host, tokens) streams: (place, stream, class) of suffixes with LONG tokens left in their stream.

    A class is a stretch of the suffix array with LONG tokens in common. Symbols are those of a host, and each stream
    ends with one of its own, so that no substring reaches over hosts or pages.
    """
    ids: dict[tuple[str, str], int] = {}
    size = [len(t) for _, t in streams]
    page = np.repeat(np.arange(len(streams)), [x + 1 for x in size])
    symbols = np.array([x for k, (host, tokens) in enumerate(streams) for x in [*(ids.setdefault((host, t), len(ids)) for t in tokens), -1 - k]], np.int64)
    at = np.arange(len(symbols)) - np.repeat(np.cumsum([0, *(x + 1 for x in size[:-1])]) if size else [], [x + 1 for x in size]).astype(np.int64)
    order, common = suffix_array(symbols)
    cls = np.cumsum(common < LONG) - 1
    left = np.array(size, np.int64)[page] - at if size else at
    fits = left[order] >= LONG
    place, cls = order[fits], cls[fits]
    back = np.argsort(place, kind="stable")
    place, cls = place[back], np.unique(cls[back], return_inverse=True)[1]
    return place - page[place], page[place], cls  # the end symbols are counted out again


def _digest(host: str, tokens: list[str]) -> tuple[int, int]:
    raw = (host + "\x01" + "\x02".join(tokens)).encode("utf-8", "replace")
    return xxhash.xxh64_intdigest(raw, 3) - (1 << 63), xxhash.xxh64_intdigest(raw, 4) - (1 << 63)


#: Rows of pass one: substrings of a chunk with their numbers of pages; places of a page's substrings; pages that are done; pages that are open.
_FIRST = "key bigint, check bigint, pages bigint, page bigint, place bigint, page_id bigint, url string, text string, html string"


def first_pass(pages: DataFrame) -> DataFrame:
    """One parse of every page: the text of those that markup decides, the html of the others, and the substrings of a chunk of pages."""
    kinds = [(f.split()[0], pa.int64() if f.split()[1] == "bigint" else pa.string()) for f in _FIRST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, list[str]]] = []
        size = 0

        def batch(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in kinds], names=[c for c, _ in kinds])

        def flush() -> Iterator[pa.RecordBatch]:
            place, page, cls = repeated_prefixes([(h, t) for _, h, t in held])
            first = np.unique(cls, return_index=True)[1] if len(cls) else cls
            tokens = [t for _, _, own in held for t in own]
            name = [_digest(held[page[f]][1], tokens[place[f] : place[f] + LONG]) for f in first.tolist()]
            seen = np.unique(cls * len(held) + page) // len(held) if len(cls) else cls
            count = np.bincount(seen, minlength=len(first)) if len(cls) else cls
            yield batch(key=[k for k, _ in name], check=[c for _, c in name], pages=[int(n) for n in count])
            start = np.concatenate(([0], np.cumsum([len(t) for _, _, t in held])))
            own = [(*name[c], held[s][0], p - int(start[s])) for p, s, c in zip(place.tolist(), page.tolist(), cls.tolist()) if held[s][0] is not None]
            yield batch(**dict(zip(("key", "check", "page", "place"), list(zip(*own)) or [[]] * 4)))

        for b in batches:
            done: list[tuple] = []
            left: list[tuple] = []
            for key, page_id, url, page in zip(*(b.column(c).to_pylist() for c in ("_key", "page_id", "url", "html"))):
                found = blocks(page)
                strength = declared(found)
                stay = verdicts(found, strength)
                if None in stay:
                    left.append((key, page_id, url, page))
                else:
                    done.append((page_id, url, " ".join(x.text for x, s in zip(found, stay) if s)))
                tokens, _ = stream(found, strength)
                held.append((key if None in stay else None, host_of(url), tokens))
                size += len(tokens)
                if size >= CHUNK:
                    yield from flush()
                    held.clear()
                    size = 0
            yield batch(**dict(zip(("page_id", "url", "text"), list(zip(*done)) or [[]] * 3)))
            yield batch(**dict(zip(("page", "page_id", "url", "html"), list(zip(*left)) or [[]] * 4)))
        if held:
            yield from flush()

    return pages.mapInArrow(run, _FIRST)


def main_text(page: str | None, covered: list[int]) -> str:
    """The page's text, given the places of its stream at which repeated substrings of LONG tokens begin."""
    found = blocks(page)
    strength = declared(found)
    stay = verdicts(found, strength)
    tokens, owner = stream(found, strength)
    hit = np.zeros(len(tokens) + LONG, bool)
    for p in covered:
        hit[p : p + LONG] = True
    own = np.array(owner, np.int64)
    word = np.array([t != "\x00" for t in tokens], bool)
    share = np.bincount(own[word], hit[: len(tokens)][word], len(found)) / np.maximum(1, np.bincount(own[word], minlength=len(found))) if len(tokens) else np.zeros(len(found))
    return " ".join(b.text for b, s, x in zip(found, stay, share) if (s if s is not None else x < 0.5))


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    Null and empty html give an empty text; a null url is a host of its own name. Repeated rows stay,
    and count as pages each. Other columns are not read. An empty table gives an empty one. Pages that markup decides are parsed
    once and not moved; the html of the others meets the places of what repeats in it.
    """
    slim = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = scratch.keep(first_pass(slim.withColumn("_key", F.xxhash64("page_id", "url", "html"))))
    often = scratch.keep(rows.filter("pages > 0").groupBy("key", "check").agg(F.sum("pages").alias("n")).filter(f"n >= {PAGES}").select("key", "check"))
    places = rows.filter("place IS NOT NULL").select("page", "place", "key", "check").join(often, ["key", "check"])
    covered = scratch.keep(places.groupBy("page").agg(F.collect_set("place").alias("covered")))
    open_pages = rows.filter("page IS NOT NULL AND place IS NULL").select("page", "page_id", "url", "html").join(covered, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, c or []) for h, c in zip(b.column("html").to_pylist(), b.column("covered").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    texts = rows.filter("text IS NOT NULL").select("page_id", "url", "text").unionByName(open_pages.mapInArrow(run, "page_id long, url string, text string"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
