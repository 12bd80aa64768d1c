"""Operator 10, HTML extraction by union-free wrappers inferred for each host.

Every page is read into a token stream: opening and closing tags (with their class and id) and text. Inline elements
without class or id are part of the text around them. A block's text that more than half of a host's different pages with
its place have there (LEAST at least) is a token of the template, wherever it stands; all other texts are slots. A page's
own regular expression is its stream with repetitions folded: neighbouring equal groups of tokens become one repeated
group. Equal expressions of a host are counted on the executors first, so a host that holds a third of all pages sends a
row for each different shape, not each page; the shapes are aligned one by one, the most frequent first, within SALTS parts
of a host and then the parts' results with each other. A mismatch of tokens is resolved, in this order, into a repeated
group (the tokens repeat what stands before them) or optional groups (found on one side only; both, where each side has
its own). There is no union. A shape that would take a wrapper beyond MOST_ITEMS isn't aligned, so a task's memory is bounded.

Each page is then matched with its host's wrapper as a whole, by an automaton that takes repeats and optional groups where
it can. Texts
of the template are left out. A slot within menus, headers, footers, side bars, notices, adverts, forms, scripts, styles or
reader comments, by tag or by the words of class and id, is left out; of the others, those within an article (else a main
part, else the body; whichever the page itself has, as a host may mix templates) are the page's text. On pages without any
such element, the slots of a repeated group that holds nothing but links are menus, however many items this page has of it;
on a host with paragraphs what stands right in the body, in links or in list items is kept within or next to what holds the
page's paragraphs. The texts are taken in page order: character references decoded, white space inside a block one space,
blocks joined by one space. Pages that no wrapper matches (its shape left out, or no host to share one) are judged by the
places of their texts in the same way, and by the links that they show themselves.

Nulls and edges: a null or empty html gives an empty text. Unclosed or stray tags close where HTML says they do; very long
pages are read whole, in linear time. Pages whose url is null or names no host share no wrapper and no template; a null or
repeated page_id is a row of its own. An empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scoped, slices, written

#: Comments, elements of raw text, tags without '<' in their attributes, stretches of text; all in linear time. Other tags are for Tags.end.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!?[/A-Za-z?](?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+>|[^<]++|<", re.S | re.I)
OPENS = re.compile(r"<!?[/A-Za-z?]")
NEXT = re.compile(r"[>\"']")
TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)")
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav header footer aside form button select dialog menu script style noscript template textarea title svg iframe head".split())
# Words of class and id that say what an element is, and words that may stand beside them.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside header masthead footer cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login share sharing social related recommended recirc comment comments respond replies disqus widget widgets toolbar pagination pager copyright".split())
STRUCTURE = frozenset("site page main top bottom left right primary secondary global box block bar list links link item items container wrapper wrap inner outer section area panel row column col unit slot button buttons icons icon media form content post posts article articles entry stories reader user thread message messages text overlay right-rail rail bottom-bar js js-only x1 fixed sticky mobile desktop small large".split())
HEADED = frozenset("article articles entry entries post posts story stories content".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())


@functools.lru_cache(100_000)
def aside(marks: str) -> bool:
    """Whether an element's class, id or role says that it isn't of the article: one name of such words alone, or with words of structure and numbers beside them."""
    for name in marks.lower().split():
        words = [w for w in re.split("[-_]+", name) if w]
        if "header" in words and any(w in HEADED for w in words):  # an article's own heading
            continue
        if name in ROLES or any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in STRUCTURE or w.isdigit() for w in words):
            return True
    return False


CONTENT = re.compile(r"(?:^|\s)(?:main|article|content|(?:main|article|post|entry|story|page|body)[-_]?(?:body|content|text))(?=$|\s)", re.I)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")


class Tags:
    """Where tags end whose attributes hold '<'. What was looked at in vain is remembered, so a text full of unclosed tags is read a few times at most."""

    def __init__(self, html: str):
        self.html, self.dead, self.seen = html, set(), (0, -1)
        self.last = {c: html.rfind(c) for c in ">\"'"}

    def _special(self, at: int) -> int:
        """The first '>' or quote from here on, or -1."""
        start, found = self.seen
        if not (start <= at and (found < 0 or at <= found)) or self.seen == (0, -1):
            m = NEXT.search(self.html, at)
            self.seen = at, m.start() if m else -1
        return self.seen[1]

    def end(self, at: int) -> int:
        """Past the first '>' outside quotes, or -1."""
        passed: list[int] = []
        if at < self.last[">"]:
            at = self._special(at)
            while at >= 0 and at not in self.dead:
                c = self.html[at]
                if c == ">":
                    return at + 1
                passed.append(at)
                if self.last[c] == at:
                    break
                at = self._special(self.html.index(c, at + 1) + 1)
        self.dead.update(passed)
        return -1


def tokens(html: str) -> Iterator[tuple[str, str]]:
    """(kind, token) of a page: text, raw (comments and elements of raw text) or tag."""
    at, tags, closed = 0, None, html.rfind(">")
    while at < len(html):
        if at > closed:  # no tag ends from here on; a comment that begins takes the rest
            end = html.find("<!--", at)
            yield "text", html[at : end if end >= 0 else len(html)]
            return
        m = TOKEN.match(html, at)
        x = m[0]
        kind = "raw" if m[1] or x.startswith("<!--") else "tag" if x[0] == "<" and len(x) > 1 else "text"
        if x == "<" and OPENS.match(html, at):
            tags = tags or Tags(html)
            end = tags.end(at)
            x, kind = (html[at:end], "tag") if end >= 0 else (x, kind)
        yield kind, x
        at += len(x)


#: Open elements; what lies deeper stands right in the last of them.
DEEPEST = 512


class Page:
    """A page as tokens: (text, path) with path the open elements' names and marks; texts holds the raw text of text tokens."""

    def __init__(self, html: str):
        self.tokens: list[str] = []  # tags, and "#" for text
        self.paths: list[int] = []  # of text tokens, else -1: a place in `places`
        self.texts: list[str | None] = []
        self.blocks: list[int] = []  # the block each text is in
        self.places: list[tuple[str, ...]] = []
        known: dict[tuple[str, ...], int] = {}
        open_: list[str] = []  # "tag" or "tag.mark"
        block = 0
        for kind, x in tokens(html):
            if kind == "text":
                if not x.strip():
                    if self.texts and self.texts[-1] is not None and self.blocks[-1] == block:
                        self.texts[-1] += " "
                    continue
                path = tuple(open_)
                if path not in known:
                    known[path] = len(self.places)
                    self.places.append(path)
                self._add("#", known[path], x, block)
                continue
            t = TAG.match(x)
            if kind == "raw" or t is None:  # or a declaration
                continue
            closing, name = t[1], t[2].lower()
            if name not in INLINE:
                block += 1
            if closing:
                names = [o.partition(".")[0] for o in open_]
                if name in names:
                    self._close(open_, len(names) - 1 - names[::-1].index(name), block)
                continue
            self._close_implied(open_, name, block)
            marks = " ".join(a or b or c for a, b, c in MARK.findall(x)).replace("/", "_")
            tag = f"{name}.{SPACE.sub(' ', marks.strip())}" if marks else name
            self._add(tag, -1, None, block)
            if name not in VOID and not x.endswith("/>") and len(open_) < DEEPEST:
                open_.append(tag)

        self._close(open_, 0, block + 1)

    def _close(self, open_: list[str], at: int, block: int) -> None:
        """Ends the elements from a place on, also those that the page leaves open."""
        for tag in reversed(open_[at:]):
            self._add(f"/{tag}", -1, None, block)
        del open_[at:]

    def _add(self, token: str, path: int, text: str | None, block: int) -> None:
        self.tokens.append(token)
        self.paths.append(path)
        self.texts.append(text)
        self.blocks.append(block)

    def _close_implied(self, open_: list[str], name: str, block: int) -> None:
        if not open_:
            return
        last = open_[-1].partition(".")[0]
        while open_ and last in SELF_CLOSING.get(name, ()):
            self._close(open_, len(open_) - 1, block)
            last = open_[-1].partition(".")[0] if open_ else ""
        if name in CLOSES_P:
            names = [o.partition(".")[0] for o in open_]
            for at in range(len(names) - 1, -1, -1):
                if names[at] == "p":
                    # inline elements left open in the paragraph end with it
                    self._close(open_, at, block)
                    break
                if names[at] not in INLINE:
                    break


#: Different pages of a host that a block's text must be on, at its place, to be part of the template; and more than half of those that have the place.
LEAST = 3


def blocks(page: Page) -> list[list[int]]:
    """The text tokens of each block, in page order."""
    out: list[list[int]] = []
    last = None
    for i, (path, block) in enumerate(zip(page.paths, page.blocks)):
        if path < 0:
            continue
        if block == last:
            out[-1].append(i)
        else:
            out.append([i])
            last = block
    return out


def stands(page: Page, block: list[int]) -> tuple[str, ...]:
    """The elements that a block is in, without inline ones at the end."""
    path = page.places[page.paths[block[0]]]
    n = len(path)
    while n and path[n - 1].partition(".")[0] in INLINE:
        n -= 1
    return path[:n]


def signed(page: Page, block: list[int]) -> tuple[int, int]:
    """Hashes of a block's place, and of its place and text."""
    place = "/".join(stands(page, block))
    text = SPACE.sub(" ", "".join(page.texts[i] for i in block)).strip()
    return tuple(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in (place, f"{place}\n{text}"))


def fixed_tokens(page: Page, fixed: frozenset[int]) -> frozenset[int]:
    """The text tokens of blocks that belong to the host's template."""
    return frozenset(i for b in blocks(page) if signed(page, b)[1] in fixed for i in b) if fixed else frozenset()


# A wrapper is a list of items: ["t", token or "=" and a constant text's place], ["s", place], ["r", items] (one or more times), ["o", items] (or not at all).


NEAREST = 16  # earlier places of an item from which folding looks for a group that repeats


class Folding:
    """Items numbered as they are met, so that groups are compared as short lists of numbers."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.step: list[int] = []  # how the item changes the depth of open elements

    def of(self, *item) -> int:
        n = self.number.get(item)
        if n is None:
            n = self.number[item] = len(self.items)
            self.items.append(item)
            self.step.append(0 if item[0] != "t" or item[1][0] == "=" or item[1].partition(".")[0] in VOID else -1 if item[1][0] == "/" else 1)
        return n

    def may_repeat(self, group: list[int]) -> bool:
        """Whether it closes nothing that it doesn't open; an item by itself must be a void element."""
        if len(group) == 1:
            kind, name = self.items[group[0]]
            return kind == "t" and name.partition(".")[0] in VOID
        depth = 0
        for n in group:
            depth += self.step[n]
            if depth < 0:
                return False
        return depth == 0 or any(self.items[n][0] == "s" for n in group)

    def folded(self, items: list[int]) -> list[int]:
        """Items with neighbouring equal groups made one repeated group."""
        out: list[int] = []
        where: dict[int, list[int]] = {}  # places of each item, and of repeated groups by their last item
        for item in items:
            self._put(out, where, item)
            while self._fold(out, where):
                pass
        return out

    def _put(self, out: list[int], where: dict[int, list[int]], item: int) -> None:
        where.setdefault(item, []).append(len(out))
        if self.items[item][0] == "r":
            where.setdefault(self.items[item][1][-1], []).append(len(out))
        out.append(item)

    def _fold(self, out: list[int], where: dict[int, list[int]]) -> bool:
        n, last = len(out), out[-1]
        places = where[last]
        tried, i = 0, len(places) - 1
        while i >= 0 and tried < NEAREST:
            at = places[i]
            here = out[at] if at < n else -1
            group = self.items[here][1] if here >= 0 and self.items[here][0] == "r" else None
            if here != last and (group is None or group[-1] != last):  # folded away since
                del places[i]
                i -= 1
                continue
            i -= 1
            if at == n - 1 and here == last:
                continue
            tried += 1
            wide = n - 1 - at
            if group is not None and len(group) == wide and group == tuple(out[at + 1 :]):
                del out[at + 1 :]
                return True
            if here == last and 2 * wide <= n and out[n - wide :] == out[n - 2 * wide : n - wide] and self.may_repeat(out[n - wide :]):
                again = self.of("r", tuple(out[n - wide :]))
                del out[n - 2 * wide :]
                self._put(out, where, again)
                return True
        return False

    def written(self, items: list[int]) -> list[list]:
        return [[k, self.written(x)] if k == "r" else [k, x] for k, x in (self.items[n] for n in items)]


def same(a: list[list], b: list[list]) -> bool:
    return len(a) == len(b) and all(alike(x, y) for x, y in zip(a, b))


def alike(x: list, y: list) -> bool:
    if x[0] != y[0]:
        return False
    return same(x[1], y[1]) if x[0] in "ro" else x[1] == y[1]


@functools.lru_cache(100_000)
def transparent(tag: str) -> bool:
    """An inline element, or a line's end, without class or id."""
    return tag in INLINE or tag == "br"


Run = tuple[str, str, list[int]]  # kind (t or s), token or place, and the text tokens that it stands for


def stream(page: Page, fixed: frozenset[int] = frozenset()) -> list[Run]:
    """A page's tags and texts in order. Neighbouring texts at one place are one; a place ends with @ where all of it is linked, and begins with = where it is of the template."""
    constant = fixed_tokens(page, fixed)
    reduced = ["/".join(e for e in p if not transparent(e)) for p in page.places]
    linked = ["a" in names(p) for p in page.places]
    out: list[Run] = []
    last = None
    for i, (token, path) in enumerate(zip(page.tokens, page.paths)):
        if path < 0:
            if not transparent(token[1:] if token[0] == "/" else token):
                out.append(("t", token, []))
                last = None
            continue
        key = reduced[path], i in constant
        if key == last:
            out[-1][2].append(i)
        else:
            out.append(("t" if i in constant else "s", reduced[path], [i]))
            last = key
    return [(k, x if not own else f"={x}" if k == "t" else f"{x}@" if all(linked[page.paths[i]] for i in own) else x, own) for k, x, own in out]


def shape(page: Page, folding: Folding | None = None, fixed: frozenset[int] = frozenset()) -> list[list]:
    """A page's own expression, in which texts of the template are tokens and all others slots."""
    folding = folding or Folding()
    return folding.written(folding.folded([folding.of(k, x) for k, x, _ in stream(page, fixed)]))


def aligned(wrapper: list[list], new: list[list]) -> list[list]:
    """The wrapper widened so that it also matches the new expression: equal items are kept, repeats are joined with what they repeat, the rest becomes optional."""
    key = lambda x: x[0] + (json.dumps(_bare(x[1])) if x[0] in "ro" else x[1])
    a, b = [key(x) for x in wrapper], [key(x) for x in new]
    out: list[list] = []
    for tag, i, j, k, l in _matched(a, b):
        if tag == "equal":
            out += wrapper[i:j]
            continue
        out += _mismatch(wrapper[i:j], new[k:l])
    return out


def _bare(items: list[list]) -> list:
    return [[x[0], _bare(x[1])] if x[0] in "ro" else [x[0], x[1]] for x in items]


def _matched(a: list[str], b: list[str]):
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def _mismatch(old: list[list], new: list[list]) -> list[list]:
    if not old or not new:
        return _optional(old or new)
    # One side repeats what the other has once: r(x) against x.
    for one, other in ((old, new), (new, old)):
        if len(one) == 1 and one[0][0] == "r":
            if other[0][0] == "r" and len(other) == 1:
                return [["r", aligned(one[0][1], other[0][1])]]
            if same(one[0][1], other):
                return [one[0]]
    if len(old) == 1 and old[0][0] == "o":
        return old if same(old[0][1], new) else [["o", aligned(old[0][1], new)]]
    return _optional(old) + _optional(new)


def _optional(items: list[list]) -> list[list]:
    return [] if not items else items if len(items) == 1 and items[0][0] == "o" else [["o", items]]


def places(items: list[list]) -> set[str]:
    out: set[str] = set()
    for x in items:
        out |= places(x[1]) if x[0] in "ro" else {x[1]} if x[0] == "s" else set()
    return out


def size(items: list[list]) -> int:
    return sum(1 + size(x[1]) if x[0] in "ro" else 1 for x in items)


@functools.lru_cache(100_000)
def rank(place: str) -> int:
    """Of a slot's place: 0 in an article, 1 in a main part, 2 in the body, 3 where it isn't of the page's text."""
    path = place.removesuffix("@").split("/") if place else []
    parts = [p.partition(".")[::2] for p in path]
    within = [i for i, (tag, marks) in enumerate(parts) if tag in ("article", "main") or CONTENT.search(marks)]
    inner = parts[within[0] + 1 :] if within else parts
    outer = parts[: within[0]] if within else []
    article = any(tag == "article" for tag, _ in parts)
    # An article's own header and footer-like elements hold its heading, unless their names say otherwise; menus and the like don't.
    off = ASIDE - {"header"} if article else ASIDE
    if any(tag in ("nav", "aside", "footer", "form") for tag, _ in outer) or any(tag in off or aside(marks) for tag, marks in inner):
        return 3
    return 0 if article else 1 if within else 2


class Wrapper:
    """A host's expression as an automaton: reading nodes (token, slot, next) and forks, taken in order; a match is exact and its time linear in the page for each state that is open at once."""

    END = -1

    def __init__(self, items: list[list]):
        self.nodes: list[tuple] = []  # ("read", (kind, token), slot, next) or ("fork", first, then)
        self.slots: list[tuple[str, bool]] = []  # place of each, and whether it is of a repeated group of links alone
        self.known: dict[tuple, dict[int, int] | None] = {}
        self.open: dict[int, dict] = {}  # what may be read next, by the node that was read; filled as pages need it
        self.start = self._sequence(items, self.END, False)
        self.paragraphs = any(rank(p) == 2 and "p" in names(tuple(p.removesuffix("@").split("/"))) for p, _ in self.slots)

    def _add(self, node: tuple) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _sequence(self, items: list[list], then: int, menu: bool) -> int:
        for kind, x in reversed(items):
            if kind == "o":
                then = self._add(("fork", self._sequence(x, then, menu), then))
            elif kind == "r":
                own, fork = places(x), self._add(())
                start = self._sequence(x, fork, menu or bool(own) and all(p.endswith("@") for p in own))
                self.nodes[fork] = "fork", start, then
                then = start
            else:
                if kind == "s":
                    self.slots.append((x, menu))
                then = self._add(("read", (kind, x), len(self.slots) - 1 if kind == "s" else None, then))
        return then

    def _next(self, at: int) -> dict[tuple[str, str], list[int]]:
        """The nodes that may be read from here, by their token, the preferred ones first."""
        if at not in self.open:
            found: dict[tuple[str, str], list[int]] = {}
            stack, seen = [at], set()
            while stack:
                i = stack.pop()
                if i in seen:
                    continue
                seen.add(i)
                if i == self.END:
                    found[("end", "")] = []
                elif self.nodes[i][0] == "read":
                    found.setdefault(self.nodes[i][1], []).append(i)
                else:
                    stack += [self.nodes[i][2], self.nodes[i][1]]
            self.open[at] = found
        return self.open[at]

    def match(self, runs: list[Run]) -> dict[int, int] | None:
        """The slot that each text of a stream stands in, by their places in both; None where the whole doesn't match."""
        key = tuple([r[:2] for r in runs])
        if key not in self.known:
            if len(self.known) >= 4096:  # remembered, no more
                self.known.clear()
            self.known[key] = self._match(runs)
        return self.known[key]

    def _match(self, runs: list[Run]) -> dict[int, int] | None:
        steps: list[dict[int, int]] = []  # nodes read, with the node read before
        now = {self.END - 1: self.start}
        for kind, x, _ in runs:
            read: dict[int, int] = {}
            for before, at in now.items():
                for node in self._next(at).get((kind, x), ()):
                    read.setdefault(node, before)
            if not read:
                return None
            steps.append(read)
            now = {node: self.nodes[node][3] for node in read}
        last = next((node for node, at in now.items() if ("end", "") in self._next(at)), None)
        if last is None:
            return None
        out: dict[int, int] = {}
        for at in range(len(steps) - 1, -1, -1):
            if (slot := self.nodes[last][2]) is not None:
                out[at] = slot
            last = steps[at][last]
        return out


def names(place: tuple[str, ...]) -> list[str]:
    return [p.partition(".")[0] for p in place]


def menus(page: Page, own: list[list[int]]) -> list[list[int]]:
    """Of the body's blocks, those of links alone, two or more together: within one block, or neighbouring blocks at one place."""
    out: list[list[int]] = []
    run: list[list[int]] = []
    links = lambda b: sum("a" in names(page.places[page.paths[i]]) for i in b)
    for b in [*own, []]:
        alone = b and links(b) == len(b) and "p" not in names(stands(page, b))
        if run and not (alone and stands(page, b) == stands(page, run[-1])):
            if sum(len(r) for r in run) > 1:
                out += run
            run = []
        if alone:
            run.append(b)
    return out


def body_blocks(page: Page, own: list[list[int]], listed: set[int], paragraphs: bool) -> list[list[int]]:
    """The blocks of a page without article or main part that are its text.

    Menus are left out: what the wrapper (`listed`, text tokens) or the page itself shows as one. Where the host has
    paragraphs, what stands right in the body, in a link or in a list item is left out too, unless its list or element
    stands within, or right next to, an element that holds paragraphs of the page.
    """
    own = [b for b in own if not all(i in listed for i in b)]
    if not paragraphs:
        return own
    gone = {b[0] for b in menus(page, own)}
    holders = {place[: names(place).index("p")] for place in (page.places[page.paths[b[0]]] for b in own) if "p" in names(place)}

    def kept(b: list[int]) -> bool:
        inner = [names(page.places[page.paths[i]]) for i in b]
        if b[0] in gone:
            return False
        if not holders or any("p" in x or x and x[-1] not in ("a", "body", "html", "li") for x in inner):
            return True
        place = stands(page, b)
        lists = [i for i, n in enumerate(names(place)) if n in ("ul", "ol", "li")]
        place = place[: lists[0]] if lists else place
        return any(place[: len(q)] == q or q[:-1] == place for q in holders)

    return [b for b in own if kept(b)]


def extracted(page: Page, wrapper: Wrapper | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """The texts of the content slots of the best rank that this page has: blocks joined by one space."""
    runs = stream(page, fixed)
    matched = wrapper.match(runs) if wrapper else None
    judged: dict[int, int] = {}  # text tokens and their ranks
    listed: set[int] = set()
    for at, (kind, place, own) in enumerate(runs):
        if kind == "t":
            continue
        place, menu = wrapper.slots[matched[at]] if matched is not None else (place, False)
        judged.update(dict.fromkeys(own, rank(place)))
        if menu:
            listed.update(own)
    best = min(judged.values(), default=3)
    if best == 3:
        return ""
    own = [c for c in ([i for i in b if judged.get(i) == best] for b in blocks(page)) if c]
    if best == 2:
        seen = any(judged[i] == 2 and "p" in names(page.places[page.paths[i]]) for i in judged)
        own = body_blocks(page, own, listed, seen or matched is not None and wrapper.paragraphs)
    found = ("".join(page.texts[i] for i in b) for b in own)
    done = (SPACE.sub(" ", entities.unescape(b)).strip() for b in found)
    return " ".join(b for b in done if b)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def constants(pages: DataFrame) -> DataFrame:
    """(host, fixed): the signed blocks of each host's template, of pages (host, html). Pages with equal blocks are one page."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for html in batch.column(1).to_pylist():
                page = Page(html or "")
                pairs = {signed(page, b) for b in blocks(page)}
                found.append(np.array(sorted(pairs | {(p, 0) for p, _ in pairs}), np.int64).reshape(-1, 2))
            all_ = np.concatenate(found)
            offsets = np.cumsum([0] + [len(f) for f in found], dtype=np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(all_[:, 0]), pa.array(all_[:, 1])], ["place", "text"]))
            same = pa.array([xxhash.xxh3_64_intdigest(f.tobytes()) - (1 << 63) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, keys], ["host", "page", "keys"])

    found = pages.mapInArrow(sign, "host string, page long, keys array<struct<place:long,text:long>>")
    once = found.groupBy("host", "page").agg(F.first("keys").alias("keys")).select("host", F.explode("keys").alias("k"))
    counts = written(once.groupBy("host", "k.place", "k.text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST))
    totals = counts.where("text = 0").select("host", "place", F.col("n").alias("total"))
    return counts.where("text <> 0").join(totals, ["host", "place"]).where("2 * n > total").groupBy("host").agg(F.collect_set("text").alias("fixed"))


#: Parts of a host whose shapes are aligned by themselves first, and items that a wrapper may have.
SALTS, MOST_ITEMS = 64, 4096


def inferred(shapes: Iterator[list[list]]) -> list[list]:
    """The wrapper of shapes, aligned one by one."""
    wrapper: list[list] | None = None
    for new in shapes:
        if wrapper is None:
            wrapper = new
        elif not same(wrapper, new):
            wider = aligned(wrapper, new)
            wrapper = wider if size(wider) <= MOST_ITEMS else wrapper
    return wrapper or []


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the expression of each host, as JSON, of pages (host, html, fixed)."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen, folding = {}, Folding()
            for host, html, fixed in zip(*(c.to_pylist() for c in batch.columns)):
                key = (host, json.dumps(shape(Page(html or ""), folding, frozenset(fixed or ()))))
                seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["host", "shape", "n"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (r for batch in slices(batches) for r in zip(*(c.to_pylist() for c in batch.columns)))
        for (host, _), own in groupby(rows, key=lambda r: r[:2]):
            # Shapes stream through in order; a task holds one wrapper.
            many, wrapper = 0, None

            def counted():
                nonlocal many
                for r in own:
                    many += r[3]
                    yield json.loads(r[2])

            wrapper = inferred(counted())
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(wrapper)], pa.string()), pa.array([many], pa.int64())], ["host", "shape", "n"])

    kind = "host string, shape string, n long"
    found = pages.mapInArrow(shapes, kind).groupBy("host", "shape").agg(F.sum("n").alias("n"))
    for salt in (F.pmod(F.xxhash64("shape"), F.lit(SALTS)), F.lit(0).cast("long")):
        dealt = found.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", F.desc("n"), F.length("shape"), "shape")
        found = dealt.select("host", "salt", "shape", "n").mapInArrow(infer, kind)
    return found.select("host", F.col("shape").alias("wrapper"))


@functools.lru_cache(256)
def _read(wrapper: str) -> Wrapper:
    return Wrapper(json.loads(wrapper))


@scoped
def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)), F.lit(""))
    hosted = own.select(host.alias("host"), "html").where("host is not null")
    fixed = written(constants(hosted))
    found = written(wrappers(hosted.join(fixed, "host", "left").select("host", "html", "fixed")).join(fixed, "host", "left"))
    # A row a host, joined by it: broadcast where Spark finds it small, else a join that splits hot hosts.
    both = own.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "wrapper", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extracted(Page(h or ""), _read(w) if w else None, frozenset(f or ())) for h, w, f in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
