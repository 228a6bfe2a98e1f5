"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks of text. A classifier of shallow features (words, sentence marks, share of link text,
the block's tag, and what its ancestors are and are called) gives each block log-odds of being content: its capacity from the
source (content) where they are positive, to the sink (boilerplate) where they are negative. Smoothness edges
join neighbours in page order and blocks of one DOM parent, stronger the nearer they are in the DOM, and of the size of
what text alone tells: a short line among paragraphs goes with them, a short sentence among links with those. The minimum
cut, found by max-flow, labels all blocks at once.

Broken mark-up is read as browsers mostly do: a block-level tag ends an open paragraph, an
end tag closes up to its start tag and is ignored without one, quotes count after an equals sign only, and what is nested deeper than DEPTH
elements is read as if it lay at that depth. Reading takes time in proportion to the page; the cut has as many rounds as
capacities (multiples of STEP / 2) allow, whatever the page's length.

Null and empty pages have empty text; so have pages without text. Very long pages are read whole, in memory for one batch. Repeated rows give equal results, and a
block that ties is boilerplate. Columns to keep may have any name but text and n_chars. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from functools import cache
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tune

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>=]")
VALUE = re.compile(r"\s*([\"'])")
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"']*)(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
#: Elements whose text is not shown, or not as text; a foreign one may close itself.
RAW = frozenset("script style title textarea noscript template iframe canvas xmp annotation annotation-xml desc metadata defs".split())
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img tspan math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mfenced mmultiscripts mprescripts none".split())
#: Elements that are never content, and those that are not but for an article or main element within them.
NEVER = frozenset("head nav footer aside button select option menu dialog fieldset".split())
WRAPS = frozenset("form header".split())
CONTENT = frozenset("article main".split())
BAD_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination partner partners popup promo promoted promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: Names of what readers write.
READERS = frozenset("comment comments discussion disqus feedback replies reply".split())
#: Running text: a block of so many words, most of them no links. A name says nothing of an element that holds MOST times as much of it as the rest of the page.
RUNNING, MOST = 8, 3
NAMES = re.compile(r"[a-z]+")
DEPTH = 512

#: Log-odds of content. By words: PER_WORD * log(1 + words) + ALONE, at most LONG.
PER_WORD, ALONE, LONG = 0.9, -1.2, 2.5
SENTENCE, LINKED = 0.5, -3.0
TAGS = {t: 0.7 for t in "p blockquote pre h1 h2 h3 h4 h5 h6".split()} | {t: 0.0 for t in "li dt dd td th caption figcaption text".split()} | {"label": -1.0, "legend": -1.0}
PLAIN = -0.3
#: By ancestors: an article or main element, names, elements that are never content, and lying outside of the page's article.
INSIDE, GOOD, BAD, SURE, OUTSIDE = 4.0, 1.5, -10.0, -12.0, -8.0
#: A copyright mark; links in an article's header; any block of a form that holds most of the page.
RIGHTS, HEADLINKS, FORM = -3.0, -3.0, -1.0
#: Smoothness between neighbours in page order, lessened by their distance in the DOM, and between blocks of one parent.
NEXT_EDGE, PARENT_EDGE, STEP = 1.2, 0.6, 0.05


class Block:
    """A run of text: its container (a number), the container's tag, link share, and the marks of its ancestors. badly: those with a bad name; bad: how many of them count."""

    __slots__ = ("text", "node", "tag", "linked", "badly", "bad", "good", "sure", "inside", "form", "head")

    def __init__(self, text, node, tag, linked, badly, good, sure, inside, form, head):
        self.text, self.node, self.tag, self.linked = text, node, tag, linked
        self.badly, self.bad, self.good, self.sure, self.inside, self.form, self.head = badly, len(badly), good, sure, inside, form, head

    def running(self) -> int:
        words = self.text.count(" ") + 1
        return words if words >= RUNNING and self.linked < 0.5 and not self.sure else 0


#: bad (elements, by number), good, sure, inside, wrapped (1 in a header, 2 in a form), gone (not shown), head (in a header within an article).
ROOT = ((), 0, False, False, 0, False, False)


def _marks(tag: str, attributes: str, above: tuple, readers: list[bool]) -> tuple:
    """The marks of an element, given its parent's. readers: of each element with a bad name, whether it says that readers wrote there."""
    bad, good, sure, inside, wrapped, gone, head = above
    if tag in NEVER:
        sure = True
    if tag == "form":
        wrapped = wrapped or 2
    if tag == "header":
        wrapped, head = (wrapped, True) if inside else (1, head)
    if tag in CONTENT:
        good, inside, wrapped, head = good + 1, True, 0, False
    if attributes:
        known = {tag} if tag in WRAPS and not inside else set()  # a form called form is no worse than a form
        for a in ATTRIBUTE.findall(attributes):
            names = set(NAMES.findall(a.lower()))
            if (found := names & BAD_WORDS - known) and tag not in ("html", "body") and tag not in CONTENT:
                bad = (*bad, len(readers))
                readers.append(not found.isdisjoint(READERS))
            elif names & GOOD_WORDS:
                good += 1
        gone = gone or HIDDEN.search(attributes) is not None
    return bad, good, sure, inside, wrapped, gone, head


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


class _Tokens:
    """Tags of a page in order: (text before, tag in lower case or "", what stands in it, whether it ends an element, whether it closes itself)."""

    def __init__(self, html: str):
        self.html, self.at = html, 0

    def skip(self, end: re.Pattern) -> None:
        """Leave out all up to an end tag, or the rest of the page."""
        m = end.search(self.html, self.at)
        self.at = m.end() if m else len(self.html)

    def __iter__(self):
        html, quotes = self.html, True
        look = self.at
        while (i := html.find("<", max(look, self.at))) >= 0:
            ends = html.startswith("/", i + 1)
            m = NAME.match(html, i + 1 + ends)
            if m is None and not html.startswith(("!", "?"), i + 1):
                look = i + 1
                continue
            if html.startswith("<!--", i):
                stop = html.find("-->", i + 2 if html.startswith(("<!-->", "<!--->"), i) else i + 4)
                stop = len(html) if stop < 0 else stop + 2
            else:
                stop = _tag_end(html, m.end()) if m and quotes else -1
                if stop < 0:
                    # After a quote that never ends, quotes count no more.
                    quotes, stop = quotes and m is None, html.find(">", i)
                    if stop < 0:
                        break
            before, self.at = html[self.at : i], stop + 1
            inside = html[m.end() : stop] if m else ""
            yield before, m[0].lower() if m else "", inside, ends, inside.endswith("/")
        yield html[self.at :], "", "", False, False


def _tag_end(html: str, at: int) -> int:
    """Where a tag's > is, -1 without one: quotes count after an equals sign."""
    while (m := STOP.search(html, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = m.end()
        if q := VALUE.match(html, at):
            at = html.find(q[1], q.end()) + 1
            if not at:
                return -1
    return -1


class Reader:
    """Blocks of a page, and the tree of their containers: parent and depth of each."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.readers: list[bool] = []
        self.parent, self.depth = [-1], [0]
        self.stack: list[tuple] = [("", 0, ROOT)]
        self.pieces: list[str] = []
        self.linked = self.links = self.foreign = 0
        self.open: Counter[str] = Counter()
        self.deep: Counter[str] = Counter()
        steps = _Tokens(html)
        for before, tag, inside, ends, own in steps:
            self._add(before)
            if not tag:
                continue
            if ends:
                self._end(tag)
            elif tag in RAW:
                if not (own and self.foreign):
                    steps.skip(_end_of(tag))
            else:
                self._start(tag, inside, own)
        self._flush()
        self._weigh()

    def _weigh(self) -> None:
        """Names do not count against elements that hold most of the page's running text: those are its frame. Where readers write that is so only if there is no other."""
        held, total = [0] * len(self.readers), 0
        for b in self.blocks:
            words = b.running()
            total += words
            for e in b.badly:
                held[e] += words
        frame = {e for e, n in enumerate(held) if n and (n == total if self.readers[e] else n >= MOST * (total - n))}
        if frame:
            for b in self.blocks:
                b.bad = sum(e not in frame for e in b.badly)

    def _add(self, raw: str) -> None:
        if raw and not self.stack[-1][2][5]:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.links:
                self.linked += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces.clear()
        if text:
            tag, node, marks = next(x for x in reversed(self.stack) if x[0] not in INLINE)
            bad, good, sure, inside, wrapped, _, head = marks
            self.blocks.append(Block(text, node, tag, self.linked / len(text), bad, good, sure or wrapped > 0, inside, not sure and wrapped == 2, head))
        self.linked = 0

    def _pop(self, i: int) -> None:
        for tag, _, _ in self.stack[i:]:
            self.open[tag] -= 1
            self.links -= tag == "a"
            self.foreign -= tag in FOREIGN
        del self.stack[i:]

    def _start(self, tag: str, inside: str, own: bool) -> None:
        if tag not in INLINE:
            self._flush()
            # A block-level start tag ends an open paragraph, and what is open within it.
            if tag not in VOID:
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i][0] == "p" or tag == "li" == self.stack[i][0]:
                        self._pop(i)
                        break
                    if self.stack[i][0] not in INLINE:
                        break
        if tag in VOID or own and self.foreign:
            return
        if len(self.stack) > DEPTH:
            self.deep[tag] += 1
            return
        self.open[tag] += 1
        self.links += tag == "a"
        self.foreign += tag in FOREIGN
        top = self.stack[-1]
        node = top[1]
        if tag not in INLINE:
            node = len(self.parent)
            self.parent.append(top[1])
            self.depth.append(self.depth[top[1]] + 1)
        self.stack.append((tag, node, _marks(tag, inside, top[2], self.readers)))

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self.deep[tag]:
            self.deep[tag] -= 1
        elif self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    break
                if tag in INLINE and self.stack[i][0] not in INLINE:
                    break

    def apart(self, a: int, b: int) -> int:
        """Steps in the tree from one container to another."""
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def log_odds(b: Block, has_main: bool) -> float:
    """How much speaks for content: never 0, an odd multiple of STEP / 2."""
    words = b.text.count(" ") + 1
    score = min(LONG, PER_WORD * log1p(words) + ALONE) + LINKED * b.linked + TAGS.get(b.tag, PLAIN)
    score += SENTENCE * (b.text[-1] in ".!?:;\u2026\u3002\u201d\"") + RIGHTS * ("\u00a9" in b.text) + FORM * b.form
    score += INSIDE * b.inside + GOOD * min(b.good - b.inside, 2) * (not b.bad) + BAD * min(b.bad, 2) + SURE * b.sure
    if b.head and b.linked > 0.5:
        score += HEADLINKS
    if has_main and not b.good:
        score += OUTSIDE
    return (score // STEP + 0.5) * STEP


def edges(page: Reader) -> list[tuple[int, int, float]]:
    out, last, found = [], {}, page.blocks
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, NEXT_EDGE / (1 + page.apart(b.node, found[i - 1].node) / 2)))
        parent = page.parent[b.node]
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, PARENT_EDGE))
        last[parent] = i
    return out


def min_cut(terminals: list[tuple[float, float]], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side. Shortest augmenting paths, blocked in levels."""
    n = len(terminals)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a, b, ab, ba):
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    for i, (s, t) in enumerate(terminals):  # what flows straight through a node is left out
        if s > t:
            link(source, i, s - t, 0.0)
        elif t > s:
            link(i, sink, t - s, 0.0)
    for a, b, w in joined:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in heads[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[x] < len(heads[x]):
                e = heads[x][turn[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            else:
                if x == source:
                    break
                x = to[path.pop() ^ 1]
                turn[x] += 1
                continue
            path.append(e)
            x = to[e]


def labels(page: Reader, smooth: bool = True) -> list[bool]:
    """Which blocks are content; smooth: with the edges, else by their own log-odds alone."""
    found = page.blocks
    forms = [b for b in found if b.form]
    # A form around most of the page's text is a plain container: many pages are wrapped in one.
    if 2 * sum(len(b.text) for b in forms) > sum(len(b.text) for b in found if not b.sure or b.form):
        for b in forms:
            b.sure = False
    has_main = any(b.good and not b.sure and not b.bad for b in found)
    odds = [log_odds(b, has_main) for b in found]
    return min_cut([(max(x, 0.0), max(-x, 0.0)) for x in odds], edges(page) if smooth else [])


def main_text(html: str | None) -> str:
    """The page's content blocks, joined by one space."""
    page = Reader(html or "")
    return " ".join(b.text for b, keep in zip(page.blocks, labels(page), strict=True) if keep)


def _extract(batches):
    for batch in batches:
        text = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, text and n_chars (code points) of each page."""
    tune(pages.sparkSession)
    src = pages.select(*keep, "html")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return src.mapInArrow(_extract, schema)
