"""Main text of web pages by line-block distribution.

Markup is stripped first: comments, scripts, styles and the like go with what they hold, and every start or end of a block
element ends a line, so that a line without text stands between two paragraphs and two or more between containers.  A
line's length is the number of its characters outside links (headings: all); elements that HTML itself sets apart (nav,
aside, footer, form, ...), that are hidden, or whose class, id or role names a menu, notice, advert or reader comments
have length 0, and so has, on pages that mark an article or main element, all that is outside of it.

The lengths of WINDOW lines are summed at each line.  A run of lines surges where its sums reach SURGE and dives where
they are 0; on a page without such a run the longest one counts.  The text is what stands between the first surge and the
last dive, and with it what shares a container (or the marked article) with a run that surged, so that a short last
paragraph stays and a line of terms in a container of its own does not; sentences in short containers right before and
behind the text, beside its own, stay too.  Rows of links outside a marked article go.  There a line of rights
("(c) 2020 ...") has length 0, so that it stays only within the text's own container.

One page at a time, whole, in linear time; no shuffle.  Cases: a null or empty page has the text ''.  Unclosed tags,
comments and quotes, and truncated character references, are taken as browsers do, roughly: an unclosed element ends with
its parent or the page, an unclosed script or style with the page.  Repeated rows are rows like any other, empty tables
give empty results, other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, table

WINDOW = 2
SURGE = 40

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[\s/](?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)?)>"
    r"|<[!?/][^>]*>?"
    r"|<[a-z][^<>]*(?:>|\Z)",
    re.I | re.S,
)
#: What these hold is no text of the page; the first ones go on to the end of the page if they are not closed.
TO_END = frozenset("script style title textarea".split())
RAW = TO_END | frozenset("noscript template iframe svg object select canvas video audio".split())
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: A line of rights and terms, wherever it stands.
RIGHTS = re.compile(r"(?:©|\(c\)\s*\d|copyright\s*(?:©|\(c\)|\d)).{0,300}|.{0,300}all rights reserved\W*", re.I | re.S)
TERMS = re.compile(r"copyright|all rights reserved|\b(?:terms|privacy|cookies?|imprint|impressum)\b", re.I)
SENTENCE = re.compile(r".*[.!?…][\"'”’»)]*\Z", re.S)
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An end tag may be left out; the next one of the same kind ends it.
OPTIONAL = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
DROPPED = frozenset("nav aside footer form button menu dialog search label input fieldset".split())
MAIN = frozenset(["article", "main"])
#: What a line stands in, as against paragraphs, lists and tables.
CONTAINER = frozenset("address article aside body center details dialog div fieldset footer form header main nav search section".split())
#: Elements whose class, id or role may say that they are none of the text.
NAMED = CONTAINER | frozenset("ul ol dl table figure span ins amp-ad".split())
#: Parts of such names that say nothing.
GENERIC = frozenset("site page main top bottom left right primary secondary area box list wrapper bar block container section item items inner outer post entry global id".split())
#: Words of class, id or role that say what an element is.
TELLING = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts "
    "sidebar sidenav aside menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer comment comments commentlist disqus discussion discussions respond reply replies "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager "
    "widget widgets masthead topbar contentinfo complementary search skip".split()
)
#: These alone take away an article, main or body.
COMMENTS = frozenset("comment comments commentlist disqus discussion discussions respond reply replies".split())
#: Of a list in the article these say that its rows of links go, not its other lines: a menu may be what is written about.
LISTS, CARDS = frozenset("ul ol dl table".split()), frozenset("menu menus".split())
SHOWN, LINKS, GONE = 0, 1, 2


def _says(token: str, words: frozenset[str]) -> bool:
    """Whether all parts of a name are such words, apart from parts that say nothing."""
    parts = [x for x in re.split(r"[^a-z]+", token) if x and x not in GENERIC]
    return bool(parts) and all(x in words for x in parts)


def attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; the first of equal names counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _told(name: str, attrs: str, in_main: bool) -> int:
    """SHOWN, or GONE if the element is none of the main text, or LINKS if its rows of links are not."""
    if name in DROPPED or (name == "header" and not in_main):
        return GONE
    if not attrs or name in ("html", "body"):
        return SHOWN
    given = attributes(attrs)
    if "hidden" in given or NOT_SHOWN.search(given.get("style", "")):
        return GONE
    if name not in NAMED:
        return SHOWN
    tokens = [t for a in ("class", "id", "role") for t in given.get(a, "").lower().split()]
    if name in MAIN:
        return GONE if any(_says(t, COMMENTS) for t in tokens) else SHOWN
    telling = [t for t in tokens if _says(t, TELLING) or (t == "header" and not in_main)]
    if telling and in_main and name in LISTS and all(_says(t, CARDS) for t in telling):
        return LINKS
    return GONE if telling else SHOWN


class Lines:
    """The lines of a page: text, length, and what is known of the place of each."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.length: list[int] = []
        self.kept: list[bool] = []  # not known to be something else
        self.main: list[int] = []  # number of the outermost article or main element around it, 0 if none
        self.container: list[int] = []
        self.row: list[bool] = []  # a row of links
        self.around: dict[int, int] = {0: 0}  # the container around a container
        self._open: list[tuple[str, int, int, int]] = []  # name, whether shown, main, container
        self._count: Counter[str] = Counter()
        self._pieces: list[str] = []
        self._size = self._linked = self._links = self._in_link = 0
        self._elements = 0
        self._read(page)

    def _close(self) -> None:
        line = " ".join(html.unescape("".join(self._pieces)).split())
        name, gone, main, container = self._open[-1] if self._open else ("", SHOWN, 0, 0)
        heading = name[:1] == "h" and name[1:].isdigit()
        links_only = self._size > 0 and self._linked == self._size and not heading
        dropped = gone == GONE or (gone == LINKS and links_only)
        self.text.append(line)
        self.length.append(0 if dropped or not line or (not main and RIGHTS.fullmatch(line)) else len(line) if heading or not self._size else len(line) * (self._size - self._linked) // self._size)
        self.kept.append(not dropped)
        self.main.append(main)
        self.container.append(container)
        self.row.append(links_only and (self._links > 1 or name in ("li", "td", "dd", "dt", "option")))
        self._pieces.clear()
        self._size = self._linked = self._links = 0

    def _add(self, piece: str) -> None:
        if piece:
            self._pieces.append(piece)
            n = len(piece.strip())
            self._size += n
            if self._in_link:
                self._linked += n

    def _read(self, page: str) -> None:
        at, endless = 0, set()
        while True:
            m = TOKEN.search(page, at)
            if m is None:
                break
            self._add(page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if name in RAW and not m["end"] and not m["attrs"].endswith("/"):
                close = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif name in TO_END:
                    at = len(page)
                else:
                    endless.add(name)
                if name in ("title", "textarea", "select", "video", "audio", "iframe", "object", "canvas", "noscript", "template"):
                    self._close()
                continue
            if name == "a":
                self._in_link = max(0, self._in_link + (-1 if m["end"] else 1))
                self._links += not m["end"]
            if name in BLOCK:
                self._close()
            if m["end"]:
                self._end(name)
            elif name not in VOID:
                self._start(name, m["attrs"])
        self._add(page[at:])
        self._close()

    def _end(self, name: str) -> None:
        if not self._count[name]:
            return
        dropped = self._open[-1][1]
        while True:
            top = self._open.pop()
            self._count[top[0]] -= 1
            if top[0] == name:
                break
        if self._pieces and dropped != (self._open[-1][1] if self._open else SHOWN):  # an element within a line
            self._open.append(top)
            self._close()
            self._open.pop()

    def _start(self, name: str, attrs: str) -> None:
        if name in OPTIONAL and self._open and self._open[-1][0] in OPTIONAL[name]:
            self._count[self._open.pop()[0]] -= 1
        if name not in BLOCK and not (attrs.strip() and name in NAMED):
            return
        _, dropped, main, container = self._open[-1] if self._open else ("", SHOWN, 0, 0)
        new = max(dropped, _told(name, attrs, main > 0))
        if new != dropped:
            self._close()
        self._elements += 1
        if name in MAIN and new != GONE:
            main = main or self._elements
        if name in CONTAINER:
            self.around[self._elements] = container
        self._open.append((name, new, main, self._elements if name in CONTAINER else container))
        self._count[name] += 1


def runs(length: np.ndarray) -> list[tuple[int, int]]:
    """(first line, line after the last) of the runs that surge, or of the longest run."""
    sums = np.convolve(length, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]  # of the line and the WINDOW - 1 after it
    edge = np.flatnonzero(np.diff(np.concatenate(([0], sums > 0, [0]))))
    found = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    surging = [(a, b) for a, b in found if sums[a:b].max() >= SURGE]
    return surging or sorted(found, key=lambda r: (-int(length[r[0] : r[1]].sum()), r))[:1]


def beside(lines: Lines, containers: set[int], first: int, last: int) -> set[int]:
    """Lines next to the text, in short containers with the same one around them: whole sentences, up to the first line
    that is none or that speaks of rights and terms."""
    around = {lines.around[c] for c in containers}
    found: set[int] = set()
    for step in (range(last, len(lines.text)), range(first - 1, -1, -1)):
        for i in step:
            if not lines.text[i] or lines.container[i] in containers:
                continue
            if not lines.kept[i] or not lines.length[i] or lines.around.get(lines.container[i]) not in around or not SENTENCE.fullmatch(lines.text[i]) or TERMS.search(lines.text[i]):
                break
            found.add(i)
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = Lines(page)
    marked = any(m and k and x for m, k, x in zip(lines.main, lines.kept, lines.length, strict=True))
    length = np.array([n if not marked or m else 0 for n, m in zip(lines.length, lines.main, strict=True)])
    surging = runs(length)
    if not surging:
        return ""
    first, last = surging[0][0], surging[-1][1]
    inside = [i for a, b in surging for i in range(a, b) if length[i]]
    containers, mains = {lines.container[i] for i in inside}, {lines.main[i] for i in inside} - {0}

    ends = beside(lines, containers, first, last) if not marked else set()

    def stays(i: int) -> bool:
        if not lines.text[i] or not lines.kept[i] or (marked and not lines.main[i]):
            return False
        if lines.main[i] in mains:
            return True
        return not lines.row[i] and (first <= i < last or lines.container[i] in containers or i in ends)

    return " ".join(text for i, text in enumerate(lines.text) if stays(i))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_line_blocks(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
