import random
import time

import numpy as np
from pyspark.sql import Row

from lockstep.llm.html_extract import SURGE, WINDOW, extract, main_text, runs

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>the tag line of this site</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to track you, dear reader</div>
%s<h1>Title</h1><p>First para with <b>bo</b>ld text&nbsp;and a <a href="a>b">link</a> &amp; more.</p><!-- x > y --><div class="ad">Buy this now</div>
<ul><li>one<li>two</ul><script>if (a</p>b) {}</script><p>Second,
   with   space.</p><section id="comments"><h2>Comments</h2><p>Nice article, dear author, thank you</p></section>%s
<aside>Side bar text that is long enough to be a line</aside><form>Email <input> <button>Go</button></form><div hidden>secret text</div><footer>&copy; me</footer></body></html>"""
TEXT = "Title First para with bold text and a link & more. one two Second, with space."


def test_article_with_and_without_its_element():
    assert main_text(PAGE % ("<article>", "</article>")) == TEXT
    assert main_text(PAGE % ("<main><div>", "</div></main>")) == TEXT
    assert main_text(PAGE % ("<div class='content'>", "</div>")) == TEXT


def test_broken_and_odd_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<nav>only</nav>") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<article><h1>A &am</h1><p><b>B<br><p>C</article>") == "A &am B C"
    assert main_text("<article><p>unclosed <!-- comment") == "unclosed"
    assert main_text("<article><p>a &#233; &eacute;&lt;p&gt;") == "a é é<p>"
    assert main_text("<p>" + "word " * 100_000).count("word") == 100_000
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def plain_runs(length):
    """Stretches whose windows hold any text, by loops; those with a window of SURGE, or the longest."""
    sums = [sum(length[i : i + WINDOW]) for i in range(len(length))]
    found, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            found.append((start, i))
            start = None
    surging = [r for r in found if max(sums[r[0] : r[1]]) >= SURGE]
    return surging or sorted(found, key=lambda r: -sum(length[r[0] : r[1]]))[:1]


def test_runs_against_plain_loops():
    rng = random.Random(1)
    for _ in range(300):
        length = [rng.choice([0, 0, 0, 3, 12, 25, 60]) for _ in range(rng.randrange(1, 30))]
        assert runs(np.array(length)) == plain_runs(length)


PARAGRAPH = "Some words of the text that go on for a while, as they do. "


def test_names_that_say_nothing():
    """Surge and dive alone leave out a menu, a tag line and terms in containers of their own."""
    page = (
        "<html><head><title>T</title><body><div class=xq><a href=1>Home</a> <a href=2>News</a></div><div class=k><p>All about it</p></div>"
        f"<div class=aa><h1><a href=x>The Title</a></h1><p>{PARAGRAPH}</p><ul><li>one<li>two</ul><p>The end.</p></div><div class=zz>Copyright 2020. Terms</div></body></html>"
    )
    assert main_text(page) == f"The Title {PARAGRAPH}one two The end."


def test_nothing_inside_the_article_goes():
    page = f"<article><p>{PARAGRAPH}</p><div class=advert>a<br>b<br>c</div><p>The end.</p><section class='related-work'><p class=alert>Mind <math><mi>x</mi></math>.</p></section><p><a href=1>More</a></p></article>"
    assert main_text(page) == f"{PARAGRAPH}The end. Mind x. More"
    assert main_text(f"<head><meta charset=x><body><div class='content-sidebar-wrap'><p>{PARAGRAPH}<video-js>on</video-js></p></div>") == f"{PARAGRAPH}on"
    assert main_text(f"<p>{PARAGRAPH}<video>no end") == f"{PARAGRAPH}no end"


def test_attributes_are_read_by_name():
    assert main_text(f'<article data-title="The hidden cost of x"><p>{PARAGRAPH}</p><p title="a hidden gem">Too.</p><p hidden>no</p><p HIDDEN="">no</p><p style="color:red; Display : none">no</p></article>') == f"{PARAGRAPH}Too."
    assert main_text(f"<div class=x title='display:none hidden'><p>{PARAGRAPH}</p></div>") == PARAGRAPH.strip()


def test_short_last_container_stays():
    assert main_text(f"<div><p>{PARAGRAPH}</p></div><div><p>The end of it.</p></div>") == f"{PARAGRAPH}The end of it."
    assert main_text(f"<div><p>{PARAGRAPH}</p></div><div><p>The end of it.</p></div><div>Read our terms.</div><div>And so on.</div>") == f"{PARAGRAPH}The end of it."
    assert main_text(f"<div><p>{PARAGRAPH}</p></div><div><a href=x>More of this.</a></div><div>Back to top</div><div>So there.</div>") == PARAGRAPH.strip()


def test_discussions_rights_and_menus():
    assert main_text(f"<main><p>{PARAGRAPH}</p><div id='discussion'><article>{PARAGRAPH}</article></div></main>") == PARAGRAPH.strip()
    rights = "© 2020 by the owners of this site and all of their friends. All rights reserved."
    assert main_text(f"<article><p>{PARAGRAPH}</p></article><div class=qq>{rights}</div>") == PARAGRAPH.strip()
    assert main_text(f"<div class=a><p>{PARAGRAPH}</p></div><div class=qq>{rights}</div>") == PARAGRAPH.strip()
    assert main_text(f"<article><p>{PARAGRAPH}</p><p>Copyright law is old.</p></article>") == f"{PARAGRAPH}Copyright law is old."
    assert main_text(f"<article><p>{PARAGRAPH}</p><ul class='menu'><li>Soup, 3 euros<li>Fish, 9 euros</ul></article>") == f"{PARAGRAPH}Soup, 3 euros Fish, 9 euros"
    assert main_text(f"<article><p>{PARAGRAPH}</p><ul class='menu'><li><a href=1>Home</a><li><a href=2>News</a></ul></article>") == PARAGRAPH.strip()


class PlainLines:
    """The lines of well-formed pages of div, p, ul, li and a, by a parser of the standard library and plain recursion."""

    def __new__(cls, page):
        from html.parser import HTMLParser

        rows = []  # text, container path, whether all of it is links

        class Parser(HTMLParser):
            path, pieces, link, linked = [0], [], False, True
            count = 0

            def flush(self):
                text = " ".join("".join(self.pieces).split())
                rows.append((text, tuple(self.path), bool(text) and self.linked))
                self.pieces, self.linked = [], True

            def handle_starttag(self, tag, attrs):
                if tag == "a":
                    self.link = True
                    return
                self.flush()
                if tag == "div":
                    Parser.count += 1
                    self.path = [*self.path, Parser.count]

            def handle_endtag(self, tag):
                if tag == "a":
                    self.link = False
                    return
                self.flush()
                if tag == "div":
                    self.path = self.path[:-1]

            def handle_data(self, data):
                self.pieces.append(data)
                if data.strip() and not self.link:
                    self.linked = False

        parser = Parser()
        parser.feed(page)
        parser.flush()
        return rows


def plain_text(page):
    """The choice of lines by its definition."""
    rows = PlainLines(page)
    length = [0 if links else len(text) for text, _, links in rows]
    found = plain_runs(length)
    if not found or not any(length):
        return ""
    first, last = found[0][0], found[-1][1]
    own = {rows[i][1] for a, b in found for i in range(a, b) if length[i]}
    stay = {i for i, (text, path, links) in enumerate(rows) if text and not links and (first <= i < last or path in own)}
    for side in (range(last, len(rows)), range(first - 1, -1, -1)):
        for i in side:
            text, path, links = rows[i]
            if not text or path in own:
                continue
            if links or len(path) < 2 or path[:-1] not in {p[:-1] for p in own} or text[-1] not in ".!?" or "terms" in text.lower():
                break
            stay.add(i)
    return " ".join(rows[i][0] for i in sorted(stay))


def test_choice_of_lines_against_a_plain_version():
    rng = random.Random(7)
    words = ["A long enough sentence of some twenty words or so, which is text.", "Short one.", "Home", "Our terms.", "label", "Yes!"]

    def block(depth):
        kind = rng.choice(["p", "p", "ul", "a", "div"] if depth < 3 else ["p"])
        if kind == "p":
            return f"<p>{rng.choice(words)}</p>"
        if kind == "a":
            return "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{rng.choice(words)}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>"
        return "<div>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 4))) + "</div>"

    for _ in range(400):
        page = "<div>" + "".join(block(1) for _ in range(rng.randrange(1, 6))) + "</div>"
        assert main_text(page) == plain_text(page), page


def test_time_is_linear():
    began = time.process_time()
    for page in ("<a b " * 20_000, "<div>" * 20_000 + "</x>" * 20_000, "<svg>" * 20_000, "<!--" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, '<a "' * 20_000):
        main_text(page)
    assert time.process_time() - began < 20


def test_query(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [Row(page_id=1, url="u", html=PAGE % ("<article>", "</article>"), text=1, n_chars="x"), Row(page_id=None, url=None, html=None, text=None, n_chars=None)]
    got = extract(spark.createDataFrame(rows * 2, schema)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "u", TEXT, len(TEXT)), (None, None, "", 0)] * 2, key=str)
    assert extract(spark.createDataFrame([], schema)).count() == 0
