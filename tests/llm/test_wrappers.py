"""Wrapper induction: the text comes from slots, with or without telling tags and classes."""

import re
from html.parser import HTMLParser

from textloom.llm import html_extract as H
from textloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


class Plain(HTMLParser):
    """The blocks of the article element, by another parser; the given pages mark it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.now, self.out = False, "", []

    def flush(self):
        if text := " ".join(self.now.split()):
            self.out.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("article", "h1", "p", "br"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.flush()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now += data


def plain(page):
    one = Plain()
    one.feed(page or "")
    one.close()
    one.flush()
    return "\n".join(one.out)


def bare(page):
    """The page without article tags and classes."""
    return re.sub(r"</?article[^>]*>", "", re.sub(r'\s(?:class|id|role)="[^"]*"', "", page or ""))


def test_given_pages_against_another_parser(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op8_wrapper_induction"](spark, SF).collect()}
    want = {r.page_id: plain(r.html) for r in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_slots_tell_the_text_without_tags_and_classes(spark):
    """Pages of hosts that have a wrapper give the same text when nothing marks the article."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    hosts = {}
    for r in rows:
        hosts.setdefault(re.sub("^[^:]*://([^/?#]*).*$", r"\1", r.url or "").lower(), set()).add(r.html)
    stripped = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extracted(stripped).collect()}
    some = [r for r in rows if len(hosts[re.sub("^[^:]*://([^/?#]*).*$", r"\1", r.url or "").lower()]) >= H.LEAST_PAGES]
    assert len(some) > 150 and all(got[r.page_id] == plain(r.html) for r in some)


MENU = "<div><a href=/1>Home {0}</a> <a href=/2>News {0}</a></div>"


def pages(body, n=6):
    return [body.format(f"w{i}", " ".join(f"t{i}x{j}" for j in range(40))) for i in range(n)]


def told(body, n=6):
    made = pages(body, n)
    return H.extract(made[-1], H.induce(made)).split("\n")


LONG = " ".join(f"t5x{j}" for j in range(40))


def test_constant_text_of_an_article_stays():
    body = MENU + "<article><h1>Title {0}</h1><h2>Summary</h2><p>{1}</p><p>This is opinion.</p></article><div>Printed by Example House</div>"
    assert told(body) == ["Title w5", "Summary", LONG, "This is opinion."]
    inner = MENU + "<div><h1>Title {0}</h1><h2>Summary</h2><p>{1}</p><h3>Sources</h3><p>{0} and others</p></div><div>Printed by Example House</div>"
    assert told(inner) == ["Title w5", "Summary", LONG, "Sources", "w5 and others"]


def test_an_article_of_links_keeps_its_list():
    body = "<nav><a href=/1>Home</a></nav><article><h1>Best of {0}</h1><p>{1}</p><ul>" + "".join(f"<li><a href=/{i}>link {{0}} {i} to read</a></li>" for i in range(30)) + "</ul></article>"
    assert told(body) == ["Best of w5", LONG, *(f"link w5 {i} to read" for i in range(30))]


def test_headline_before_and_text_after_stay_and_the_rest_goes():
    body = MENU + "<h1>Title {0}</h1><p>Lead of {0}</p><article><p>{1}</p></article><p>Update by {0}</p><article><a href=/x>More {0}</a> teaser</article><div class=c-list><div><b>ann {0}</b> nice</div><div><b>bob {0}</b> no</div></div><div>Copyright {0} house</div>"
    assert told(body) == ["Title w5", "Lead of w5", LONG, "Update by w5"]
    assert H.extract(pages(body)[-1].replace("Copyright w5 house", ""), None).split("\n") == ["Title w5", "Lead of w5", LONG, "Update by w5"]


def test_a_form_around_everything_is_no_form():
    body = "<form>" + MENU + "<div><h1>Title {0}</h1><p>{1}</p></div><div>Ask {0} us</div></form>"
    assert told(body) == ["Title w5", LONG]


def test_ordinary_words_as_classes_of_single_pages():
    assert H.extract("<article><p>One.</p><p class='reply'>He replied.</p><div class='market share'>Up.</div><div class='share'>Tell a friend</div></article>", None) == "One.\nHe replied.\nUp."


def test_a_page_without_the_wrappers_content_has_its_own():
    wrapper = H.induce(pages(MENU + "<div><div><h1>Title {0}</h1><p>{1}</p></div></div>"))
    assert H.extract("<p>Not found</p>", wrapper) == "Not found"
    assert H.extract("", wrapper) == ""
