"""Career pages against the parser of the standard library, on all given pages, and on malformed ones by hand."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera.functions import boards


class Plain(HTMLParser):
    """Strings, links and first title and heading of well-formed pages whose links are not nested."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.strings, self.links, self.firsts, self.hidden, self.link, self.within = [], [], {}, 0, None, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in boards.RAW
        if tag == "a" and dict(attrs).get("href") is not None:
            self.link = [dict(attrs)["href"], []]
        if tag in ("h1", "title") and tag not in self.firsts:
            self.firsts[tag] = []
            self.within.append(tag)

    def handle_endtag(self, tag):
        self.hidden -= tag in boards.RAW
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(" ".join(self.link[1]).split())[:120]))
            self.link = None
        if tag in self.within:
            self.within.remove(tag)

    def handle_data(self, data):
        if self.hidden or not data.strip():
            return
        self.strings.append(data.strip())
        if self.link:
            self.link[1].append(data)
        for tag in self.within:
            self.firsts[tag].append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages_equal_the_standard_parser(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "html", boards.parsed(F.col("html")).alias("r")).collect()
    assert pages
    for p in pages:
        plain = Plain()
        plain.feed(p["html"] or "")
        plain.close()
        flat = " ".join(" ".join(plain.strings).split())
        assert p["r"]["head"] == " ".join(plain.strings)[:6000], p["page_id"]
        assert p["r"]["excerpt"] == (flat[:400].rstrip() + "..." if len(flat) > 400 else flat)
        names = [" ".join(" ".join(plain.firsts.get(t, [])).split()) for t in ("h1", "title")]
        assert p["r"]["title"] == (names[0] or names[1] or None)
        want = {}
        for href, label in plain.links:
            if label:
                want.setdefault(href, label)
        assert [(x["href"], x["label"]) for x in p["r"]["links"]] == list(want.items())


def test_malformed_pages():
    links = lambda h: [(x["href"], x["label"]) for x in boards.read_page(h)["links"]]
    assert links("<A HREF='/a?x=1&amp;y=2'>B&eacute;&#x21;&hellip;</A>") == [("/a?x=1&y=2", "Bé!…")]
    assert links('<a title="a > b" href=/jobs/>one</a><a href="/b"/>two<a name=x>three</a>') == [("/jobs/", "one")]
    assert links('<a href="/o">out <a href="/i">in</a> end</a>') == [("/o", "out in end"), ("/i", "in")]
    assert links('<p><a href="/a">open <b>bold</p> behind<!-- <a href="/no">no</a> --><script>"<a href=/s>s</a>"</script>') == [("/a", "open bold")]
    assert links('</a></p><a href="/a">one</i></a><a href="/a">again</a><a href="/e"> <img src="x"> </a><a href="/cut">cut') == [("/a", "one"), ("/cut", "cut")]
    assert links("<a href='/n' href='/last'>it's</a> 1 < 2 <a href=\"/never closed>x</a>") == [("/last", "it's"), ('"/never', "x")]
    page = boards.read_page("<title> T </title><h1> </h1><style>p{}</style>x<br>y &lt;b&gt; <h1>second</h1>")
    assert (page["title"], page["excerpt"]) == ("T", "T x y <b> second")
    assert boards.read_page("") == {"title": None, "head": "", "excerpt": "", "links": []}


def test_null_pages(spark):
    got = spark.createDataFrame([(None,), ("",)], "h string").select(boards.page(F.col("h")).alias("p")).collect()
    assert [tuple(r["p"])[2:] for r in got] == [(None, None), ("", [])]


@pytest.mark.parametrize("piece", ["<", "<!--", '<a href="', "<a ", "</a", "&", "<![CDATA[", "<title>", "<a b=", '<a href="/x">y', "<script>", "<b>", "a=", " "])
def test_time_is_linear(piece):
    start = time.process_time()
    boards.read_page(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 10


def test_any_text_is_read():
    rnd = random.Random(2)
    bits = ["<a", " href", "=", '"', "'", "/x", ">", "</a", "<", "!--", "-->", "<script", "</script>", "&amp;", "t", " ", "<h1>", "</h1>", "<br/>", "</p>"]
    for _ in range(5000):
        boards.read_page("".join(rnd.choices(bits, k=30)))
