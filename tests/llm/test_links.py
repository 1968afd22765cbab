"""Links of pages and context words of spans against plain-Python versions that share no pattern with the operators."""

import random
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import duckdb
import pytest

pytest.importorskip("daywheel.llm")
from daywheel.llm import catalog, pii, urls

URL = "http://a.test/dir/page?x=1"
PAGES = [
    '<link rel="canonical" href="/c">', "<LINK href=/c rel=canonical>", '<link rel="alternate canonical" href="/c">', '<link rel="canonical alternate" href="/c">',
    '<link title="a > b" rel="canonical" href="/c">', "<link title='rel=canonical' href='/no'>", '<link title="<link rel=canonical href=/no>" rel=next href=/n>', '<link data-rel="canonical" href="/no">',
    '<!-- <link rel="canonical" href="/no"> -->', '<!-- a --><link rel="canonical" href="/c"><!-- b -->', '<!--><link rel="canonical" href="/c">', '<script>var s = \'<link rel="canonical" href="/no">\';</script>',
    '<style>/* <link rel="canonical" href="/no"> */</style><link rel=canonical href=/c>', '<title><link rel=canonical href=/no></title>', '<textarea><link rel=canonical href=/no></textarea>',
    '<base href="http://b.test/x/"><link rel="canonical" href="c">', '<base target=_top><base href="/deep/er/"><base href="/other/"><link rel="canonical" href="c">', '<link rel="canonical" href="c"><base href="//b.test/z/y">',
    '<meta http-equiv="refresh" content="0; url=/r;v=1?q=2">', "<meta content=\"5;URL='/r s'\" http-equiv=Refresh>", '<meta http-equiv="refresh" content="0;/r">', '<meta http-equiv="refresh" content="30">', '<meta name="refresh" content="0; url=/no">',
    '<link rel="canonical" href="mailto:x@y.z">', '<link rel="canonical" href="#top">', '<link rel="canonical" href=" /c ">', '<link rel="canonical" href="?y=2&amp;z=3">', '<link rel="canonical" href="../../up/./c#f">', '<link rel="canonical" href="HTTP://C.test">',
    '<link rel="canonical" rel="next" href="/c" href="/d">', '<link rel="canonical">', "<link rel=canonical href='/c' title=\"it's > that\">", '<p title="unclosed> <link rel="canonical" href="/c">', "",
]


class Links(HTMLParser):
    """The standard library's parser, with text areas and titles taken as text."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "title")

    def __init__(self, page):
        super().__init__()
        self.page, self.base, self.found = page, None, []

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v)
        if tag == "base" and first.get("href") is not None and self.base is None:
            self.base = urljoin(self.page, first["href"].strip())
        if tag == "link" and "canonical" in (first.get("rel") or "").lower().split() and first.get("href") is not None:
            self.found.append(first["href"].strip())
        if tag == "meta" and (first.get("http-equiv") or "").lower().strip() == "refresh":
            rest = re.sub(r"^\s*[\d.]*\s*[;,]?\s*", "", first.get("content") or "")
            rest = re.sub(r"(?i)^url\s*=\s*", "", rest)
            self.found.append(rest[1:].split(rest[0])[0] if rest[:1] in ("'", '"') else rest)

    handle_startendtag = handle_starttag


def links(page, html):
    parser = Links(page)
    parser.feed(html)
    parser.close()
    out = set()
    for href in parser.found:
        if urldefrag(href)[0]:
            target = urlsplit(urldefrag(urljoin(parser.base or page, href))[0])
            if target.netloc:
                out.add(f"{target.scheme}://{target.netloc.lower()}{target.path or '/'}" + (f"?{target.query}" if target.query else ""))
    return out


#: The parser ends an unclosed quote otherwise.
PLAIN = [h for h in PAGES if "unclosed" not in h]


def test_links(spark):
    rows = [(f"http://p{i}.test/dir/page?x=1", html) for i, html in enumerate(PLAIN)]
    found = {}
    for r in urls.link_edges(spark.createDataFrame(rows, "url string, html string")).collect():
        found.setdefault(r.src, set()).add(r.dst)
    for url, html in rows:
        assert found.get(url, set()) == links(url, html), html


def test_long_markup(spark):
    """No stack is needed for many attributes, quotes or an unclosed comment."""
    pages = ["<a " + "x='1' " * 100_000 + "><link rel=canonical href=/c>", "<!--" + "-" * 500_000, "<a title=\"" + "<link rel=canonical href=/no>" * 20_000, "<script>" + "<" * 500_000 + "</script><link rel=canonical href=/c>"]
    rows = [(f"http://q{i}.test/", html + "<!-- canonical -->") for i, html in enumerate(pages)]
    got = {r.src for r in urls.link_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"http://q0.test/", "http://q3.test/"}


def test_links_of_the_sql(spark):
    """Both sides give the same verdicts on planted pages, and these follow the links."""
    rows = [(i, f"http://p{i}.test/dir/page?x=1", html.replace("/c", "http://shop.com/de/1")) for i, html in enumerate(PLAIN)]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = {r[0]: r[1] for r in con.sql(f"SELECT page_id, verdict FROM ({catalog.OP9_SQL})").fetchall()}
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want == {i: "block" if any(x.startswith("http://shop.com/de/") for x in links(url, html)) else "allow" for i, url, html in rows}
    assert set(got.values()) == {"allow", "block"}


def test_context_words(spark):
    """Words are cut out by hand, letter by letter."""
    key, rnd = "a1" * 16, random.Random(1)
    texts = ["ipsum 1.2.3.4", "ip 1.2.3.4", f"keyboard {key}", f"api_key={key}", f"apiary {key}", "zzzzzzkey" + "-" * 45 + key, "x key" + "-" * 45 + key, "x key" + "-" * 46 + key, "servers: 1.2.3.4", "1.2.3.4" + " " * 44 + "host", "1.2.3.4" + " " * 45 + "host", "1.2.3.4" + " " * 44 + "hostile", "1.2.3.4host", f"clé {key}", f"éip 1.2.3.4 {key}"]
    texts += ["".join(rnd.choice(["ip", "host", "key", "token", "mail", " ", " ", "-", "é", "x", "_", "1.2.3.4", key, "a@b.cc", "s", "\n"]) for _ in range(40)) for _ in range(300)]
    found = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "pii").collect()

    def words(text, low, high):
        """Whole runs of letters and digits within [low, high)."""
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end].isalnum():
                end += 1
            if end > at and low <= at and end <= high:
                yield text[at:end].translate(str.maketrans(catalog.UPPER, catalog.LOWER))
            at = max(end, at + 1)

    for r in found:
        text = texts[r.doc_id]
        for span in r.pii:
            near = {w for low, high in ((span.start - 48, span.start), (span.end, span.end + 48)) for w in words(text, low, high)}
            known = {w + s for w in pii.WORDS[span.kind].split("|") for s in ("", "s")}
            score, gain = pii.SCORES[span.kind]
            assert span.score == pytest.approx(score + gain * bool(near & known)), (text, span)
        if r.doc_id < 15:
            assert ("secret" in {s.kind for s in r.pii}) == (r.doc_id in (3, 6)), text


def test_many_mails(spark):
    text = " ".join(f"u{i}@example.com" for i in range(20_000))
    [row] = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("pii").collect()
    assert [(s.start, s.end) for s in row.pii] == [m.span() for m in re.finditer(r"\S+", text)]
