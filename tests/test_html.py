"""HTML to Markdown: tokens against the standard library's parser on random
markup, hand-written pages with nested and broken markup, awkward rows."""

import random
from html.parser import HTMLParser

import pytest

from riskloom.operators import html as h


class Events(HTMLParser):
    """Tokens by the standard library; contents of raw elements left out."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.raw = [], None

    def handle_starttag(self, tag, attrs):
        if self.raw is None:
            self.out.append(("open", tag, dict(attrs).get("href", "")))
            if tag in ("script", "style"):
                self.raw = tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.raw in (None, tag):
            self.raw = None
            self.out.append(("close", tag, ""))

    def _text(self, text):
        if self.raw is None:
            self.out.append(("text", "", text))

    handle_data = _text

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")


def merged(events):
    out = []
    for kind, name, rest in events:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", "", out[-1][2] + rest)
        elif kind != "text" or rest:
            out.append((kind, name, rest))
    return out


def page(rng):
    parts = ["<p>", "</p>", "<b>", "</b>", "<div class='x > y'>", "</div>", '<a href="/a?x=1&amp;y>2">', "</a>", "text ", "a &lt; b ", "&#169; ", "<!-- no <b> here -->", "<br/>",
             "<script>if (a < b) { '</p>' }</script>", "<style>p > b {}</style>", "<ul>", "<li>", "</li>", "</ul>", "<!DOCTYPE html>", "<H1 ID=t>", "</H1>", "3 < 4 ", "\n", "<img src=a.png alt='it\"s'>"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_tokens_are_the_parsers():
    rng = random.Random(9)
    for _ in range(1500):
        p = page(rng)
        parser = Events()
        parser.feed(p)
        parser.close()
        mine = [(kind, name, h.attribute(rest, "href") if kind == "open" else rest) for kind, name, rest in h.tokens(p)]
        assert merged(mine) == merged(parser.out), p


PAGES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<h2>Head <i>two</i></h2><p>one<p>two", "## Head *two*\n\none\n\ntwo"),
    ("<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>after", "- a\n  - b\n  - c\n- d\n\nafter"),
    ("<ol><li>a<li>b<ul><li>x</ul><li>c</ol>", "1. a\n2. b\n  - x\n3. c"),
    ('<a href="/x?a=1&amp;b=2">go <b>now</b></a>, <a name=t>anchor</a>', "[go **now**](/x?a=1&b=2), anchor"),
    ('<p title="a > b">text</p><!-- <p>no</p> --><script>x = "</p>"</script>end', "text\n\nend"),
    ("<pre>  a\n    b &lt; c</pre>x <code>f(x)</code>", "```\n  a\n    b < c\n```\n\nx `f(x)`"),
    ("a<br>b<br><br>c<hr>d", "a\nb\n\nc\n\n---\n\nd"),
    ("<b>open <p>never closed</p></i> stray", "open\n\nnever closed\n\nstray"),
    ("<b><i>crossed</b> marks</i>", "**crossed** marks"),
    ("<b></b>x<i> </i>y", "x y"),
    ('<img alt="a &quot;b&quot;" src=/i.png> pic', '![a "b"](/i.png) pic'),
    ("&eacute;&#233;&#xE9; &copy &notit; &amp;lt;", "ééé © ¬it; &lt;"),
    ("cut <a href='never ends", "cut"),
    ("cut <!-- never ends <p>x", "cut"),
    ("<script>never ends", ""),
    ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", "| a | b\n| 1 | 2"),
    ("1 < 2 and <3 &c", "1 < 2 and <3 &c"),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_pages(source, text):
    assert h.to_markdown(source) == text


def test_random_pages_do_not_fail_and_keep_their_text():
    rng = random.Random(4)
    for _ in range(500):
        p = page(rng)
        said = h.to_markdown(p)
        assert "<p>" not in said and "never" not in said
        assert said.count("text") == sum(t.count("text") for k, _, t in h.tokens(p) if k == "text")


def test_long_pages_take_linear_time():
    import time

    def cost(n):
        t = time.perf_counter()
        for p in ("<a '" * n, "<b>" * n, "<ul><li>x" * n, "<!--" * n, "<script>" * n, "<" * n, "&" * n, "<p>x " * n):
            h.to_markdown(p)
        return time.perf_counter() - t

    cost(500)
    assert cost(16_000) < 12 * cost(4_000) + 1


def test_column(spark):
    df = spark.createDataFrame([(1, "<p>a"), (2, None), (3, ""), (3, ""), (4, "<p>word " * 50_000)], "page_id long, html string")
    got = sorted(map(tuple, df.select("page_id", h.html_to_markdown("html").alias("t")).collect()), key=str)
    assert got[:4] == [(1, "a"), (2, None), (3, ""), (3, "")] and got[4][1].count("word") == 50_000
    assert df.limit(0).select(h.html_to_markdown("html")).count() == 0
