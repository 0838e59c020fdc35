"""HTML pages to Markdown: one pass of a tokenizer over each page.

The tokenizer knows comments (an open one runs to the end), declarations, tags
with quoted attributes (``>`` inside quotes does not end a tag; a tag that never
ends is dropped with what follows) and elements whose content is no markup
(script, style, ...), which are dropped up to their own end tag.  Character
references are resolved by HTML's rules, with or without a semicolon.

Headings, nested lists, links, images, emphasis, code and preformatted text keep
their marks; other block elements part paragraphs; white space collapses outside
preformatted text.  Broken markup: end tags without a start are ignored; a block
ends the emphasis, code and links that are open in it, and marks that were not
closed there are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# HTML's elements by what they do.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "head", "header", "html", "main", "nav", "p", "section", "summary", "table", "tbody", "thead", "tfoot")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
OPENS = re.compile(r"<!--|<[!?]|</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
SPACE = re.compile(r"[ \t\n\r\f]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text", "", text)``, ``("open", name, attributes)``, ``("close", name, "")``."""
    at = 0
    while at < len(page):
        m = OPENS.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.start()
        if m.group() == "<!--":
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if m.group() in ("<!", "<?"):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        tag = TAG.match(page, at)
        if tag is None:  # never ends
            return
        at, name = tag.end(), tag.group(2).lower()
        yield ("close" if tag.group(1) else "open"), name, tag.group(3)
        if not tag.group(1) and name in RAW:
            end = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
            if end is None:
                return
            at = end.start()


def attribute(attributes: str, name: str) -> str:
    for m in ATTRIBUTE.finditer(attributes):
        if m.group(1).lower() == name:
            return html.unescape(next(v for v in m.groups()[1:] if v is not None))
    return ""


class Markdown:
    """Builds the text; ``due`` line ends stand before what is written next."""

    def __init__(self):
        self.out: list[str] = []
        self.due, self.pre, self.head = 0, 0, ""
        self.lists: list[int | None] = []  # next number of an ordered list, None for bullets
        self.marks: list[tuple[str, int, str]] = []  # element, where it opened, what closes it

    def part(self, lines: int) -> None:
        """A new line or block: open marks end, unclosed ones are left out."""
        for _, at, _ in self.marks:
            self.out[at] = ""
        self.marks = []
        self.due = max(self.due, lines)

    def line(self) -> None:
        """A line end within a block."""
        self.due = min(self.due + 1, 2)

    def put(self, text: str) -> None:
        if self.due or not self.out:
            while self.out and not self.out[-1].strip(" "):
                self.out.pop()
                self.marks = [m for m in self.marks if m[1] < len(self.out)]
            if self.out:
                self.out[-1] = self.out[-1].rstrip(" ")
                self.out.append("\n" * self.due)
            text = text if self.pre else text.lstrip(" ")
            self.due = 0
        if self.head:
            self.out.append(self.head)
            self.head = ""
            text = text if self.pre else text.lstrip(" ")
        self.out.append(text)

    def text(self, text: str) -> None:
        text = html.unescape(text)
        if self.pre:
            self.put(text)
            return
        text = SPACE.sub(" ", text)
        if text == " " and (self.due or self.head or not self.out):
            return
        if text.startswith(" ") and self.out and self.out[-1].endswith(" "):
            text = text[1:]
        if text:
            self.put(text)

    def open(self, name: str, attributes: str) -> None:
        if name in HEADINGS:
            self.part(2)
            self.head = "#" * int(name[1]) + " "
        elif name in ("ul", "ol"):
            self.part(1 if self.lists else 2)
            self.lists.append(1 if name == "ol" else None)
        elif name == "li":
            self.part(1)
            n = self.lists[-1] if self.lists else None
            if n is not None:
                self.lists[-1] = n + 1
            self.head = "  " * (len(self.lists) - 1) + ("- " if n is None else f"{n}. ")
        elif name == "pre":
            self.part(2)
            if not self.pre:
                self.put("```\n")
            self.pre += 1
        elif name == "br":
            self.put("\n") if self.pre else self.line()
        elif name == "hr":
            self.part(2)
            self.put("---")
            self.part(2)
        elif name == "tr":
            self.part(1)
        elif name in ("td", "th"):
            self.put(" | ")
        elif name in BLOCKS:
            self.part(2)
        elif name == "img":
            self.put(f"![{attribute(attributes, 'alt')}]({attribute(attributes, 'src')})")
        elif not self.pre and (name in MARKS or name == "a"):
            target = attribute(attributes, "href") if name == "a" else ""
            if name == "a" and not target:
                return
            self.put("[" if name == "a" else MARKS[name])
            self.marks.append((name, len(self.out) - 1, f"]({target})" if name == "a" else MARKS[name]))

    def close(self, name: str) -> None:
        if name in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.part(1 if self.lists else 2)
        elif name == "li":
            self.part(1)
        elif name == "tr":
            self.part(1)
        elif name == "pre":
            if self.pre:
                self.pre -= 1
                if not self.pre:
                    self.out.append("" if self.out[-1].endswith("\n") else "\n")
                    self.out.append("```")
                    self.part(2)
        elif name in HEADINGS:
            self.head = ""
            self.part(2)
        elif name in BLOCKS:
            self.part(2)
        else:
            for i in range(len(self.marks) - 1, -1, -1):
                if self.marks[i][0] == name:
                    for _, at, _ in self.marks[i + 1:]:  # opened inside, never closed
                        self.out[at] = ""
                    _, at, end = self.marks[i]
                    del self.marks[i:]
                    if any(x.strip() for x in self.out[at + 1:]):
                        self.out.append(end)
                    else:
                        self.out[at] = ""
                    return

    def done(self) -> str:
        if self.pre:
            self.pre = 1
            self.close("pre")
        self.part(0)
        return "".join(self.out).strip()


def to_markdown(page: str) -> str:
    md = Markdown()
    for kind, name, rest in tokens(page):
        if kind == "text":
            md.text(rest)
        elif name not in RAW:
            md.open(name, rest) if kind == "open" else md.close(name)
    return md.done()


@arrow_udf(StringType())
def _markdown(pages: pa.Array) -> pa.Array:
    return pa.array([None if p is None else to_markdown(p) for p in pages.to_pylist()], pa.string())


def html_to_markdown(c) -> Column:
    """Markdown of a column of pages (null stays null)."""
    return _markdown(F.col(c) if isinstance(c, str) else c)
