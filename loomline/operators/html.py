"""HTML to text and media nodes, inside one Arrow UDF with the standard library's parser.

Nodes are a flat list, so elements without text or media leave nothing behind and
nesting needs no simplification.  ``Rules`` says what else goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
HIDDEN = {"script", "style", "noscript", "template", "head", "nav", "footer", "header", "form", "button", "select", "textarea", "iframe", "svg"}
BOILERPLATE = {"footer", "header", "navigation", "nav", "navbar", "menu"}
STRUCTURE = ["address", "article", "aside", "blink", "blockquote", "body", "br", "caption", "center", "dd", "dl", "dt", "div", "figcaption", "h", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "html", "legend", "main", "marquee", "ol", "p", "section", "summary", "title", "ul"]
IMAGE_SOURCES = ("src", "data-src", "data-src-fg", "data-scroll-image", "srcset", "data-lateloadsrc", "data-img-src", "data-original", "data-gt-lazy-src", "data-lazy", "data-lazy-src", "src2")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

#: Tags that break a paragraph: those that structure a text, digits left out, without the line break, and more that do so here.
PARAGRAPH = ({tag.rstrip("123456") for tag in STRUCTURE} - {"br", "html"}) | {"li", "td", "tr", "table", "pre", "figure"}

#: Rules for blogs, fixed values: what goes, and the text that takes another's place.
BLOG_DELETE = ("[class~='footer']", "[class~='site-info']")
BLOG_REPLACE = {"[class~='more-link']": "\n\nEND_OF_DOCUMENT_TOKEN_TO_BE_REPLACED\n\n"}

#: Pages that are objects of Python at a time.
PAGES = 64

NODES = "array<struct<kind:string,text:string,src:string,alt:string>>"


_COMPOUND = re.compile(r"""([\w-]+|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[~^$*]?=(?:'[^']*'|"[^"]*"|[^\]'"]*))?\])*)""")
_CONDITION = re.compile(r"""([.#])([\w-]+)|\[([\w-]+)(?:([~^$*]?=)(?:'([^']*)'|"([^"]*)"|([^\]'"]*)))?\]""")
_TESTS = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
}


def selector(rule: str):
    """A (tag, attributes) predicate for compound selectors: tags, classes, ids and attribute tests, in lists with commas."""
    options = []
    for part in re.split(r",(?![^\[]*\])", rule):
        found = _COMPOUND.fullmatch(part.strip())
        if not found or not found[0]:
            raise ValueError(f"not a compound selector: {part.strip()!r}")
        tests = []
        for mark, name, attribute, test, *values in _CONDITION.findall(found[2]):
            if mark:
                tests.append(("class" if mark == "." else "id", "~=" if mark == "." else "=", name))
            else:
                tests.append((attribute.lower(), test, "".join(values)))
        options.append(((found[1] or "*").lower(), tests))

    def matches(tag: str, attrs: dict) -> bool:
        return any(t in ("*", tag) and all(a in attrs and (not op or _TESTS[op](attrs[a] or "", want)) for a, op, want in tests) for t, tests in options)

    return matches


@dataclass
class Rules:
    """``delete``: selectors of elements that go.  ``replace``: by selector, the text that stands for an element.
    ``dates``: text directly under a div goes whose class holds "date" (inline elements count as text).
    ``cut_after``: ids of elements that go with all siblings after them."""

    delete: tuple[str, ...] = ()
    replace: dict[str, str] = field(default_factory=dict)
    dates: bool = False
    cut_after: tuple[str, ...] = ()

    def compiled(self) -> tuple[list, list]:
        return [selector(r) for r in self.delete], [(selector(r), text) for r, text in self.replace.items()]


class _Nodes(HTMLParser):
    """Flat list of text, image, video and audio nodes; text is joined by the strongest separator passed in between."""

    def __init__(self, base: str, rules: Rules, compiled: tuple[list, list]):
        super().__init__(convert_charrefs=True)
        self.base, self.nodes, self.open, self.hidden, self.gap = base, [], [], 0, ""
        self.rules, (self.delete, self.replace), self.media, self.dated = rules, compiled, None, []

    def _break(self, gap: str) -> None:
        if len(gap) > len(self.gap) or self.gap == "" or (gap.startswith("\n") and self.gap == " "):
            self.gap = max(self.gap, gap, key=lambda g: (g.count("\n"), len(g)))

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        hide = any(rule(tag, attrs) for rule in self.delete) if self.delete else False
        if self.replace and not hide and not self.hidden:
            text = next((text for rule, text in self.replace if rule(tag, attrs)), None)
            if text is not None:
                self._replaced(text)
                hide = True
        if self.rules.cut_after and attrs.get("id") in self.rules.cut_after:
            hide = True
            if self.open:  # hidden until its parent ends
                self.open[-1][1] += 1
            self.hidden += 1
        tag = re.sub(r"\d", "", tag)
        if hide and tag in VOID:
            return None
        if tag == "br":
            return self._break("\n")
        if tag == "source" and self.media and not self.hidden:
            self._add_media(self.media, attrs.get("src"))
        if tag == "img" and not self.hidden:
            src = next((attrs[a] for a in IMAGE_SOURCES if attrs.get(a) and not re.search(r"[,\s]", attrs[a])), None)
            if src:
                self.nodes.append(("image", None, urljoin(self.base, src) if self.base else src, attrs.get("alt")))
                self.gap = ""
        if tag in PARAGRAPH:
            self._break("\n\n")
        if tag in VOID:
            return None
        marks = {str(attrs.get(a, "")).lower() for a in ("id", "class", "title")}
        hide = hide or tag in HIDDEN or (tag == "div" and bool(marks & BOILERPLATE))
        self.open.append([tag, int(hide)])
        self.hidden += hide
        if self.rules.dates and tag in PARAGRAPH:
            self.dated.append((len(self.open), tag == "div" and "date" in (attrs.get("class") or "")))
        if tag in ("video", "audio") and not self.hidden:
            self.media = tag
            self._add_media(tag, attrs.get("src"))
        return None

    def _add_media(self, kind: str, src: str | None) -> None:
        """The first source counts, unless it holds a comma or a space."""
        if src:
            self.media = None
            if not re.search(r"[,\s]", src):
                self.nodes.append((kind, None, urljoin(self.base, src) if self.base else src, None))
                self.gap = ""

    def _replaced(self, text: str) -> None:
        lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
        if lead:
            self._break("\n\n" if "\n\n" in lead else lead[0])
        self._add_text(text.strip())
        if trail:
            self._break("\n\n" if "\n\n" in trail else trail[0])

    def _add_text(self, text: str) -> None:
        if not text:
            return
        if self.nodes and self.nodes[-1][0] == "text":
            self.nodes[-1] = ("text", self.nodes[-1][1] + self.gap + text, None, None)
        else:
            self.nodes.append(("text", text, None, None))
        self.gap = ""

    def handle_endtag(self, tag):
        tag = re.sub(r"\d", "", tag)
        if any(t == tag for t, _ in self.open):
            while True:
                t, hide = self.open.pop()
                self.hidden -= hide
                while self.dated and self.dated[-1][0] > len(self.open):
                    self.dated.pop()
                if t in ("video", "audio"):
                    self.media = None
                if t == tag:
                    break
        if tag in PARAGRAPH:
            self._break("\n\n")

    def handle_data(self, data):
        flat = re.sub(r"\s+", " ", data)
        text = flat.strip()
        if self.hidden or not text or (self.dated and self.dated[-1][1]):
            if flat and not self.hidden:
                self._break(" ")
            return
        if flat[0] == " ":
            self._break(" ")
        self._add_text(text)
        self.gap = " " if flat[-1] == " " else ""


def nodes(html: str | None, url: str | None, rules: Rules | None = None, compiled: tuple[list, list] | None = None) -> list[tuple] | None:
    """Nodes in document order; an empty list for what can't be parsed."""
    if html is None:
        return []
    rules = rules or Rules()
    compiled = compiled or rules.compiled()
    try:
        parser = _Nodes(url or "", rules, compiled)
        parser.feed(re.sub(r"<!--.*?-->", "", html, flags=re.S))
        parser.close()
        return parser.nodes
    except (ValueError, AssertionError):
        return []


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", rules: Rules | None = None) -> DataFrame:
    """(id, nodes): text and media nodes of each page, in order."""
    rules = rules or Rules()
    rules.compiled()  # a wrong selector is an error here, not in a task
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("alt", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = rules.compiled()
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):  # a batch may hold 10,000
                ids, urls, texts = batch.slice(at, PAGES).columns
                found = [[dict(zip(("kind", "text", "src", "alt"), n, strict=True)) for n in nodes(h.as_py(), u.as_py(), rules, compiled)] for u, h in zip(urls, texts, strict=True)]
                yield pa.record_batch([ids, pa.array(found, kind)], names=[id_col, "nodes"])

    return pages.select(F.col(id_col).cast("long"), url, html).mapInArrow(run, f"{id_col} long, nodes {NODES}")


def page_text(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    texts = F.transform(F.filter("nodes", lambda n: n["kind"] == "text"), lambda n: n["text"])
    return found.select(id_col, F.array_join(texts, "\n\n").alias("text"))


def image_text_pairs(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, pos, src, alt, text): each image with the first paragraph of the text node right after it."""
    after = lambda i: F.try_element_at("nodes", i + 2)
    pairs = F.filter(F.transform("nodes", lambda n, i: F.struct(i.alias("pos"), n["kind"].alias("kind"), n["src"].alias("src"), n["alt"].alias("alt"), F.when(after(i)["kind"] == "text", F.split(after(i)["text"], "\n\n")[0]).alias("text"))), lambda p: p["kind"] == "image")
    return found.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.pos", "p.src", "p.alt", "p.text")


def absolute_url(source, base):
    """``source`` as seen from ``base``: with a scheme as it is, from the scheme, from the root, or from the base's folder (dots resolved)."""
    scheme, authority = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*/|/)?", 1)
    path = F.concat(F.when(folder == "", "/").otherwise(folder), source)
    parts = F.filter(F.split(F.regexp_replace(path, r"^/", ""), "/", -1), lambda p: p != ".")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    relative = F.concat(authority, F.lit("/"), F.array_join(kept, "/"))
    absolute = source.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | (authority == "")
    return F.when(absolute, source).when(source.startswith("//"), F.concat(scheme, source)).when(source.startswith("/"), F.concat(authority, source)).otherwise(relative)


def images_outside(found: DataFrame, pages: DataFrame, id_col: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(id, src) of image sources in the raw HTML, made absolute like those of the nodes, that no node holds."""
    sources = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]*\ssrc=["']?([^"'\s>]+)"""), F.lit(1)))
    raw = pages.select(id_col, F.explode(F.transform(sources, lambda s: absolute_url(s, F.col(url)))).alias("src")).distinct()
    kept = found.select(id_col, F.explode(F.filter("nodes", lambda n: n["kind"] == "image")).alias("n")).select(id_col, F.col("n.src").alias("src"))
    return raw.join(kept, [id_col, "src"], "left_anti")


def collapse(html):
    """Comments dropped, white space collapsed, <br> marked: the passes before parsing."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"[ ]?[\r\n]+[ ]?", "\n")
    return F.regexp_replace(text, r"(?i)<br[ ]?/?>", "#BR_TAG#")


def visible_words(html):
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
