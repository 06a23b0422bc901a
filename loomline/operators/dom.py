"""Pages as trees in arrays, simplified by rules that are array expressions.

``trees`` parses a page to its nodes in pre-order, array<struct<tag, end, path, attrs, text>>:
``end`` is the place behind the node's last descendant and ``path`` lists its ancestors'
places, the page's own first; a text node has the tag ``-text``.  Nothing else is Python.

``simplified`` never moves a node: each step makes an array that says which places are
alive.  What a step asks about subtrees it asks a string with a 1 for each place that
counts, of which a node's subtree is a substring.  A page costs its nodes times their
depth, and no page meets another, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .html import _COMPOUND, _CONDITION, BLOG_DELETE, BLOG_REPLACE, IMAGE_SOURCES, STRUCTURE, VOID

# Tags that only style text, media and what tells of them, ids and classes of boilerplate.
UNWRAP = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "shadow", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"]
MEDIA = ["audio", "embed", "figure", "iframe", "img", "object", "picture", "video"]
OF_MEDIA = ["source"]
SPECIAL = ["footer", "header", "navigation", "nav", "navbar", "menu"]

#: Media that may hold their sources: they stay while something in them does.
HOLDERS = ["figure", "picture", "video", "audio"]
TEXT = "-text"
NODES = "array<struct<tag:string,end:int,path:array<int>,attrs:map<string,string>,text:string>>"
_BLOCKS = {"address", "article", "aside", "blockquote", "center", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
#: By tag: what an open one of ends where the tag begins, and what it is looked for within.
_ENDS = {tag: ({"p"}, {"button", "table", "td", "th", "caption", "object", "li", "dd", "dt"}) for tag in _BLOCKS}
_ENDS |= {"li": ({"li", "p"}, {"ul", "ol"}), "dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: dict, text: str | None) -> int:
        self.nodes.append({"tag": tag, "end": len(self.nodes) + 1, "path": list(self.open), "attrs": list(attrs.items()), "text": text})
        return len(self.nodes) - 1

    def _close(self, level: int) -> None:
        for at in self.open[level:]:
            self.nodes[at]["end"] = len(self.nodes)
        del self.open[level:]

    def handle_starttag(self, tag, attrs):
        ended, within = _ENDS.get(tag, ((), ()))
        for level in range(len(self.open) - 1, -1, -1) if ended else ():
            if (above := self.nodes[self.open[level]]["tag"]) in within:
                break
            if above in ended:
                self._close(level)
        at = self._add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for level in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[level]]["tag"] == tag:
                return self._close(level)
        return None

    def handle_data(self, data):
        last = self.nodes[-1] if self.nodes else None
        if last and last["tag"] == TEXT and last["path"] == self.open:
            last["text"] += data
        else:
            self._add(TEXT, {}, data)


def parsed(html: str | None) -> list[dict]:
    """A page's nodes; none for null and for what the parser gives up on."""
    parser = _Parser()
    try:
        parser.feed(html or "")
        parser.close()
    except (ValueError, AssertionError):
        return []
    parser._close(0)
    return parser.nodes


def trees(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, nodes), after line breaks and blanks in a row were made one, comments dropped and line break tags marked."""
    kind = pa.list_(pa.struct([("tag", pa.string()), ("end", pa.int32()), ("path", pa.list_(pa.int32())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([parsed(page.as_py())], kind)], names=[id_col, "nodes"])

    clean = F.regexp_replace(F.regexp_replace(html, r"\n{2,}", "\n"), r" {2,}", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?s)<!--.*?-->", ""), r"<br>|<br/>|<br />|</br>", "#BR_TAG#")
    return pages.select(F.col(id_col).cast("long"), clean.alias("_html")).mapInArrow(run, f"{id_col} long, nodes {NODES}")


def _holds(attrs: Column, name: str, op: str, want: str) -> Column:
    have = F.try_element_at(attrs, F.lit(name))
    tests = {
        "": have.isNotNull(),
        "=": have == want,
        "~=": F.array_contains(F.split(have, r"\s+"), want),
        "^=": have.startswith(want) if want else F.lit(False),
        "$=": have.endswith(want) if want else F.lit(False),
        "*=": F.contains(have, F.lit(want)) if want else F.lit(False),
    }
    return F.coalesce(tests[op], F.lit(False))


def selector(rule: str) -> list[list[tuple[str, str, list[tuple[str, str, str]]]]]:
    """A rule's alternatives, each a way of (combinator, tag, conditions) steps: compound selectors below (``a b``) or right below (``a > b``) others."""
    ways = []
    for part in re.split(r",(?![^\[]*\])", rule):
        way, rest = [], part.strip()
        while rest:
            lead = re.match(r"\s*(>?)\s*", rest)
            found = _COMPOUND.match(rest, lead.end())
            if not found or not found[0] or bool(way) != bool(lead[0]):
                raise ValueError(f"not a selector: {part.strip()!r}")
            conditions = [("class" if m == "." else "id", "~=" if m == "." else "=", n) if m else (a.lower(), op, "".join(v)) for m, n, a, op, *v in _CONDITION.findall(found[2])]
            way.append((lead[1] or " ", (found[1] or "*").lower(), conditions))
            rest = rest[found.end() :]
        if not way:
            raise ValueError(f"not a selector: {part.strip()!r}")
        ways.append(way)
    return ways


def matching(nodes: str, rule: str) -> Column:
    """array<boolean>: the places that a rule selects."""
    column = F.col(nodes)

    def compound(x: Column, tag: str, conditions: list) -> Column:
        ok = (x["tag"] != TEXT) if tag == "*" else x["tag"] == tag
        for condition in conditions:
            ok = ok & _holds(x["attrs"], *condition)
        return ok

    def below(over: Column, combinator: str, tag: str, conditions: list) -> Column:
        """Each step reads the array of the one before, which a lambda's variable holds."""
        def within(m: Column) -> Column:
            if combinator == ">":
                return F.transform(column, lambda x: compound(x, tag, conditions) & F.coalesce(F.get(m, F.element_at(F.concat(F.array(F.lit(-1)), x["path"]), -1)), F.lit(False)))
            return F.transform(column, lambda x: compound(x, tag, conditions) & F.exists(x["path"], lambda j: F.get(m, j)))

        return F.transform(F.array(over), within)[0]

    def way(steps: list) -> Column:
        out = F.transform(column, lambda x: compound(x, *steps[0][1:]))
        for step in steps[1:]:
            out = below(out, *step)
        return out

    out, *others = [way(steps) for steps in selector(rule)]
    for other in others:
        out = F.zip_with(out, other, lambda a, b: a | b)
    return out


@dataclass
class Steps:
    """What ``simplified`` does, in this order; ``keep_images`` lets images stay that stand in a part of no interest."""

    delete: tuple[str, ...] = BLOG_DELETE
    replace: dict[str, str] = field(default_factory=lambda: dict(BLOG_REPLACE))
    unwrap: bool = True
    strip: bool = True
    keep_images: bool = False
    cut_after: tuple[str, ...] = ()
    special: bool = True
    dates: bool = True
    empty: bool = True
    unnest: bool = True

    def __post_init__(self) -> None:
        if self.keep_images and self.strip:
            raise ValueError("what is stripped takes its images along: keep_images goes without strip")


def _listed(value: Column, names: list[str]) -> Column:
    return value.isin(names)


def _source(x: Column) -> Column:
    """Where a media node's file is: an image's first source that isn't a list, others' src or data."""
    image = [F.when(~F.try_element_at(x["attrs"], F.lit(a)).rlike("[, ]"), F.nullif(F.try_element_at(x["attrs"], F.lit(a)), F.lit(""))) for a in IMAGE_SOURCES]
    other = [F.nullif(F.try_element_at(x["attrs"], F.lit(a)), F.lit("")) for a in ("src", "data")]
    return F.when(x["tag"] == "img", F.coalesce(*image)).when(_listed(x["tag"], MEDIA + OF_MEDIA), F.coalesce(*other))


def _marks(flags: Column) -> Column:
    """A byte a place, 1 where it is flagged: a subtree is a part of it."""
    return F.array_join(F.transform(flags, lambda b: F.when(b, "1").otherwise("0")), "").cast("binary")


def _any(marks: Column, start: Column, end: Column) -> Column:
    """Whether a place from ``start`` on and before ``end`` is marked."""
    return F.contains(F.substring(marks, start + 1, F.greatest(end - start, F.lit(0))), F.lit("1").cast("binary"))


def simplified(pages: DataFrame, steps: Steps | None = None, id_col: str = "page_id", nodes: str = "nodes") -> DataFrame:
    """(id, nodes array<struct<tag, depth, text, src>>): what the steps leave of ``trees``, in order, with depths in the tree that is left.

    A text that consists of blanks is no node.  A page of which nothing is left has no nodes.
    """
    steps = steps or Steps()
    digits = lambda tag: F.regexp_replace(tag, "[0-9]+", "")
    interesting = STRUCTURE + MEDIA + OF_MEDIA + ["", TEXT] + UNWRAP
    rows = T.once(pages.select(id_col, F.col(nodes).alias("_n")), _alive=F.transform("_n", lambda x: F.lit(True)))

    def flagged(**columns: Column) -> None:
        nonlocal rows
        made = T.once(rows, **{f"{name}2": c for name, c in columns.items()})
        rows = made.drop(*columns).withColumnsRenamed({f"{name}2": name for name in columns})

    def without(gone: Column) -> None:
        """Nodes of an array of flags go, and all below them."""
        flagged(_gone=gone)
        flagged(_alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ~F.get("_gone", i) & ~F.exists(x["path"], lambda j: F.get("_gone", j))))

    def each(test: Callable[[Column], Column]) -> Column:
        return F.transform("_n", test)

    for rule in steps.delete:
        without(F.zip_with(matching("_n", rule), each(lambda x: x["tag"] != "html"), lambda a, b: a & b))
    for rule, text in steps.replace.items():
        flagged(_gone=F.zip_with(matching("_n", rule), F.col("_alive"), lambda a, b: a & b))
        put = F.struct(F.lit(TEXT).alias("tag"), F.lit(text).alias("text"))
        flagged(
            _alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ~F.exists(x["path"], lambda j: F.get("_gone", j))),
            _m=F.transform("_n", lambda x, i: F.when(F.get("_gone", i), F.struct(put["tag"].alias("tag"), x["end"].alias("end"), x["path"].alias("path"), x["attrs"].alias("attrs"), put["text"].alias("text"))).otherwise(x)),
        )
        rows = rows.drop("_n").withColumnRenamed("_m", "_n")
    if steps.unwrap:  # they go alone, with what is in them left
        flagged(_alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ~_listed(x["tag"], UNWRAP)))
    if steps.strip:
        without(each(lambda x: ~_listed(digits(x["tag"]), interesting)))
    if steps.cut_after:
        def cuts(x: Column, i: Column) -> Column:
            return F.when(F.get("_alive", i) & (x["tag"] != TEXT) & F.coalesce(_listed(F.try_element_at(x["attrs"], F.lit("id")), list(steps.cut_after)), F.lit(False)), F.struct(i.alias("a"), holder(x).alias("p")))

        def holder(x: Column) -> Column:
            return F.coalesce(F.try_element_at(F.filter(x["path"], lambda j: F.get("_alive", j)), F.lit(-1)), F.lit(-1))

        flagged(_cuts=F.filter(F.transform("_n", cuts), lambda c: c.isNotNull()))
        end = lambda c: F.when(c["p"] < 0, F.size("_n")).otherwise(F.get("_n", c["p"])["end"])
        flagged(_alive=F.transform("_alive", lambda alive, i: alive & ~F.exists("_cuts", lambda c: (i >= c["a"]) & (i < end(c)))))
    if steps.keep_images:
        without_image = each(lambda x: ~_listed(digits(x["tag"]), interesting))
        flagged(_gone=without_image)
        flagged(_alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ~F.get("_gone", i) & ((x["tag"] == "img") | ~F.exists(x["path"], lambda j: F.get("_gone", j)))))
    if steps.special:
        said = lambda x, a: F.coalesce(_listed(F.try_element_at(x["attrs"], F.lit(a)), SPECIAL), F.lit(False))
        without(each(lambda x: (x["tag"] == "div") & (said(x, "id") | said(x, "class") | said(x, "title"))))
    if steps.dates:
        flagged(_dated=each(lambda x: (x["tag"] == "div") & F.coalesce(F.contains(F.try_element_at(x["attrs"], F.lit("class")), F.lit("date")), F.lit(False))))
        nearest = lambda x: F.try_element_at(F.filter(x["path"], lambda j: F.get("_alive", j)), F.lit(-1))
        flagged(_alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ~((x["tag"] == TEXT) & F.coalesce(F.get("_dated", nearest(x)), F.lit(False)))))
    if steps.empty:  # a medium without a source goes with what is in it
        without(each(lambda x: _listed(x["tag"], [m for m in MEDIA + OF_MEDIA if m not in HOLDERS]) & _source(x).isNull()))
    full = lambda x: F.when(x["tag"] == TEXT, ~x["text"].rlike(r"^\s*$")).otherwise(_source(x).isNotNull())
    flagged(_full=F.transform("_n", lambda x, i: F.get("_alive", i) & full(x)))
    if steps.empty:
        flagged(_marks=_marks(F.col("_full")))
        flagged(_alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ((x["tag"] == "html") | _any(F.col("_marks"), i, x["end"]))))
    else:
        flagged(_alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ((x["tag"] != TEXT) | F.get("_full", i))))
    if steps.unnest:
        flagged(_marks=_marks(F.col("_alive")))

        def nested(x: Column, i: Column) -> Column:
            """Whether all that a node holds is one node of its own tag."""
            first = i + F.locate("1", F.substring(F.col("_marks"), i + 2, F.greatest(x["end"] - i - 1, F.lit(0))).cast("string"))
            return F.transform(F.array(first), lambda a: (a > i) & (F.get("_n", a)["tag"] == x["tag"]) & ~_any(F.col("_marks"), F.get("_n", a)["end"], x["end"]))[0]

        flagged(_alive=F.transform("_n", lambda x, i: F.get("_alive", i) & ~((x["tag"] != TEXT) & F.coalesce(nested(x, i), F.lit(False)))))
    depth = lambda x: F.size(F.filter(x["path"], lambda j: F.get("_alive", j)))
    left = F.transform("_n", lambda x, i: F.when(F.get("_alive", i), F.struct(x["tag"].alias("tag"), depth(x).alias("depth"), x["text"].alias("text"), _source(x).alias("src"))))
    return rows.select(id_col, F.filter(left, lambda x: x.isNotNull()).alias("nodes"))
