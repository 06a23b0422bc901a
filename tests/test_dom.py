"""Simplified trees against a plain version that moves nodes about, on all pages of a table and on random ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import dom

FOLDER = "/root/testdata/sf0.01"
SOURCES = ["src", "data-src", "data-src-fg", "data-scroll-image", "srcset", "data-lateloadsrc", "data-img-src", "data-original", "data-gt-lazy-src", "data-lazy", "data-lazy-src", "src2"]


class Node:
    def __init__(self, tag, attrs=None, text=None):
        self.tag, self.attrs, self.text, self.children, self.parent = tag, attrs or {}, text, [], None

    def add(self, child):
        child.parent = self
        self.children.append(child)

    def walk(self):
        for c in list(self.children):
            yield c
            yield from c.walk()

    def gone(self):
        self.parent.children.remove(self)

    def up(self):
        while (self := self.parent) is not None and self.tag != "":
            yield self


def built(nodes):
    root, made = Node(""), []
    for n in nodes:
        made.append(Node(n["tag"], dict(n["attrs"]), n["text"]))
        (made[n["path"][-1]] if n["path"] else root).add(made[-1])
    return root


def source(n):
    if n.tag == "img":
        return next((n.attrs[a] for a in SOURCES if n.attrs.get(a) and not re.search("[, ]", n.attrs[a])), None)
    return n.attrs.get("src") or n.attrs.get("data") or None if n.tag in dom.MEDIA + dom.OF_MEDIA else None


def words(n, name):
    return re.split(r"\s+", n.attrs[name]) if name in n.attrs else []


def plain(nodes, cut_after=(), keep_images=False, strip=True, delete=None):
    root = built(nodes)
    inside = lambda n: n.tag not in (dom.TEXT, "html")
    for n in root.walk():
        if delete(n) if delete else inside(n) and ({"footer", "site-info"} & set(words(n, "class"))):
            if n.tag != "html":
                n.gone()
                n.children = []
    for n in list(root.walk()):
        if n.tag != dom.TEXT and "more-link" in words(n, "class") and not any("more-link" in words(a, "class") for a in n.up()):
            n.tag, n.children, n.text = dom.TEXT, [], "\n\nEND_OF_DOCUMENT_TOKEN_TO_BE_REPLACED\n\n"

    def dissolve(n):
        at = n.parent.children.index(n)
        for c in n.children:
            c.parent = n.parent
        n.parent.children[at : at + 1] = n.children

    for n in list(root.walk()):
        if n.tag in dom.UNWRAP:
            dissolve(n)
    boring = lambda n: re.sub("[0-9]", "", n.tag) not in {*dom.STRUCTURE, *dom.MEDIA, *dom.OF_MEDIA, dom.TEXT, ""}
    dropped = lambda n, inside_of: n.parent is not None and inside_of(n)  # noqa: E731, F841
    if strip:
        for n in list(root.walk()):
            if boring(n):
                n.gone() if n in n.parent.children else None
                n.children = []
    for n in list(root.walk()):
        if n.attrs.get("id") in cut_after and n.tag != dom.TEXT and cut_after and n in n.parent.children:
            at = n.parent.children.index(n)
            for c in n.parent.children[at:]:
                c.children = []
            del n.parent.children[at:]
    if keep_images:
        def rescue(n):
            out = []
            for c in n.children:
                out += [c] if c.tag == "img" else rescue(c)
            return out

        def clean(n):
            kept = []
            for c in n.children:
                if boring(c):
                    for image in rescue(c):
                        image.parent = n
                        kept.append(image)
                else:
                    clean(c)
                    kept.append(c)
            n.children = kept

        clean(root)
    for n in list(root.walk()):
        if n.tag == "div" and any(n.attrs.get(a) in dom.SPECIAL for a in ("id", "class", "title")) and n in n.parent.children:
            n.gone()
            n.children = []
    for n in list(root.walk()):
        if n.tag == dom.TEXT and n.parent.tag == "div" and "date" in n.parent.attrs.get("class", ""):
            n.gone()
    changed = True
    while changed:
        changed = False
        for n in list(root.walk()):
            holder = n.tag in ("figure", "picture", "video", "audio")
            if n.tag == dom.TEXT:
                empty = not re.sub(r"[ \t\n\x0b\f\r]", "", n.text)
            elif n.tag in dom.MEDIA + dom.OF_MEDIA and not holder:
                empty = source(n) is None
            else:
                empty = n.tag != "html" and not n.children and source(n) is None
            if empty and n in n.parent.children:
                n.gone()
                n.children = []
                changed = True
    changed = True
    while changed:
        changed = False
        for n in list(root.walk()):
            if n.tag != dom.TEXT and len(n.children) == 1 and n.children[0].tag == n.tag and n in n.parent.children:
                dissolve(n)
                changed = True
                break
    out = []

    def show(n, depth):
        for c in n.children:
            out.append((c.tag, depth, c.text, source(c)))
            show(c, depth + 1)

    show(root, 0)
    return out


def random_page(rng):
    def part(depth):
        kind = rng.random()
        if depth > 5 or kind < 0.3:
            return rng.choice(["text", " ", "\n", "a b", "&amp;", "<br>", ""])
        tag = rng.choice(["div", "div", "p", "a", "b", "span", "ul", "li", "section", "figure", "img", "script", "nav", "video", "source", "picture", "table", "iframe", "h1"])
        attrs = "".join(rng.choice(['', '', ' class="x date-y"', ' class="footer a"', ' id="ref"', ' class="menu"', ' id="nav"', ' src="/i.png"', ' data-src="j.png"', ' src="a b"', ' class="more-link"', ' title="header"', ' class="site-info"']) for _ in range(2))
        inner = "".join(part(depth + 1) for _ in range(rng.randrange(4)))
        end = "" if tag in ("img", "source") or rng.random() < 0.05 else f"</{tag}>"
        return f"<{tag}{attrs}>{inner if end else ''}{end}" if tag in ("img", "source") else f"<{tag}{attrs}>{inner}{end}"

    return "<html><body>" + "".join(part(0) for _ in range(rng.randrange(6))) + rng.choice(["</body></html>", ""])


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(8)
    pages = spark.createDataFrame([(10_000 + i, random_page(rng)) for i in range(400)] + [(-1, None), (-2, ""), (-3, "no tags"), (-4, "<"), (-5, "</p></div>"), (-6, "<p>" * 300 + "deep")], "page_id long, html string")
    both = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").unionByName(pages)
    return dom.trees(both.repartition(4)).cache()


def as_dicts(row):
    return [n.asDict() for n in row.nodes]


@pytest.mark.parametrize("steps", [{}, {"cut_after": ("ref", "note")}, {"keep_images": True, "strip": False}])
def test_steps_against_a_tree_that_is_changed(trees, steps):
    want = {r.page_id: plain(as_dicts(r), **steps) for r in trees.collect()}
    got = {r.page_id: [tuple(n) for n in r.nodes] for r in dom.simplified(trees, dom.Steps(**steps)).collect()}
    assert len(got) == len(want) and [i for i in want if got[i] != want[i]] == []
    assert sum(map(len, want.values())) > 5000


RULES = {
    "div": lambda n: n.tag == "div",
    "div p": lambda n: n.tag == "p" and any(a.tag == "div" for a in n.up()),
    "div > p, section>*": lambda n: (n.tag == "p" and n.parent.tag == "div") or (n.tag != dom.TEXT and n.parent.tag == "section"),
    "body div > b[class~='date-y']": lambda n: n.tag == "b" and "date-y" in words(n, "class") and n.parent.tag == "div" and any(a.tag == "body" for a in n.parent.up()),
    ".menu .footer span": lambda n: n.tag == "span" and any("footer" in words(a, "class") and any("menu" in words(b, "class") for b in a.up()) for a in n.up()),
    "#ref > * > [src$='.png']": lambda n: n.attrs.get("src", "").endswith(".png") and n.parent.tag not in ("", dom.TEXT) and n.parent.parent.attrs.get("id") == "ref",
}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_rules_with_combinators(trees, rule):
    got = {r.page_id: r.m for r in trees.select("page_id", dom.matching("nodes", rule).alias("m")).collect()}
    found = 0
    for r in trees.collect():
        root = built(as_dicts(r))
        want = [n.tag != dom.TEXT and RULES[rule](n) for n in root.walk()]
        assert got[r.page_id] == want
        found += sum(want)
    assert found > 0
    want = {r.page_id: plain(as_dicts(r), delete=lambda n: n.tag not in (dom.TEXT, "html") and RULES[rule](n)) for r in trees.collect()}
    left = dom.simplified(trees, dom.Steps(delete=(rule,))).collect()
    assert [r.page_id for r in left if [tuple(n) for n in r.nodes] != want[r.page_id]] == []


def test_selectors_that_are_none():
    for rule in ("", "a >", "> a", "a + b", "a:first-child", "a,,b", "[x"):
        with pytest.raises(ValueError, match="selector"):
            dom.selector(rule)
    with pytest.raises(ValueError, match="strip"):
        dom.Steps(keep_images=True)


def test_implied_ends(spark):
    nodes = dom.parsed("<ul><li>a<li><b>c<p>d<p>e</ul><table><tr><td>1<td>2<tr><td>3</table>x")
    assert [(n["tag"], len(n["path"])) for n in nodes if n["tag"] != dom.TEXT] == [("ul", 0), ("li", 1), ("li", 1), ("b", 2), ("p", 3), ("p", 3), ("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 2)]
    assert nodes[-1]["text"] == "x" and nodes[-1]["path"] == [] and all(n["end"] <= len(nodes) for n in nodes)
    found = dom.simplified(dom.trees(spark.createDataFrame([(1, "a<!-- <p>no</p> -->b<br>c\n\n\nd   e")], "page_id long, html string"))).first().nodes
    assert [n.text for n in found] == ["ab#BR_TAG#c\nd e"]
