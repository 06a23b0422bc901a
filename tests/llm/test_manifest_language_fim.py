"""The Merkle manifest and the fill-in-the-middle cuts against plain versions, language identification on held-out rows."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import fill_middle, merkle, string_kernel
from tests.test_oracles import FOLDER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, tree string, pos long, path string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated ids and rows, columns whose names the operators use."""
    long = "Lorem ipsum dolor sit amet consectetur adipiscing elit. " * 3000
    rows = [(1, "A b C d", "en", "s", 7), (2, "der Hund <S> x", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "t", 0), (None, "A b c d", "en", "s", 7), (5, long, "en", "s", len(long)), (6, "x" * 200_000, "de", "t", 1), (1, "A b C d", "en", "s", 7), (1, "other", "en", "s", 7), (7, "123 é\U0001f600\n\n!", "é", "s", 3), (-8, "q", "-", "s", None), (9, "w", "", "s", None)]
    return spark.createDataFrame([(*r, "n", "t", 5, "p") for r in rows], DOCS).repartition(4)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(nodes, width):
    """(root, per node its (left, right) siblings by level)"""
    level, at, paths = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, p in enumerate(at):
            start = p // width * width
            paths[i].append(("".join(level[start:p]), "".join(level[p + 1 : start + width])))
        level = [h(*level[i : i + width]) for i in range(0, len(level), width)]
        at = [p // width for p in at]
    return level[0], paths


def slow_manifest(rows, width=8):
    """{row number: (leaf, subroot, root, proof, folded root)} of (doc_id, text, lang, source, n_chars)."""

    def of(r, text):
        values = [r[0], r[3], r[2], r[4], text]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[2], []).append(k)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, below = [], {}
    for g in langs:
        members = sorted(groups[g], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, of(rows[k], rows[k][1])))
        subroot, paths = slow_tree([of(rows[k], rows[k][1]) for k in members], width)
        subroots.append(subroot)
        below |= dict(zip(members, paths, strict=True))
    root, above = slow_tree(subroots, width)
    out = {}
    for g, subroot, path in zip(langs, subroots, above, strict=True):
        for k in groups[g]:
            r, whole = rows[k], below[k] + path
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = of(r, text)
            for a, b in whole:
                node = h(a, node, b)
            out[k] = (of(r, r[1]), subroot, root, h(*[a + b for a, b in whole]), node)
    return out


def same_manifest(docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    found = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.verify(docs).collect()]
    want = slow_manifest(rows)
    return sorted(found, key=str) == sorted([(rows[k][0], *v, v[4] == v[2]) for k, v in want.items()], key=str)


# 11
@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_of_blocks_of_any_depth(spark, monkeypatch, depth):
    """The smallest table, whose trees take one round or several by the depth of a block."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)
    assert same_manifest(docs)
    for n in (1, 9):
        assert same_manifest(docs.filter("lang = 'en'").orderBy("doc_id").limit(n))


def test_manifest_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    docs = spark.range(700).selectExpr("id doc_id", "concat('T', id) text", "nullif(concat('l', least(id, 80)), 'l3') lang", "cast(null as string) source", "id n_chars")
    assert same_manifest(docs)


def test_manifest_of_odd_rows(spark, odd):
    assert same_manifest(odd) and same_manifest(odd.filter("lang is null"))
    assert merkle.verify(odd.filter("false")).count() == 0 and merkle.verify(odd.filter("false")).columns == merkle.verify(odd).columns
    kept = merkle.manifest(odd.select("lang", "doc_id", merkle.leaf(F.col("text")).alias("leaf"), "pos"), keep=("pos",))
    assert kept.columns == ["doc_id", "leaf", "subroot", "root", "path", "pos"] and {r.pos for r in kept.collect()} == {5}


def test_a_changed_text_breaks_the_proof(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'de'")
    found = {r.doc_id: r.verified for r in merkle.verify(docs).collect()}
    changed = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r.text) for r in docs.collect()}
    assert any(changed.values()) and all(found[k] == (not changed[k]) for k in found)


# 12
def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/../sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = string_kernel.predict_documents(docs, string_kernel.learn(docs)).collect()
    assert len(found) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    right = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out]
    print("accuracy", np.mean(right), "of", len(right))
    assert np.mean(right) >= 0.98


def test_kernel_is_the_share_of_n_grams_of_both(spark):
    """Presence, kernel and prediction against sets of strings."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdef "), 200)) if i % 2 else "".join(rng.choice(list("efghij "), 200)) for i in range(40)]
    model = string_kernel.fit([(t, "xy"[i % 2]) for i, t in enumerate(texts)])

    def grams(text):
        text = " " + " ".join(text.split()) + " "
        return {text[i : i + n] for n in range(1, string_kernel.LONGEST + 1) for i in range(len(text) - n + 1)}

    def number(gram):
        return next(x[0] for n, x in enumerate(string_kernel_numbers(gram)) if n == len(gram) - 1)

    def string_kernel_numbers(gram):
        at, out = np.zeros(1, np.uint64), []
        for c in gram:
            with np.errstate(over="ignore"):
                at = (at + np.uint64(ord(c))) * np.uint64(0x9E3779B97F4A7C15)
                at ^= at >> np.uint64(29)
            out.append(at)
        return out

    keys = set(model.keys.tolist())
    known = {g for t in texts for g in grams(t) if number(g) in keys}
    assert len(known) == len(model.keys)
    marks = [t for y in (0, 1) for i, t in enumerate(x for k, x in enumerate(texts) if k % 2 == y) if i % 3 != 2]
    have, other = [grams(t) & known for t in texts[:6]], [grams(t) & known for t in marks]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in other] for a in have]
    assert np.allclose(model.kernel(model.presence(texts[:6])), want, atol=1e-5)
    assert [p for p, _ in model.predict(texts)] == ["xy"[i % 2] for i in range(40)]


def test_blocks_of_a_long_text_find_the_same_n_grams(spark, monkeypatch):
    text = "Ab, cd  1 efé" * 50 + " z"
    whole = {int(x) for part in string_kernel.grams(text) for x in part}
    for block in (7, 64, len(text), len(text) - 1):
        monkeypatch.setattr(string_kernel, "BLOCK", block)
        assert {int(x) for part in string_kernel.grams(text) for x in part} == whole


def test_languages_of_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in string_kernel.predict_documents(odd, string_kernel.learn(odd)).collect()}
    assert (rows[3].lang_pred, rows[4].lang_pred, rows[3].score) == ("und", "und", 0.0) and rows[7].lang_pred != "und"
    none = string_kernel.learn(odd.filter("lang is null"))
    assert {r.lang_pred for r in string_kernel.predict_documents(odd, none).collect()} == {"und"}
    one = string_kernel.learn(odd.filter("lang = 'de'"))
    assert {r.lang_pred for r in string_kernel.predict_documents(odd, one).collect()} <= {"und", "de"}
    assert string_kernel.predict_documents(odd.filter("false"), string_kernel.learn(odd.filter("false"))).count() == 0
    foreign = spark.createDataFrame([(1, "你好"), (2, " 12 -- "), (3, "İ")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in string_kernel.predict_documents(foreign, string_kernel.learn(odd)).orderBy("doc_id").collect()] == [False, True, False]


# 13
def slow_cut(doc_id, text):
    text, n = text or "", len(text or "")
    a, b, c, d = (int(h(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4))
    if not n or c % 100 >= 90 or "<P>" in text or "<S>" in text or "<M>" in text:
        return n, "plain", None, None, text
    low, high = min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1))
    p, m, s = text[:low], text[low:high], text[high:]
    return (n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}")


def test_cuts_of_odd_rows(spark, odd):
    want = sorted(((r.doc_id, *slow_cut(r.doc_id, r.text)) for r in odd.collect()), key=str)
    assert sorted((tuple(r) for r in fill_middle.fill_in_middle(odd).collect()), key=str) == want
    got = sorted((tuple(r) for r in fill_middle.digests(odd).collect()), key=str)
    texts = sorted(((r.doc_id, *slow_cut(r.doc_id, r.text)[:4], h(slow_cut(r.doc_id, r.text)[4]), h(r.text or "")) for r in odd.collect()), key=str)
    assert got == texts
    assert fill_middle.digests(odd.filter("false")).count() == 0 and fill_middle.fill_in_middle(odd.filter("false")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 400), st.text(alphabet="<PSM>ab \n1é\U0001f600", max_size=30), st.sampled_from(sorted(fill_middle.UNITS)))
def test_outputs_give_the_text_back(doc_id, text, unit):
    n, form, _, _, output = fill_middle.transform(doc_id, text, unit)
    assert fill_middle.restored(output, form) == text and n <= len(text)
    if unit == "code point":
        assert (n, form, output) == (slow_cut(doc_id, text)[0], slow_cut(doc_id, text)[1], slow_cut(doc_id, text)[4])


def test_units_are_runs_and_lines():
    points = np.frombuffer("ab  12\n\nc!".encode("utf-32-le"), "<u4")
    assert fill_middle.boundaries(points, "run").tolist() == [0, 2, 4, 6, 8, 9, 10]
    assert fill_middle.boundaries(points, "line").tolist() == [0, 7, 8, 10]
    assert fill_middle.boundaries(points[:0]).tolist() == [0]
