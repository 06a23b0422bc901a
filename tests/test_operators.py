"""Small cases of the operators that SQL doesn't check."""

import hashlib
import random
import re
from urllib.parse import urljoin

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import answers, text
from loomline.operators import dedup, html, mixing, packing, puzzles, quality, scoring
from loomline.sources import readers, sinks
from loomline.streaming import stages


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<int>' if isinstance(v, list) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


def test_redaction_against_the_patterns_run_by_python(spark):
    """Sequential, idempotent, with the phone prefix that tells numbers from lists; also over a whole table."""
    texts = ["write a.b@c.org, 10.0.0.1 or 0912345678; list 1, 2, 3", "+84 912 345 678 and 84-912-345-678", "12 345 678, 2019-2020-2021 and (555) 123-4567", "<|pii|> 0912.345.678x", "", "x@y.z@q 1.2.3.4.5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    want = {}
    for r in docs.collect():
        t, n = r.text, 0
        for pattern in (text.EMAIL, text.IP, text.PHONE):
            n, t = n + len(re.findall(pattern, t, re.A)), re.sub(pattern, "<|pii|>", t, flags=re.A)
        want[r.doc_id] = (t, n)
    got = text.redact(docs)
    assert {r.doc_id: (r.text, r.replaced) for r in got.collect()} == want
    assert [want[i][1] for i in range(4)] == [3, 2, 0, 0] and text.redact(got).filter("replaced <> 0").isEmpty()


def test_images_outside_resolves_sources(spark):
    html_text = "<img src='/x.png'><nav><img src=y.png><img src=http://b/z.png></nav><img src='../w.png'>"
    pages = spark.createDataFrame([(1, "http://a/d/e/f.html?q", html_text)], "page_id long, url string, html string")
    got = html.images_outside(html.extract(pages), pages)
    assert sorted(r.src for r in got.collect()) == ["http://a/d/e/y.png", "http://b/z.png"]
    sources = ["a.png", "./a.png", "../a.png", "../../../a.png", "/r/a.png", "//c/a.png", "https://q/x?y#z"]
    rows = spark.createDataFrame([(s, b) for s in sources for b in ("http://h.org", "http://h.org/", "http://h.org/d/e/f.html?x=/y#z")], "s string, b string")
    for r in rows.withColumn("u", html.absolute_url(F.col("s"), F.col("b"))).collect():
        assert r.u == urljoin(r.b, r.s), r


def test_numbering_in_buckets(spark):
    rows = spark.range(0, 300_000, 7).selectExpr("id", "id % 3 as g").union(spark.createDataFrame([(-5, 0), (10**12, 1)], "id long, g long"))
    got = mixing.numbered(rows, mixing.by_id("id"), ["id"], "i", ["g"], "n").toPandas().sort_values(["g", "id"])
    assert (got.groupby("g").cumcount() == got.i).all() and (got.groupby("g").id.transform("size") == got.n).all()


def test_ngrams(spark):
    grams = text.word_ngrams(F.split("t", " "), 3)
    assert one(spark, grams, t="a b") == []
    assert one(spark, grams, t="a b c") == ["a b c"]
    assert one(spark, grams, t="a b c d") == ["a b c", "b c d"]


def test_last_boxed_matches_braces(spark):
    assert one(spark, answers.last_boxed(F.col("t")), t="\\boxed{1} and \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert one(spark, answers.last_boxed(F.col("t")), t="\\boxed{1") is None


def test_answers(spark):
    assert one(spark, answers.normalise_answer(F.col("t")), t="100") == "100"
    assert one(spark, answers.normalise_answer(F.col("t")), t="1,000.50") == "1000.5"
    assert one(spark, answers.choice_letter(F.col("t")), t="A or B") == "B"
    assert one(spark, answers.vqa_accuracy(F.lit("a"), F.array(*map(F.lit, "aaab"))), t="") == (3 * 2 / 3 + 1) / 4


def test_collapse_markers(spark):
    got = quality.collapse_markers(F.split("t", ","), "E")
    assert one(spark, got, t="a,E,E,b,E,E") == ["a", "E", "b"]


def test_minhash_links_near_copies_and_no_others(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(20)]
    near = [b.rsplit(" ", 1)[0] + " changed" for b in base[:10]]
    docs = spark.createDataFrame(list(enumerate(base + near + base[:3])), "doc_id long, text string")
    kept = {r[0] for r in dedup.minhash_dedup(docs).select("doc_id").collect()}
    assert kept <= set(range(30)) and set(range(10, 20)) <= kept and len(kept & set(range(20, 30))) <= 1


def test_fails_closed_without_a_benchmark(spark):
    with pytest.raises(ValueError, match="benchmark"):
        dedup.benchmark_grams(spark.createDataFrame([(1, "too short")], "item_id long, text string"))


def test_html_nodes():
    got = html.nodes("<nav>x</nav><h1>A</h1><p>one <b>two</b><br>three</p><img src='/i.png' alt='z'><p>after</p><script>no()</script>", "http://a.b/c")
    assert got == [("text", "A\n\none two\nthree", None, None), ("image", None, "http://a.b/i.png", "z"), ("text", "after", None, None)]
    assert html.nodes(None, None) == []


def shown(text, **rules):
    return [n[1] if n[0] == "text" else n[0] + ":" + n[2] for n in html.nodes(text, "http://a/", html.Rules(**rules))]


def test_html_rules():
    page = "<div class='x footer'><p>gone<img src=a.png></p></div><p>one</p><a class='b more-link c'>read on</a><p>two</p>"
    assert shown(page) == ["gone", "image:http://a/a.png", "one\n\nread on\n\ntwo"]
    assert shown(page, delete=html.BLOG_DELETE, replace=html.BLOG_REPLACE) == ["one\n\nEND_OF_DOCUMENT_TOKEN_TO_BE_REPLACED\n\ntwo"]
    assert shown("<img class=footer src=a.png><p>x", delete=html.BLOG_DELETE) == ["x"]
    assert shown("<p>a<br class=more-link>b</p>", replace={".more-link": "!"}) == ["a!b"]
    dated = "<div class='post-date'>1 May <b>2020</b><p>kept</p> gone<div>kept too</div></div><p>after</p>"
    assert shown(dated) == ["1 May 2020\n\nkept\n\ngone\n\nkept too\n\nafter"] and shown(dated, dates=True) == ["kept\n\nkept too\n\nafter"]
    cut = "<div><p>a</p><h2 id=ref>Refs</h2><p>b</p><ul><li>c</ul></div><p>d</p>"
    assert shown(cut, cut_after=("ref", "note")) == ["a\n\nd"]
    assert shown("<p>x</p><br id=note><p>y</p>", cut_after=("ref", "note")) == ["x"]


def test_media_nodes():
    assert shown("<p>a</p><video src=v.mp4></video><audio><source><source src='b,c'><source src=d.mp3></audio><source src=e.mp3><p>z</p>") == ["a", "video:http://a/v.mp4", "z"]
    assert shown("<audio><source src=d.mp3><source src=e.mp3></audio>") == ["audio:http://a/d.mp3"]


@pytest.mark.parametrize("rule,tag,attrs,want", [("div", "div", {}, True), ("div.a#b", "div", {"class": "x a", "id": "b"}, True), ("div.a", "p", {"class": "a"}, False), ("[class~='a']", "p", {"class": "ab"}, False), ("[href^=http], .z", "a", {"href": "https://x"}, True), ("*[data-x]", "i", {"data-x": None}, True), ("[title$='.x,y']", "p", {"title": "q.x,y"}, True)])
def test_selectors(rule, tag, attrs, want):
    assert html.selector(rule)(tag, attrs) is want


@pytest.mark.parametrize("rule", ["div > p", "", "a:hover", "div p"])
def test_selectors_that_are_not_compound(rule):
    with pytest.raises(ValueError, match="compound"):
        html.selector(rule)


def test_infix(spark):
    cases = {"add(a,const_2)": "(a + 2)", "divide(1,2), subtract(#0,#0), multiply(#1,3)": "(((1 / 2) - (1 / 2)) * 3)", "add(#0,1)": None, "exp(2,const_3), add(#0,1)": "(exp(2,3) + 1)", "const_7": "7", "": ""}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "p string").withColumn("x", answers.infix(F.col("p"))).collect()
    assert {r.p: r.x for r in rows} == {**cases, None: None}


def test_sampling_strategies(spark):
    entries = [("one:Chat", None, "text"), ("two:chat", None, "text"), ("clips", "x_30_60_s.json", "video"), ("films_60_120_s", "x_0_30_s", "video"), ("Web_GPT", None, "image"), ("multiimage_z", None, "?"), (None, None, None)]
    frame = spark.createDataFrame(entries, "name string, path string, modality string")
    got = packing.sampling_fractions(frame, {"text": 14, "image": 50, "multiimage": 5, "video": 36}, 0.5, 0.3, ("one", "two"), ("gpt",))
    assert {r.name: r.strategy for r in got.collect()} == {"one:Chat": "random:9.8%", "two:chat": "random:4.2%", "clips": "random:18.0%", "films_60_120_s": "random:36.0%", "Web_GPT": "random:100%", "multiimage_z": "random:5.0%", None: "random:100.0%"}


def test_image_text_pairs(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<img src=x.png><p>t</p><img src=y.png>")], "page_id long, url string, html string")
    got = html.image_text_pairs(html.extract(pages)).orderBy("pos").collect()
    assert [(r.src, r.text) for r in got] == [("http://a/x.png", "t"), ("http://a/y.png", None)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40), st.integers(1, 4), st.integers(20, 60))
def test_multipack_packs_every_length_that_fits(lengths, bins, capacity):
    steps = mixing.multipack(lengths, bins, capacity)
    assert all((s == -1) == (n > capacity) for s, n in zip(steps, lengths, strict=True))
    for step in set(steps) - {-1}:
        assert mixing.lpt_fits([n for n, s in zip(lengths, steps, strict=True) if s == step], bins, capacity)


def test_first_fit_and_next_fit(spark):
    assert mixing.greedy_first_fit([(5, 1), (6, 1), (5, 0), (20, 0)], 10, 2) == [0, 1, 0, -1]
    assert one(spark, mixing.next_fit(F.col("a"), 10), a=[4, 6, 1, 12, 3]) == [0, 0, 1, 2, 3]


def test_cubic_permutation_is_a_bijection(spark):
    got = spark.range(101).select(mixing.cubic_permutation(F.col("id"), 7, 101)).collect()
    assert len({r[0] for r in got}) == 101


def test_dihedral_round_trip():
    grid = [[1, 2, 3], [4, 5, 6]]
    made = [puzzles.dihedral(grid, k) for k in range(8)]
    assert len({str(g) for g in made}) == 8
    assert all(puzzles.undo_dihedral(g, k) == grid for k, g in enumerate(made))
    assert puzzles.crop(puzzles.encode(grid)) == grid


def test_maze_and_sudoku(spark):
    assert puzzles.maze_distance(["S#G", "   "]) == 4
    assert puzzles.maze_distance(["S#G"]) == -1
    base = [[(3 * (r % 3) + r // 3 + c) % 9 + 1 for c in range(9)] for r in range(9)]
    assert one(spark, puzzles.sudoku_valid(F.col("a")), a=sum(base, [])) is True
    turned = puzzles.sudoku_symmetry(base, [0, 2, 1, 3, 4, 5, 6, 7, 8, 9], [1, 0, 2, 3, 4, 5, 6, 7, 8], list(range(9)), True)
    assert one(spark, puzzles.sudoku_valid(F.col("a")), a=sum(turned, [])) is True
    assert one(spark, puzzles.sudoku_valid(F.col("a")), a=[1] * 81) is False


def test_nearest_agrees_with_numpy(spark, monkeypatch):
    x = np.random.default_rng(0).standard_normal((50, 8)).astype("float32")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    g = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(g, -np.inf)
    for block in (4096, 2):  # one block of queries, and several
        monkeypatch.setattr(scoring, "QUERY_BLOCK", block)
        monkeypatch.setattr(scoring, "VECTOR_BLOCK", 9)
        got = scoring.nearest(rows.filter("vec_id < 5"), rows, 3).orderBy("query", "rank").collect()
        assert [r.neighbour for r in got] == np.argsort(-g[:5], axis=1)[:, :3].ravel().tolist()


def test_sources(spark, tmp_path):
    assert readers.split_slice("train[10%:30%]") == (0.1, 0.3)
    assert readers.split_slice("train") == (0.0, 1.0)
    assert one(spark, readers.windows_of_tokens(F.col("a"), 2), a=[1, 2, 3, 4, 5]) == [[1, 2], [3, 4]]
    made = []
    for _ in range(2):
        got = sinks.once(spark, str(tmp_path / "stage"), lambda: made.append(1) or spark.range(3).toDF("id"))
    assert got.count() == 3 and made == [1]


def test_stream_gives_the_batch_result(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * i) for i in range(50)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stage = lambda rows: rows.filter(F.length("text") >= 100).select("doc_id")
    for _ in range(2):
        stages.run_available(spark, str(tmp_path / "in"), docs.schema, stage, str(tmp_path / "out"), str(tmp_path / "state"), 2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in stage(docs).collect())


def test_whole_texts_are_scored_numbered_and_packed(spark, tmp_path):
    from loomline.plans import registry

    texts = ["abcabd", "é", "", "x" * 5000, "abcdefghij" * 10 + "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id as conv_id", "0L as turn", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    ids = {r.doc_id: r.ids for r in registry.QUERIES["document_ngram_ids"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        want = {sum((b + 1) * 256 ** (n - 1 - k) for k, b in enumerate(raw[j : j + n])) for n in range(1, 5) for j in range(len(raw) - n + 1)}
        assert len(ids[i]) == len(want) and set(ids[i]) == want
    scores = {r.conv_id: r.anls for r in registry.QUERIES["anls_scores_whole"](spark, str(tmp_path)).collect()}
    assert abs(scores[4] - 100 / 102) < 1e-9 and scores[2] == 0
    steps = {r.doc_id: r.step for r in registry.QUERIES["multipacked"](spark, str(tmp_path)).collect()}
    assert steps[3] == -1 and all(steps[i] >= 0 for i in (0, 1, 2, 4))


def test_web_checks_in_order(spark):
    from loomline.operators import quality

    stop, flagged, common = frozenset({"the", "of", "a"}), frozenset({"vile"}), frozenset("the of a bird cat dog fox hen owl pig ram rat saw met by on old in new red vile".split())
    good = "The bird of a cat saw the dog, a fox of the hen met a new owl."
    check = lambda text: quality.web_check(text, stop, flagged, common)
    assert check(good) is None
    wrong = {
        "the bird": "number_words",
        "the a of the " * 9: "character_repetition",
        "the bird of a cat met dog, " * 2 + "old": "character_repetition",
        "the a of !!!! #### $$$$ old %%%": "special_characters",
        "bird cat dog fox hen owl pig ram": "stop_words",
        "the vile bird of a cat": "flagged_words",
        "the bird of a cat saw the dog on a red old fox of the hen": "punctuation",
        "the zzz of a qqq": "common_words",
    }
    assert {t: check(t) for t in wrong} == wrong
    words = "the a of bird cat".split()
    spaced = " ".join(words) + " " + "  ".join(words) + "."
    assert quality.web_check(spaced, stop, flagged, common, quality.Web(max_character_repetition=1.0)) == "word_repetition"
    rows = [(1, good + "\n\nzzz qqq\n\nEND", 2), (2, good, 0), (3, None, 1), (4, "zzz", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r.doc_id: (r.text, r.failed) for r in quality.web_document_filter(docs, list(stop), list(flagged), list(common | {"end"}), images="n").collect()}
    assert got == {1: (good + "\n\nEND", None), 2: (good, "number_images"), 3: ("", "number_words"), 4: ("", "number_words")}


NP_TRANSFORMS = [lambda a: a, lambda a: np.rot90(a), lambda a: np.rot90(a, 2), lambda a: np.rot90(a, 3), np.fliplr, np.flipud, lambda a: a.T, lambda a: np.fliplr(np.rot90(a))]


def test_predictions_are_put_back_and_voted_on(spark):
    """Every named transform of ragged shapes there and back, tokens and crops against the plain functions, keys against SHA-256."""
    rng = np.random.default_rng(4)
    grids = [rng.integers(0, 10, shape).tolist() for shape in ((1, 1), (2, 3), (30, 30), (30, 1), (4, 30), (7, 7))]
    mapping = [0, 4, 2, 9, 1, 3, 5, 6, 8, 7]
    rows = spark.createDataFrame([(i, g, mapping) for i, g in enumerate(grids)], "i int, g array<array<int>>, m array<int>")
    for k in range(8):
        made = rows.withColumn("a", puzzles.augmented(F.col("g"), k, F.col("m"))).withColumn("n", puzzles.named_augmentation(puzzles.augmented_name(F.lit("p"), k, F.col("m"))))
        made = made.withColumn("t", puzzles.encoded(F.col("a"))).withColumn("b", puzzles.unaugmented(puzzles.cropped(F.col("t")), F.col("n.transform"), F.col("n.mapping")))
        for r in made.select("*", puzzles.grid_key(F.col("b")).alias("key")).collect():
            want = NP_TRANSFORMS[k](np.array(mapping)[np.array(r.g)]).tolist()
            assert r.a == want and r.t == puzzles.encode(want) and r.b == r.g and r.n.name == "p"
            assert r.key == hashlib.sha256(bytes([len(r.g), len(r.g[0])]) + bytes(sum(r.g, []))).hexdigest()
    square = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    moved = spark.range(1).select(puzzles.encoded(square, 5, 1, F.lit(2)), puzzles.encoded(square, 2, 1)).first()
    assert tuple(moved) == (puzzles.encode([[1, 2], [3, 4]], 5, 1, 2), None)
    for _ in range(20):
        tokens = np.where(rng.random(25) < 0.2, 1, rng.integers(2, 12, 25)).tolist()
        assert one(spark, puzzles.cropped(F.col("a"), 5), a=tokens) == (puzzles.crop(tokens, 5) or [])
    plain = one(spark, puzzles.named_augmentation(F.col("a")), a="name")
    assert (plain.name, plain.transform, plain.mapping) == ("name", 0, None)


def test_votes_of_tests_that_share_an_input(spark):
    one_grid, other = [[1, 2]], [[3], [4]]
    tests = spark.createDataFrame([("p", 0, one_grid, other), ("p", 1, one_grid, one_grid), ("q", 0, other, other), ("r", 0, other, one_grid)], "name string, test int, input array<array<int>>, output array<array<int>>")
    said = [(1, one_grid, other, 1.0), (1, one_grid, other, 0.0), (1, one_grid, one_grid, 5.0), (2, other, one_grid, 0.0), (0, other, other, 9.0), (3, one_grid, one_grid, 0.0)]
    outputs = spark.createDataFrame([(i, puzzles.encode(a), puzzles.encode(b), q) for i, a, b, q in said], "identifier int, inputs array<int>, preds array<int>, halt_logit double")
    names = spark.createDataFrame([(0, "blank"), (1, "p"), (2, "q"), (3, "r")], "identifier int, name string")
    voted = puzzles.test_votes(puzzles.predictions(outputs, names), tests)
    got = sorted((r.name, r.test, r.rank, r.votes, r.right) for r in voted.collect())
    assert got == [("p", 0, 1, 2, True), ("p", 0, 2, 1, False), ("p", 1, 1, 2, False), ("p", 1, 2, 1, True), ("q", 0, 1, 1, False)]
    scores = {r.k: r.score for r in puzzles.pass_at(voted, tests, [1, 2]).collect()}
    assert scores == {1: pytest.approx((1 / 2) / 3), 2: pytest.approx(1 / 3)}


def test_interleaved_shards_are_drawn_uniformly(spark):
    """Each next row comes from any live shard alike, shards keep their order, and reruns agree."""
    sizes = {"a": 4000, "b": 2000, "c": 2000, None: 500}
    rows = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "shard string, position long").repartition(7)
    made = mixing.random_interleave(rows, "shard", "position", "x")
    got = [(r.shard, r.position) for r in made.orderBy("at", "shard", "position").collect()]
    assert len(got) == 8500 and got == [(r.shard, r.position) for r in mixing.random_interleave(rows.repartition(3), "shard", "position", "x").orderBy("at", "shard", "position").collect()]
    left, draws, chi = dict(sizes), {s: 0 for s in sizes}, 0.0
    for shard, position in got:
        assert position == sizes[shard] - left[shard]
        live = [s for s in left if left[s]]
        if len(live) == 4:
            draws[shard] += 1
        left[shard] -= 1
    n = sum(draws.values())
    chi = sum((c - n / 4) ** 2 / (n / 4) for c in draws.values())
    assert n > 1500 and chi < 16.3  # 0.999 of the distribution with three degrees of freedom
    pairs = [(got[i][0], got[i + 1][0]) for i in range(1500)]
    same = sum(a == b for a, b in pairs) / len(pairs)
    assert 0.2 < same < 0.3  # draws don't depend on the one before


def test_buffer_shuffle_moves_rows_about_a_buffer(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "place").repartition(5)
    moved = sorted((r.place, r.to) for r in mixing.buffer_shuffled(rows, "place", 100, "to", "s").collect())
    assert sorted(t for _, t in moved) == list(range(20_000))
    steps = np.array([t - p for p, t in moved])[2000:-2000]
    assert 60 < np.abs(steps).mean() < 150 and abs(steps.mean()) < 5 and np.abs(steps).max() < 3000
    again = mixing.shard_stream(spark.createDataFrame([(s, i) for s in "abc" for i in range(50)], "s string, i long"), "s", "i", 8)
    found = again.collect()
    assert len({(r.batch, r.slot) for r in found}) == 150 and {r.batch for r in found} == set(range(19)) and max(r.slot for r in found) == 7


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 4)), max_size=60))
def test_first_fit_takes_the_first_pack_with_room(items):
    packs, want = [], []
    for t, i in items:
        k = next((k for k, (a, b) in enumerate(packs) if a + t <= 10 and b + i <= 3), len(packs)) if t <= 10 and i <= 3 else -1
        if k == len(packs):
            packs.append([0, 0])
        if k >= 0:
            packs[k] = [packs[k][0] + t, packs[k][1] + i]
        want.append(k)
    assert mixing.greedy_first_fit(iter(items), 10, 3) == want


def test_next_fit_and_shards(spark):
    rows = spark.createDataFrame([([3, 4, 5, 20, 0, 1],), ([],), (None,), ([7] * 2000,)], "a array<int>")
    assert [r[0] for r in rows.select(mixing.next_fit(F.col("a"), 8)).collect()] == [[0, 0, 1, 2, 3, 3], [], None, list(range(2000))]
    assert mixing.shards_for(spark.range(10)) == 8 and mixing.shards_for(spark.range(mixing.SHARD_ROWS * 9 + 1)) == 10


def test_places_of_sparse_repeated_and_null_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, rng.randrange(-(1 << 62), 1 << 62), 5]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k long, i long").repartition(6)
    first = lambda v: (v is not None, v or 0)  # noqa: E731  nulls first
    got = mixing.placed(frame, ["k", "i"], "at", ["g"], "n").collect()
    for g in (None, "a", "b", "c"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (first(r[1]), r[2]))
        assert [(r.k, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.at)] == [r[1:] for r in mine]
        assert sorted(r.at for r in got if r.g == g) == list(range(len(mine))) and {r.n for r in got if r.g == g} == {len(mine)}
    whole = mixing.placed(frame, ["i"], "at", total="n").collect()
    assert all(r.at == r.i and r.n == 3000 for r in whole)
    assert mixing.placed(frame.filter("false"), ["i"], "at", ["g"], "n").count() == 0
