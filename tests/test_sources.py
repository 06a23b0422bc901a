"""Readers, archives, streams and the operators that no SQL checks, on hand-written cases."""

import gzip
import io
import json
import re
import tarfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import answers, chat, text
from loomline.operators import dedup, lexicon, mixing, packing, puzzles, quality, webdocs
from loomline.sources import archives, readers, sinks
from loomline.streaming import stages


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "m": {"k": "v"}}\n{broken\n{"id": 2}\n')
    rows = readers.json_lines(spark, f"{tmp_path}/a.jsonl", "id int, m struct<k:string>").collect()
    assert [(r.id, r.m and r.m.k) for r in rows] == [(1, "v"), (2, None)]
    (tmp_path / "p.csv").write_text("source,question,answer,rating\na,1..,123,5\nb,2..,223,1\n")
    assert [r.source for r in readers.csv_puzzles(spark, f"{tmp_path}/p.csv", 3).collect()] == ["a"]
    (tmp_path / "j").mkdir()
    for name in ("x", "y"):
        (tmp_path / f"j/{name}.json").write_text(json.dumps({"n": name * 2}, indent=1))
    assert sorted((r.name, r.n) for r in readers.json_folder(spark, f"{tmp_path}/j", "n string").collect()) == [("x", "xx"), ("y", "yy")]
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(25)))
    blocks = readers.text_blocks(spark, f"{tmp_path}/t.txt", 10).orderBy("block").collect()
    assert [b.text.count("\n") + 1 for b in blocks] == [10, 10, 5] and blocks[2].text.startswith("line 20")
    left = spark.createDataFrame([("p", 0), ("q", 0)], "id string, nth int")
    right = spark.createDataFrame([("p", 0, "[[1]]")], "id string, nth int, solution string")
    assert sorted(r.solution for r in readers.with_solutions(left, right, ["id", "nth"]).collect()) == ["[[0]]", "[[1]]"]


def test_parquet_sources(spark, tmp_path):
    sinks.write_documents(spark.range(3).toDF("id"), f"{tmp_path}/a/b")
    (tmp_path / "a/b/note.log").write_text("x")
    (tmp_path / "a/bad.parquet").write_text("no parquet")
    assert readers.parquet_tree(spark, f"{tmp_path}/a").count() == 3
    assert readers.first_source(spark, [f"{tmp_path}/none", f"{tmp_path}/a/b"]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.first_source(spark, [f"{tmp_path}/none"])
    rows = spark.range(1).select(readers.frame_indices(F.lit(100), 5).alias("a"), readers.frame_indices(F.lit(3), 5).alias("b")).first()
    assert (rows.a, rows.b) == ([0, 24, 49, 74, 99], [0, 1, 2])


def test_warc_responses(spark, tmp_path):
    def record(kind, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a/\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + "é".encode("latin-1")
    meta = b"HTTP/1.1 200 OK\r\n\r\n<meta charset=utf-8>" + "ü".encode()
    whole = record("request", b"x") + record("response", latin) + record("response", meta)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "b.warc").write_bytes(whole + b"garbage\n")
    rows = archives.warc_html(spark, str(tmp_path)).orderBy("file", "nth").collect()
    assert [(r.nth, r.html, r.error) for r in rows] == [(0, "é", None), (1, "<meta charset=utf-8>ü", None)] * 2 + [(2, None, "no WARC record")]
    assert archives.warc_html(spark, f"{tmp_path}/a.warc.gz", first_only=True).count() == 1


def test_tar_samples(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, content in {"d/1.jpg": b"one", "d/1.json": b'{"url": "u1", "status": "success"}', "d/2.jpg": b"two", "d/2.json": b'{"url": "u2", "status": "failed"}', "d/3.jpg": b"three"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    (tmp_path / "bad.tar").write_bytes(b"no tar" * 300)
    members = archives.tar_members(spark, f"{tmp_path}/*.tar")
    whole, broken = archives.samples(members, ["jpg", "json"])
    assert sorted(r.key for r in whole.collect()) == ["d/1", "d/2"] and [r.key for r in broken.collect()] == ["d/3"]
    assert members.filter("error is not null").count() == 1
    assert [(r.url, bytes(r.content)) for r in archives.images_by_url(members).collect()] == [("u1", b"one")]


def test_token_files(spark):
    docs = [[1, 2, 3], [], [65_535], [7, 8]]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, ids array<int>")
    shards = packing.token_shards(rows, 9, 5)
    back = {}
    for r in archives.indexed_shards(shards).collect():
        here = shards.filter(F.col("shard") == r.shard).orderBy("start").collect()
        for k, row in enumerate(here):
            back[row.doc_id] = archives.tokens_at(r.data, r["index"], k).tolist()
            assert archives.tokens_at(r.data, r["index"], k, 1, 1).tolist() == row.ids[1:2]
    assert back == {i: [*d, 9] for i, d in enumerate(docs)}
    flat = [t for r in archives.array_shards(shards).orderBy("shard").collect() for t in np.load(io.BytesIO(r.npy)).tolist()]
    assert sorted(flat) == sorted(t for d in docs for t in [*d, 9])
    with pytest.raises(Exception, match="fit"):
        archives.array_shards(packing.token_shards(rows, 70_000, 5)).collect()


def test_blocks_drop_only_the_tail(spark):
    rows = spark.createDataFrame([(i, [i] * (i % 5)) for i in range(30)], "doc_id long, ids array<int>")
    blocks = packing.token_blocks(rows, 7, -1).orderBy("block").collect()
    stream = [t for r in packing.token_shards(rows, -1, 10**9).orderBy("start").collect() for t in r.ids]
    assert [b.ids for b in blocks] == [stream[i : i + 7] for i in range(0, len(stream) - 6, 7)]
    with pytest.raises(Exception, match="context"):
        packing.instruction_layout(spark.createDataFrame([(1, 10, 10)], "doc_id long, instruction int, response int"), 24).collect()


def test_blocks_of_text_are_those_of_its_characters(spark):
    texts = ["", "ab", None, "äöü" * 9, "x😀y", "|" * 20, "z" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, ids string")
    blocks = {r.block: r.ids for r in packing.token_blocks(rows, 7, "|").collect()}
    chars = spark.createDataFrame([(i, None if t is None else list(t)) for i, t in enumerate(texts)], "doc_id long, ids array<string>")
    assert len(blocks) > 10 and blocks == {r.block: "".join(r.ids) for r in packing.token_blocks(chars, 7, "|").collect()}


def test_stateful_packing_carries_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, [i] * 3) for i in range(20)], "shard int, tokens array<int>")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stages.run_available(spark, f"{tmp_path}/in", rows.schema, lambda r: stages.pack_tokens(r, 8, 99), f"{tmp_path}/out", f"{tmp_path}/state", 1)
    packed = spark.read.parquet(f"{tmp_path}/out").collect()
    assert Counter(r.shard for r in packed) == {0: 5, 1: 5} and all(len(r.tokens) == 8 for r in packed)
    assert Counter(t for r in packed for t in r.tokens) == Counter([t for i in range(20) for t in (i, i, i, 99)])


def test_symmetries_of_grids(spark):
    grid = [[1, 2, 3], [4, 5, 6]]
    rows = spark.createDataFrame([(1, grid), (2, [[0, 0], [0, 0]])], "puzzle_id long, grid array<array<int>>")
    shown = rows.select("puzzle_id", *[puzzles.turned(F.col("grid"), k).alias(f"k{k}") for k in range(8)]).collect()
    assert all(r[f"k{k}"] == puzzles.dihedral(grid if r.puzzle_id == 1 else [[0, 0], [0, 0]], k) for r in shown for k in range(8))
    made = puzzles.augment(rows, colours=2).collect()
    assert Counter(r.puzzle_id for r in made) == {1: 24, 2: 1}
    assert all(sorted(v for row in r.grid for v in row)[0] >= 1 and len({v for row in r.grid for v in row}) == 6 for r in made if r.puzzle_id == 1)
    assert spark.range(1).select(puzzles.maze_ids(F.array(F.lit("S#"), F.lit(" G"))).alias("x")).first().x == [3, 1, 2, 4]
    ids = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string")
    assert puzzles.pool(ids, "k", 3).count() == 2
    with pytest.raises(ValueError):
        puzzles.pool(ids, "k", 2)
    hashes = spark.range(1).select(dedup.puzzle_hash(F.array(F.lit("x"), F.lit("y"))).alias("a"), dedup.puzzle_hash(F.array(F.lit("y"), F.lit("x"))).alias("b")).first()
    assert hashes.a == hashes.b
    signs = spark.range(1).select(dedup.image_set_signature(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("a")).first()
    assert signs.a == "a\u0001b"


def test_packs_hold_what_fits(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 90 + 1) for i in range(200)], "doc_id long, n int")
    packed = mixing.multipack_by_shard(rows, 3, 4, 100).join(rows, "doc_id").collect()
    filled = Counter()
    for r in packed:
        filled[r.shard, r.step, r.bin] += r.n
    assert len(packed) == 200 and all(r.step >= 0 and 0 <= r.bin < 4 for r in packed) and max(filled.values()) <= 100
    items = rows.select("doc_id", F.col("n").alias("tokens"), (F.col("doc_id") % 3).cast("int").alias("images"))
    packs = mixing.first_fit_by_shard(items, 2, 120, 4).join(items, "doc_id").collect()
    tokens, images = Counter(), Counter()
    for r in packs:
        tokens[r.shard, r["pack"]] += r.tokens
        images[r.shard, r["pack"]] += r.images
    assert len(packs) == 200 and max(tokens.values()) <= 120 and max(images.values()) <= 4


def test_perceptual_hash(spark):
    rng = np.random.default_rng(0)
    image = rng.random((32, 32))
    bits = webdocs.perceptual_bits(image)
    assert webdocs.perceptual_bits(image * 3) == bits and 0 <= bits < 1 << 64
    assert (webdocs.perceptual_bits(image + 0.001 * rng.random((32, 32))) ^ bits).bit_count() <= 6
    rows = spark.createDataFrame([(1, image.ravel().tolist()), (2, [1.0, 2.0]), (3, None)], "i long, p array<double>")
    got = {r.i: r.h for r in rows.select("i", webdocs.perceptual_hash("p").alias("h")).collect()}
    assert got[1] & (1 << 64) - 1 == bits and got[2] is None and got[3] is None


def test_longest_match_tokenizer(spark, tmp_path):
    (tmp_path / "v.txt").write_text("th\nthe\n the\né\n")
    docs = spark.createDataFrame([(1, "the thé x"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in lexicon.token_numbers(docs, f"{tmp_path}/v.txt").collect()}
    assert got == {1: [257, 32, 256, 259, 32, 120], 2: []}
    assert got[1] == lexicon.Trie([b"th", b"the", b" the", "é".encode()]).encode("the thé x".encode())


def test_quality_classifier(spark):
    rows = [(i, ("good fine text here" if i % 2 else "bad poor junk there") + f" w{i % 7}", i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = lexicon.quality_classifier(docs.drop("quality"), docs.select("doc_id", "quality"))
    scored = model.transform(docs.select("quality", text.words(F.col("text")).alias("words")))
    assert scored.filter("prediction = quality").count() == 200


def slow_repetition(t, p):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    ok = True
    for sep, share, chars in (("\n", p.lines, p.line_characters), ("\n\n", p.paragraphs, p.paragraph_characters)):
        lines = [x for x in t.split(sep) if x.strip(" ")]
        once = list(dict.fromkeys(lines))
        if lines:
            ok &= (len(lines) - len(once)) / len(lines) <= share and (sum(map(len, lines)) - sum(map(len, once))) / sum(map(len, lines)) <= chars
    for n, most in p.top:
        counts = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        top = max(counts.values(), default=0)
        ok &= max((len(g) * c for g, c in counts.items() if c == top and c > 1), default=0) / max(1, len(t)) <= most
    for n, most in p.repeated:
        seen, covered = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                covered |= set(range(i, i + n))
            seen.add(g)
        ok &= sum(len(words[i]) for i in covered) / max(1, len(t)) <= most
    return ok


def test_repetition_against_a_plain_version(spark):
    import random

    rng = random.Random(4)
    texts = ["", "a", "x y z"]
    for i in range(150):
        part = " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet", "q"] + [f"w{k}" for k in range(60)], k=40))
        texts.append(rng.choice(["\n", "\n\n", " "]).join([part, *[part[: rng.randrange(200)] for _ in range(i % 4)], " ".join(f"u{rng.randrange(10**6)}" for _ in range(40 * (i % 5)))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.repetition_ok for r in quality.repetition_ok(docs).collect()}
    want = {i: slow_repetition(t, quality.Repetition()) for i, t in enumerate(texts)}
    assert got == want and 10 < sum(want.values()) < 140


def test_answers_and_summaries(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(answers.answers_equal(F.lit("1,000"), F.lit("1000.0"))) and not one(answers.answers_equal(F.lit("100"), F.lit("1")))
    parts = answers.summary_sections(F.lit("# Summary\nshort\n# Details\nlong one"))
    assert (one(parts[0]), one(parts[1])) == ("short", "long one")
    assert one(chat.conflicts(F.array(F.lit("a"), F.lit("b")), {"a": ["b"]})) and not one(chat.conflicts(F.array(F.lit("a")), {"a": ["b"]}))
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2)], "doc long, src string, pos int")
    assert sorted(r.pos for r in dedup.first_in_document(rows, "doc", "src", "pos").collect()) == [0, 2]
    links = dedup.near_links(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "q"), (4, None), (5, ""), (6, "Q!")], "doc_id long, text string"), bands=2)
    assert sorted((r.a, r.b, r.similarity) for r in links.collect()) == [(1, 2, 1.0), (3, 6, 1.0)]
