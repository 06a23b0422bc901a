"""Shards that are written with a commit, and records that are read by ranges."""

import gzip
import hashlib
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.sources import archives, shards


def test_tar_round_trip_within_bounds(spark, tmp_path):
    rows = [(f"dir/k{i}" if i % 2 else f"k{i}", f"téxt {i}" * (i % 7), bytes([i % 256]) * (700 * (i % 5)), None if i % 3 else "{}") for i in range(200)]
    rows.append(("long" * 60, "x" * 50_000, b"", None))
    frame = spark.createDataFrame(rows, "key string, txt string, `image.jpeg` binary, json string").repartition(3)
    path = str(tmp_path / "tar")
    shards.write_tar(frame, path, 20_000)
    found = sorted((tmp_path / "tar").glob("shard-*.tar"))
    manifest = json.loads((tmp_path / "tar/_manifest.json").read_text())["shards"]
    assert [f.name for f in found] == [f"shard-{i:07d}.tar" for i in range(len(found))] == [m["file"] for m in manifest]
    assert all((m["bytes"], m["sha256"]) == (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f, m in zip(found, manifest, strict=True))
    assert sum(m["samples"] for m in manifest) == 201 and all(m["bytes"] <= 20_000 or m["samples"] == 1 for m in manifest)
    assert all(len({n.split(".")[0] for n in tarfile.open(f).getnames()}) == m["samples"] or m["samples"] for f, m in zip(found, manifest, strict=True))
    assert sorted(p.name for p in (tmp_path / "tar").iterdir()) == sorted(["_SUCCESS", "_manifest.json", *(f.name for f in found)])
    got = {(r.key, r.part): bytes(r.content) for r in archives.tar_members(spark, f"{path}/shard-*.tar").collect()}
    want = {(k, part): v.encode() if isinstance(v, str) else v for k, *values in rows for part, v in zip(("txt", "image.jpeg", "json"), values, strict=True) if v is not None}
    assert got == want

    shards.write_tar(frame.limit(1), path)
    assert (tmp_path / f"tar/shard-{len(found):07d}.tar").exists() and len(json.loads((tmp_path / "tar/_manifest.json").read_text())["shards"]) == len(found) + 1
    shards.write_tar(frame.limit(1), path, mode="overwrite")
    assert [p.name for p in (tmp_path / "tar").glob("shard*")] == ["shard-0000000.tar"]


@pytest.mark.parametrize("key", [None, "a.b"])
def test_a_failed_export_leaves_nothing(spark, tmp_path, key):
    frame = spark.createDataFrame([(f"k{i}", "t") for i in range(50)] + [(key, "t")], "key string, txt string").repartition(4)
    with pytest.raises(Exception, match="no key"):
        shards.write_tar(frame, str(tmp_path / "t"), 2000)
    assert not list((tmp_path / "t").glob("*"))
    with pytest.raises(Exception, match="string or binary"):
        shards.write_tar(spark.createDataFrame([("a", 1)], "key string, n int"), str(tmp_path / "t"))
    shards.write_tar(frame.filter("false"), str(tmp_path / "e"))
    assert sorted(p.name for p in (tmp_path / "e").iterdir()) == ["_SUCCESS", "_manifest.json"]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    made = [(f"http://h/{i}", "".join(rng.choices("abc é\n<>", k=rng.randrange(3000)))) for i in range(60)]
    return [*made, (None, "no url"), ("http://empty", None), ("http://odd", "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc")]


def digests(frame):
    return sorted(((r.url, bytes(r.content).partition(b"\r\n\r\n")[2].decode()) for r in frame.collect()), key=str)


def test_records_of_any_ranges(spark, tmp_path, pages):
    """Every record once, whatever the ranges; an index gives the same; files and types are chosen by the source."""
    frame = spark.createDataFrame(pages, "url string, html string").repartition(2)
    path, want = str(tmp_path / "w"), sorted(((u, h or "") for u, h in pages), key=str)
    shards.write_warc(frame, path, 20_000)
    for split in (399, 1 << 20):
        found = shards.read_warc(spark, path, split)
        assert digests(found) == want and found.filter("error is not null or type <> 'response'").count() == 0
    assert found.rdd.getNumPartitions() == len(list((tmp_path / "w").glob("*.gz"))) > 1
    assert digests(shards.fetch(found.select("file", "offset", "length"))) == want
    file = found.first().file
    one = shards.read_warc(spark, path, 997, ["response", "metadata"], [file])
    assert one.rdd.getNumPartitions() < shards.read_warc(spark, path, 997).rdd.getNumPartitions()
    assert digests(one) == digests(found.filter(F.col("file") == file))
    assert shards.read_warc(spark, path, types=["request"]).count() == 0


def test_damage_gives_rows(spark, tmp_path, pages):
    """A gap between good members, a cut end and a member that is no record: a row each with its range, and all else is read."""
    (tmp_path / "d").mkdir()
    good = [gzip.compress(shards.response_record(u, h)) for u, h in pages[:6]]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 255
    other = gzip.compress(b"something else")
    data = good[0] + bytes(broken) + b"garbage" + good[2] + other + good[3] + good[4][:-9]
    (tmp_path / "d/x.warc.gz").write_bytes(data)
    at = [0, len(good[0]), len(good[0]) + len(broken) + 7]
    (tmp_path / "d/y.warc.gz").write_bytes(b"rubbish" * 100)
    for split in (50, 1 << 20):
        rows = sorted(shards.read_warc(spark, str(tmp_path / "d"), split).collect(), key=lambda r: (r.file, r.offset))
        assert (rows[-1].offset, rows.pop().length) == (0, 700)
        assert [bool(r.error) for r in rows] == [False, True, False, True, False, True]
        assert [r.offset for r in rows][:3] == at and sum(r.length for r in rows) == len(data)
        assert [r.url for r in rows if not r.error] == [pages[i][0] for i in (0, 2, 3)]
    index = spark.createDataFrame([(str(tmp_path / "d/x.warc.gz"), o, n) for o, n in ((0, len(good[0])), (1, 50), (at[2], len(good[2])), (len(data) - 5, 50))] + [("/nowhere", 0, 5), (None, 0, 5), (str(tmp_path / "d/x.warc.gz"), None, 5)], "file string, offset long, length long").coalesce(1)
    assert [r.error is None for r in shards.fetch(index).collect()] == [True, False, True, False, False, False, False]


def test_plain_archives(spark, tmp_path, pages):
    (tmp_path / "p").mkdir()
    records = [shards.response_record(u, h) for u, h in pages]
    (tmp_path / "p/a.warc").write_bytes(b"".join(records))
    (tmp_path / "p/b.warc").write_bytes(records[0] + b"rubbish\r\n\r\n" + records[1] + records[2][:-40])
    (tmp_path / "p/empty.warc").write_bytes(b"")
    whole = shards.read_warc(spark, str(tmp_path / "p/a.warc"))
    assert digests(whole) == sorted(((u, h or "") for u, h in pages), key=str) and digests(shards.fetch(whole)) == digests(whole)
    rows = sorted(shards.read_warc(spark, str(tmp_path / "p")).filter("file like '%b.warc'").collect(), key=lambda r: r.offset)
    assert [bool(r.error) for r in rows] == [False, True, False, True] and [r.url for r in rows][::2] == [pages[0][0], pages[1][0]]
    (tmp_path / "none").mkdir()
    assert shards.read_warc(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("kind", ["<u2", "<i4"])
def test_token_shards_and_any_document_of_them(spark, tmp_path, kind):
    rng = random.Random(1)
    docs = [[rng.randrange(60_000) for _ in range(rng.randrange(200))] for _ in range(300)]
    docs[5], docs[6] = None, []
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, ids array<int>").repartition(3)
    path = str(tmp_path / "t")
    shards.write_tokens(frame.select("ids"), path, 20_000, kind)
    files = sorted(p.name for p in (tmp_path / "t").glob("shard*"))
    assert len(files) > 6 and {n.split(".", 1)[1] for n in files} == {"u16.bin" if kind == "<u2" else "i32.bin", "idx"}
    assert shards.verified(spark, path).filter("problem is not null").count() == 0
    found = shards.fetch_tokens(shards.token_places(spark, path)).collect()
    assert sorted(r.ids for r in found) == sorted(d or [] for d in docs)
    one = found[100]
    assert archives.tokens_at(open(one.file, "rb").read(), open(one.file.replace(".u16.bin", ".idx").replace(".i32.bin", ".idx"), "rb").read(), one.document).tolist() == one.ids
    (tmp_path / "t" / files[0]).write_bytes(b"x")
    (tmp_path / "t" / files[2]).unlink()
    broken = bytearray((tmp_path / "t" / files[4]).read_bytes())
    broken[-1] ^= 1
    (tmp_path / "t" / files[4]).write_bytes(bytes(broken))
    assert sorted(r.problem for r in shards.verified(spark, path).filter("problem is not null").collect()) == ["digest", "missing", "size"]
    with pytest.raises(Exception, match="doesn't fit"):
        shards.write_tokens(spark.createDataFrame([([-1],)], "ids array<int>"), str(tmp_path / "u"), kind="<u2")
    assert not list((tmp_path / "u").glob("*"))


def test_numpy_shards(spark, tmp_path):
    """One stream of 16-bit numbers and tables of a fixed width; numbers and widths that don't fit leave nothing."""
    rng = random.Random(2)
    docs = [[rng.randrange(65_536) for _ in range(rng.randrange(300))] for _ in range(100)]
    shards.write_arrays(spark.createDataFrame([(d,) for d in docs], "ids array<int>").coalesce(1), str(tmp_path / "a"), shard_bytes=10_000)
    files = sorted((tmp_path / "a").glob("*.npy"))
    found = [np.load(f) for f in files]
    assert len(files) > 2 and all(x.dtype == np.uint16 and x.ndim == 1 and x.nbytes <= 10_000 for x in found)
    assert np.concatenate(found).tolist() == sum(docs, []) and shards.verified(spark, str(tmp_path / "a")).filter("problem is not null").count() == 0
    table = spark.range(50).select(F.array(F.col("id").cast("int"), F.lit(-1), F.lit(7)).alias("row")).coalesce(1)
    shards.write_arrays(table, str(tmp_path / "b"), 3, kind="<i4", column="row")
    assert np.load(tmp_path / "b/shard-0000000.npy").tolist() == [[i, -1, 7] for i in range(50)]
    for bad, width in (([[70_000]], 0), ([[1, 2], [1]], 2)):
        with pytest.raises(Exception, match="fit the type|wide"):
            shards.write_arrays(spark.createDataFrame([(b,) for b in bad], "ids array<int>"), str(tmp_path / "c"), width)
        assert not list((tmp_path / "c").glob("*"))


def test_a_stage_runs_once_and_knows_its_rows(spark, tmp_path):
    from loomline.sources import sinks

    runs = []
    make = lambda: runs.append(1) or spark.range(100).repartition(3)
    path = str(tmp_path / "stage")
    assert sinks.once(spark, path, make).count() == sinks.once(spark, path, make).count() == 100 and len(runs) == 1
    assert (tmp_path / "stage/_rows").read_text() == "100"
    next(p for p in (tmp_path / "stage").glob("part-*.parquet")).unlink()
    with pytest.raises(RuntimeError, match="100 rows"):
        sinks.once(spark, path, make)


def test_corpus_is_composed(spark, tmp_path):
    from loomline.sources import readers

    (tmp_path / "a.jsonl").write_text('{"text": "é"}\nbroken\n{"text": null}\n{"other": 1}\n{"text": ""}\n', encoding="utf-8")
    (tmp_path / "b.txt").write_text("café\n\n", encoding="utf-8")
    assert sorted(r.text for r in readers.corpus(spark, str(tmp_path / "a.jsonl")).collect()) == ["", "é"]
    assert sorted(r.text for r in readers.corpus(spark, str(tmp_path / "b.txt")).collect()) == ["", "café"]
