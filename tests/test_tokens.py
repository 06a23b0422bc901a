"""Token ids of whole texts, in blocks and in shards, against the library and a plain stream."""

import hashlib

import pytest

from loomline.operators import tokens
from loomline.plans import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def md5(ids):
    return hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()


@pytest.fixture(scope="module")
def known(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    encoding = tokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return {r.doc_id: encoding.encode_ordinary(r.text) for r in rows}


def test_blocks_are_cuts_of_one_stream(spark, known):
    order = sorted(known, key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
    stream = [t for i in order for t in [*known[i], 50_257]]
    want = [stream[i : i + 2048] for i in range(0, len(stream), 2048)]
    got = sorted(tuple(r) for r in packing.token_id_blocks(spark, FOLDER).collect())
    assert got == [(i, len(b), md5(b)) for i, b in enumerate(want)]


def test_shards_hold_every_document(spark, known):
    got = sorted(tuple(r) for r in packing.token_id_shards(spark, FOLDER).collect())
    assert got == sorted((len(ids), md5(ids)) for ids in known.values())


def test_odd_texts_and_small_blocks(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 5000), (4, "é\U0001f600\n\n"), (None, "x y")], "doc_id long, text string")
    found = {r.doc_id: r.ids for r in tokens.token_ids(docs, path, pattern).collect()}
    assert found[1] == found[2] == [] and tokens.encoding(path, pattern).decode(found[4]) == "é\U0001f600\n\n"
    made = spark.createDataFrame([(i, list(range(i))) for i in range(8)], "doc_id long, ids array<int>")
    blocks = [r.ids for r in tokens.token_blocks(made, 5, -1).orderBy("block").collect()]
    assert all(len(b) == 5 for b in blocks[:-1]) and sum(map(len, blocks)) == 28 + 8 and sum(blocks, []).count(-1) == 8
    assert tokens.token_blocks(made.filter("false"), 5, -1).count() == 0
