"""Ids of byte n-grams."""

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import tokens


def test_ids_of_bytes_are_those_of_the_arrays_in_their_order(spark):
    texts = [(0, "abcabd"), (1, "é😀é😀"), (2, ""), (3, None), (4, "x"), *((10 + i, "\x00ab" * i) for i in range(80))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in tokens.byte_ngram_ids(docs).collect()}
    listed = spark.createDataFrame([(i, list((t or "").encode())) for i, t in texts], "doc_id long, b array<bigint>")
    assert got == {r.doc_id: r.ids for r in listed.select("doc_id", T.ngram_ids(F.col("b"), 256).alias("ids")).collect()}
