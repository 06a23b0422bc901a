"""The statistics that routing makes are those of the operator, made once."""

import loomline.plans.registry  # noqa: F401  (first, for plans import each other)
from pyspark.sql import functions as F

from loomline.operators import quality
from loomline.plans import curation


def test_routing_hands_its_statistics_on(spark):
    docs = curation.table(spark, "/root/testdata/sf0.001", "documents")
    roles = spark.createDataFrame(curation._ROLES, "source string, role string")
    routed = quality.kept_by_route(docs, roles, "de", curation.GERMAN, statistics=True)
    want = {tuple(r) for r in quality.gopher_statistics(docs).select("doc_id", *quality.STATISTICS).collect()}
    assert {tuple(r) for r in routed.select("doc_id", *quality.STATISTICS).collect()} == want


def test_lines_given_are_those_of_the_text(spark):
    rows = spark.createDataFrame([("a.\n\n b\na.\n",), ("",), (None,), ("x" * 40 + "\n" + "x" * 40,)], "t string")
    own, given = (quality.fineweb_statistics(F.col("t"), lines=lines) for lines in (None, quality.filled_lines(F.col("t"))))
    for r in rows.select(F.struct(*[c.alias(k) for k, c in own.items()]).alias("a"), F.struct(*[c.alias(k) for k, c in given.items()]).alias("b")).collect():
        assert r.a == r.b
