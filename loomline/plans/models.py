"""Queries of language models that learn from one part of the documents and score the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import language_models as models
from ..tables import table
from .curation import _PUNCT_SQL, CRC
from .registry import query

_PERPLEXITY = f"""
WITH s AS (SELECT doc_id, {CRC} % 4 = 2 AS held, [' begin', ' begin'] || list_filter(regexp_split_to_array({_PUNCT_SQL.replace("lower(regexp_replace(text", "(regexp_replace(coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') || [' end'] AS t FROM documents),
g AS (SELECT doc_id, held, unnest(t[1:len(t) - 2]) AS u, unnest(t[2:len(t) - 1]) AS v, unnest(t[3:len(t)]) AS w FROM s),
c3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE NOT held GROUP BY ALL), c2 AS (SELECT v, w, count(*) AS c FROM c3 GROUP BY ALL), c1 AS (SELECT w, count(*) AS c FROM c2 GROUP BY ALL),
x3 AS (SELECT u, v, sum(c)::DOUBLE AS t, count(*) AS k FROM c3 GROUP BY ALL), x2 AS (SELECT v, sum(c)::DOUBLE AS t, count(*) AS k FROM c2 GROUP BY ALL), x1 AS (SELECT sum(c)::DOUBLE AS t, count(*) AS k FROM c1),
h AS (SELECT doc_id, u, v, w, count(*) AS n FROM g WHERE held GROUP BY ALL),
p1 AS (SELECT h.*, greatest(coalesce(c, 0) - 0.75::DOUBLE, 0) / t + 0.75::DOUBLE * k / t / (k + 1) AS p FROM h LEFT JOIN c1 USING (w), x1),
p2 AS (SELECT doc_id, u, v, w, n, CASE WHEN t IS NULL THEN p ELSE greatest(coalesce(c, 0) - 0.75::DOUBLE, 0) / t + 0.75::DOUBLE * k / t * p END AS p FROM p1 LEFT JOIN c2 USING (v, w) LEFT JOIN x2 USING (v)),
p3 AS (SELECT doc_id, n, CASE WHEN t IS NULL THEN p ELSE greatest(coalesce(c, 0) - 0.75::DOUBLE, 0) / t + 0.75::DOUBLE * k / t * p END AS p FROM p2 LEFT JOIN c3 USING (u, v, w) LEFT JOIN x3 USING (u, v)),
r AS (SELECT doc_id, round(10 ** (-sum(n * log10(p)) / sum(n)), 1) AS perplexity FROM p3 GROUP BY doc_id)
"""


def _scored(spark, d):
    return models.perplexity_of(table(spark, d, "documents"), models.held_out("doc_id"))


@query(_PERPLEXITY + "SELECT * FROM r")
def trigram_perplexity(spark, d):
    """Of the held-out quarter of the documents under a model of the others."""
    return _scored(spark, d)


@query(_PERPLEXITY + "SELECT doc_id, perplexity FROM r WHERE perplexity <= 1500")
def trigram_perplexity_gate(spark, d):
    return _scored(spark, d).filter("perplexity <= 1500")


def _languages(spark, d):
    docs = table(spark, d, "documents")
    return models.identify(docs, models.language_classifier(models.language_sample(docs)))


@query()
def identified_language(spark, d):
    """By a linear model over characters, learnt off the held-out quarter."""
    return _languages(spark, d).select("doc_id", "language", F.round("score", 6).alias("score"))


@query()
def languages_kept(spark, d):
    """The keep-list at its confidence."""
    return _languages(spark, d).filter(F.col("language").isin("en", "de", "fr") & (F.col("score") >= 0.65)).select("doc_id", "language")
