"""Queries that score, vote and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import quality, scoring, tokens
from ..tables import table
from .curation import _ROUTED
from .registry import query


@query("""
SELECT lang AS language, source AS dataset, count(*) AS total, avg((length(text) >= 1000)::INT) AS old_rate, avg((length(text) BETWEEN 300 AND 500000)::INT) AS new_rate
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def filter_survival(spark, d):
    return scoring.survival(table(spark, d, "documents"), "lang", "source", F.length("text") >= 1000, F.length("text").between(300, 500_000))


@query("SELECT source, sum(length(text))::BIGINT AS characters, CASE WHEN sum(length(text)) >= 100000 THEN 'full' ELSE 'short' END AS status FROM documents GROUP BY source")
def source_characters(spark, d):
    total = F.sum(F.length("text"))
    return table(spark, d, "documents").groupBy("source").agg(total.alias("characters"), F.when(total >= 100_000, "full").otherwise("short").alias("status"))


@query("SELECT lang, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM documents GROUP BY lang")
def mixture_summary(spark, d):
    from pyspark.sql import Window

    counted = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("""
WITH v AS (SELECT user_id, event_type, count(*) AS votes, avg(round(value, 2)) AS mean_score FROM events GROUP BY ALL)
SELECT user_id, event_type, votes, round(mean_score, 6) AS mean_score, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, round(mean_score, 6) DESC, event_type) AS rank FROM v""")
def vote_ranking(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("user_id", "event_type", F.round("value", 2).alias("value"))
    ranked = scoring.votes(rows, ["user_id"], "event_type", "value").withColumn("mean_score", F.round("mean_score", 6))
    order = Window.partitionBy("user_id").orderBy(F.desc("votes"), F.desc("mean_score"), "event_type")
    return ranked.withColumn("rank", F.row_number().over(order))


@query("""
WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM v),
a AS (SELECT user_id, list(event_type ORDER BY r) AS l FROM r WHERE r <= 2 GROUP BY user_id)
SELECT user_id, l[1] AS first_attempt, coalesce(l[2], l[1]) AS second_attempt FROM a""")
def padded_attempts(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.lit(0.0).alias("v"))
    best = scoring.attempts(scoring.votes(rows, ["user_id"], "event_type", "v"), ["user_id"], "event_type", 2)
    return best.select("user_id", F.col("attempts")[0].alias("first_attempt"), F.col("attempts")[1].alias("second_attempt"))


@query("""
WITH u AS (SELECT user_id, count(*) AS n, sum((event_type = 'purchase')::INT)::BIGINT AS c FROM events GROUP BY user_id)
SELECT user_id, n, c, 1 - CASE WHEN n - c >= 1 THEN (n - c)::DOUBLE / n ELSE 0 END * CASE WHEN n - c >= 2 THEN (n - c - 1)::DOUBLE / greatest(n - 1, 1) ELSE 0 END AS pass_at_2 FROM u""")
def unbiased_pass_at_k(spark, d):
    users = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("c"))
    return users.select("user_id", "n", "c", A.pass_at_k(F.col("n"), F.col("c"), 2).alias("pass_at_2"))


@query("SELECT avg(a) AS macro_accuracy FROM (SELECT source, avg(quality::DOUBLE) AS a FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def macro_accuracy(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return scoring.macro_accuracy(rows, "source", F.col("quality") == 1)


@query("""
WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL),
l AS (SELECT DISTINCT unnest([quality, toxic]) AS label FROM c),
s AS (SELECT label, coalesce((SELECT n FROM c WHERE quality = label AND toxic = label), 0)::DOUBLE AS hit,
  (SELECT sum(n) FROM c WHERE quality = label)::DOUBLE AS real, (SELECT sum(n) FROM c WHERE toxic = label)::DOUBLE AS said FROM l),
r AS (SELECT label, coalesce(hit / said, 0) AS p, coalesce(hit / real, 0) AS r FROM s)
SELECT label, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM r""")
def class_scores(spark, d):
    return scoring.class_scores(scoring.confusion(table(spark, d, "labels"), "quality", "toxic"), "quality", "toxic")


@query()
def anls_scores_whole(spark, d):
    """Whole texts, each against itself without its first two characters."""
    score = A.anls(F.col("text"), F.array(F.substring("text", 3, 2**31 - 1)))
    return table(spark, d, "conversations").select("conv_id", "turn", score.alias("anls"))


@query("SELECT event_id, abs(value - value * 1.04::DOUBLE) <= 0.05::DOUBLE * abs(value * 1.04::DOUBLE) AS close FROM events WHERE value <> 0")
def relaxed_accuracy(spark, d):
    rows = table(spark, d, "events").filter("value <> 0")
    return rows.select("event_id", A.relaxed_match(F.col("value"), F.col("value") * 1.04).alias("close"))


@query("SELECT user_id, min(event_id) AS first_event, count(DISTINCT event_type) > 1 AS disagrees FROM events GROUP BY user_id")
def metric_rows_deduplicated(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), (F.countDistinct("event_type") > 1).alias("disagrees"))


@query("""
WITH a AS (SELECT least(floor((value - 0) / 5) + 1, 40) AS bin, event_type FROM events WHERE value BETWEEN 0 AND 200),
p AS (SELECT bin, count(*)::DOUBLE / sum(count(*)) OVER () * 40 / 200 AS p FROM a WHERE event_type = 'click' GROUP BY bin),
q AS (SELECT bin, count(*)::DOUBLE / sum(count(*)) OVER () * 40 / 200 AS q FROM a WHERE event_type <> 'click' GROUP BY bin)
SELECT round(coalesce(sum(p * ln(p / q)), 0), 9) AS kl FROM p JOIN q USING (bin)""")
def score_divergence(spark, d):
    rows = table(spark, d, "events")
    p = scoring.histogram(rows.filter("event_type = 'click'"), "value", 40, 0.0, 200.0)
    q = scoring.histogram(rows.filter("event_type <> 'click'"), "value", 40, 0.0, 200.0)
    return scoring.kl_divergence(p, q).select(F.round("kl", 9).alias("kl"))


@query(r"""
SELECT conv_id, turn, coalesce(nullif(regexp_extract(t, '\\boxed\{([^}]*)\}', 1), ''), nullif(regexp_extract(t, '(?i)the answer is:?\s*([^\s.,;]+)', 1), ''),
  regexp_extract_all(t, '-?[0-9]+(?:\.[0-9]+)?')[-1]) AS answer
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' \boxed{' || conv_id || '}' WHEN turn % 3 = 1 THEN 'The answer is ' || conv_id || '.' || text ELSE text || ' ' || conv_id || '.5' END AS t FROM conversations)""")
def extracted_answers(spark, d):
    boxed = F.concat("text", F.lit(" \\boxed{"), F.col("conv_id").cast("string"), F.lit("}"))
    stated = F.concat(F.lit("The answer is "), F.col("conv_id").cast("string"), F.lit("."), "text")
    t = F.when(F.col("turn") % 3 == 0, boxed).when(F.col("turn") % 3 == 1, stated).otherwise(F.concat("text", F.lit(" "), F.col("conv_id").cast("string"), F.lit(".5")))
    return table(spark, d, "conversations").select("conv_id", "turn", A.extract_answer(t).alias("answer"))


@query(r"SELECT conv_id, turn, regexp_extract_all(text || ' (B) or C', '\(([A-D])\)', 1)[-1] AS letter FROM conversations")
def choice_letters(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", A.choice_letter(F.concat("text", F.lit(" (B) or C"))).alias("letter"))


@query(r"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reward,
  regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN '<think>' || text || '</think> ' || text ELSE text END, '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS stripped FROM conversations WHERE length(trim(text, ' ')) > 0""")
def think_blocks(spark, d):
    rows = table(spark, d, "conversations").filter(F.length(F.trim("text")) > 0)
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> "), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", A.format_reward(t).alias("reward"), T.strip_think(t).alias("stripped"))


@query("SELECT doc_id, CASE WHEN length(text) <= 3000 THEN 0.0::DOUBLE ELSE -least((length(text) - 3000) / 1000.0::DOUBLE, 1.0) END AS penalty FROM documents")
def overlong_penalties(spark, d):
    return table(spark, d, "documents").select("doc_id", A.overlong_penalty(F.length("text"), 4000, 1000).alias("penalty"))


@query("SELECT event_id, round_even(least(greatest(value / 20, 0), 5), 0)::INT AS score FROM events")
def half_even_scores(spark, d):
    return table(spark, d, "events").select("event_id", T.round_half_even(F.col("value") / 20).alias("score"))


@query("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)) AS score FROM q, embeddings e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s)
SELECT query, neighbour, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def nearest_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return scoring.nearest(rows.filter(F.pmod("vec_id", F.lit(50)) == 0), rows).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE 1 / n::DOUBLE END AS sample, CASE WHEN n = 0 THEN 0 ELSE 1 / sqrt(n) END AS square FROM (SELECT doc_id, length(text) AS n FROM documents)")
def subsequence_weights(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").select("doc_id", T.subsequence_weight(n, "sample").alias("sample"), T.subsequence_weight(n, "square").alias("square"))


@query()
def document_ngram_ids(spark, d):
    """The distinct ids of all n-grams, n from 1 to 4, of each text's bytes: base 256 holds four of them in a BIGINT."""
    return tokens.byte_ngram_ids(table(spark, d, "documents"))


@query("SELECT conv_id, turn, role, role <> 'assistant' AS masked, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS target FROM conversations")
def masked_turns(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", "role", (F.col("role") != "assistant").alias("masked"), F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("long").alias("target"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn) AS prompt, count(*) AS turns FROM conversations GROUP BY conv_id")
def formatted_prompts(spark, d):
    part = F.concat(F.lit("<|"), "role", F.lit("|>"), "text")
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("a"), F.count("*").alias("turns"))
    return grouped.select("conv_id", F.array_join(F.transform("a", lambda x: x["p"]), "\n").alias("prompt"), "turns")


@query(f"{_ROUTED} SELECT doc_id, lang FROM r WHERE route <> 'rejected' AND gopher AND mean_word_length >= 3 AND stop_words >= 2")
def doc_gopher_router(spark, d):
    rows = quality.gopher_statistics(table(spark, d, "documents"))
    return rows.filter(quality.basic(F.col("text")) & quality.gopher_quality()).select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber, '((' || l_orderkey || ' + ' || l_linenumber || ') * (' || l_partkey || ' / 2))' AS expression FROM lineitem WHERE l_linenumber = 1")
def infix_programs(spark, d):
    part = lambda c: F.col(c).cast("string")
    program = F.concat(F.lit("add("), part("l_orderkey"), F.lit(",const_"), part("l_linenumber"), F.lit("), divide("), part("l_partkey"), F.lit(",const_2), multiply(#0,#1)"))
    return table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", A.infix(program).alias("expression"))
