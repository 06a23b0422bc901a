"""Queries that evaluate, and models of words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon, metrics
from ..operators.language_models import held_out
from ..operators.lookup import attach
from ..tables import table
from .curation import STRIP
from .registry import query

_WORDS = f"list_filter(list_transform(regexp_split_to_array(text, '[ \\n\\t]'), lambda x: {STRIP.format('lower(x)')}), lambda x: x <> '')"


@query("WITH t AS (SELECT user_id, event_type, bool_or(value > 300) AS ok FROM events GROUP BY ALL) SELECT user_id, count(*) AS tests, avg(ok::INT) AS credit, bool_and(ok) AS strict FROM t GROUP BY user_id")
def puzzle_scores(spark, d):
    tests = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 300).alias("ok"))
    return metrics.puzzle_scores(tests, "user_id", "ok")


@query("""
WITH a AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS a FROM events),
c AS (SELECT user_id, a, count(*) AS c, min(event_id) AS f FROM a WHERE a IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS r FROM c)
SELECT u.user_id, coalesce(sum(c), 0)::BIGINT AS valid, coalesce(max(c), 0) AS top, coalesce(bool_or(r <= 2 AND a = 'click'), false) AS hit FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY u.user_id""")
def majority_at_k(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("a"), F.lit("click").alias("t"))
    return metrics.majority_at_k(rows, "user_id", "a", "event_id", "t", 2)


@query("""SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 0.25::DOUBLE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS accuracy, avg((event_type = 'error')::INT) AS invalid FROM events GROUP BY user_id""")
def choice_accuracy(spark, d):
    said = F.when(F.col("event_type") != "error", F.col("event_type"))
    return metrics.choice_accuracy(table(spark, d, "events"), ["user_id"], said, F.lit("click"), 4)


@query("SELECT count(*) AS n, avg((event_type = 'click')::INT) AS accuracy, avg((event_type = 'error')::INT) AS invalid FROM events")
def answer_accuracy(spark, d):
    return metrics.answer_accuracy(table(spark, d, "events"), F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("click"))


_BEST = "p AS (SELECT user_id, arg_min(event_type, (-v, event_type)) AS predicted FROM (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL) GROUP BY user_id)"


def _predicted(spark, d):
    scores = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return metrics.best_labels(scores, "user_id", "event_type", "v")


@query(f"WITH {_BEST} SELECT user_id, predicted FROM p")
def best_labels(spark, d):
    return _predicted(spark, d)


@query(f"""
WITH {_BEST}, r AS (SELECT e.event_type AS label, p.predicted, e.user_id % 7 AS bucket, (e.event_type = p.predicted)::INT AS ok FROM events e JOIN p USING (user_id))
SELECT (SELECT avg(ok) FROM r) AS accuracy, (SELECT avg(a) FROM (SELECT avg(ok) AS a FROM r GROUP BY label)) AS class_accuracy,
  (SELECT avg(a) FROM (SELECT avg(ok) AS a FROM r GROUP BY bucket)) AS bucket_accuracy, round((SELECT stddev_pop(a) FROM (SELECT avg(ok) AS a FROM r GROUP BY bucket)), 9) AS bucket_deviation""")
def bucket_accuracy(spark, d):
    rows = table(spark, d, "events").join(_predicted(spark, d), "user_id").withColumn("bucket", F.col("user_id") % 7)
    return metrics.bucket_accuracy(rows, "event_type", "predicted", "bucket").withColumn("bucket_deviation", F.round("bucket_deviation", 9))


@query("SELECT round(-sum(p * ln(p)), 9) AS entropy FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM documents GROUP BY lang)")
def label_entropy(spark, d):
    return metrics.entropy(table(spark, d, "documents"), "lang").select(F.round("entropy", 9).alias("entropy"))


@query("""
WITH l AS (SELECT toxic, length(text) AS s FROM labels JOIN documents USING (doc_id)), p AS (SELECT s, sum(toxic) AS p, sum(1 - toxic) AS n FROM l GROUP BY s)
SELECT round(sum(p * (coalesce(b, 0) + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 9) AS auc FROM (SELECT *, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p)""")
def ranking_auc(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("toxic", F.length("text").alias("s"))
    return metrics.ranking_auc(rows, "toxic", "s").select(F.round("auc", 9).alias("auc"))


@query("""
WITH e AS (SELECT user_id, event_id, value, (event_type = 'purchase')::INT AS rel FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, event_id) AS i FROM e)
SELECT user_id, round(coalesce(sum(rel / log2(r + 1)) / nullif(sum(rel / log2(i + 1)), 0), 0), 9) AS ndcg FROM r GROUP BY user_id""")
def discounted_gain(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "purchase").cast("int").alias("rel"))
    return metrics.discounted_gain(rows, "user_id", "rel", "value", "event_id").withColumn("ndcg", F.round("ndcg", 9))


@query("""
WITH p AS (SELECT event_id // 4 AS ex, event_id % 4 // 2 AS image, event_id % 2 AS caption, value AS s FROM events),
o AS (SELECT ex, image AS n, s FROM p WHERE image = caption),
t AS (SELECT p.ex, bool_and(o.s > p.s) AS ok FROM p JOIN o ON o.ex = p.ex AND o.n = p.image WHERE p.image <> p.caption GROUP BY p.ex),
i AS (SELECT p.ex, bool_and(o.s > p.s) AS ok FROM p JOIN o ON o.ex = p.ex AND o.n = p.caption WHERE p.image <> p.caption GROUP BY p.ex)
SELECT ex, coalesce(t.ok, true) AS text, coalesce(i.ok, true) AS image, coalesce(t.ok, true) AND coalesce(i.ok, true) AS whole FROM (SELECT DISTINCT ex FROM p) LEFT JOIN t USING (ex) LEFT JOIN i USING (ex)""")
def matching_scores(spark, d):
    rows = table(spark, d, "events").select(F.expr("event_id div 4").alias("ex"), F.expr("event_id % 4 div 2").alias("image"), (F.col("event_id") % 2).alias("caption"), F.col("value").alias("s"))
    return metrics.matching_scores(rows, "ex", "image", "caption", "s")


@query("SELECT avg((string_split(p_name, ' ')[1] IN (string_split(p_type, ' ')[1], string_split(p_name, ' ')[1]))::INT) AS first_word_match FROM part")
def first_word_match(spark, d):
    return metrics.first_word_match(table(spark, d, "part"), F.col("p_name"), F.array("p_type", "p_name"))


@query("SELECT round(avg(v), 6) AS mean FROM (SELECT user_id, min(value) AS v FROM events GROUP BY user_id)")
def mean_over_examples(spark, d):
    return metrics.mean_over_examples(table(spark, d, "events"), "user_id", "value").select(F.round("mean", 6).alias("mean"))


@query("""
WITH q AS (SELECT quantile_cont(value, 0.05::DOUBLE) AS a, quantile_cont(value, 0.95::DOUBLE) AS b FROM events), k AS (SELECT value AS v FROM events, q WHERE value BETWEEN a AND b),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM k)
SELECT least(floor((v - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM k, s GROUP BY 1""")
def trimmed_histogram(spark, d):
    return metrics.trimmed_histogram(table(spark, d, "events"), "value", 20)


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769)) AS text FROM documents")
def composed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", lexicon.nfc(F.concat("text", F.lit("é"))).alias("text"))


_COUNTS = f"w AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY ALL)"
_MODEL = f"{_COUNTS}, m AS (SELECT word, ln(sum(c)::DOUBLE / (SELECT sum(c) FROM w)) AS logp FROM w GROUP BY word)"


@query(f"WITH {_MODEL} SELECT doc_id, round(exp(-sum(c * logp) / sum(c)), 4) AS perplexity FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN m USING (word) GROUP BY doc_id")
def word_perplexity(spark, d):
    docs = table(spark, d, "documents")
    counts = lexicon.word_counts(docs)
    sizes = lexicon.word_sizes(counts)
    return lexicon.perplexity(docs, counts, lexicon.unigram_model(sizes), sizes=sizes).withColumn("perplexity", F.round("perplexity", 4))


@query(f"WITH {_MODEL}, p AS (SELECT doc_id, exp(-sum(c * logp) / sum(c)) AS p FROM w JOIN m USING (word) GROUP BY doc_id) SELECT doc_id FROM p WHERE p <= 1500")
def perplexity_gate(spark, d):
    docs = table(spark, d, "documents")
    counts = lexicon.word_counts(docs)
    sizes = lexicon.word_sizes(counts)
    return lexicon.perplexity(docs, counts, lexicon.unigram_model(sizes), sizes=sizes).filter("perplexity <= 1500").select("doc_id")


@query(f"""
WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, array_to_string(w[('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (greatest(len(w) - 512, 0) + 1) + 1 : ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (greatest(len(w) - 512, 0) + 1) + 512], ' ') AS text FROM s),
{_MODEL}, c AS (SELECT doc_id, unnest({_WORDS}) AS word FROM t)
SELECT doc_id, round(exp(-sum(logp) / count(*)), 4) AS perplexity FROM c JOIN m USING (word) GROUP BY doc_id HAVING exp(-sum(logp) / count(*)) < 2000""")
def window_perplexity(spark, d):
    docs = table(spark, d, "documents")
    counts = lexicon.word_counts(lexicon.window_of_words(docs, 512))
    scored = lexicon.perplexity(docs, counts, lexicon.unigram_model(lexicon.word_sizes(lexicon.word_counts(docs))))
    return scored.filter("perplexity < 2000").withColumn("perplexity", F.round("perplexity", 4))


_LANGUAGE = f"""{_COUNTS}, n AS (SELECT word, lang, sum(c) AS n FROM w JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
s AS (SELECT word, lang, n::DOUBLE / sum(n) OVER (PARTITION BY word) AS share FROM n), z AS (SELECT doc_id, sum(c) AS z FROM w GROUP BY doc_id),
k AS (SELECT doc_id, lang AS language, round(sum(c * share) / any_value(z), 6) AS score FROM w JOIN s USING (word) JOIN z USING (doc_id) GROUP BY doc_id, lang),
b AS (SELECT doc_id, language, score FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) = 1)"""


def _detected(spark, d):
    docs = table(spark, d, "documents")
    return lexicon.detect_language(docs, lexicon.language_model(docs))


@query(f"WITH {_LANGUAGE} SELECT doc_id, language, score FROM documents LEFT JOIN b USING (doc_id)")
def detected_language(spark, d):
    """Of every document, by the words of all that have a language."""
    return _detected(spark, d)


@query(f"WITH {_LANGUAGE} SELECT doc_id, language FROM b WHERE language IN ('en', 'de') AND score >= 0.65")
def kept_languages(spark, d):
    return _detected(spark, d).filter("language in ('en', 'de') and score >= 0.65").select("doc_id", "language")


@query(f"""WITH {_COUNTS}, t AS (SELECT word FROM w GROUP BY word ORDER BY sum(c) DESC, word LIMIT 1000)
SELECT doc_id, coalesce(sum(CASE WHEN word IN (SELECT word FROM t) THEN c ELSE 0 END)::DOUBLE / nullif(sum(c), 0), 0) AS ratio FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id""")
def common_word_ratios(spark, d):
    """Against the 1,000 most frequent words of the corpus."""
    docs = table(spark, d, "documents")
    counts = lexicon.word_counts(docs)
    sizes = lexicon.word_sizes(counts)
    common = sizes.orderBy(F.desc("total"), "word").limit(1000)
    return lexicon.list_ratios(docs, common.select("word"), counts=counts, sizes=sizes)


_LISTED = ["the", "was", "with", "idiot", "trash"]


@query(f"WITH {_COUNTS} SELECT doc_id, coalesce(sum(CASE WHEN word IN ('the', 'was', 'with', 'idiot', 'trash') THEN c ELSE 0 END)::DOUBLE / nullif(sum(c), 0), 0) AS ratio FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id")
def flagged_word_ratios(spark, d):
    listed = spark.createDataFrame([(w,) for w in _LISTED], "word string")
    return lexicon.list_ratios(table(spark, d, "documents"), listed)


@query()
def longest_match_tokens(spark, d):
    docs = table(spark, d, "documents")
    return lexicon.fertility(docs, lexicon.token_numbers(docs, [" the", "the", "th", "an", " an", "tion", "er", "re", "in", "and"]))


@query()
def quality_probabilities(spark, d):
    from pyspark.ml.functions import vector_to_array

    docs, rest = table(spark, d, "documents"), held_out("doc_id")
    model = lexicon.quality_classifier(docs.filter(~rest), table(spark, d, "labels"))
    scored = model.transform(docs.filter(rest).select("doc_id", T.words(F.col("text")).alias("words")))
    return scored.select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("score"))


@query("SELECT user_id, event_type, array_to_string(list(event_id ORDER BY event_id), ',') AS positions FROM events GROUP BY ALL")
def positions_by_key(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("p"))
    return rows.select("user_id", "event_type", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("positions"))


@query("SELECT source, p AS paragraph, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE NOT contains(p, 'END') GROUP BY ALL HAVING count(*) > 2")
def repeated_paragraphs(spark, d):
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("paragraph")).filter(~F.col("paragraph").contains("END"))
    return lines.groupBy("source", "paragraph").agg(F.count("*").alias("n")).filter("n > 2")


@query("SELECT user_id % 5 AS source, event_id % 3 AS subset, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS stages, count(*) AS n FROM events GROUP BY ALL")
def sources_deduplicated(spark, d):
    """A row a source and subset, with all the stages that use it."""
    rows = table(spark, d, "events").withColumn("source", F.col("user_id") % 5).withColumn("subset", F.col("event_id") % 3)
    return rows.groupBy("source", "subset").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("stages"), F.count("*").alias("n"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type)::INT AS code FROM events")
def encoded_labels(spark, d):
    codes = table(spark, d, "events").select("event_type").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("event_type")))
    return attach(table(spark, d, "events").select("event_id", "event_type"), codes, ["event_type"]).select("event_id", "code")
