"""Queries over interleaved documents.  Events stand in for nodes: four a document, views and clicks are images."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dom, mixing, webdocs
from ..sources import readers
from ..sources.shared import written
from ..tables import table
from .curation import WORDS
from .registry import query

_N = """WITH n AS (SELECT event_id // 4 AS doc, event_id AS pos, event_type IN ('view', 'click') AS img, 'http://i/' || floor(value / 20)::BIGINT AS src,
  event_type AS txt, CASE WHEN event_type IN ('view', 'click') THEN 'http://i/' || floor(value / 20)::BIGINT ELSE event_type END AS node FROM events),
docs AS (SELECT DISTINCT doc FROM n)"""


def _docs(spark, d):
    image = F.col("event_type").isin("view", "click")
    src = F.concat(F.lit("http://i/"), F.floor(F.col("value") / 20).cast("string"))
    node = F.struct("event_id", F.when(image, "image").otherwise("text").alias("kind"), F.when(~image, F.col("event_type")).alias("text"), F.when(image, src).alias("src"))
    rows = table(spark, d, "events").groupBy(F.expr("event_id div 4").alias("doc")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return rows.select("doc", F.transform("nodes", lambda n: F.struct(n["kind"].alias("kind"), n["text"].alias("text"), n["src"].alias("src"))).alias("nodes"))


def _shown(docs):
    return docs.select("doc", F.array_join(F.transform("nodes", lambda n: F.coalesce(n["src"], n["text"])), "|").alias("nodes"))


_LEFT = "SELECT d.doc, coalesce(string_agg(k.node, '|' ORDER BY k.pos), '') AS nodes FROM docs d LEFT JOIN k USING (doc) GROUP BY d.doc"


@query(f"{_N} SELECT doc, coalesce(string_agg(src, ' ' ORDER BY pos) FILTER (WHERE img), '') AS urls FROM n GROUP BY doc")
def image_urls(spark, d):
    return _docs(spark, d).select("doc", F.array_join(webdocs.image_urls(F.col("nodes")), " ").alias("urls"))


@query(f"{_N} SELECT src, count(*) AS n FROM n WHERE img GROUP BY src")
def image_url_counts(spark, d):
    return webdocs.url_counts(_docs(spark, d))


@query(f"{_N}, k AS (SELECT * FROM n WHERE NOT img OR src NOT IN (SELECT src FROM n WHERE img GROUP BY src HAVING count(*) > 40)) {_LEFT}")
def frequent_images_removed(spark, d):
    return _shown(webdocs.drop_frequent_images(_docs(spark, d), 40))


_BANNED = ["http://i/0", "http://i/3", "http://i/7"]


@query(f"{_N} SELECT doc FROM docs WHERE doc NOT IN (SELECT doc FROM n WHERE img AND src IN ('http://i/0', 'http://i/3', 'http://i/7'))")
def documents_with_banned_images_removed(spark, d):
    banned = spark.createDataFrame([(u,) for u in _BANNED], "src string")
    return webdocs.drop_documents_with(_docs(spark, d), banned).select("doc")


@query(f"{_N}, k AS (SELECT * FROM n WHERE NOT img OR src NOT IN ('http://i/0', 'http://i/3', 'http://i/7')) {_LEFT}")
def opted_out_images_removed(spark, d):
    return _shown(webdocs.drop_images(_docs(spark, d), spark.createDataFrame([(u,) for u in _BANNED], "src string")))


#: The image at a URL is the source of the document of its number, so that several URLs hold the same bytes.
_BYTES = "seen AS (SELECT 'http://i/' || doc_id AS src, md5(source) AS digest FROM documents), held AS (SELECT src FROM seen WHERE digest IN (md5('src1'), md5('src4')))"


def _test_images(spark, d):
    docs = table(spark, d, "documents")
    images = docs.select(F.concat(F.lit("http://i/"), F.col("doc_id").cast("string")).alias("src"), F.col("source").cast("binary").alias("content"))
    return images, spark.createDataFrame([("src1",), ("src4",)], "s string").select(F.md5("s").alias("digest"))


@query(f"{_N}, {_BYTES}, k AS (SELECT * FROM n WHERE NOT img OR src NOT IN (SELECT src FROM held)) {_LEFT}")
def test_images_removed(spark, d):
    images, digests = _test_images(spark, d)
    return _shown(webdocs.drop_test_images(_docs(spark, d), digests, whole_document=False, images=images))


@query(f"{_N}, {_BYTES} SELECT doc FROM docs WHERE doc NOT IN (SELECT doc FROM n WHERE img AND src IN (SELECT src FROM held))")
def documents_with_test_images_removed(spark, d):
    images, digests = _test_images(spark, d)
    return webdocs.drop_test_images(_docs(spark, d), digests, whole_document=True, images=images).select("doc")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (VALUES (1, 'view'), (2, 'error'), (3, 'click')) b(u, t) WHERE b.u = e.user_id AND b.t = e.event_type)")
def banned_pairs_removed(spark, d):
    banned = spark.createDataFrame([(1, "view"), (2, "error"), (3, "click")], "user_id long, event_type string")
    return table(spark, d, "events").join(banned, ["user_id", "event_type"], "left_anti").select("event_id")


@query("SELECT doc_id, length(text) AS n, lang, source FROM documents")
def texts_rejoined(spark, d):
    """Texts that were written by themselves go back to their rows by shard and place in it: nothing else tells whose they are."""
    docs = table(spark, d, "documents")
    texts, rest = (readers.by_position(spark, written(part, "part")) for part in (docs.select("text"), docs.select("doc_id", "lang", "source")))
    return rest.join(texts, ["shard", "row"]).select("doc_id", F.length("text").cast("long").alias("n"), "lang", "source")


@query(f"""{_N}, p AS (SELECT *, img OR coalesce(lag(img) OVER w, true) AS first FROM n WINDOW w AS (PARTITION BY doc ORDER BY pos)),
g AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc ORDER BY pos) AS g FROM p),
m AS (SELECT doc, g, string_agg(node, '+' ORDER BY pos) AS node FROM g GROUP BY doc, g)
SELECT doc, string_agg(node, '|' ORDER BY g) AS nodes FROM m GROUP BY doc""")
def merged_text_nodes(spark, d):
    return _shown(_docs(spark, d).withColumn("nodes", webdocs.merge_texts(F.col("nodes"), "+")))


@query(f"{_N}, k AS (SELECT * FROM n WHERE NOT img OR pos = (SELECT min(m.pos) FROM n m WHERE m.doc = n.doc AND m.img AND m.src = n.src)) {_LEFT}")
def first_images_only(spark, d):
    return _shown(_docs(spark, d).withColumn("nodes", webdocs.first_images(F.col("nodes"))))


@query(f"{_N}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, img ORDER BY pos) AS r FROM n), k AS (SELECT * FROM r WHERE NOT img OR r <= 1) {_LEFT}")
def surplus_images_removed(spark, d):
    return _shown(_docs(spark, d).withColumn("nodes", webdocs.surplus_images(F.col("nodes"), 1)))


@query(f"""{_N}, g AS (SELECT *, sum((NOT img AND txt = 'error')::INT) OVER (PARTITION BY doc ORDER BY pos) AS part FROM n)
SELECT doc, string_agg(node, '|' ORDER BY pos) AS nodes FROM g WHERE img OR txt <> 'error' GROUP BY doc, part HAVING bool_or(img)""")
def split_at_markers(spark, d):
    parts = _docs(spark, d).select("doc", F.explode(webdocs.split_at(F.col("nodes"), F.lit("error"))).alias("nodes"))
    return _shown(parts)


@query(f"{_N} SELECT doc FROM n GROUP BY doc HAVING bool_or(img) AND NOT bool_and(img)")
def documents_of_both_kinds(spark, d):
    return _docs(spark, d).filter(webdocs.has_both(F.col("nodes"))).select("doc")


@query(f"{_N}, k AS (SELECT doc, string_agg(CASE WHEN img THEN 'i' ELSE 't' END, '' ORDER BY pos) AS s FROM n GROUP BY doc) SELECT doc FROM k WHERE NOT ends_with(s, 'ii') AND NOT contains(s, 'iii')")
def image_runs_removed(spark, d):
    return _docs(spark, d).filter(webdocs.image_runs_ok(F.col("nodes"))).select("doc")


@query(f"""{_N}, s AS (SELECT doc, string_agg(DISTINCT src, ' ' ORDER BY src) FILTER (WHERE img) AS s FROM n GROUP BY doc)
SELECT doc FROM s WHERE s IS NULL OR doc = (SELECT max(t.doc) FROM s t WHERE t.s = s.s)""")
def latest_per_image_set(spark, d):
    return webdocs.latest_per_image_set(_docs(spark, d), "doc").select("doc")


@query(f"{_N} SELECT doc, count(*) FILTER (WHERE img AND floor(replace(src, 'http://i/', '')::INT) % 2 = 0) AS found, count(*) FILTER (WHERE img AND floor(replace(src, 'http://i/', '')::INT) % 2 = 1) AS missing FROM n GROUP BY doc")
def images_attached(spark, d):
    images = spark.range(0, 1000, 2).select(F.concat(F.lit("http://i/"), F.col("id").cast("string")).alias("src"), F.col("id").cast("string").cast("binary").alias("content"))
    return webdocs.with_images(_docs(spark, d), images).select("doc", "found", "missing")


@query(f"{_N} SELECT doc, CASE WHEN count(*) FILTER (WHERE img AND replace(src, 'http://i/', '')::INT % 2 = 1) > 0 THEN 'incomplete' ELSE 'complete' END AS part FROM n GROUP BY doc")
def split_by_missing_images(spark, d):
    images = spark.range(0, 1000, 2).select(F.concat(F.lit("http://i/"), F.col("id").cast("string")).alias("src"), F.lit(b"x").alias("content"))
    return webdocs.with_images(_docs(spark, d), images).select("doc", F.when(F.col("missing") > 0, "incomplete").otherwise("complete").alias("part"))


@query(f"{_N} SELECT n.doc, n.pos AS event_id, t.n_name AS name FROM n JOIN nation t ON t.n_nationkey = replace(n.src, 'http://i/', '')::INT WHERE n.img")
def images_by_name(spark, d):
    name = F.regexp_extract(F.concat(F.lit("http://i/"), F.floor(F.col("value") / 20).cast("string")), "[^/]*$", 0)
    rows = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(F.expr("event_id div 4").alias("doc"), "event_id", name.alias("key"))
    return rows.join(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name")), "key").select("doc", "event_id", "name")


@query("SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE regexp_matches(html, 'class=\"[^\"]*(nav|menu)[^\"]*\"'))")
def pages_by_rule_removed(spark, d):
    pages = table(spark, d, "pages")
    return pages.join(pages.filter(F.col("html").rlike('class="[^"]*(nav|menu)[^"]*"')).select("url").distinct(), "url", "left_anti").select("page_id")


@query("""SELECT 'http://i/' || floor(value / 20)::BIGINT AS src, min(event_id) AS first, string_agg(event_type, chr(10) ORDER BY event_id) AS texts FROM events GROUP BY 1""")
def merged_by_image(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("http://i/"), F.floor(F.col("value") / 20).cast("string")).alias("src"), "event_id", "event_type")
    return webdocs.merged_by_image(rows, "src", "event_type", "event_id")


@query("""
WITH s AS (SELECT p_partkey, p_size * 20 AS w, round(p_retailprice)::BIGINT AS h FROM part)
SELECT p_partkey, w BETWEEN 150 AND 10000 AND h BETWEEN 150 AND 10000 AND w::DOUBLE / h BETWEEN 1 / 3.0::DOUBLE AND 3 AS ok, least(w, h) >= 150 AS large,
  CASE WHEN p_partkey % 2 = 0 THEN round(0.5::DOUBLE * w)::BIGINT ELSE w END AS rendered FROM s""")
def sized_images(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).cast("long").alias("w"), F.round("p_retailprice").cast("long").alias("h"))
    rendered = F.when(F.col("p_partkey") % 2 == 0, "50%").otherwise(F.concat(F.col("w").cast("string"), F.lit("px")))
    return rows.select("p_partkey", webdocs.size_ok(F.col("w"), F.col("h")).alias("ok"), (F.least("w", "h") >= 150).alias("large"), webdocs.rendered_pixels(rendered, F.col("w")).alias("rendered"))


@query("SELECT event_id FROM events WHERE value / 500 <= 0.4::DOUBLE AND NOT (user_id % 10 / 10.0::DOUBLE > 0.85::DOUBLE) AND event_type IN ('view', 'click', 'error')")
def scored_images(spark, d):
    scores = {"nude": F.col("value") / 500, "drawn": (F.col("user_id") % 10) / F.lit(10.0)}
    ok = webdocs.scores_ok(scores, {"nude": 0.4, "drawn": 0.85}) & webdocs.format_ok(F.col("event_type"), ["view", "click", "error"])
    return table(spark, d, "events").filter(ok).select("event_id")


@query("""
WITH h AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE >= list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / 64 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings)
SELECT vec_id, bits, bits IN (SELECT bits FROM h WHERE vec_id % 50 <> 0) AS seen FROM h WHERE vec_id % 50 = 0""")
def evaluation_images_seen(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", webdocs.average_hash(F.transform("embedding", lambda x: x.cast("double"))).alias("bits"))
    training = rows.filter("vec_id % 50 <> 0").select(F.col("bits").alias("b"), F.lit(True).alias("seen")).distinct()
    return rows.filter("vec_id % 50 = 0").join(training, F.col("bits") == F.col("b"), "left").select("vec_id", "bits", F.coalesce("seen", F.lit(False)).alias("seen"))


@query()
def perceptual_hashes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", webdocs.perceptual_hash("embedding").alias("bits"))


@query("SELECT c_mktsegment || ':' || c_nationkey AS key FROM customer WHERE c_nationkey > 4 INTERSECT SELECT c_mktsegment || ':' || (c_nationkey + 1) FROM customer")
def shared_keys(spark, d):
    rows = table(spark, d, "customer")
    key = lambda shift: F.concat_ws(":", "c_mktsegment", (F.col("c_nationkey") + shift).cast("string")).alias("key")
    return rows.filter("c_nationkey > 4").select(key(0)).intersect(rows.select(key(1)))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS a, row_number() OVER (ORDER BY doc_id DESC) AS b FROM documents) WHERE a <= 20 OR b <= 10")
def first_and_last(spark, d):
    rows = mixing.placed(table(spark, d, "documents").select("doc_id"), ["doc_id"], "i", total="n")
    return rows.filter((F.col("i") < 20) | (F.col("i") >= F.col("n") - 10)).select("doc_id")


_COMMON = ["the", "of", "and", "in", "to", "is", "on", "that", "de", "der", "die", "la", "le", "que", "en"]
_PAIR_TEXTS = f"""
WITH p AS (SELECT doc_id, n_chars, 50 + n_chars % 1000 AS w, 120 + doc_id % 500 AS h, ['jpg', 'PNG', 'gif', NULL][1 + doc_id % 4] AS f, CASE WHEN doc_id % 5 = 0 THEN 60 + doc_id % 100 END AS rw,
    translate(split_part(text, '.', 1), '{T.EXOTIC_SPACES}', '{" " * len(T.EXOTIC_SPACES)}') AS alt_text, translate(split_part(text, chr(10), 1), '{T.EXOTIC_SPACES}', '{" " * len(T.EXOTIC_SPACES)}') AS extracted_text, source AS formatted_filename FROM documents),
t AS (SELECT doc_id, w, h, f, rw, 'alt_text' AS kind, alt_text AS text, doc_id % 10 / 10.0::DOUBLE AS sim FROM p UNION ALL SELECT doc_id, w, h, f, rw, 'extracted_text', extracted_text, NULL FROM p UNION ALL SELECT doc_id, w, h, f, rw, 'formatted_filename', formatted_filename, NULL FROM p),
v AS (SELECT *, {WORDS} AS words, coalesce(length(regexp_replace(text, '[^!-/:-@\\[-`{{-~0-9]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0) AS special FROM t),
r AS (SELECT *, 1 - len(list_distinct(words))::DOUBLE / nullif(len(words), 0) AS repetition, 1 - len(list_filter(list_distinct(words), lambda x: len(list_filter(words, lambda y: y = x)) = 1))::DOUBLE / nullif(len(words), 0) AS repeated,
  len(list_filter(words, lambda x: list_contains({_COMMON}, x)))::DOUBLE / nullif(len(words), 0) AS common FROM v)
"""


def _pairs(spark, d):
    """An image a document, of a size and format that follow from its numbers, with three texts."""
    doc, column = F.col("doc_id"), F.col
    image = F.struct(F.get(F.array(F.lit("jpg"), F.lit("PNG"), F.lit("gif"), F.lit(None)), (doc % 4).cast("int")).alias("format"), (50 + column("n_chars") % 1000).alias("width"), (120 + doc % 500).alias("height"), F.when(doc % 5 == 0, 60 + doc % 100).alias("rendered_width"), F.lit(None).cast("long").alias("rendered_height"))
    texts = F.create_map(F.lit("alt_text"), F.substring_index("text", ".", 1), F.lit("extracted_text"), F.substring_index("text", "\n", 1), F.lit("formatted_filename"), column("source"))
    return table(spark, d, "documents").select("doc_id", image.alias("image"), texts.alias("texts"), F.create_map(F.lit("alt_text"), doc % 10 / 10.0).alias("similarities"), (doc % 7 != 0).alias("in_tree"))


def _listed(pairs):
    return pairs.select("doc_id", F.array_join(F.array_sort(F.map_keys("texts")), ",").alias("kinds"))


@query(_PAIR_TEXTS + """SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM r WHERE doc_id % 7 <> 0 AND w BETWEEN 100 AND 10000 AND h BETWEEN 100 AND 10000 AND w::DOUBLE / h BETWEEN 1 / 3.0::DOUBLE AND 3
AND coalesce(rw BETWEEN 100 AND 100000, true) AND coalesce(lower(f) IN ('jpg', 'jpeg', 'png', 'webp'), true) AND len(words) BETWEEN 3 AND 256 AND special <= 0.4::DOUBLE AND repetition <= 0.3::DOUBLE AND coalesce(sim >= 0.2::DOUBLE, true) GROUP BY doc_id""")
def image_text_pairs(spark, d):
    """Pairs that keep a text, and which ones they keep."""
    return _listed(webdocs.filtered_pairs(_pairs(spark, d)))


@query(_PAIR_TEXTS + """SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM r WHERE doc_id % 7 <> 0 AND w BETWEEN 150 AND 10000 AND h BETWEEN 150 AND 10000 AND w::DOUBLE / h BETWEEN 1 / 3.0::DOUBLE AND 3
AND coalesce(rw BETWEEN 150 AND 100000, true) AND len(words) BETWEEN 1 AND 256 AND special <= 0.4::DOUBLE AND repeated <= 0.7::DOUBLE AND common >= 0.2::DOUBLE GROUP BY doc_id""")
def listed_image_pairs(spark, d):
    cut = replace(webdocs.LISTED, min_common=0.2)
    return _listed(webdocs.filtered_pairs(_pairs(spark, d), cut, F.array(*map(F.lit, _COMMON))))


@query()
def simplified_trees(spark, d):
    """What is left of each page's tree: its nodes' tags, depths, texts and sources."""
    left = dom.simplified(dom.trees(table(spark, d, "pages")))
    return left.select("page_id", F.posexplode("nodes").alias("place", "n")).select("page_id", "place", "n.*")


@query()
def tree_rules(spark, d):
    """Nodes by rules that look at what they stand in, on the whole trees."""
    rules = {"items": "ul li, ol > li", "in_article": "article > p", "deep": "body * p", "linked": "nav a[href^='/t']"}
    found = dom.trees(table(spark, d, "pages"))
    return found.select("page_id", *[F.size(F.filter(dom.matching("nodes", rule), lambda b: b)).alias(name) for name, rule in rules.items()])
