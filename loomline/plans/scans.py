"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mixing
from ..sources import archives, readers, shards, sinks
from ..sources.shared import shared_path
from ..tables import table
from .registry import query


@query("SELECT doc_id::VARCHAR AS id, text, 'fixed' AS dataset, source, '' AS language FROM documents")
def projected_documents(spark, d):
    rows = readers.project_documents(table(spark, d, "documents"), "doc_id", defaults={"dataset": "fixed"})
    return rows.select("id", "text", "metadata.dataset", "metadata.source", "metadata.language")


@query("SELECT page_id, coalesce(nullif(html, ''), nullif(url, ''), '') AS text FROM pages")
def text_field_fallback(spark, d):
    return table(spark, d, "pages").select("page_id", readers.text_field("html", "url").alias("text"))


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 3")
def modulo_shard(spark, d):
    return readers.shard(table(spark, d, "documents"), "doc_id", 7, 3).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r >= floor(n * 0.1::DOUBLE) AND r < floor(n * 0.3::DOUBLE)")
def percent_slice(spark, d):
    start, end = readers.split_slice("train[10%:30%]")
    ranked = mixing.placed(table(spark, d, "documents").select("doc_id"), ["doc_id"], "r", total="n")
    return ranked.filter((F.col("r") >= F.floor(F.col("n") * start)) & (F.col("r") < F.floor(F.col("n") * end))).select("doc_id")


@query("""
SELECT doc_id FROM (SELECT doc_id, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY md5('0:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 500000""")
def byte_budget(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n"), F.lit(0).alias("_all"))
    return mixing.running(rows, ["_all"], ["doc_id"], F.col("n"), "before").filter("before < 500000").select("doc_id")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS shard, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) // 100 < 2 THEN 'valid' ELSE 'train' END AS part FROM documents")
def contiguous_shards(spark, d):
    return sinks.contiguous_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id, source, sha256(coalesce(source, '') || chr(1) || coalesce(lang, '') || chr(1) || coalesce(text, '')) AS source_hash FROM documents")
def manifest(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", sinks.fingerprint("source", "lang", "text").alias("source_hash"))


@query("""SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS meta FROM documents""")
def collapsed_meta(spark, d):
    return sinks.collapse_to_meta(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"])


@query("SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents")
def exploded_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain FROM pages")
def url_domains(spark, d):
    return table(spark, d, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query("SELECT doc_id, s.role FROM documents JOIN (VALUES ('src1', 'math'), ('src2', 'web')) s(source, role) USING (source)")
def joined_sources(spark, d):
    roles = spark.createDataFrame([("src1", "math"), ("src2", "web")], "source string, role string")
    return table(spark, d, "documents").join(roles, "source").select("doc_id", "role")


@query("SELECT doc_id, regexp_extract_all(text, '\\p{L}+')[1] AS first_word FROM documents")
def first_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.try_element_at(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lit(1)).alias("first_word"))


@query("SELECT doc_id::VARCHAR AS key, p.part AS part, sha256(CASE p.part WHEN 'txt' THEN text WHEN 'source' THEN source ELSE lang END) AS content_sha256 FROM documents, (SELECT unnest(['txt', 'source', 'lang']) AS part) p WHERE CASE p.part WHEN 'txt' THEN text WHEN 'source' THEN source ELSE lang END IS NOT NULL")
def tar_round_trip(spark, d):
    """All documents as tar shards and back."""
    path = shared_path(spark, "tar")
    shards.write_tar(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("txt"), "source", "lang"), path, 8 << 20)
    return archives.tar_members(spark, f"{path}/shard-*.tar").select("key", "part", F.sha2("content", 256).alias("content_sha256"))


def _archived(spark, d):
    path = shared_path(spark, "warc")
    shards.write_warc(table(spark, d, "pages"), path, 4 << 20)
    return shards.read_warc(spark, path, 1 << 20)


_PAGES = "SELECT url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS html_sha256, NULL::VARCHAR AS error FROM pages"


def _payloads(records):
    html = F.expr("substring(content, position(X'0d0a0d0a' IN content) + 4)")
    return records.select("url", F.octet_length(html).alias("payload_bytes"), F.sha2(html, 256).alias("html_sha256"), "error")


@query(_PAGES)
def warc_by_ranges(spark, d):
    """All pages written as archives and read again in ranges of their bytes."""
    return _payloads(_archived(spark, d))


@query(_PAGES)
def warc_by_index(spark, d):
    """The same archives, each record fetched by file, offset and length."""
    index = _archived(spark, d).filter("type = 'response'").select("file", "offset", "length")
    return _payloads(shards.fetch(index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")))
