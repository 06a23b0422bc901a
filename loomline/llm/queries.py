"""The thirteen operators as driver queries over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_convert, byte_bpe, compress_tox, extendible_hash, fair_mix, fill_middle, line_templates, merkle, quote_links, rp_forest, simhash, string_kernel, token_lengths

#: The rank file that token queries use; its place is a parameter of the operators.
RANK_FILE = "byte_bpe_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.length_histogram(token_lengths.document_lengths(_table(spark, sf_dir, "documents"), *tokenizer()))


def line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_templates.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = arc_convert.pages_to_warc(_table(spark, sf_dir, "pages"))
    return arc_convert.read_warc(spark, path).withColumnRenamed("source_id", "page_id")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_hash.exact_dedup(_table(spark, sf_dir, "documents"))


def fair_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(_table(spark, sf_dir, "documents")).drop("copies")


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.conversations(_table(spark, sf_dir, "conversations"))


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), *tokenizer())


def compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return compress_tox.score_documents(docs, compress_tox.learn(docs, _table(spark, sf_dir, "labels")))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return string_kernel.predict_documents(docs, string_kernel.learn(docs))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embedding_near_dedup,
        "op2_simhash_near_dedup": simhash_near_dedup,
        "op3_token_length_histogram": token_length_histogram,
        "op4_line_template_dedup": line_template_dedup,
        "op5_arc_to_warc": arc_to_warc,
        "op6_exact_dedup": exact_dedup,
        "op7_fair_source_mix": fair_source_mix,
        "op8_quoted_conversations": quoted_conversations,
        "op9_byte_bpe": byte_bpe_round_trip,
        "op10_compression_toxicity": compression_toxicity,
        "op11_merkle_manifest": merkle_manifest,
        "op12_language_id": language_id,
        "op13_fill_in_middle": fill_in_middle,
    }


_LINES_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), joined AS (
  SELECT doc_id, pos, raw, trim(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS flat FROM raw
), lines AS (
  SELECT doc_id, pos, raw, list_transform(string_split(flat, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks
  FROM joined
), keyed AS (
  SELECT doc_id, pos, raw, toks, array_to_string(toks, ' ') AS line, len(toks) AS n, array_to_string(toks[1:4], ' ') AS head
  FROM lines WHERE array_to_string(toks, ' ') <> '' AND doc_id IS NOT NULL
), distinct_lines AS (
  SELECT n, head, line, md5(line) AS h, any_value(toks) AS toks, min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS c, count(DISTINCT doc_id) AS docs FROM keyed GROUP BY n, head, line
), links AS (
  SELECT a.h AS a, b.h AS b FROM distinct_lines a JOIN distinct_lines b ON a.n = b.n AND a.head = b.head AND a.h <> b.h
  WHERE a.n > 4 AND 5 * len(list_filter(range(1, a.n + 1), lambda i: a.toks[i] = b.toks[i])) >= 4 * a.n
), reach AS (
  SELECT a AS h, a AS root FROM links UNION SELECT r.h, l.b FROM reach r JOIN links l ON r.root = l.a
), roots AS (
  SELECT h, min(root) AS root FROM reach GROUP BY h
), assigned AS (
  SELECT d.*, coalesce(r.root, d.h) AS template FROM distinct_lines d LEFT JOIN roots r ON r.h = d.h
), recurring AS (
  SELECT template, min(lo) AS first_id FROM assigned GROUP BY template HAVING min(lo) <> max(hi) AND (max(n) > 4 OR max(docs) >= 2 ** (6 - max(n)))
), found AS (
  SELECT a.line, r.first_id FROM assigned a JOIN recurring r USING (template)
), lost AS (
  SELECT k.doc_id, k.pos FROM keyed k JOIN found f USING (line) WHERE f.first_id <> k.doc_id
), per_doc AS (
  SELECT r.doc_id, count(*) AS n_lines, count(l.pos) AS n_dropped,
    coalesce(string_agg(r.raw, chr(10) ORDER BY r.pos) FILTER (WHERE l.pos IS NULL), '') AS kept
  FROM raw r LEFT JOIN lost l ON l.doc_id = r.doc_id AND l.pos = r.pos GROUP BY r.doc_id
)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.n_dropped, 0) AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN sha256(p.kept) END AS text_sha256
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), k AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * i + 1, 5))::INT >> s) & 31)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM k
"""

_EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents
), sums AS (
  SELECT source, sum(size) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sums
), leveled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE) / (sum(w) OVER after)::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), settled AS (
  SELECT *, (SELECT level FROM leveled WHERE cap::DOUBLE / w >= level ORDER BY cap::DOUBLE / w, level LIMIT 1) AS final FROM leveled
), goals AS (
  SELECT source, source_size, coalesce(CASE WHEN cap <= w * final THEN cap::DOUBLE ELSE w * final END, cap::DOUBLE) AS target FROM settled
), queued AS (
  SELECT s.*, g.source_size, g.target, sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT doc_id, source, turn, size, e, (cum + e * source_size)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1]) AS e) WHERE size > 0
), ranged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, turn, e RANGE UNBOUNDED PRECEDING) AS total FROM copies
), taken AS (
  SELECT doc_id, source, count(*) AS n FROM ranged WHERE total <= (SELECT sum(target) FROM goals) + 0.000001 GROUP BY doc_id, source
)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(t.n, 0) * q.size AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.source IS NOT DISTINCT FROM t.source
"""


#: A tree's nodes are made level by level; an id's crc32 is eight shifts a character.
_MERKLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, source, n_chars, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce(list_transform(range(0, length(doc_id::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr(doc_id::VARCHAR, i, 1)) END::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256(head || {text}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || {lowered}) END AS tampered
  FROM (SELECT *, {doc_id} || {source} || {lang} || {n_chars} AS head FROM fields)
), leaves AS (
  SELECT *, coalesce('+' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 8, n
), subroots AS (
  SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree <> '-', encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY lvl, pos // 8, n
), beside AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
), beside_top AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM upper a JOIN upper b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
), steps AS (
  SELECT v.tree, v.pos, b.lvl, b.l, b.r FROM leaves v JOIN beside b ON b.tree = v.tree AND b.pos = v.pos // (8 ** b.lvl)::BIGINT
  UNION ALL
  SELECT v.tree, v.pos, 1000 + b.lvl, b.l, b.r FROM leaves v JOIN subroots s USING (tree) JOIN beside_top b ON b.pos = s.pos // (8 ** b.lvl)::BIGINT
), paths AS (
  SELECT tree, pos, string_agg(l || r, '' ORDER BY lvl) AS siblings, list(l || '|' || r ORDER BY lvl) AS path FROM steps GROUP BY tree, pos
), folded AS (
  SELECT v.doc_id, v.leaf, s.subroot, (SELECT node FROM upper WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce([coalesce(v.tampered, v.leaf)] || coalesce(p.path, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM leaves v JOIN subroots s USING (tree) LEFT JOIN paths p ON p.tree = v.tree AND p.pos = v.pos
)
SELECT *, folded_root = root AS verified FROM folded
""".format(**{c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "text", "lowered")})

_FIM_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS kept, ('0x' || h[25:32])::BIGINT % 100 AS turn FROM cut
), formed AS (
  SELECT *, least(a, b) AS low, greatest(a, b) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR kept >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, substr(text, 1, low) AS p, substr(text, low + 1, high - low) AS m, substr(text, high + 1) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express on whole tables."""
    return {
        "op4_line_template_dedup": _LINES_SQL,
        "op5_arc_to_warc": _WARC_SQL,
        "op6_exact_dedup": _EXACT_SQL,
        "op7_fair_source_mix": _MIX_SQL,
        "op11_merkle_manifest": _MERKLE_SQL,
        "op13_fill_in_middle": _FIM_SQL,
    }
