"""Queries over documents and pages: statistics, filters, deduplication, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, html, lexicon, quality
from ..sources.shared import written
from ..tables import table
from .registry import query

# SQL fragments
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SPLIT_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
STRIP = r"""regexp_replace(regexp_replace({}, '^[!-/:-@\[-`{{-~0-9 ]+', ''), '[!-/:-@\[-`{{-~0-9 ]+$', '')"""
WORDS = f"list_filter(list_transform(regexp_split_to_array(text, '[ \\n\\t]'), lambda x: {STRIP.format('lower(x)')}), lambda x: x <> '')"
GERMAN = "äöüßÄÖÜ"
#: crc32 of the text of doc_id, bit by bit.
CRC = """xor(list_reduce(list_transform(range(0, length(doc_id::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr(doc_id::VARCHAR, i, 1)) END::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query(rf"""
WITH b AS (SELECT unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(t[i:i+12], ' '))) AS gram
           FROM (SELECT {TOKENS} AS t FROM benchmark) WHERE len(t) >= 13),
d AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(t[i:i+12], ' '))) AS gram
      FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE len(t) >= 13)
SELECT doc_id, lang, source, text FROM documents WHERE doc_id NOT IN (SELECT d.doc_id FROM d JOIN b USING (gram))""")
def decontaminate(spark, d):
    return dedup.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "lang", "source", "text")


@query(rf"SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g') AS clean FROM documents")
def non_printing_removed(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remove_non_printing(F.col("text")).alias("clean"))


_PUNCT_SQL = "regexp_replace(translate(lower(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')), '" + T.EXOTIC_SPACES + "', '" + " " * len(T.EXOTIC_SPACES) + "'), '\\p{Nd}', '0', 'g')"
for _a, _b in T.UNICODE_PUNCTUATION.items():
    _PUNCT_SQL = f"replace({_PUNCT_SQL}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT doc_id, {_PUNCT_SQL} AS clean FROM documents")
def normalised_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {STRIP.format('text')} AS stripped, list_count(string_split(text, chr(10))) AS n_lines FROM documents")
def stripped_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_characters(F.col("text")).alias("stripped"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"""
SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(w))::DOUBLE / len(w) END AS single_word_repetition,
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: list_contains({_STOPS}, x)))::DOUBLE / len(w) END AS stop_words,
  CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '[^!-/:-@\\[-`{{-~0-9]', '', 'g'))::DOUBLE / length(text) END AS special_characters,
  CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '[^{GERMAN}]', '', 'g'))::DOUBLE / length(text) END AS diacritics,
  length(text) / 3.8::DOUBLE AS estimated_tokens
FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)""")
def text_statistics(spark, d):
    rows = T.once(table(spark, d, "documents").select("doc_id", "text"), w=T.words(F.col("text")))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), T.single_word_repetition(F.col("w")).alias("single_word_repetition"), T.member_ratio(F.col("w"), T.STOP_WORDS).alias("stop_words"), T.special_character_ratio(F.col("text")).alias("special_characters"), T.diacritic_fraction(F.col("text"), GERMAN).alias("diacritics"), T.estimated_tokens(F.col("text")).alias("estimated_tokens"))


@query(rf"""
WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \n\t]'), lambda x: x <> '')) AS n,
  regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+|[!-&(-/:-@\[-^`{{-~]') AS k FROM documents)
SELECT doc_id, CASE WHEN n < 3 THEN 1.0::DOUBLE WHEN len(k) = 0 THEN 0.0 ELSE len(list_filter(k, lambda x: regexp_full_match(x, '[!-&(-/:-@\[-^`{{-~]')))::DOUBLE / len(k) END AS punctuation FROM t""")
def punctuation_ratios(spark, d):
    return table(spark, d, "documents").select("doc_id", T.punctuation_ratio(F.col("text")).alias("punctuation"))


@query(f"""
WITH g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END) AS gram
           FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
c AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL)
SELECT d.doc_id, coalesce(sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c), 0.0) AS ratio FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def word_gram_repetition(spark, d):
    return quality.gram_repetition(table(spark, d, "documents"), 5)


@query("""
WITH g AS (SELECT doc_id, unnest(CASE WHEN length(text) >= 10 THEN list_transform(range(1, length(text) - 8), lambda i: substr(text, i, 10)) ELSE [] END) AS gram FROM documents),
c AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS r, count(*) OVER (PARTITION BY doc_id) AS n, sum((c = 1)::INT) OVER (PARTITION BY doc_id) AS ones FROM c)
SELECT d.doc_id, coalesce(sum(CASE WHEN r <= least(floor(sqrt(n)), n - ones) THEN c ELSE 0 END)::DOUBLE / sum(c), 0.0) AS ratio FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def character_gram_repetition(spark, d):
    return quality.gram_repetition(table(spark, d, "documents"), 10, characters=True)


_ROLES = [("src1", "decay_math"), ("src7", "science"), ("src2", "web")]


def _dup(separator, name):
    lines = f"list_filter(string_split(text, {separator}), lambda x: trim(x, ' ') <> '')"
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    share = lambda part, whole: f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0)"
    return f"{share(f'len({lines}) - len(list_distinct({lines}))', f'len({lines})')} AS {name}_share, {share(size.format(lines) + ' - ' + size.format(f'list_distinct({lines})'), size.format(lines))} AS {name}_chars"


def _gram(n, top):
    keyed = f"SELECT doc_id, i, CASE WHEN i + {n} <= len(w) THEN array_to_string(w[i + 1 : i + {n}], ' ') END AS g, length(w[i + 1]) AS c FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words)"
    if top:
        return f"SELECT doc_id, max(CASE WHEN k = m AND k > 1 THEN k * length(g) ELSE 0 END) AS chars FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, g, count(*) AS k FROM ({keyed}) WHERE g IS NOT NULL GROUP BY doc_id, g)) GROUP BY doc_id"
    again = f"SELECT doc_id, i, c, coalesce((g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1)::INT, 0) AS r FROM ({keyed})"
    return f"SELECT doc_id, sum(CASE WHEN near > 0 THEN c ELSE 0 END) AS chars FROM (SELECT doc_id, c, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS near FROM ({again})) GROUP BY doc_id"


_LIMITS = [*((n, x, True) for n, x in quality.Repetition().top), *((n, x, False) for n, x in quality.Repetition().repeated)]
_C4 = "array_to_string(list_filter(string_split({t}, chr(10)), lambda x: {ok}), chr(10))"
_LINE_WORDS = r"len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
_NO_SCRIPT = "NOT contains(lower(x), 'javascript') AND NOT regexp_matches(lower(x), 'terms of use|privacy policy|cookie policy|uses cookies|use of cookies|use cookies')"
_ENDS = "regexp_matches(x, '[.!?\"''][ \\t]*$') AND NOT regexp_matches(x, '\\.\\.\\.[ \\t]*$')"
_STRICT = _C4.format(t=r"regexp_replace(text, '\[[0-9]*\]|\[edit\]|\[citation needed\]', '', 'g')", ok=f"{_ENDS} AND {_NO_SCRIPT} AND {_LINE_WORDS} >= 3")
_LENIENT = _C4.format(t="text", ok=f"{_NO_SCRIPT} AND {_LINE_WORDS} >= 1")
_DOCUMENT = "len(regexp_extract_all({0}, '[.!?]')) >= {1} AND NOT contains(lower({0}), 'lorem ipsum') AND NOT contains({0}, '{{')"
_ROUTED = rf"""
WITH words AS MATERIALIZED (SELECT doc_id, text, lang, source, {SPLIT_WORDS} AS w, string_split(text, chr(10)) AS l FROM documents),
grams AS MATERIALIZED (SELECT doc_id, bool_and(ok) AS ok FROM ({" UNION ALL ".join(f"SELECT g.doc_id, g.chars::DOUBLE / greatest(length(d.text), 1) <= {x}::DOUBLE AS ok FROM ({_gram(n, top)}) g JOIN documents d USING (doc_id)" for n, x, top in _LIMITS)}) GROUP BY doc_id),
s AS (SELECT words.doc_id, text, source, lang, w,
  len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END AS mean_word_length,
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE (length(text) - length(replace(text, '#', '')) + len(list_filter(w, lambda x: ends_with(x, '...') OR ends_with(x, '…'))))::DOUBLE / len(w) END AS symbol_ratio,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ 	]*[-•*]')))::DOUBLE / len(l) AS bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	]*$')))::DOUBLE / len(l) AS ellipsis_lines,
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::DOUBLE / len(w) END AS alpha_words,
  len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({_STOPS}, x)))) AS stop_words,
  coalesce(length(regexp_replace(text, '[^{GERMAN}]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0) AS marks,
  {_dup("chr(10)", "line")}, {_dup("chr(10) || chr(10)", "block")}, {_STRICT} AS strict, {_LENIENT} AS lenient, coalesce(grams.ok, true) AS grams_ok
  FROM words LEFT JOIN grams ON grams.doc_id = words.doc_id),
f AS (SELECT *, list_filter(string_split(strict, chr(10)), lambda x: trim(x, ' ') <> '') AS sl, len(list_filter(regexp_split_to_array(strict, '[ 
	]'), lambda x: x <> '')) AS sn,
  line_share <= 0.3::DOUBLE AND line_chars <= 0.2::DOUBLE AND block_share <= 0.3::DOUBLE AND block_chars <= 0.2::DOUBLE AND grams_ok AS again_ok,
  n_words BETWEEN 50 AND 100000 AND mean_word_length <= 10 AND symbol_ratio <= 0.1::DOUBLE AND bullet_lines <= 0.9::DOUBLE AND ellipsis_lines <= 0.3::DOUBLE AND alpha_words >= 0.65::DOUBLE AS gopher FROM s),
r AS (SELECT *, CASE WHEN NOT (length(text) BETWEEN 300 AND 500000) OR len(list_filter(w, lambda x: length(x) > 1000)) > 0 THEN 'rejected'
  WHEN source IN ('src1', 'src7') THEN 'math'
  WHEN CASE WHEN coalesce(lang, '') <> '' THEN lang = 'de' ELSE marks >= 0.01::DOUBLE END THEN 'marked' ELSE 'english' END AS route FROM f),
routed AS MATERIALIZED (SELECT doc_id, route, CASE route WHEN 'rejected' THEN false WHEN 'math' THEN n_words >= 30 AND again_ok
  WHEN 'marked' THEN gopher AND mean_word_length >= 2 AND again_ok AND {_DOCUMENT.format("lenient", 1)} AND marks >= 0.002::DOUBLE
  ELSE gopher AND mean_word_length >= 3 AND stop_words >= 2 AND again_ok AND {_DOCUMENT.format("strict", 5)} AND trim(strict, ' ') <> ''
    AND coalesce(len(list_filter(sl, lambda x: regexp_matches(x, '[.!?"'']$')))::DOUBLE / nullif(len(sl), 0), 0) >= 0.12::DOUBLE
    AND coalesce(len(list_filter(sl, lambda x: length(x) <= 30))::DOUBLE / nullif(len(sl), 0), 0) <= 0.67::DOUBLE
    AND coalesce((list_sum(list_transform(sl, lambda x: length(x))) - list_sum(list_transform(list_distinct(sl), lambda x: length(x))))::DOUBLE / nullif(list_sum(list_transform(sl, lambda x: length(x))), 0), 0) <= 0.01::DOUBLE
    AND coalesce((length(strict) - length(replace(strict, chr(10), '')))::DOUBLE / nullif(sn, 0), 0) <= 0.3::DOUBLE END AS kept FROM r)"""


def _routed(spark, d, statistics=False):
    roles = spark.createDataFrame(_ROLES, "source string, role string")
    return quality.kept_by_route(table(spark, d, "documents"), roles, "de", GERMAN, statistics=statistics)


@query(f"{_ROUTED} SELECT doc_id, route, kept FROM routed")
def quality_router(spark, d):
    return _routed(spark, d).select("doc_id", "route", "kept")


@query(f"{_ROUTED} SELECT lang AS language, source AS dataset, count(*) AS total, avg(gopher::INT) AS old_rate, avg(kept::INT) AS new_rate FROM documents JOIN routed USING (doc_id) JOIN (SELECT doc_id, gopher AND mean_word_length >= 3 AND stop_words >= 2 AS gopher FROM f) USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def router_survival(spark, d):
    """Rates of the language-blind quality filter and of the router."""
    from ..operators import scoring

    rows = _routed(spark, d, statistics=True).withColumn("_old", quality.gopher_quality())
    return scoring.survival(rows, "lang", "source", F.col("_old"), F.col("kept"))


#: Of the rows of ``one`` those that are the smallest id of what 5-word shingles link at 0.8, by all pairs that share one.
_NEAR = rf"""sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM (SELECT doc_id, {TOKENS} AS t FROM one)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
near AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE k::DOUBLE / (p.n + q.n - k) >= 0.8::DOUBLE),
up AS (SELECT b AS doc_id, a AS reach FROM near UNION SELECT a, b FROM near UNION SELECT u.doc_id, CASE WHEN n.a = u.reach THEN n.b ELSE n.a END FROM up u JOIN near n ON u.reach IN (n.a, n.b)),
distinct_texts AS (SELECT * FROM one WHERE doc_id NOT IN (SELECT doc_id FROM up GROUP BY doc_id HAVING min(reach) < doc_id))"""
_MAIL_SQL, _IP_SQL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


@query(rf"""{_ROUTED.replace("WITH", "WITH RECURSIVE", 1)},
one AS (SELECT doc_id, text FROM (SELECT d.doc_id, d.text, row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) AS r FROM documents d JOIN routed USING (doc_id) WHERE kept AND d.lang IN ('en', 'de', 'fr')) WHERE r = 1),
{_NEAR},
gated AS (SELECT doc_id, text FROM distinct_texts LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id) WHERE trim(text, ' ') <> '' AND (q IS NULL OR q >= 1)),
b AS (SELECT unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(t[i:i+12], ' '))) AS gram FROM (SELECT {TOKENS} AS t FROM benchmark) WHERE len(t) >= 13),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(t[i:i+12], ' '))) AS gram FROM (SELECT doc_id, {TOKENS} AS t FROM gated) WHERE len(t) >= 13),
clean AS (SELECT doc_id, text, regexp_replace(text, '{_MAIL_SQL}', '<|pii|>', 'g') AS t1 FROM gated WHERE doc_id NOT IN (SELECT g.doc_id FROM g JOIN b USING (gram))),
red AS (SELECT doc_id, text, t1, regexp_replace(t1, '{_IP_SQL}', '<|pii|>', 'g') AS t2 FROM clean)
SELECT doc_id, length(t2) AS n_chars, len(regexp_extract_all(text, '{_MAIL_SQL}')) + len(regexp_extract_all(t1, '{_IP_SQL}')) AS replaced, sha256(t2) AS text_sha256 FROM red""")
def curated(spark, d):
    """The curation chain: language, quality by route, exact and near copies, classifier gate, benchmark passages, personal data."""
    docs = written(_routed(spark, d).filter(F.col("kept") & F.col("lang").isin("en", "de", "fr")).select("doc_id", "text"), "kept")
    one = dedup.minhash_dedup(docs)
    gated = quality.classifier_gate(one, table(spark, d, "labels"), 1)
    clean = dedup.decontaminate(gated, table(spark, d, "benchmark"))
    return T.redact(clean, patterns=(T.EMAIL, T.IP)).select("doc_id", F.length("text").cast("long").alias("n_chars"), "replaced", F.sha2("text", 256).alias("text_sha256"))


@query(rf"""
WITH p AS (SELECT doc_id, text, {SPLIT_WORDS} AS w, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, len(w) AS n_words,
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END AS mean_word_length,
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE (length(text) - length(replace(text, '#', '')) + len(list_filter(w, lambda x: ends_with(x, '...') OR ends_with(x, '…'))))::DOUBLE / len(w) END AS symbol_ratio,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-•*]')))::DOUBLE / len(l) AS bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t]*$')))::DOUBLE / len(l) AS ellipsis_lines,
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::DOUBLE / len(w) END AS alpha_words,
  len(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({_STOPS}, x)))) AS stop_words FROM p)
SELECT doc_id, n_words, mean_word_length, symbol_ratio, bullet_lines, ellipsis_lines, alpha_words, stop_words,
  n_words BETWEEN 50 AND 100000 AND mean_word_length BETWEEN 3 AND 10 AND symbol_ratio <= 0.1 AND bullet_lines <= 0.9 AND ellipsis_lines <= 0.3 AND alpha_words >= 0.65 AND stop_words >= 2 AS passes FROM s""")
def gopher_quality(spark, d):
    rows = quality.gopher_statistics(table(spark, d, "documents").select("doc_id", "text")).drop("text")
    return rows.withColumn("passes", quality.gopher_quality()).withColumn("n_words", F.col("n_words").cast("long")).withColumn("stop_words", F.col("stop_words").cast("long"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 0.0::DOUBLE ELSE (len(l) - len(list_distinct(l)))::DOUBLE / len(l) END AS duplicate_lines,
  coalesce((list_sum(list_transform(l, lambda x: length(x))) - list_sum(list_transform(list_distinct(l), lambda x: length(x))))::DOUBLE / nullif(list_sum(list_transform(l, lambda x: length(x))), 0), 0.0) AS duplicate_characters FROM l""")
def gopher_repetition(spark, d):
    lines, characters = quality.duplicate_lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", lines.alias("duplicate_lines"), characters.alias("duplicate_characters"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '\[[0-9]*\]|\[edit\]|\[citation needed\]', '', 'g') AS text FROM documents),
c AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[.!?"''][ \t]*$') AND NOT regexp_matches(x, '\.\.\.[ \t]*$')
  AND NOT contains(lower(x), 'javascript') AND NOT regexp_matches(lower(x), 'terms of use|privacy policy|cookie policy|uses cookies|use of cookies|use cookies')
  AND len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 3), chr(10)) AS text FROM t)
SELECT doc_id, text FROM c WHERE len(regexp_extract_all(text, '[.!?]')) >= 5 AND NOT contains(lower(text), 'lorem ipsum') AND NOT contains(text, '{')""")
def c4_cleaned(spark, d):
    # the document predicate is judged on the rewritten text, which a filter pushed below the projection would rewrite twice
    cut = table(spark, d, "documents").select("doc_id", quality.c4_lines(F.col("text")).alias("text"))
    return cut.filter(quality.c4_document(F.col("text")))


@query(r"""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l,
  len(list_filter(regexp_split_to_array(text, '[ \n\t]'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(l, lambda x: regexp_matches(x, '[.!?"'']$')))::DOUBLE / len(l) END AS line_punct_ratio,
  CASE WHEN len(l) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(l, lambda x: length(x) <= 30))::DOUBLE / len(l) END AS short_line_ratio,
  coalesce((list_sum(list_transform(l, lambda x: length(x))) - list_sum(list_transform(list_distinct(l), lambda x: length(x))))::DOUBLE / nullif(list_sum(list_transform(l, lambda x: length(x))), 0), 0.0) AS char_dup_ratio,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE (length(text) - length(replace(text, chr(10), '')))::DOUBLE / n END AS newline_word_ratio FROM l""")
def fineweb_statistics(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in quality.fineweb_statistics(F.col("text")).items()])


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches(h, '[{GERMAN}]') THEN 'de' WHEN regexp_matches(h, '[A-Za-z]') THEN 'en' ELSE 'other' END AS language,
  CASE WHEN regexp_matches(h, '[{GERMAN}]') THEN 0.70::DOUBLE WHEN regexp_matches(h, '[A-Za-z]') THEN 0.60 ELSE 0.50 END AS score
FROM (SELECT doc_id, translate(substr(text, 1, 512), chr(10), ' ') AS h FROM documents)""")
def heuristic_language(spark, d):
    language, score = quality.heuristic_language(F.col("text"), GERMAN, "de")
    return table(spark, d, "documents").select("doc_id", language.alias("language"), score.alias("score"))


@query("SELECT doc_id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id) WHERE trim(text, ' ') <> '' AND (q IS NULL OR q >= 1)")
def classifier_gate(spark, d):
    return quality.classifier_gate(table(spark, d, "documents"), table(spark, d, "labels"), 1).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND length(text) >= 500")
def source_filter(spark, d):
    return table(spark, d, "documents").filter(F.col("source").isin("src1", "src2", "src3") & (F.length("text") >= 500)).select("doc_id", "source")


_W_X = WORDS.replace("(text,", "(x,")
_NODE_WORDS = f"list_filter(list_transform(regexp_split_to_array(p, '[ \\n\\t]'), lambda x: {STRIP.format('lower(x)')}), lambda x: x <> '')"


@query(rf"""
WITH n AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS p FROM documents),
w AS (SELECT *, {_NODE_WORDS} AS w FROM n),
k AS (SELECT doc_id, i, p FROM w WHERE p = 'END' OR (len(w) BETWEEN 4 AND 1000
  AND coalesce(length(regexp_replace(p, '[^!-/:-@\[-`{{-~0-9]', '', 'g'))::DOUBLE / nullif(length(p), 0), 0) <= 0.3
  AND 1 - len(list_distinct(w))::DOUBLE / len(w) <= 0.5))
SELECT d.doc_id, coalesce(string_agg(k.p, chr(10) ORDER BY k.i), '') AS text FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def node_filter(spark, d):
    return quality.node_filter(table(spark, d, "documents").select("doc_id", "text"))


@query()
def web_document_filter(spark, d):
    """All checks of web paragraphs and documents; the stop words and common words are the corpus's most frequent ones, a bounded list."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    counts = lexicon.frequencies(docs).orderBy(F.desc("total"), "word").limit(65_536)
    common = [r.word for r in counts.collect()]
    return quality.web_document_filter(docs, common[:100], T.SPAM_WORDS, common, separator="\n")


@query(rf"""
WITH n AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS p FROM documents),
w AS (SELECT *, {_NODE_WORDS} AS w FROM n),
k AS (SELECT doc_id, i, p FROM w WHERE coalesce(len(list_filter(w, lambda x: x IN ('the', 'and')))::DOUBLE / nullif(len(w), 0), 0) < 0.12)
SELECT d.doc_id, coalesce(string_agg(k.p, chr(10) ORDER BY k.i), '') AS text FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def spam_paragraphs_removed(spark, d):
    return table(spark, d, "documents").select("doc_id", quality.remove_spam(F.col("text"), ["the", "and"]).alias("text"))


@query(r"""
SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'logo|button|icon|plugin|widget|porn|xxx|sex')
AND NOT contains(lower(html), 'lorem ipsum')
AND len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 10""")
def html_filter(spark, d):
    bad = F.col("url").rlike("logo|button|icon|plugin|widget|porn|xxx|sex") | F.lower("html").contains("lorem ipsum")
    return table(spark, d, "pages").filter(~bad & (html.visible_words(F.col("html")) >= 10)).select("page_id", "url")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') NOT IN ('UNSURE', 'NSFW')")
def safety_tag_filter(spark, d):
    tag = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", tag.alias("k")).filter(~F.coalesce(F.col("k"), F.lit("")).isin("UNSURE", "NSFW"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+', '<|pii|>', 'g') AS t1,
  len(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+')) AS n1 FROM documents)
SELECT doc_id, regexp_replace(t1, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<|pii|>', 'g') AS text, n1 + len(regexp_extract_all(t1, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS replaced FROM a""")
def mail_and_ip_redacted(spark, d):
    return T.redact(table(spark, d, "documents").select("doc_id", "text"), patterns=(T.EMAIL, T.IP))


@query()
def pii_redacted(spark, d):
    return T.redact(table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_copies_removed(spark, d):
    return dedup.exact(table(spark, d, "documents"), F.sha2("text", 256), "doc_id").select("doc_id", "text")


_KEY = r"regexp_replace(url, '[?#].*$', '')"


@query(rf"SELECT page_id, key FROM (SELECT page_id, regexp_extract({_KEY}, '^https?://([^/?#]*)', 1) AS key, page_id // 10 AS version FROM pages) QUALIFY version = max(version) OVER (PARTITION BY key)")
def latest_per_url(spark, d):
    rows = table(spark, d, "pages").select("page_id", T.domain(F.regexp_replace("url", r"[?#].*$", "")).alias("key"), F.floor(F.col("page_id") / 10).alias("version"))
    return dedup.latest_with_ties(rows, "key", "version").select("page_id", "key")


@query(r"SELECT domain, n, (SELECT sum(n) - count(*) FROM (SELECT count(*) AS n FROM pages GROUP BY regexp_extract(url, '^https?://([^/?#]*)', 1) HAVING count(*) > 1))::BIGINT AS removable FROM (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1) WHERE n > 1")
def duplicate_domains(spark, d):
    found = dedup.duplicate_keys(table(spark, d, "pages").select(T.domain(F.col("url")).alias("domain")), "domain")
    return found.withColumn("removable", found.agg(F.sum(F.col("n") - 1)).scalar())


@query(r"SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, count(*) AS n, min(page_id) AS first_id, max(page_id) AS last_id FROM pages GROUP BY 1")
def domain_positions(spark, d):
    return table(spark, d, "pages").groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))


@query("""
WITH p AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS p FROM documents),
c AS (SELECT source, p FROM p GROUP BY ALL HAVING count(*) > 2),
k AS (SELECT p.* FROM p ANTI JOIN c ON p.source = c.source AND p.p = c.p)
SELECT d.doc_id, coalesce(string_agg(k.p, chr(10) ORDER BY k.i), '') AS text FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def lines_deduplicated_by_source(spark, d):
    return dedup.line_dedup_by_domain(table(spark, d, "documents"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 0)")
def opted_out_removed(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    refused = pages.filter(F.pmod("page_id", F.lit(7)) == 0).select("url").distinct()
    return pages.join(refused, "url", "left_anti").select("page_id", "url")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def all_copies_removed(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    return rows.join(dedup.duplicate_keys(rows, "digest").select("digest"), "digest", "left_anti").select("doc_id", "digest")


@query("SELECT p.page_id, h.html IS NOT NULL AS found, length(h.html) AS size FROM pages p LEFT JOIN (SELECT url, html FROM pages WHERE page_id % 3 < 2) h USING (url)")
def html_back_filled(spark, d):
    pages = table(spark, d, "pages")
    shards = pages.filter(F.pmod("page_id", F.lit(3)) == 0).unionByName(pages.filter(F.pmod("page_id", F.lit(3)) == 1)).select("url", F.col("html").alias("back"))
    return pages.select("page_id", "url").join(shards, "url", "left").select("page_id", F.col("back").isNotNull().alias("found"), F.length("back").cast("long").alias("size"))


_FIVES = "list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))"


@query(f"""WITH w AS (SELECT unnest({_FIVES}) AS gram FROM (SELECT {TOKENS} AS t FROM benchmark WHERE item_id < 50) WHERE len(t) >= 5),
g AS (SELECT doc_id, source, unnest({_FIVES}) AS gram FROM (SELECT doc_id, source, {TOKENS} AS t FROM documents) WHERE len(t) >= 5)
SELECT DISTINCT doc_id AS document, source AS url FROM g WHERE gram IN (SELECT gram FROM w)""")
def ngram_search(spark, d):
    """Documents that hold a run of five words of the first benchmark items."""
    docs = table(spark, d, "documents")
    fives = lambda rows, *ids: T.once(rows, _t=T.unicode_tokens(F.col("text"))).select(*ids, F.explode(T.ngram_hashes("_t", 5)).alias("ngram"))
    wanted = fives(table(spark, d, "benchmark").filter("item_id < 50"))
    return dedup.ngram_search(fives(docs, F.col("doc_id").alias("document")), docs.select(F.col("doc_id").alias("document"), F.col("source").alias("url")), wanted)


_MARK = "list_sum(list_transform(range({0}, {0} + 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << (i - {0})) ELSE 0 END))::BIGINT"


@query(f"""
WITH m AS (SELECT vec_id, {_MARK.format(0)} AS u, {_MARK.format(32)} AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, (bit_count(xor(a.u, b.u)) + bit_count(xor(a.v, b.v)))::INT AS bits FROM m a, m b WHERE a.vec_id % 50 = 0)
SELECT id, other, bits FROM p WHERE bits < 12""")
def hamming_neighbours(spark, d):
    mark = F.aggregate(F.transform("embedding", lambda x: (x > 0).cast("long")), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), mark.alias("mark"))
    return dedup.hamming_near(rows.filter(F.pmod("id", F.lit(50)) == 0), rows, 12)


@query(f"""WITH RECURSIVE one AS (SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1),
{_NEAR} SELECT doc_id, lang, source FROM documents JOIN distinct_texts USING (doc_id)""")
def minhash_near_dedup(spark, d):
    return dedup.minhash_dedup(table(spark, d, "documents")).select("doc_id", "lang", "source")


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents GROUP BY source HAVING count(*) > 1")
def unique_id_audit(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).filter("n > 1")


@query("SELECT DISTINCT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def shared_sources(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("lang = 'en'").select("source").intersect(docs.filter("lang = 'de'").select("source"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE length(text) > 1000")
def union_of_sets(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("lang = 'en'").select("doc_id").unionByName(docs.filter("length(text) > 1000").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 0")
def excluded_by_label(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti").distinct()


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '[ \t]+', ' ', 'g'), '[ ]?[\r\n]+[ ]?', chr(10), 'g'), '(?i)<br[ ]?/?>', '#BR_TAG#', 'g') AS html FROM pages""")
def html_collapsed(spark, d):
    return table(spark, d, "pages").select("page_id", html.collapse(F.col("html")).alias("html"))


@query()
def html_text(spark, d):
    return html.page_text(html.extract(table(spark, d, "pages")))


@query(r"""
WITH kept AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages)
SELECT page_id, 1 + (length(html) - length(replace(html, '<div class="ad">', ''))) // 16 AS ends FROM kept""")
def html_ends_by_rule(spark, d):
    rules = html.Rules(delete=("h1", *html.BLOG_DELETE), replace={"div[class~='ad']": html.BLOG_REPLACE["[class~='more-link']"]}, dates=True)
    text = html.page_text(html.extract(table(spark, d, "pages"), rules=rules))
    return text.select("page_id", F.size(F.split("text", "END_OF_DOCUMENT_TOKEN_TO_BE_REPLACED", -1)).cast("long").alias("ends"))


@query()
def html_image_pairs(spark, d):
    return html.image_text_pairs(html.extract(table(spark, d, "pages")))


@query()
def html_images_outside(spark, d):
    pages = table(spark, d, "pages")
    return html.images_outside(html.extract(pages), pages)


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i] = '' AND i > 1 AND p[i-1] = '' THEN NULL ELSE p[i] END), lambda x: x IS NOT NULL), chr(10)) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\n+$', ''), chr(10)) AS p FROM documents)")
def blank_runs_collapsed(spark, d):
    lines = F.split(F.regexp_replace("text", "\n+$", ""), "\n", -1)
    return table(spark, d, "documents").select("doc_id", F.array_join(quality.collapse_markers(lines, ""), "\n").alias("text"))
