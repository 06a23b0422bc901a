"""Queries over chat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat, latex
from ..functions import text as T
from ..operators import mixing
from ..tables import table
from .registry import query

_PAIRS = "WITH p AS (SELECT conv_id, turn, text AS prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations)"


def _pairs(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("response"))


@query(f"""{_PAIRS} SELECT conv_id, turn, 'system:s|user:' || prompt || '|assistant:<think>' || chr(10) || prompt || chr(10) || '</think>' || chr(10) || response AS thinking,
  'user:' || prompt || '|assistant:' || regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS plain FROM p WHERE response IS NOT NULL AND prompt <> ''""")
def built_conversations(spark, d):
    rows = _pairs(spark, d).filter("response is not null and prompt <> ''")
    shown = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    think = chat.conversation(F.col("prompt"), F.col("response"), F.col("prompt"), True, "s")
    plain = chat.conversation(F.col("prompt"), F.concat(F.lit("<think>x</think>"), "response"), F.lit(None).cast("string"), False)
    return rows.select("conv_id", "turn", shown(think).alias("thinking"), shown(plain).alias("plain"))


@query("""
WITH q AS (SELECT p_partkey, p_brand, p_name || chr(10) || 'A. ' || p_type || chr(10) || 'B. ' || p_brand || chr(10) || 'Answer:' AS q, chr((65 + p_partkey % 2)::INT) AS a FROM part),
s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM q),
f AS (SELECT p_brand, string_agg(q || ' ' || a || chr(10) || chr(10), '' ORDER BY p_partkey) AS shots FROM s WHERE r <= 2 GROUP BY p_brand)
SELECT p_partkey, shots || q AS prompt FROM q JOIN f USING (p_brand)""")
def choice_prompts(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.array("p_type", "p_brand").alias("choices"), (F.col("p_partkey") % 2).cast("int").alias("answer"))
    shot = chat.choice_question(F.col("p_name"), F.col("choices"), F.col("answer"))
    first = mixing.take_per_key(rows, "p_brand", "p_partkey", 2).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", shot.alias("s")))).alias("f"))
    joined = rows.join(first.select("p_brand", F.transform("f", lambda x: x["s"]).alias("shots")), "p_brand")
    return joined.select("p_partkey", chat.with_shots(chat.choice_question(F.col("p_name"), F.col("choices")), F.col("shots")).alias("prompt"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+')) AS mail, unnest(range(len(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+'))))::INT AS nth FROM documents")
def exploded_mails(spark, d):
    found = F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("nth", "mail")).select("doc_id", "mail", "nth")


@query("SELECT conv_id, turn, replace(replace(text || '?.!.', '?.', '?'), '!.', '?') AS text FROM conversations")
def repaired_punctuation(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", chat.repaired_punctuation(F.concat("text", F.lit("?.!."))).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 3 > 0 AS valid FROM events")
def keyword_arguments(spark, d):
    found, valid = chat.keyword_arguments(F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise("{not json"))
    return table(spark, d, "events").select("event_id", F.try_element_at(found, F.lit("k")).alias("k"), valid.alias("valid"))


@query("""
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id, event_id // 40)
SELECT user_id, array_to_string(list_sort(t), ',') AS types FROM u WHERE NOT (list_contains(t, 'signup') AND (list_contains(t, 'error') OR list_contains(t, 'purchase'))) AND NOT (list_contains(t, 'view') AND list_contains(t, 'click'))""")
def conflicting_instructions_removed(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.expr("event_id div 40")).agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    clash = chat.conflicts(F.col("t"), {"signup": ["error", "purchase"], "view": ["click"]})
    return rows.filter(~clash).select("user_id", F.array_join("t", ",").alias("types"))


@query(f"{_PAIRS} SELECT conv_id, turn FROM p WHERE length(prompt) > 0 AND length(response) > 0")
def preference_rows(spark, d):
    return _pairs(spark, d).filter(chat.preference_ok(F.col("prompt"), F.col("response"))).select("conv_id", "turn")


@query("""
WITH m AS (SELECT conv_id, turn, role, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations)
SELECT conv_id, start::INT AS start, (start + n)::INT AS "end" FROM m WHERE role <> 'assistant'""")
def masked_spans(spark, d):
    return chat.masked_spans(table(spark, d, "conversations"))


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(replace(translate(lower(text || ' The two-three a One!'), '""" + T.EXOTIC_SPACES + "', '" + " " * len(T.EXOTIC_SPACES) + """'), '-', ''), '[!"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~\\n\\t]', ' ', 'g'), ' '), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: CASE x WHEN 'none' THEN '0' WHEN 'zero' THEN '0' WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5' WHEN 'six' THEN '6' WHEN 'seven' THEN '7' WHEN 'eight' THEN '8' WHEN 'nine' THEN '9' WHEN 'ten' THEN '10' ELSE x END), ' ') AS answer FROM w""")
def normalised_answers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", chat.normalised_answer(F.concat("text", F.lit(" The two-three a One!"))).alias("answer"))


@query(r"""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '\frac{' || conv_id || '}{' || length(text) || '}' WHEN 1 THEN length(text)::VARCHAR WHEN 2 THEN chr(65 + (conv_id % 5)::INT) ELSE '0.' || (100 + conv_id) END AS answer
FROM conversations WHERE NOT contains(text, 'boxed') AND NOT contains(text, 'final answer is')""")
def math_answers(spark, d):
    """Answers in four ways of stating them behind each message, found again and written in one way."""
    n = F.length("text").cast("string")
    fraction = F.concat(F.lit(r" so $\boxed{\tfrac{"), F.col("conv_id").cast("string"), F.lit("}{"), n, F.lit(r"} \text{ m}}$ holds"))
    said = F.when(F.col("turn") % 4 == 0, fraction).when(F.col("turn") % 4 == 1, F.concat(F.lit(" or $"), F.format_number(F.length("text"), 2)))
    said = said.when(F.col("turn") % 4 == 2, F.concat(F.lit(" so the answer is ("), F.char(65 + F.col("conv_id") % 5), F.lit(").")))
    said = said.otherwise(F.concat(F.lit(" The final answer is $ x = ."), (100 + F.col("conv_id")).cast("string"), F.lit(r"\%$. I hope it is.")))
    rows = table(spark, d, "conversations").filter(~F.contains("text", F.lit("boxed")) & ~F.contains("text", F.lit("final answer is")))
    found = latex.extracted(F.concat("text", said), F.when(F.col("turn") % 4 == 2, "mmlu").otherwise("math"))
    return rows.select("conv_id", "turn", found.alias("answer"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM w), k AS (SELECT doc_id, w, md5(doc_id || ':' || i || ':' || w) AS h FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, w) AS r FROM k)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY r) FILTER (WHERE r <= 50), '') AS negative FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def synthetic_negatives(spark, d):
    return table(spark, d, "documents").select("doc_id", chat.degraded(F.col("text"), F.col("doc_id").cast("string")).alias("negative"))


_GERMAN = "äöüßÄÖÜ"


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, w, unnest([0, 1, 2]) AS k FROM w),
s AS (SELECT doc_id, w, ('0x' || substr(md5(doc_id || ':' || k), 1, 8))::BIGINT % (greatest(len(w) - 100, 0) + 1) AS s FROM v),
t AS (SELECT doc_id, array_to_string(w[s + 1 : s + 100], ' ') AS t FROM s)
SELECT doc_id, sum((coalesce(length(regexp_replace(t, '[^{_GERMAN}]', '', 'g'))::DOUBLE / nullif(length(t), 0), 0) > 0.01::DOUBLE)::INT) >= 2 AS consistent FROM t GROUP BY doc_id""")
def language_consistency(spark, d):
    return table(spark, d, "documents").select("doc_id", chat.consistent_language(F.col("text"), _GERMAN, F.col("doc_id").cast("string")).alias("consistent"))


@query("""
SELECT NULL::VARCHAR AS image, text, 'conversations' AS source, '{"conv_id":' || conv_id || ',"role":"' || role || '"}' AS meta FROM conversations
UNION ALL SELECT url, html, 'pages', '{"page_id":' || page_id || '}' FROM pages
UNION ALL SELECT NULL, text, 'benchmark', '{"item_id":' || item_id || '}' FROM benchmark""")
def one_schema(spark, d):
    def cast(name, text, image, *rest):
        rows = table(spark, d, name)
        return rows.select((F.col(image) if image else F.lit(None).cast("string")).alias("image"), F.col(text).alias("text"), F.lit(name).alias("source"), F.to_json(F.struct(*rest)).alias("meta"))

    return cast("conversations", "text", None, "conv_id", "role").unionByName(cast("pages", "html", "url", "page_id")).unionByName(cast("benchmark", "text", None, "item_id"))
