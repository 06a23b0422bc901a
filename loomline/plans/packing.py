"""Queries over token streams.  Characters stand in for tokens where SQL checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, latex
from ..functions import text as T
from ..operators import mixing, packing, puzzles, tokens
from ..sources import shards
from ..sources.shared import shared_path, written
from ..tables import spread, table
from .registry import query

_START = "coalesce(sum({v}) OVER ({by} ORDER BY md5('0:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"


def _characters(spark, d):
    codes = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return table(spark, d, "documents").select("doc_id", codes.alias("ids"))


@query(f"SELECT doc_id, {_START.format(v='length(text) + 1', by='')} AS start, {_START.format(v='length(text) + 1', by='')} // 20000 AS shard, length(text) + 1 AS n FROM documents")
def token_shards(spark, d):
    return packing.token_shards(_characters(spark, d), 0, 20_000).select("doc_id", "start", "shard", F.size("ids").cast("long").alias("n"))


@query("""
WITH a AS (SELECT string_agg(text || '|', '' ORDER BY md5('0:' || doc_id), doc_id) AS t FROM documents)
SELECT b AS block, substr(t, (b * 2049 + 1)::BIGINT, 2049) AS text FROM a, (SELECT unnest(range(length(t) // 2049)) AS b FROM a)""")
def token_blocks(spark, d):
    return packing.token_blocks(table(spark, d, "documents"), 2049, "|", ids="text").withColumnRenamed("ids", "text")


@query(f"""
WITH r AS (SELECT doc_id, length(text) AS i, length(source) AS r, {_START.format(v='length(text) + length(source) + 4', by='')} AS start FROM documents)
SELECT doc_id, start, start + i + 3 AS answer, start + i + r + 4 AS "end" FROM r""")
def instruction_layout(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("instruction"), F.length("source").alias("response"))
    return packing.instruction_layout(rows, 1 << 20)


@query("""
WITH u AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id // 100 + 1 AS g FROM events),
s AS (SELECT user_id, i, g, coalesce(lag(g) OVER (PARTITION BY user_id ORDER BY i) <> g, true) AS first FROM u),
b AS (SELECT user_id, i FROM s WHERE first UNION ALL SELECT user_id, max(i) + 1 FROM s GROUP BY user_id)
SELECT user_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS bounds FROM b GROUP BY user_id""")
def sequence_bounds(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.expr("cast(event_id div 100 + 1 as int)").alias("g")))).alias("a"))
    padded = F.concat(F.transform("a", lambda x: x["g"]), F.array(F.lit(0), F.lit(0)))
    bounds = packing.sequence_bounds(padded)
    return rows.select("user_id", F.array_join(F.transform(bounds, lambda x: x.cast("string")), ",").alias("bounds"))


@query(f"""
WITH a AS (SELECT doc_id, source, length(text) AS n, {_START.format(v='length(text)', by='PARTITION BY source')} AS b FROM documents),
k AS (SELECT * FROM a WHERE b < 30000), g AS (SELECT doc_id, source, n, {_START.format(v='n', by='')} AS b FROM k)
SELECT doc_id, source, n FROM g WHERE b < 100000""")
def until_budget(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return packing.until_budget(rows, F.col("n"), 30_000, 100_000)


@query("""
WITH s AS (SELECT lang, source, sum(length(text))::BIGINT AS size FROM documents GROUP BY ALL HAVING sum(length(text)) >= 3000)
SELECT lang, source, size, least(size::DOUBLE / sum(size) OVER (PARTITION BY lang) * CASE lang WHEN 'en' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * 50000, size) AS budget FROM s WHERE lang IN ('en', 'de')""")
def two_level_budgets(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", F.length("text").cast("long").alias("size"))
    return packing.two_level_budgets(rows, {"en": 0.6, "de": 0.4}, 50_000, 3000)


@query("""
WITH n AS (SELECT DISTINCT event_type || '_' || (user_id % 9) || CASE WHEN user_id % 2 = 0 THEN '_s' ELSE '' END AS name FROM events)
SELECT name, regexp_extract(name, '^([a-z]+)_', 1) AS modality, regexp_extract(name, '^[a-z]+_(.*?)(_s)?$', 1) AS alias,
  CASE WHEN ends_with(name, '_s') THEN 0.25::DOUBLE ELSE 1 END / count(*) OVER (PARTITION BY regexp_extract(name, '^[a-z]+_(.*?)(_s)?$', 1)) AS weight FROM n""")
def mixture_weights(spark, d):
    short = F.when(F.col("user_id") % 2 == 0, "_s").otherwise("")
    names = table(spark, d, "events").select(F.concat("event_type", F.lit("_"), (F.col("user_id") % 9).cast("string"), short).alias("name")).distinct()
    return packing.mixture_weights(names, 0.25)


@query("SELECT doc_id, unnest(range(1, 3 + (('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT % 4 = 1)::INT))::INT AS copy FROM documents")
def mini_epoch(spark, d):
    return packing.mini_epoch(table(spark, d, "documents").select("doc_id"), 2.25, 5)


@query("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) / CASE source WHEN 'src0' THEN 3.0::DOUBLE WHEN 'src1' THEN 2 ELSE 0.5 END AS at FROM documents WHERE source IN ('src0', 'src1', 'src2')""")
def weighted_order(spark, d):
    return packing.weighted_order(table(spark, d, "documents").select("doc_id", "source"), {"src0": 3, "src1": 2, "src2": 0.5})


@query("SELECT event_id, CASE WHEN event_id >= 600 THEN 'decay' ELSE 'main' END AS phase FROM events")
def phases(spark, d):
    return table(spark, d, "events").select("event_id", packing.phase_of(F.col("event_id"), 600).alias("phase"))


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) - 1 AS place FROM documents) WHERE place >= 50")
def resumed_order(spark, d):
    return packing.resumed(table(spark, d, "documents").select("doc_id"), 50, epoch=3)


_TRIES = "WITH t AS (SELECT conv_id, turn, k, length(text) * 7 + turn AS truth, (conv_id + turn + k) % 3 = 0 AS good FROM conversations, (SELECT unnest([0, 1]) AS k))"


def _tries(spark, d):
    """Two answers to each message, one way or another, of which one in three states the truth."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.length("text") * 7 + F.col("turn")).alias("truth"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    said = F.col("truth") + F.when((F.col("conv_id") + F.col("turn") + F.col("k")) % 3 == 0, 0).otherwise(1 + F.col("k"))
    stated = F.when(F.col("k") == 0, F.concat(F.col("text"), F.lit(r" so \boxed{"), said.cast("string"), F.lit(r"\text{ km}}."))).otherwise(F.concat(F.col("text"), F.lit(" The answer is $"), F.format_number(said, 0), F.lit(".0$.")))
    return rows.withColumn("answer", latex.extracted(F.regexp_replace(stated, r"(?<=\d),(?=\d)", ""), F.lit("math"))).withColumn("right", answers.answers_equal(F.col("answer"), F.col("truth").cast("string")))


@query(f"{_TRIES} SELECT conv_id, turn, min(k)::INT AS k FROM t WHERE good GROUP BY conv_id, turn")
def verified_responses(spark, d):
    """Of several answers to a message the first whose extracted result is right; messages without one go."""
    return _tries(spark, d).filter("right").groupBy("conv_id", "turn").agg(F.min("k").alias("k"))


@query(f"{_TRIES} SELECT conv_id, turn, k::INT AS k FROM t WHERE NOT good")
def rejected_by_answer(spark, d):
    """Answers whose extracted result isn't the truth: what rejection sampling drops."""
    return _tries(spark, d).filter("not right").select("conv_id", "turn", "k")


@query("SELECT d.doc_id, quality, toxic, length(text) AS n FROM documents d LEFT JOIN labels l USING (doc_id)")
def scorer_outputs(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    for column in ("quality", "toxic"):
        docs = docs.join(labels.select("doc_id", column), "doc_id", "left")
    return docs.select("doc_id", "quality", "toxic", F.length("text").cast("long").alias("n"))


@query()
def first_fit_packs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("tokens"), F.pmod("doc_id", F.lit(4)).cast("int").alias("images"))
    return mixing.first_fit_by_shard(rows, mixing.shards_for(rows), 8192, 6)


_GRIDS = "SELECT p_partkey AS id, [[p_size % 3, p_size % 5, 1], [p_size % 2, 4, p_size % 7]] AS g FROM part"


def _grids(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.array(size % 3, size % 5, F.lit(1)), F.array(size % 2, F.lit(4), size % 7)).alias("grid"))


@query(f"""
WITH g AS ({_GRIDS}), t AS (SELECT id, g[1][1] AS a, g[1][2] AS b, g[1][3] AS c, g[2][1] AS d, g[2][2] AS e, g[2][3] AS f FROM g),
s AS (SELECT id, unnest([a||''||b||c||'/'||d||e||f, c||''||f||'/'||b||e||'/'||a||d, f||''||e||d||'/'||c||b||a, d||''||a||'/'||e||b||'/'||f||c, c||''||b||a||'/'||f||e||d, a||''||d||'/'||b||e||'/'||c||f, d||''||e||f||'/'||a||b||c, f||''||c||'/'||e||b||'/'||d||a]) AS grid, unnest(range(8)) AS k FROM t)
SELECT id, grid, min(k)::INT AS symmetry FROM s GROUP BY id, grid""")
def puzzle_symmetries(spark, d):
    made = puzzles.augment(spread(_grids(spark, d)), "id")
    rows = F.transform("grid", lambda row: F.array_join(F.transform(row, lambda v: v.cast("string")), ""))
    return made.select("id", F.array_join(rows, "/").alias("grid"), "symmetry")


@query()
def puzzle_colourings(spark, d):
    return puzzles.augment(spread(_grids(spark, d)), "id", colours=3).select("id", "symmetry", "colouring", F.to_json("grid").alias("grid"))


def _tests(spark, d):
    """A brand's parts as the tests of a puzzle: the answer to a grid is its colours, each one on."""
    made = _grids(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id")
    return made.select(F.col("p_brand").alias("name"), F.col("id").alias("test"), F.col("grid").alias("input"), F.transform("grid", lambda row: F.transform(row, lambda v: (v + 1) % 10)).alias("output"))


def _outputs(tests):
    """(outputs, names) of a model that sees each test recoloured and in all eight positions, and repeats the input now and then."""
    seed = F.concat_ws(":", "name", F.col("test").cast("string"))
    tests, each, named = T.once(spread(tests), mapping=puzzles.colouring(seed)), [], []
    for k in range(8):
        said = F.when((F.col("test") + k) % 3 == 0, F.col("input")).otherwise(F.col("output"))
        grids = [F.transform(F.array(puzzles.augmented(g, k, F.col("mapping"))), lambda g: puzzles.encoded(g, 10))[0] for g in (F.col("input"), said)]
        identifier = (F.col("test") * 8 + k).alias("identifier")
        each.append(F.struct(identifier, grids[0].alias("inputs"), grids[1].alias("preds"), ((F.col("test") * 7 + 3 * k) % 11 - 5).cast("double").alias("halt_logit")))
        named.append(F.struct(identifier, puzzles.augmented_name(F.col("name"), k, F.col("mapping")).alias("name")))
    return tests.select(F.inline(F.array(*each))), tests.select(F.inline(F.array(*named)))  # by themselves: a generator makes all its columns


_VOTES = f"""
WITH t AS (SELECT p_brand AS name, id AS test, '0203' || array_to_string(list_transform(flatten(g), lambda v: '0' || v), '') AS i,
    '0203' || array_to_string(list_transform(flatten(g), lambda v: '0' || ((v + 1) % 10)), '') AS o FROM ({_GRIDS}) JOIN part ON p_partkey = id),
p AS (SELECT name, i, CASE WHEN (test + k) % 3 = 0 THEN i ELSE o END AS said, 1 / (1 + exp(-((test * 7 + 3 * k) % 11 - 5)::DOUBLE)) AS q FROM t, (SELECT unnest(range(8)) AS k)),
c AS (SELECT name, i, said, count(*) AS votes, round(avg(q), 9) AS mean_confidence FROM p GROUP BY ALL),
v AS (SELECT name, test, sha256(unhex(said)) AS prediction_key, votes, mean_confidence, said = o AS "right" FROM t JOIN c USING (name, i)),
r AS (SELECT *, row_number() OVER (PARTITION BY name, test ORDER BY votes DESC, mean_confidence DESC, prediction_key) AS rank FROM v)
"""


@query(_VOTES + "SELECT * FROM r")
def puzzle_votes(spark, d):
    """What a model said of augmented puzzles, put back, joined with the tests by puzzle and input, and counted."""
    tests = _tests(spark, d)
    return puzzles.test_votes(puzzles.predictions(*_outputs(tests), blank=-1, size=10), tests).drop("prediction")


@query(_VOTES + """, h AS (SELECT t.name, t.test, min(r.rank) AS rank FROM t LEFT JOIN r ON r.name = t.name AND r.test = t.test AND r."right" GROUP BY ALL),
m AS (SELECT k, name, avg(coalesce((rank <= k)::INT, 0)) AS s FROM h, (SELECT unnest([1, 2]) AS k) GROUP BY ALL) SELECT k::INT AS k, avg(s) AS score FROM m GROUP BY k""")
def puzzle_pass_at(spark, d):
    tests = _tests(spark, d)
    return puzzles.pass_at(puzzles.test_votes(puzzles.predictions(*_outputs(tests), blank=-1, size=10), tests), tests, [1, 2])


def _mazes(spark, d):
    """A maze of 10 rows and 16 columns an event, 7 of 16 cells between the first and the last row walls, from the digits of its hashes."""
    row = lambda i: F.translate(F.substring(F.md5(F.concat_ws(":", F.col("event_id").cast("string"), i.cast("string"))), 1, 16), "0123456789abcdef", "#######" + " " * 9)
    rows = F.transform(F.sequence(F.lit(1), F.lit(8)), row)
    whole = F.concat(F.array(F.lit("S" + " " * 15)), rows, F.array(F.lit(" " * 15 + "G")))
    return T.once(spread(table(spark, d, "events").select("event_id"), 10_000), maze=whole)


@query()
def maze_steps(spark, d):
    """Shortest ways through mazes."""
    mazes = _mazes(spark, d)
    return mazes.select("event_id", F.array_join("maze", "\n").alias("maze"), puzzles.maze_steps(F.col("maze")).alias("steps"))


@query()
def maze_symmetries(spark, d):
    """The ids of each maze in its 8 positions."""
    # numbered once and then turned: a maze's characters are looked at once, not once a position
    grids = T.once(_mazes(spark, d), m=F.transform("maze", lambda row: puzzles.maze_ids(F.array(row)))).select("event_id", "m")
    made = puzzles.all_turned(grids, "m")
    return made.select("event_id", "symmetry", F.size("m").alias("rows"), F.array_join(F.flatten("m").cast("array<string>"), "").alias("ids"))


@query()
def sudoku_pool(spark, d):
    """A six by six puzzle a part, all with different solutions."""
    return puzzles.sudoku_pool(table(spark, d, "part").select(F.col("p_partkey").alias("seed")), 6, 12, 20)


@query("SELECT 0 AS pad_id, 0 AS ignore_label_id, 0 AS blank_identifier_id, 12 AS vocab_size, 900 AS seq_len, count(DISTINCT p_size) + 1 AS num_puzzle_identifiers, count(DISTINCT p_brand) AS total_groups, count(*) / count(DISTINCT p_size)::DOUBLE AS mean_puzzle_examples FROM part")
def puzzle_metadata(spark, d):
    return puzzles.puzzle_metadata(table(spark, d, "part"), "p_brand", "p_size", 900)


@query("""
WITH e AS (
  SELECT CASE WHEN p_partkey % 3 < 2 THEN ['one', 'two'][1 + p_partkey % 3] || ':' ELSE '' END || 'set' || (p_partkey // 3) || '_0_' || (p_size * 5) || '_s' AS name,
    ['text', 'image', 'video', 'multiimage', 'other'][1 + p_size % 5] AS modality, p_partkey, p_size FROM part
), f AS (
  SELECT name, 'set' || (p_partkey // 3) || '_0_' || (p_size * 5) || '_s' AS alias, p_partkey, p_size,
    CASE p_size % 5 WHEN 0 THEN 14::DOUBLE / 100 WHEN 1 THEN 50::DOUBLE / 100 WHEN 2 THEN 36::DOUBLE / 100 * CASE WHEN p_size * 5 <= 60 THEN 0.5::DOUBLE ELSE 1 END WHEN 3 THEN 5::DOUBLE / 100 ELSE 1 END AS base FROM e
), g AS (
  SELECT name, alias, contains(name, 'set1') AS whole, base * CASE WHEN count(*) OVER (PARTITION BY alias) = 1 THEN 1 WHEN p_partkey % 3 = 0 THEN 1 - 0.25::DOUBLE WHEN p_partkey % 3 = 1 THEN 0.25::DOUBLE ELSE 1 END AS part FROM f
) SELECT name, alias, CASE WHEN whole THEN 1 ELSE part END AS fraction FROM g""")
def sampling_fractions(spark, d):
    origin = F.get(F.array(F.lit("one:"), F.lit("two:"), F.lit("")), (F.col("p_partkey") % 3).cast("int"))
    name = F.concat(origin, F.lit("set"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("_0_"), (F.col("p_size") * 5).cast("string"), F.lit("_s"))
    kind = F.get(F.array(*map(F.lit, ["text", "image", "video", "multiimage", "other"])), F.col("p_size") % 5)
    entries = table(spark, d, "part").select(name.alias("name"), F.lit(None).cast("string").alias("path"), kind.alias("modality"))
    out = packing.sampling_fractions(entries, {"text": 14, "image": 50, "multiimage": 5, "video": 36}, 0.5, 0.25, ("one", "two"), ("set1",))
    return out.select("name", "alias", "fraction")


def _token_ids(spark, d):
    import public_tokenizers

    return tokens.token_ids(table(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def token_id_blocks(spark, d):
    """All documents' token ids in blocks of 2,048, a document's end marked by the id behind the vocabulary."""
    blocks = tokens.token_blocks(written(_token_ids(spark, d), "token-ids"), 2048, 50_257)
    return blocks.select("block", F.size("ids").alias("tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query()
def token_id_shards(spark, d):
    """Token ids written as indexed shards, which are verified and read again by their index."""
    path = shared_path(spark, "tokens")
    shards.write_tokens(_token_ids(spark, d).select("ids"), path, 8 << 20)
    if not shards.verified(spark, path).filter("problem is not null").isEmpty():
        raise RuntimeError("a shard isn't what was written")
    found = shards.fetch_tokens(shards.token_places(spark, path))
    return found.select("tokens", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))
