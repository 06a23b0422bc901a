"""Line deduplication by a log-template tree, in DataFrame operations only.

A line's tokens are its runs of characters other than space and \\x09-\\x0D.
Tokens that hold a digit are variable fields and read ``<*>``.  The tree has a
fixed depth: the first level branches by token count, the next ``LEADING`` by one
leading token each, and the last holds a leaf's templates.

In a leaf, lines that agree in ``SIMILARITY`` of their positions are linked, and
lines linked with one another, directly or not, are one template.  Two such lines
differ in so few positions that, cut into one more block of positions than that, they
share a block.  So the lines of a leaf meet by block, first with the commonest line of
each block (smallest MD5 on ties), which is a template.  A line joins the one that
agrees with it in most positions, in ``SIMILARITY`` of them at least (then the
commonest, then the smallest MD5), and the positions that differ are variable fields as
well.  ``_missed`` then compares the lines of each block that this left in different
templates, so that no link of a leaf is lost.  Two lines are told apart by their
sketches of 16 bytes (``_sketched``) where these show that they differ in too many positions; only
pairs that it can't tell apart are written and compared by their texts.

A template recurs if it occurs in two or more documents.  Lines that end among the
leading tokens have no position to compare and are short enough to come up by
chance: of ``LEADING`` tokens or fewer, ``least_documents`` must hold them, twice as
many for each token less.  A recurring template stays in the document with the
smallest id and its lines are dropped from all others.  Blank lines always stay.

Lines are split at \\n.  A null text stays null and has no lines.  Rows with a
null id neither make a template recur nor lose lines.  Rows that repeat an id
are one document, and each loses its own lines.  Other columns pass through ``drop_recurring`` untouched, whatever
their names.  An empty table gives an empty result.

Scale: lines are normalised once and written; a line is known by its leaf and a
128-bit digest, and only those are aggregated, before the shuffle, so a line that
half of all documents hold is one row a task.  Line texts move only for leaves that
hold several lines of several documents; which leaves do is broadcast if they number
``MAX_BROADCAST`` at most, else shuffled.  No task holds a leaf or a block: the
commonest line is an aggregate, and it goes back to the lines by ``attach_groups``,
as do a template's documents.  Blocks with over ``PARTNERS`` pairs a line left to
compare are cut by a further block; the lines of the others are dealt in chunks.  A
document's text is shuffled once, in the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import attach_groups, components
from .scratch import discard, materialise

#: Leading tokens that the tree branches by.
LEADING = 4
#: Share of positions in which lines of a template agree with the one they join, as a fraction.
SIMILARITY = (4, 5)
#: Pairs of sketches a line that the lines of a block may make before it is cut further.
PARTNERS = 2048
#: Lines of a block that one task compares with those outside of its largest template.
CHUNK = 4096
#: Leaves (8 bytes each) that are broadcast, at most.
MAX_BROADCAST = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"
#: Possessive, and entered at the start of a token only: linear in the line.
DIGIT_TOKEN = r"(?<![^\x20])[^\x20\d]*+\d[^\x20]*+"


def least_documents(tokens: Column) -> Column:
    """Documents that must hold a line: 2, and for lines of LEADING tokens or fewer 4, 8, 16 and so on."""
    return F.when(tokens > LEADING, 2).otherwise(F.pow(F.lit(2), LEADING + 2 - tokens).cast("int"))


def normalised(line: Column) -> Column:
    """Tokens joined by single spaces, those with a digit as ``<*>``; regular expressions only where there is work for them."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for space in "\t\x0b\x0c\r":
        odd = odd | line.contains(space)
    joined = F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(joined, DIGIT_TOKEN, "<*>")).otherwise(joined)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns evaluated once a row: Catalyst doesn't inline a generator's output into what reads it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _digest(line: str) -> Column:
    return F.unhex(F.md5(line))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, pos, tokens, leaf, digest, line) of every line with a token; ``line`` is null where the leaf says it all."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "raw"))
    lines = _once(lines.filter("raw <> ''"), line=normalised(F.col("raw"))).drop("raw").filter("line <> ''")
    lines = _once(lines, tokens=F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    leaf = F.xxhash64("tokens", F.substring_index("line", " ", LEADING))  # a clash only adds lines to compare
    return lines.select("doc_id", "text_hash", "pos", "tokens", leaf.alias("leaf"), _digest("line").alias("digest"), F.when(F.col("tokens") > LEADING, F.col("line")).alias("line"))


def _spans(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))


def _short(lines: DataFrame) -> DataFrame:
    """(digest, first_id, occurrences, template) of recurring lines of LEADING tokens or fewer."""
    held = lines.filter(F.col("tokens") <= LEADING).groupBy("digest", "tokens", "doc_id").agg(F.count("*").alias("n"))
    counted = held.groupBy("digest", "tokens").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("occurrences"), F.count("*").alias("docs"))
    return counted.filter(F.col("docs") >= least_documents(F.col("tokens"))).select("digest", "first_id", "occurrences", F.lit(None).cast("string").alias("template"))


def _allowed(tokens: Column) -> Column:
    """Positions in which lines of a template may differ."""
    part, whole = SIMILARITY
    return F.floor(tokens * (whole - part) / whole)


def _sketched(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sketch``: 128 bits of the tokens behind the leading ones, and how many positions may differ.

    Up to 64 tokens have a bit in each of two words, more one bit of the 128 in turn.
    A token that differs changes one place of 64 or one bit at most, so lines whose
    sketches differ in more are not linked.
    """
    out = _once(rows, _toks=F.split("line", " "))
    out = _once(out, _may=_allowed(F.size("_toks")).cast("int"), _hashes=F.transform(F.slice("_toks", F.lit(LEADING + 1), F.size("_toks")), lambda t: F.xxhash64(t))).drop("_toks")
    out = _once(out, _few=F.size("_hashes") <= 64)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(j):
        def bit(h, i):
            mine = F.when(F.col("_few"), F.shiftright(h, j)).when(F.shiftright(i, 6).bitwiseAND(one.cast("int")) == j, h).otherwise(none)
            return F.call_function("shiftleft", mine.bitwiseAND(one), i.bitwiseAND(F.lit(63)))

        return F.aggregate(F.transform("_hashes", bit), none, lambda x, y: x.bitwiseXOR(y)).alias(f"w{j}")

    return out.select(*rows.columns, F.struct(F.col("_may").alias("may"), F.col("_few").alias("few"), *[word(j) for j in range(2)]).alias("sketch"))


def _alike(a: str, b: str) -> Column:
    """Whether sketches leave it open that their lines agree in SIMILARITY of their positions."""
    x, y = (F.col(f"{a}.w{j}").bitwiseXOR(F.col(f"{b}.w{j}")) for j in range(2))
    places, bits = F.bit_count(x.bitwiseOR(y)), F.bit_count(x) + F.bit_count(y)
    return F.when(F.col(f"{a}.few"), places).otherwise(bits) <= F.col(f"{a}.may")


def _blocks(rows: DataFrame) -> DataFrame:
    """(digest, n, sketch, block): the blocks of positions after the leading ones; a single empty one where all may differ."""
    rows = _once(rows.select("leaf", "digest", "n", "sketch", "line"), toks=F.split("line", " "))
    rows = _once(rows, rest=F.size("toks") - LEADING, k=_allowed(F.size("toks")) + 1)
    start = lambda i: F.floor(i * F.col("rest") / F.col("k")).cast("int")
    cut = lambda i: F.xxhash64("leaf", i, F.slice("toks", start(i) + LEADING + 1, start(i + 1) - start(i)))
    some = F.transform(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")), cut)
    return rows.select("digest", "n", "sketch", F.explode(F.when(F.col("rest") < F.col("k"), F.array(F.xxhash64("leaf", F.lit(-1)))).otherwise(some)).alias("block"))


def _near(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The ``pairs`` (digest, other) of lines that agree in SIMILARITY of their positions; with tokens ``a`` and ``b``, ``agree`` and ``same``."""
    asked = pairs.groupBy(F.col("other").alias("_other")).agg(F.count("*").alias("asked"))
    other = held.join(asked, F.col("digest") == F.col("_other")).select(F.col("_other").alias("other"), "asked", F.col("line").alias("with"), F.col("n").alias("others_n"))
    mine = pairs.join(held.select("digest", "line"), "digest")
    both = attach_groups(mine, other, "other", "asked", pairs.count(), F.col("digest"))
    both = _once(both.select("digest", "other", "others_n", F.split("line", " ").alias("a"), F.split("with", " ").alias("b")), agree=F.zip_with(F.col("a"), F.col("b"), lambda x, y: x == y))
    part, whole = SIMILARITY
    both = _once(both, same=F.size(F.filter("agree", lambda x: x)))
    return both.filter((F.size("a") == F.size("b")) & (F.col("same") * whole >= F.size("a") * part))


def _cut(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` (digest, sketch, component, block, path), each cut into one more block of its remaining positions than may differ.

    ``path`` numbers the blocks taken so far; a block's positions are gone from those that remain.  ``left`` counts these.
    """
    rows = _once(rows.join(held.select("digest", "line"), "digest"), toks=F.split("line", " ")).drop("line")
    rows = _once(rows, may=_allowed(F.size("toks")).cast("int"), rest=F.slice("toks", F.lit(LEADING + 1), F.size("toks"))).drop("toks")
    start = lambda free, i: F.floor(i * F.size(free) / (F.col("may") + 1)).cast("int")
    without = lambda free, i: F.concat(F.slice(free, F.lit(1), start(free, i)), F.slice(free, start(free, i + 1) + 1, F.size(free)))
    rows = _once(rows, free=F.aggregate("path", F.col("rest"), without)).drop("rest")

    def part(i):
        length = start("free", i + 1) - start("free", i)
        key = F.xxhash64("block", i, F.slice("free", start("free", i) + 1, length))
        return F.struct(key.alias("block"), F.concat("path", F.array(i)).alias("path"), (F.size("free") - length - F.col("may")).alias("left"))

    return rows.select("digest", "sketch", "component", F.inline(F.transform(F.sequence(F.lit(0), F.col("may")), part)))


def _missed(held: DataFrame, united: DataFrame) -> DataFrame:
    """(a, b): links of lines in different components that ``united`` (node, component) leaves; ``held`` as in ``_parents``.

    The first block is the leaf.  Lines of a block are compared if they are of
    different components, by their sketches within the join.  Where that makes over PARTNERS pairs a line, the block is
    cut by the positions outside of it: lines that are linked differ in so few of
    these that, cut into one more block than that, they share one of them too.  Once
    no more positions are left than may differ, all lines of a block are linked.
    """
    rows = held.join(united.select(F.col("node").alias("digest"), "component"), "digest", "left")
    tokens = F.size(F.split("line", " "))
    rows = rows.select("digest", "sketch", F.coalesce("component", "digest").alias("component"), F.col("leaf").alias("block"), F.array().cast("array<int>").alias("path"), (tokens - LEADING - _allowed(tokens)).cast("int").alias("left"))
    found, done, level = [], [], 0
    while True:
        rows = materialise(rows, f"templates-missed-{level}")
        done.append(rows)
        sizes = rows.groupBy("block", "component").agg(F.count("*").alias("m"), F.min("digest").alias("hub"), F.min("left").alias("left"))
        groups = sizes.groupBy("block").agg(F.sum("m").alias("members"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.max(F.struct("m", "component")).alias("most"), F.min("hub").alias("hub"), F.min("left").alias("left"), F.count("*").alias("kinds"))
        over = F.expr(f"members * members - squares > {2 * PARTNERS} * members")
        kind = F.when(F.col("left") <= 0, "linked").when(over, "cut").otherwise("compared")
        groups = materialise(groups.filter("kinds > 1").select("block", "members", "hub", F.col("most.component").alias("largest"), kind.alias("kind")), f"templates-groups-{level}")
        done.append(groups)
        total = groups.agg(F.sum("members")).first()[0]
        if not total:
            break
        met = attach_groups(rows, groups.withColumn("deals", F.ceil(F.col("members") / CHUNK).cast("int")), "block", "members", total, F.col("digest"))
        linked = met.filter("kind = 'linked' and digest <> hub").groupBy("block", "component").agg(F.min(F.struct("digest", "hub")).alias("p")).select("p.digest", F.col("p.hub").alias("other"))
        mine = met.filter("kind = 'compared'").select("block", "digest", "sketch", "component", "largest", F.pmod(F.xxhash64("digest"), "deals").cast("int").alias("deal"))
        others = met.filter("kind = 'compared' and component <> largest").select("block", F.col("digest").alias("other"), F.col("sketch").alias("others"), F.col("component").alias("with"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
        apart = F.expr("component <> with and (component = largest or digest < other)")
        pairs = mine.join(others, ["block", "deal"]).filter(apart & _alike("sketch", "others")).select("digest", "other")
        found.append(materialise(linked.unionByName(pairs).distinct(), f"templates-apart-{level}"))
        rows, level = _cut(met.filter("kind = 'cut'").select("digest", "sketch", "component", "block", "path"), held), level + 1
    if not found:
        discard(*done)
        return held.select(F.col("digest").alias("a"), F.col("digest").alias("b")).limit(0)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    links = materialise(_near(pairs.distinct(), held).select(F.col("digest").alias("a"), F.col("other").alias("b")), "templates-missed")
    discard(*done, *found)
    return links


def _parents(held: DataFrame) -> DataFrame:
    """(digest, parent, template) of the lines that join a commoner one; ``held``: (leaf, digest, line, sketch, lo, hi, n)."""
    keyed = materialise(_blocks(held), "templates-blocks")
    hubs = keyed.groupBy("block").agg(F.min(F.struct((-F.col("n")).alias("m"), "digest", "sketch")).alias("hub"), F.count("*").alias("members"))
    met = attach_groups(keyed.select("digest", "sketch", "block"), hubs.filter("members > 1"), "block", "members", keyed.count(), F.col("digest"))
    met = met.filter((F.col("hub.digest") != F.col("digest")) & _alike("sketch", "hub.sketch"))
    pairs = materialise(met.select("digest", F.col("hub.digest").alias("other")).distinct(), "templates-pairs")
    near = _near(pairs, held)
    fields = F.array_join(F.zip_with("a", "agree", lambda x, same: F.when(same, x).otherwise(F.lit("<*>"))), " ")
    best = near.groupBy("digest").agg(F.min(F.struct((-F.col("same")).alias("s"), (-F.col("others_n")).alias("m"), F.col("other").alias("o"), fields.alias("f"))).alias("best"))
    found = materialise(best.select("digest", F.col("best.o").alias("parent"), F.col("best.f").alias("template")), "templates-parents")
    discard(keyed, pairs)
    return found


def templates(lines: DataFrame) -> DataFrame:
    """A row a distinct line of a recurring template: digest, first_id, occurrences, template.

    ``lines`` are the documents' ``lines_of``.  ``first_id`` is the document that
    keeps the template; ``template`` is the line with the variable fields in which it
    differs from the one that it joined, null if it joined none (or only by a link found later).
    """
    long = lines.filter(F.col("tokens") > LEADING)
    distinct = materialise(_spans(long, "leaf", "digest"), "templates-distinct")
    leaves = distinct.groupBy("leaf").agg(F.min("lo").alias("leaf_lo"), F.max("hi").alias("leaf_hi"), F.count("*").alias("n_lines"))
    leaves = materialise(leaves.filter("leaf_lo <> leaf_hi").select("leaf", "n_lines"), "templates-leaves")
    alone = distinct.join(leaves.filter("n_lines = 1").select("leaf"), "leaf", "left_semi")
    alone = alone.select("digest", F.col("lo").alias("first_id"), F.col("n").alias("occurrences"), F.lit(None).cast("string").alias("template"))

    several = leaves.filter("n_lines > 1").select("leaf")
    several = F.broadcast(several) if several.count() <= MAX_BROADCAST else several
    held = _spans(long.select("leaf", "line", "doc_id").join(several, "leaf", "left_semi"), "leaf", "line")
    held = materialise(_sketched(held.withColumn("digest", _digest("line"))), "templates-compared")
    parents = _parents(held)
    links = parents.select(F.col("digest").alias("a"), F.col("parent").alias("b"))
    united = components(links, "templates-united")
    missed = _missed(held, united)
    if not missed.isEmpty():
        united = components(links.unionByName(missed), "templates-exact")
    joined = held.select("digest", "lo", "hi", "n").join(united.select(F.col("node").alias("digest"), "component"), "digest", "left")
    joined = joined.join(parents.select("digest", "template"), "digest", "left").withColumn("key", F.coalesce("component", "digest"))
    joined = materialise(joined.drop("component"), "templates-joined")
    discard(held, parents)
    merged = joined.groupBy("key").agg(F.min("lo").alias("first_id"), F.max("hi").alias("last_id"), F.count("*").alias("members"))
    known = attach_groups(joined.select("key", "digest", "n", "template"), merged.filter("first_id <> last_id"), "key", "members", joined.count(), F.col("digest")).filter("first_id is not null")
    return known.select("digest", "first_id", F.col("n").alias("occurrences"), "template").unionByName(alone).unionByName(_short(lines))


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a text that loses lines: doc_id, text_hash, and the ascending positions of those, from 0."""
    lines = materialise(lines_of(docs, id_col, text_col), "templates-lines")
    known = materialise(templates(lines).select("digest", "first_id", "occurrences"), "templates-found")
    rows = lines.select("doc_id", "text_hash", "pos", "digest")
    lost = attach_groups(rows, known, "digest", "occurrences", rows.count(), F.struct("doc_id", "pos")).filter(F.col("first_id") != F.col("doc_id"))
    lost = materialise(lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped")), "templates-lost")
    discard(lines, known)
    return lost


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with recurring lines dropped from the text.

    ``counts`` adds the columns n_lines and n_dropped, in the place of any that the
    documents have under these names.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lost = mark_lines(docs, id_col, text_col).select(F.col("doc_id").alias("lost_id"), "text_hash", F.col("dropped").alias("lost"))
    same = (F.col("id") == F.col("lost_id")) & (F.xxhash64("text") == F.col("text_hash"))
    joined = packed.filter("id is not null").join(lost, same, "left").select("doc", "text", "lost")
    joined = joined.unionByName(packed.filter("id is null").select("doc", "text", F.lit(None).cast("array<int>").alias("lost")))
    lines = F.split("text", "\n", -1)
    # a text's kept lines are the stretches between dropped positions: each is cut out once, whatever the number of lines
    ends = F.concat(F.col("lost"), F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform("lost", lambda p: p + 1))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    new = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    own = [new.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if not counts:
        return joined.select(*own)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*own, n_lines.alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))
