"""Quality predicates and the router: every document is judged by one CASE in one pass."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Basic:
    min_chars: int = 300
    max_chars: int = 500_000
    max_token_chars: int = 1000


def basic(text: Column, p: Basic = Basic()) -> Column:
    long_token = F.exists(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > p.max_token_chars)
    return F.length(text).between(p.min_chars, p.max_chars) & ~long_token


@dataclass(frozen=True)
class Gopher:
    min_words: int = 50
    max_words: int = 100_000
    min_mean_length: float = 3
    max_mean_length: float = 10
    max_symbol_ratio: float = 0.1
    max_bullet_lines: float = 0.9
    max_ellipsis_lines: float = 0.3
    min_alpha_word_fraction: float = 0.65
    min_stop_words: int = 2


STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "bullet_lines", "ellipsis_lines", "alpha_words", "stop_words")


def gopher_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, mean_word_length, symbol_ratio, bullet_lines, ellipsis_lines, alpha_words, stop_words."""
    w, lines = F.col("_w"), F.col("_l")
    parts = T.once(docs, _w=F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""), _l=F.split(text, "\n", -1))
    listed = F.array(*map(F.lit, T.STOP_WORDS))
    characters = F.aggregate(w, F.lit(0), lambda acc, x: acc + F.length(x))
    symbols = F.length(text) - F.length(F.replace(F.col(text), F.lit("#"), F.lit(""))) + F.size(F.filter(w, lambda x: x.endswith("...") | x.endswith("…")))
    out = parts.withColumns(
        {
            "n_words": F.size(w),
            "mean_word_length": T.ratio(characters, F.size(w)),
            "symbol_ratio": T.ratio(symbols, F.size(w)),
            "bullet_lines": T.ratio(F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*[-•*]"))), F.size(lines)),
            "ellipsis_lines": T.ratio(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[ \t]*$"))), F.size(lines)),
            "alpha_words": T.ratio(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))), F.size(w)),
            "stop_words": F.size(F.array_intersect(F.transform(w, F.lower), listed)),
        }
    )
    return out.drop("_w", "_l")


def gopher_quality(p: Gopher = Gopher(), stop_words: bool = True) -> Column:
    """Predicate over ``gopher_statistics``."""
    ok = F.col("n_words").between(p.min_words, p.max_words) & F.col("mean_word_length").between(p.min_mean_length, p.max_mean_length)
    ok = ok & (F.col("symbol_ratio") <= p.max_symbol_ratio) & (F.col("bullet_lines") <= p.max_bullet_lines)
    ok = ok & (F.col("ellipsis_lines") <= p.max_ellipsis_lines) & (F.col("alpha_words") >= p.min_alpha_word_fraction)
    return ok & (F.col("stop_words") >= p.min_stop_words) if stop_words else ok


def filled_lines(text: Column, separator: str = "\n") -> Column:
    return F.filter(F.split(text, separator, -1), lambda x: F.trim(x) != "")


def duplicate_lines(text: Column, separator: str = "\n", lines: Column | None = None) -> tuple[Column, Column]:
    """(share of lines that repeat an earlier one, share of characters in them); ``lines`` if they are a column already."""
    lines = filled_lines(text, separator) if lines is None else lines
    once = F.array_distinct(lines)
    size = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + F.length(x))
    return T.ratio(F.size(lines) - F.size(once), F.size(lines)), T.ratio(size(lines) - size(once), size(lines))


def top_share(text: str, n: int, places: np.ndarray) -> float:
    """The share of the top n-grams of characters; their hashes are sums of mixed code points, each by the multiplier of its place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = len(codes) - n + 1
    if size < 1:
        return 0.0
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # SplitMix64
        codes = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(factor)
        codes ^= codes >> np.uint64(shift)
    hashes = np.zeros(size, np.uint64)
    for i in range(n):
        hashes += codes[i : i + size] * places[i]
    hashes.sort()
    counts = np.diff(np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1], True]))
    top = min(math.isqrt(len(counts)), int((counts > 1).sum()))
    return float(np.sort(counts)[len(counts) - top :].sum()) / size


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1)


def _character_repetition(n: int):
    places = multipliers(n)

    @F.pandas_udf("double")
    def ratios(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: top_share(t if isinstance(t, str) else "", n, places)).astype("float64")

    return ratios


def gram_repetition(docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text", characters: bool = False) -> DataFrame:
    """(id, ratio) of a document's n-grams.

    Words: share of n-gram occurrences whose n-gram occurs more than once.
    Characters: share held by the top k distinct n-grams, k = min(floor(sqrt(distinct)), distinct - singletons).
    Counts are the runs of the sorted 64-bit hashes in the row; nothing is shuffled.
    """
    if characters:
        return docs.select(id_col, _character_repetition(n)(text).alias("ratio"))
    rows = T.once(docs.select(id_col, text), _units=T.words(F.col(text))).select(id_col, "_units")
    rows = T.once(rows, _sorted=F.array_sort(T.ngram_hashes("_units", n))).select(id_col, "_sorted")
    size = F.size("_sorted")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    rows = T.once(rows, _starts=F.when(size > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(size))
    rows = T.once(rows, _counts=F.zip_with("_starts", F.when(size > 0, ends).otherwise(F.array().cast("array<int>")), lambda a, b: b - a))
    part = F.aggregate(F.filter("_counts", lambda c: c > 1), F.lit(0).cast("long"), lambda acc, c: acc + c)
    return rows.select(id_col, T.ratio(part, size).alias("ratio"))


# Lines that hold one of these go.
CITATION = r"\[[0-9]*\]|\[edit\]|\[citation needed\]"
POLICY = ["terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies"]


def c4_lines(text: Column, min_words: int = 3, punctuation: bool = True, citations: bool = True, javascript: bool = True, policy: bool = True) -> Column:
    """The text with the lines that end in terminal punctuation, have enough words and speak of no script or policy: a projection, not a filter.

    ``citations``: marks of citations are taken out first.
    """
    def ok(x: Column) -> Column:
        good = F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")) >= min_words
        if punctuation:
            good = good & x.rlike(r"[.!?\"'][ \t]*$") & ~x.rlike(r"\.\.\.[ \t]*$")
        if javascript:
            good = good & ~F.lower(x).contains("javascript")
        return good & ~F.lower(x).rlike("|".join(POLICY)) if policy else good

    text = F.regexp_replace(text, CITATION, "") if citations else text
    return F.array_join(F.filter(F.split(text, "\n", -1), ok), "\n")


def c4_document(text: Column, min_sentences: int = 5) -> Column:
    return (F.regexp_count(text, F.lit(r"[.!?]")) >= min_sentences) & ~F.lower(text).contains("lorem ipsum") & ~text.contains("{")


def fineweb_statistics(text: Column, short: int = 30, lines: Column | None = None) -> dict[str, Column]:
    lines = filled_lines(text) if lines is None else lines
    return {
        "line_punct_ratio": T.ratio(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?\"']$"))), F.size(lines)),
        "short_line_ratio": T.ratio(F.size(F.filter(lines, lambda x: F.length(x) <= short)), F.size(lines)),
        "char_dup_ratio": duplicate_lines(text, lines=lines)[1],
        "newline_word_ratio": T.ratio(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.size(T.words(text, strip=False))),
    }


@dataclass(frozen=True)
class FineWeb:
    min_line_punct: float = 0.12
    max_short_lines: float = 0.67
    max_char_dup: float = 0.01
    max_newlines: float = 0.3


def fineweb_ok(text: Column, p: FineWeb = FineWeb(), lines: Column | None = None) -> Column:
    s = fineweb_statistics(text, lines=lines)
    ok = (s["line_punct_ratio"] >= p.min_line_punct) & (s["short_line_ratio"] <= p.max_short_lines)
    return ok & (s["char_dup_ratio"] <= p.max_char_dup) & (s["newline_word_ratio"] <= p.max_newlines) & (F.trim(text) != "")


@dataclass(frozen=True)
class Repetition:
    """Largest shares: repeated lines and paragraphs, their characters, the commonest n-gram's characters, and those of repeated n-grams."""

    lines: float = 0.3
    paragraphs: float = 0.3
    line_characters: float = 0.2
    paragraph_characters: float = 0.2
    top: tuple = ((2, 0.2), (3, 0.18), (4, 0.16))
    repeated: tuple = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.1))


def within_repetition(text: str, p: Repetition = Repetition()) -> bool:
    """Whether a text stays within the shares of repetition.

    The commonest n-gram counts with its words and the spaces between them, as often as
    it occurs (of n-grams as common, the longest).  A word is repeated if an n-gram that
    holds it occurred before.  N-grams are told apart by 64-bit hashes.
    """
    for separator, most, most_characters in (("\n", p.lines, p.line_characters), ("\n\n", p.paragraphs, p.paragraph_characters)):
        lines = [x for x in text.split(separator) if x.strip(" ")]
        once = dict.fromkeys(lines)
        if len(once) < len(lines):
            size = sum(map(len, lines))
            if (len(lines) - len(once)) / len(lines) > most or (size - sum(map(len, once))) / size > most_characters:
                return False
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if len(words) < 2:
        return True
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.uint64) + np.uint64(1)
    ids = (ids ^ (ids >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    ids = (ids ^ (ids >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    lengths = np.array([len(w) for w in words])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    hashes, at = ids, 1
    for n, most, top in sorted([*((n, x, True) for n, x in p.top), *((n, x, False) for n, x in p.repeated)]):
        if len(words) < n:
            break
        while at < n:
            hashes = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[at:]
            at += 1
        if top:
            _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            i = first[counts == counts.max()]
            characters = counts.max() * ((ends[i + n] - ends[i]).max() + n - 1) if counts.max() > 1 else 0
        else:
            again = np.ones(len(hashes), bool)
            again[np.unique(hashes, return_index=True)[1]] = False
            i = np.flatnonzero(again)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, i, 1)
            np.add.at(change, i + n, -1)
            characters = lengths[np.cumsum(change[:-1]) > 0].sum()
        if characters / max(1, len(text)) > most:
            return False
    return True


def repetition_ok(docs: DataFrame, p: Repetition = Repetition(), text: str = "text", out: str = "repetition_ok") -> DataFrame:
    """Adds ``within_repetition`` of a text; null counts as empty.

    Nine counts of n-grams a text: as lambdas over arrays they took 128 s on 25 million
    characters, in NumPy a few, so this is an Arrow UDF, which only the text goes to.
    """

    @F.arrow_udf("boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([within_repetition(t.as_py(), p) for t in texts], pa.bool_())

    return docs.withColumn(out, judge(F.coalesce(F.col(text), F.lit(""))))


def kept_by_route(docs: DataFrame, roles: DataFrame, marked_language: str, marks: str, text: str = "text", least_marks: float = 0.002, math_words: int = 30, statistics: bool = False) -> DataFrame:
    """Adds ``route`` and ``kept``: each route's own chain of predicates; with ``statistics`` those of ``gopher_statistics`` too.

    math: words and repetition; marked: quality without stop words, repetition, lenient
    lines and marks; english: quality, repetition, strict lines and, of what they leave,
    line statistics; rejected: none.
    """
    rows = gopher_statistics(route(docs, roles, marked_language, marks, text=text), text)
    on = lambda name: F.col("route") == name
    first = F.when(on("math"), F.col("n_words") >= math_words)
    first = first.when(on("marked"), gopher_quality(Gopher(min_mean_length=2.0), stop_words=False) & (T.diacritic_fraction(F.col(text), marks) >= least_marks))
    first = first.when(on("english"), gopher_quality()).otherwise(False)
    rows = T.once(rows, _open=F.coalesce(first, F.lit(False)))
    # each test is only made of the rows that all tests before it left open, from the cheap ones to the counts of n-grams
    still = lambda name: F.col("_open") & on(name)
    rows = T.once(rows, _lines=F.when(still("english"), c4_lines(F.col(text))).when(still("marked"), c4_lines(F.col(text), 1, False, False)))
    rows = T.once(rows, _filled=F.when(still("english"), filled_lines(F.col("_lines"))))  # split once, not for each share
    good = F.when(on("english"), c4_document(F.col("_lines")) & fineweb_ok(F.col("_lines"), lines=F.col("_filled"))).when(on("marked"), c4_document(F.col("_lines"), 1)).otherwise(True)
    rows = T.once(rows, _undecided=F.when(F.col("_open"), F.coalesce(good, F.lit(False))).otherwise(False))
    rows = repetition_ok(rows.withColumn("_judged", F.when(F.col("_undecided"), F.col(text))), text="_judged")
    added = STATISTICS if statistics else ()
    return rows.select(*docs.columns, *added, "route", (F.col("_undecided") & F.col("repetition_ok")).alias("kept"))


def heuristic_language(text: Column, marks: str, marked_as: str) -> tuple[Column, Column]:
    """(language, score) by diacritics, else ASCII letters, of the first 512 characters."""
    head = F.translate(F.substring(text, 1, 512), "\n", " ")
    marked = head.rlike("[" + marks + "]")
    return F.when(marked, marked_as).when(head.rlike("[A-Za-z]"), "en").otherwise("other"), F.when(marked, 0.70).when(head.rlike("[A-Za-z]"), 0.60).otherwise(0.50)


def route(docs: DataFrame, roles: DataFrame, marked_language: str, marks: str, least: float = 0.01, source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """Adds ``route``: rejected, math, marked or english; ``roles`` (source, role) is a dimension of one row a source."""
    joined = docs.join(roles.select(F.col("source").alias("_src"), "role"), F.col(source) == F.col("_src"), "left").drop("_src")
    science = F.coalesce(F.col("role").rlike("math|science"), F.lit(False))
    marked = F.when(F.coalesce(F.col(lang), F.lit("")) != "", F.col(lang) == marked_language).otherwise(T.diacritic_fraction(F.col(text), marks) >= least)
    return joined.withColumn("route", F.when(~basic(F.col(text)), "rejected").when(science, "math").when(marked, "marked").otherwise("english")).drop("role")


def classifier_gate(docs: DataFrame, scores: DataFrame, threshold: float, id_col: str = "doc_id", score: str = "quality", text: str = "text") -> DataFrame:
    """Rows without a score pass, blank texts don't."""
    found = scores.groupBy(F.col(id_col).alias("_id")).agg(F.max(score).alias("_score"))
    joined = docs.join(found, F.col(id_col) == F.col("_id"), "left")
    return joined.filter((F.trim(text) != "") & (F.col("_score").isNull() | (F.col("_score") >= threshold))).drop("_id", "_score")


def node_filter(docs: DataFrame, id_col: str = "doc_id", text: str = "text", separator: str = "\n", min_words: int = 4, max_words: int = 1000, max_special: float = 0.3, max_repetition: float = 0.5, min_stop_words: float = 0.0, keep: str = "END") -> DataFrame:
    """Paragraphs that fail any check go; ``keep`` paragraphs are exempt; documents left empty have text ''."""
    def ok(x: Column) -> Column:
        w = T.words(x)
        good = F.size(w).between(min_words, max_words) & (T.special_character_ratio(x) <= max_special)
        return (x == keep) | (good & (T.single_word_repetition(w) <= max_repetition) & (T.member_ratio(w, T.STOP_WORDS) >= min_stop_words))

    return docs.withColumn(text, F.array_join(F.filter(F.split(text, separator, -1), ok), separator))


@dataclass(frozen=True)
class Web:
    """Cutoffs of a web text, by default those of a paragraph; DOCUMENT has those of a document."""

    min_words: int = 4
    max_words: int = 1000
    character_length: int = 10
    max_character_repetition: float = 0.1
    word_length: int = 5
    max_word_repetition: float = 0.1
    max_special: float = 0.3
    min_stop_words: float = 0.3
    max_flagged: float = 0.01
    min_punctuation_words: int = 12
    min_punctuation: float = 0.001
    min_common_words: float = 0.8


DOCUMENT = Web(min_words=10, max_words=2000, max_word_repetition=0.2, max_special=0.275, min_stop_words=0.35, min_punctuation_words=-1, min_punctuation=0.03, min_common_words=0.9)
_SPECIAL = T.PUNCTUATION + "0123456789"
_BLANKS, _TOKENS = re.compile("[ \n\t]"), re.compile(f"[\\w']+|[{re.escape(T.PUNCTUATION)}]")
_places = functools.cache(multipliers)


#: A web text's checks in the reference's order, and in that of their cost: whether a text fails doesn't depend on it.
CHECKS = ("number_words", "character_repetition", "word_repetition", "special_characters", "stop_words", "flagged_words", "punctuation", "common_words")
BY_COST = ("number_words", "stop_words", "flagged_words", "common_words", "special_characters", "punctuation", "word_repetition", "character_repetition")


def web_check(text: str, stop_words: frozenset, flagged_words: frozenset, common_words: frozenset, p: Web = Web(), order: tuple[str, ...] = CHECKS) -> str | None:
    """The first check of ``order`` that a text fails; None if it passes all."""
    words = [w for w in (x.strip(_SPECIAL + " ") for x in _BLANKS.split(text.lower())) if w]
    share = lambda listed: sum(map(listed.__contains__, words)) / max(1, len(words))

    def fails(check: str) -> bool:
        if check == "number_words":
            return not p.min_words <= len(words) <= p.max_words
        if check == "character_repetition":
            return top_share(text, p.character_length, _places(p.character_length)) > p.max_character_repetition
        if check == "word_repetition":
            grams = list(zip(*(words[i:] for i in range(p.word_length)), strict=False))
            if len(set(grams)) == len(grams):
                return p.max_word_repetition < 0
            return sum(c for c in Counter(grams).values() if c > 1) / len(grams) > p.max_word_repetition
        if check == "special_characters":
            return text != "" and sum(map(text.count, _SPECIAL)) / len(text) > p.max_special
        if check == "stop_words":
            return share(stop_words) < p.min_stop_words
        if check == "flagged_words":
            return share(flagged_words) > p.max_flagged
        if check == "common_words":
            return share(common_words) < p.min_common_words
        tokens = _TOKENS.findall(text)
        short = 0 < len(tokens) < p.min_punctuation_words
        return not short and sum(map(T.PUNCTUATION.__contains__, tokens)) / max(1, len(tokens)) < p.min_punctuation

    return next((check for check in order if fails(check)), None)


def web_document_filter(docs: DataFrame, stop_words: list[str], flagged_words: list[str], common_words: list[str], text: str = "text", images: str | None = None, node: Web = Web(), document: Web = DOCUMENT, separator: str = "\n\n", keep: str = "END", min_images: int = 1, max_images: int = 30) -> DataFrame:
    """Documents without the paragraphs that fail a check, with the column ``failed``: the document's first failed check, null if it's kept.

    ``images`` is a column with a document's number of images, not checked if
    there's none.  Language and perplexity, which need models, are not checked.
    A null text counts as empty.
    """
    lists = [frozenset(x) for x in (stop_words, flagged_words, common_words)]

    def check(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for t in texts:
                kept = separator.join(x for x in (t or "").split(separator) if x == keep or web_check(x, *lists, node, BY_COST) is None)
                out.append((kept, web_check(kept, *lists, document)))
            yield pd.DataFrame(out, columns=["text", "failed"])

    checked = F.pandas_udf(check, "text string, failed string")(F.col(text))
    out = docs.withColumn("_web", checked)
    failed = F.col("_web.failed")
    if images:
        failed = F.when(~F.coalesce(F.col(images).between(min_images, max_images), F.lit(False)), "number_images").otherwise(failed)
    return out.select(*[F.col("_web.text").alias(c) if c == text else F.col(c) for c in docs.columns], failed.alias("failed"))


def remove_spam(text: Column, spam: list[str], cutoff: float = 0.12, separator: str = "\n") -> Column:
    return F.array_join(F.filter(F.split(text, separator, -1), lambda x: T.member_ratio(T.words(x), spam) < cutoff), separator)


def collapse_markers(paragraphs: Column, marker: str) -> Column:
    """Runs of ``marker`` become one, and none is left at the end."""
    kept = F.filter(paragraphs, lambda x, i: ~((x == marker) & (i > 0) & (F.try_element_at(paragraphs, i) == marker)))
    last = F.try_element_at(kept, F.lit(-1)) == marker
    return F.when(last, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
