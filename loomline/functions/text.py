"""Text expressions: normalisation, words, and per-document statistics.

All are Catalyst expressions.  Ratios over nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NON_PRINTING = r"[\x00-\x1f\x7f-\x9f]"
EXOTIC_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# The fullwidth digit one, which the map has as a quotation mark, is left out: digits are zeros by then.
UNICODE_PUNCTUATION = {"，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "「": '"', "」": '"', "《": '"', "》": '"', "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
SPAM_WORDS = ["login", "sign-in", "register", "advertisement", "cookies", "newsletter", "subscribe"]

# What is redacted, in this order, and what takes its place.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE = r"(?<!\w)(?:\+?84|0)(?:[\s.\-]?\d){8,10}(?!\w)"
MASK = "<|pii|>"


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def remove_non_printing(text: Column) -> Column:
    return F.regexp_replace(text, NON_PRINTING, "")


def standardise_whitespace(text: Column) -> Column:
    return F.translate(text, EXOTIC_SPACES, " " * len(EXOTIC_SPACES))


def digits_to_zero(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "0")


def replace_unicode_punctuation(text: Column) -> Column:
    for a, b in UNICODE_PUNCTUATION.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalise(text: Column, lower: bool = True) -> Column:
    """The chain: non-printing, lower case, white space, digits, punctuation."""
    text = remove_non_printing(text)
    return replace_unicode_punctuation(digits_to_zero(standardise_whitespace(F.lower(text) if lower else text)))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns evaluated once a row: Catalyst doesn't inline a generator's output into each place that reads it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


#: What words lose at their ends.
STRIPPED = PUNCTUATION + "0123456789 "


def strip_characters(text: Column, characters: str = STRIPPED) -> Column:
    return F.btrim(text, F.lit(characters))


def words(text: Column, lower: bool = True, strip: bool = True) -> Column:
    """Split at space, newline and tab; empty words are left out."""
    def one(w: Column) -> Column:
        w = F.lower(w) if lower else w
        return strip_characters(w) if strip else w

    return F.filter(F.transform(F.split(text, "[ \n\t]"), one), lambda w: w != "")


def unicode_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ngrams(array: Column, n: int, separator: str = " ") -> Column:
    """Joined n-grams of an array; none if it has fewer elements.

    The array is zipped with itself, shifted: an expression used inside a lambda
    would be evaluated anew for each element.
    """
    size = F.greatest(F.size(array) - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(array, F.lit(i + 1), size) for i in range(n)])
    return F.transform(zipped, lambda x: F.concat_ws(separator, *[x[str(i)] for i in range(n)]))


def word_ngrams(array: Column, n: int) -> Column:
    return ngrams(array, n)


def ngram_hashes(array: str, n: int) -> Column:
    """64-bit hashes of the n-grams of an array column, which must be a column: an expression would be evaluated for each n-gram."""
    at = F.sequence(F.lit(1), F.greatest(F.size(array) - (n - 1), F.lit(1)))
    return F.when(F.size(array) >= n, F.transform(at, lambda i: F.xxhash64(F.slice(array, i, F.lit(n))))).otherwise(F.array().cast("array<long>"))


def member_ratio(array: Column, vocabulary: list[str]) -> Column:
    listed = F.array(*map(F.lit, vocabulary))
    return ratio(F.size(F.filter(array, lambda w: F.array_contains(listed, w))), F.size(array))


def special_character_ratio(text: Column, special: str = PUNCTUATION + "0123456789") -> Column:
    return ratio(F.length(text) - F.length(F.translate(text, special, "")), F.length(text))


def punctuation_ratio(text: Column, least_words: int = 3) -> Column:
    """Share of tokens that are punctuation; texts of fewer words pass with 1."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_']+|[!-&(-/:-@\[-^`{-~]"), F.lit(0))
    marks = F.filter(tokens, lambda w: w.rlike(r"^[!-&(-/:-@\[-^`{-~]$"))
    return F.when(F.size(words(text, strip=False)) < least_words, 1.0).otherwise(ratio(F.size(marks), F.size(tokens)))


def single_word_repetition(array: Column) -> Column:
    return F.when(F.size(array) == 0, 0.0).otherwise(1 - ratio(F.size(F.array_distinct(array)), F.size(array)))


def diacritic_fraction(text: Column, marks: str) -> Column:
    return ratio(F.length(text) - F.length(F.translate(text, marks, "")), F.length(text))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def redact(rows: DataFrame, text: str = "text", patterns: tuple[str, ...] = (EMAIL, IP, PHONE), mask: str = MASK) -> DataFrame:
    """``rows`` with the text redacted and the column ``replaced``; each pattern works on what the one before left.

    The masks that a text has gained are what was replaced, so each pattern runs once.
    """
    new = F.col(text)
    for pattern in patterns:
        new = F.regexp_replace(new, pattern, mask.replace("$", "\\$"))
    done = once(rows, _redacted=new)
    replaced = occurrences(F.col("_redacted"), mask) - occurrences(F.col(text), mask)
    return done.select(*[F.col("_redacted").alias(c) if c == text else F.col(c) for c in rows.columns if c != "replaced"], replaced.alias("replaced"))


def strip_think(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def domain(url: Column) -> Column:
    """Network location with port and user info; null for what isn't a URL."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def round_half_even(score: Column, low: float = 0, high: float = 5) -> Column:
    return F.bround(F.least(F.greatest(score, F.lit(float(low))), F.lit(float(high))), 0).cast("int")


def subsequence_weight(n: Column, mode: str) -> Column:
    weight = {"token": F.lit(1.0), "sample": 1 / n.cast("double"), "square": 1 / F.sqrt(n.cast("double"))}[mode]
    return F.when(n == 0, 0.0).otherwise(weight)


def estimated_tokens(text: Column, characters_per_token: float = 3.8) -> Column:
    return F.length(text) / F.lit(characters_per_token)


def ngram_id(ids: Column, vocabulary: int) -> Column:
    """Base-``vocabulary`` number of ids + 1, as a BIGINT."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda acc, x: acc * vocabulary + x + 1)


def ngram_ids(ids: Column, vocabulary: int, most: int = 4) -> Column:
    """The distinct ``ngram_id`` of all n-grams, n from 1 to ``most``; the array is zipped with itself as in ``ngrams``."""
    def of(n: int) -> Column:
        size = F.greatest(F.size(ids) - (n - 1), F.lit(0))
        zipped = F.arrays_zip(*[F.slice(ids, F.lit(i + 1), size) for i in range(n)])
        return F.transform(zipped, lambda x: ngram_id(F.array(*[x[str(i)] for i in range(n)]), vocabulary))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, most + 1)]))
