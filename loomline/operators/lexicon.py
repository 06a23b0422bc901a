"""Models that are tables of words: perplexity, language, word lists; and a longest-match tokenizer.

Each model is a DataFrame with a row a word, made from the corpus or given.  Scoring
counts a document's words in its task, joins the distinct words with the table, those of
most documents dealt over tasks, and adds up by document; no model is gathered anywhere.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..functions import text as T
from ..sources.shared import written
from .lookup import attach


@F.arrow_udf(StringType())
def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode normal form C."""
    for texts in batches:
        yield pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StructType().add("word", StringType()).add("c", LongType())))
def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``T.words`` of texts in lower case, each word with its count."""
    for texts in batches:
        words, counts, ends = [], [], [0]
        for text in texts.to_pylist():
            found: dict[str, int] = {}
            for raw, n in Counter((text or "").replace("\n", " ").replace("\t", " ").split(" ")).items():
                if word := raw.strip(T.STRIPPED):
                    found[word] = found.get(word, 0) + n
            words += found.keys()
            counts += found.values()
            ends.append(len(words))
        pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "c"])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, word, c), written: a row a word of each text, counted in its task, so that no word is shuffled; ids that repeat have a word once a text."""
    return written(docs.select(id_col, F.inline(_counted(F.lower(text)))), "word-counts")


def word_sizes(counts: DataFrame) -> DataFrame:
    """(word, n, total), written: the rows and occurrences of each word, to deal those that most documents hold."""
    return written(counts.groupBy("word").agg(F.count("*").alias("n"), F.sum("c").alias("total")), "word-sizes")


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, total): the occurrences of each word in all texts, counted by text in its task before they are shuffled."""
    return docs.select(F.inline(_counted(F.lower(text)))).groupBy("word").agg(F.sum("c").alias("total"))


def unigram_model(sizes: DataFrame) -> DataFrame:
    """(word, logp): log share of a word among all, of ``word_sizes``."""
    return sizes.select("word", F.ln(F.col("total") / sizes.agg(F.sum("total")).scalar()).alias("logp"))


def perplexity(docs: DataFrame, counts: DataFrame, model: DataFrame, id_col: str = "doc_id", unknown: float = -20.0, sizes: DataFrame | None = None) -> DataFrame:
    """(id, perplexity) under a word model: exp of the mean negative log share; null without words.  ``sizes`` are the counts' own, if they are known."""
    scored = attach(counts, model, ["word"], sizes).groupBy(F.col(id_col).alias("_id")).agg((-F.sum(F.col("c") * F.coalesce("logp", F.lit(unknown))) / F.sum("c")).alias("_h"))
    return docs.select(id_col).join(scored, F.col(id_col) == F.col("_id"), "left").select(id_col, F.exp("_h").alias("perplexity"))


def window_of_words(docs: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): ``width`` words from a place that only depends on the id: a sampling operator."""
    rows = T.once(docs.select(id_col, text), _w=F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    room = F.greatest(F.size("_w") - width, F.lit(0)) + 1
    start = F.pmod(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long"), room.cast("long")).cast("int")
    return rows.select(id_col, F.array_join(F.slice("_w", start + 1, F.lit(width)), " ").alias(text))


def language_model(docs: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """(word, shares map<language, double>): a word's occurrences by language, of all of its."""
    words = docs.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.inline(_counted(F.lower(text))))
    counted = words.groupBy("word", "language").agg(F.sum("c").alias("n"))
    by_word = counted.groupBy("word").agg(F.collect_list(F.struct("language", "n")).alias("l"), F.sum("n").alias("s"))  # a language each
    return by_word.select("word", F.map_from_entries(F.transform("l", lambda x: F.struct(x["language"], x["n"] / F.col("s")))).alias("shares"))


def detect_language(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, language, score): the language with the greatest mean share over a document's words, rounded; null without words."""
    counts = word_counts(docs, id_col, text)
    known = attach(counts, model, ["word"], word_sizes(counts))
    sizes = known.groupBy(F.col(id_col).alias("_id")).agg(F.sum("c").alias("_n"))
    sums = known.select(id_col, "c", F.explode("shares").alias("language", "share")).groupBy(id_col, "language").agg(F.sum(F.col("c") * F.col("share")).alias("s"))
    scored = sums.join(sizes, F.col(id_col) == F.col("_id")).select(F.col("_id"), "language", F.round(F.col("s") / F.col("_n"), 6).alias("score"))
    best = scored.groupBy("_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "language")).alias("b"))
    return docs.select(id_col).join(best, F.col(id_col) == F.col("_id"), "left").select(id_col, F.col("b.language").alias("language"), (-F.col("b.s")).alias("score"))


def list_ratios(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text: str = "text", counts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(id, ratio): share of a document's words that are in the list (word), however long that is; ``counts`` and ``sizes`` if they are known."""
    counts = word_counts(docs, id_col, text) if counts is None else counts
    marked = attach(counts, words.select("word", F.lit(1).alias("_in")).distinct(), ["word"], word_sizes(counts) if sizes is None else sizes)
    shares = marked.groupBy(F.col(id_col).alias("_id")).agg(F.sum("c").alias("_n"), F.sum(F.when(F.col("_in") == 1, F.col("c")).otherwise(0)).alias("_k"))
    return docs.select(id_col).join(shares, F.col(id_col) == F.col("_id"), "left").select(id_col, T.ratio(F.col("_k"), F.col("_n")).alias("ratio"))


class Trie:
    """Longest-match tokenizer over byte strings; a byte that begins no token is its own, from 0 to 255."""

    def __init__(self, tokens: list[bytes]):
        self.root: dict = {}
        for number, token in enumerate(tokens):
            at = self.root
            for byte in token:
                at = at.setdefault(byte, {})
            at.setdefault(None, 256 + number)

    def encode(self, data: bytes) -> list[int]:
        out, i = [], 0
        while i < len(data):
            at, best, end = self.root, data[i], i + 1
            for j in range(i, len(data)):
                at = at.get(data[j])
                if at is None:
                    break
                if None in at:
                    best, end = at[None], j + 1
            out.append(best)
            i = end
        return out


_tries: dict[str, Trie] = {}


def trie_of(path: str) -> Trie:
    """One a file of a token a line and worker process: tasks carry the path, not the model."""
    if path not in _tries:
        with open(path, encoding="utf-8") as lines:
            _tries[path] = Trie([line.rstrip("\n").encode() for line in lines if line.strip("\n")])
    return _tries[path]


def token_numbers(docs: DataFrame, tokens: str | list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) by the longest match among tokens given, or in a file that all executors see."""
    given = None if isinstance(tokens, str) else Trie([t.encode() for t in tokens])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = given or trie_of(tokens)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([trie.encode(t.as_py().encode()) for t in batch.column(1)], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, f"{id_col} long, ids array<int>")


def fertility(docs: DataFrame, tokens: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fertility): tokens by word."""
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return docs.select(id_col, words.alias("_w")).join(tokens, id_col).select(id_col, T.ratio(F.size("ids"), F.col("_w")).alias("fertility"))


def quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", features: int = 1 << 14):
    """A logistic regression over hashed words, trained on the labelled documents: a fitted pipeline whose output has ``probability``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = docs.join(labels.select(id_col, F.col(label).cast("double").alias("label")), id_col).select("label", T.words(F.col(text)).alias("words"))
    return Pipeline(stages=[HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True), LogisticRegression(maxIter=20, regParam=0.01)]).fit(rows)
