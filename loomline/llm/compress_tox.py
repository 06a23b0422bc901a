"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A document is cut into windows of ``WINDOW`` words, each is compressed with
either, and what the toxic dictionary saves is the window's gain.  The ordinary
dictionary's content also stands behind the toxic one, so that ordinary passages
come out alike and the gain is due to toxic text alone.

Toxic documents are mostly ordinary text, so their dictionary is trained on what
sets them apart: words and beginnings of words which, by a log-likelihood ratio
over distinct contexts (the word before and the word), stand out in toxic
documents by more than chance would give for that many terms.  Counting contexts
rather than documents keeps groups of copies from counting more than once.

Thresholds are calibrated on learning rows that trained no dictionary: a
logistic curve over the largest gain, the sum of gains and the number of windows
gives the score.  Whole texts are scored, without state between rows.

Learning takes at most ``MAX_LEARN`` labelled rows of each class, those with the
smallest hash of the id (the id decides ties), and none with crc32(id) mod 4 = 2.
Neither id nor label, language or source enters a score.

A null text counts as empty; an empty text has no window and gets the curve's
value for no gain.  A null id isn't held out.  With labels of one class only, or
none, all scores are the share of toxic learning rows (0 if there are none).  Of
rows that repeat an id one is learnt from; each is scored by its own text.  An
empty table gives an empty result.  Columns of any other name are neither read
nor changed: ``drop_toxic`` returns the documents' own columns.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class to learn from, at most.
MAX_LEARN = 2000
#: Words a window.
WINDOW = 16
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 1 << 15, 1 << 12
#: Beginnings of words that are compared, in characters.
BEGIN = range(4, 9)
#: A term stands out if it's so many times as frequent in toxic texts, at least.
LEAST_RATIO = 6
#: Least gain of a window, in bytes, that counts.
LEAST_GAIN = 2
#: A row is predicted toxic from this score on.
THRESHOLD = 0.3

SCORED = "doc_id long, held_out boolean, score double, predicted int"


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, len(words), WINDOW)]


def _terms(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in BEGIN if n <= len(word))]


def _contexts(texts: list[str]) -> Counter:
    """By term: the number of distinct (word before, word) that hold it."""
    pairs = set()
    for text in texts:
        words = text.lower().split()
        pairs.update(zip(["", *words], words, strict=False))
    by_word = Counter(word for _, word in pairs)
    out: Counter = Counter()
    for word, n in by_word.items():
        for term in _terms(word):
            out[term] += n
    out[""] = len(pairs)
    return out


def distinctive(toxic: list[str], ordinary: list[str]) -> dict[str, float]:
    """Terms that stand out in toxic texts, with their log-likelihood ratio."""
    a, b = _contexts(toxic), _contexts(ordinary)
    all_a, all_b = max(1, a.pop("")), max(1, b.pop(""))
    least = 2 * math.log(max(2, len(a)))
    out = {}
    for term, x in a.items():
        y = b[term]
        expect_a, expect_b = (x + y) * all_a / (all_a + all_b), (x + y) * all_b / (all_a + all_b)
        if x >= 3 and x * all_b > LEAST_RATIO * (y + 0.5) * all_a:
            ratio = 2 * (x * math.log(x / expect_a) + (y * math.log(y / expect_b) if y else 0))
            if ratio > least:
                out[term] = ratio
    return out


def _train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; samples too few to train one are its content as they are."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(9, dict_size=len(content), source_size=64, write_checksum=False, write_content_size=False, write_dict_id=False, min_match=3)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    share: float = 0.0

    def features(self, texts: list[str] | pa.StringArray) -> np.ndarray:
        """Of texts as they are or in an Arrow array, of which one at a time becomes a Python string."""
        plain, marked = _compressors(self)
        out = np.zeros((len(texts), 4))
        for row, text in zip(out, texts, strict=True):
            parts = windows(text.as_py() if isinstance(text, pa.Scalar) else text)
            gains = np.array([len(plain(p)) - len(marked(p)) for p in parts] or [0])
            row[:] = 1, max(0, gains.max()), math.log1p(gains[gains >= LEAST_GAIN].sum()), math.log1p(len(parts))
        return out

    def score(self, texts: list[str] | pa.StringArray) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


_made: dict[tuple[bytes, bytes], tuple] = {}


def _compressors(model: Model) -> tuple:
    key = (model.ordinary, model.toxic)
    if key not in _made:
        _made.clear()
        _made[key] = tuple(_compressor(c).compress for c in (model.ordinary, model.toxic + model.ordinary))
    return _made[key]


def _logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w)) * np.array([0, *[1] * (len(w) - 1)]) + 1e-9 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * (p * (1 - p) + 1e-6))[:, None]).T @ x + keep, x.T @ (counts * (p - y)) + keep @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(rows: list[tuple[int, str, int]], share: float | None = None) -> Model:
    """From (id, text, label) rows; every third distinct text calibrates, the others train.

    ``share``: of toxic rows among all that could be learnt from, if ``rows`` are a
    sample by class; the curve is fitted as if the rows had it.
    """
    once = {text: (i, text, y) for i, text, y in sorted(rows, key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0]))}
    rows = [*once.values()]
    if share is None:
        share = float(np.mean([y for *_, y in rows])) if rows else 0.0
    parts: dict[tuple[int, bool], list[str]] = {}
    seen: Counter = Counter()
    for _, text, y in rows:
        parts.setdefault((y, seen[y] % 3 == 2), []).append(text)
        seen[y] += 1
    if len(parts) < 4:
        return Model(share=share)
    toxic, ordinary = parts[1, False], parts[0, False]
    found = distinctive(toxic, ordinary)
    kept = []
    for text in toxic:
        best = [max(mine, key=lambda t: (found[t], len(t))) for w in text.lower().split() if (mine := [t for t in _terms(w) if t in found])]
        kept.append(" ".join(best).encode())
    plain = [part for t in ordinary for raw in [t.lower().encode()] for part in (raw[i : i + 512] for i in range(0, len(raw), 512))]
    model = Model(_train(plain, ORDINARY_BYTES), _train(kept, TOXIC_BYTES), share=share)
    x = np.concatenate([model.features(parts[1, True]), model.features(parts[0, True])])
    y = np.array([1.0] * len(parts[1, True]) + [0.0] * len(parts[0, True]))
    counts = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    model.weights = _logistic(x, y, counts)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    ids = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out("doc_id"))
    ids = ids.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_y"))
    texts = docs.filter(F.octet_length(text_col) > 0).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    at_hand = texts.select(F.col("_doc").alias("_id"), F.xxhash64("_doc").alias("_h")).distinct()
    pool = ids.join(at_hand, "_id")
    total, toxic = pool.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    picked = [pool.filter(F.col("_y") == y).orderBy("_h", "_id").limit(MAX_LEARN) for y in (0, 1)]
    few = picked[0].unionByName(picked[1]).select("_id", "_y")  # 2 * MAX_LEARN rows at most
    rows = texts.join(F.broadcast(few), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    return fit([tuple(r) for r in rows.select("_id", "_text", "_y").collect()], toxic / total if total else 0.0)


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document, in one pass without a shuffle: ``SCORED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column("text"))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.record_batch(cols, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, each judged by its own text, in one pass without a shuffle.

    Only the text goes to Python; the row stays where it is, whatever its columns.
    """

    @F.arrow_udf("boolean")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(texts) >= THRESHOLD, pa.bool_())

    return docs.filter(~toxic(F.coalesce(F.col(text_col), F.lit(""))))
