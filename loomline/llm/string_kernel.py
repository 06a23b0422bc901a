"""Language identification by string kernels.

Two texts are as alike as the share of n-grams of 1 to ``LONGEST`` characters that both
hold: the presence kernel of the blended spectrum, normalised by the lengths of the
presence vectors.  ``LANDMARKS`` learning texts span the Nyström features; on these a
ridge regression a language, that language against the rest, is solved at once.  A
batch of texts is scored by two matrix products: presence times landmarks gives the
kernel, the kernel times the weights gives the languages.

Texts are lower-cased and runs of anything but letters become one space.  The kernel
counts the ``VOCABULARY`` n-grams that most learning texts hold.  A text's n-grams are
found in blocks of code points that overlap, so that whole texts are read in bounded
memory.

Learning takes about ``MAX_LEARN`` rows of each language, those with the smallest hash
of the id, none above ``LEARN_BYTES`` bytes and none with crc32(id) mod 4 = 2, which are
held out.  Two thirds of them fit the regression; on the others a logistic curve over
the margin between the best language and the next is fitted, whose value is the score.
Neither id nor label nor source enters a prediction.

A null text, or one without a letter, is ``und`` with score 0.  A text that shares no
n-gram with the vocabulary gets the language with the greatest bias, as ties do the
one that comes first.  A null id isn't held out; a null label is never learnt; of rows
that repeat an id and language one is learnt from.  With no language to learn all
texts are ``und``.  An empty table gives an empty result.  Columns of any other name
are neither read nor changed.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a language to learn from, about, and bytes of one.
MAX_LEARN, LEARN_BYTES = 512, 1 << 16
#: Landmark texts, and n-grams that count.
LANDMARKS, VOCABULARY = 192, 1 << 14
#: Characters of the longest n-gram.
LONGEST = 4
#: Slots of the table that finds n-grams, as a power of two.
SLOTS = 18
#: Code points that are looked at at once.
BLOCK = 1 << 20
#: Texts a matrix product.
BATCH = 128
RIDGE = 0.3

NONE = "und"
FOUND = "doc_id long, held_out boolean, lang_pred string, score double"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _blocks(text: str) -> Iterator[np.ndarray]:
    """The text's code points, as the kernel sees them, in blocks that overlap by an n-gram less one."""
    tail, inside = np.array([32], np.uint32), False
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "replace"), "<u4")
        letter = _is_letter()[points]
        points = np.where(letter, points, 32)[letter | np.concatenate([[inside], letter[:-1]])]
        inside = bool(letter[-1])
        end = [[32]] if inside and at + BLOCK >= len(text) else []
        points = np.concatenate([tail, points, *end]).astype(np.uint64)
        yield points
        tail = points[-(LONGEST - 1) :]


def grams(text: str) -> Iterator[np.ndarray]:
    """Numbers of the text's n-grams, repeats included; different n-grams differ but for chance in 64 bits."""
    for points in _blocks(text):
        number = np.zeros(len(points), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(points) < n:
                break
            number = (number[: len(points) - n + 1] + points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            number ^= number >> np.uint64(29)
            yield number


@dataclass
class Model:
    """``keys``: numbers of the n-grams that count.  ``landmarks``: their presence, a packed row a landmark text.  ``weights``: landmarks by languages."""

    languages: list[str] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.uint8))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: tuple[float, float] = (0.0, 0.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, column) by slot; the keys were chosen so that no two share one."""
        if "_table" not in self.__dict__:
            keys, columns = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
            keys[slot(self.keys)], columns[slot(self.keys)] = self.keys, np.arange(len(self.keys))
            self._table = keys, columns
        return self._table

    def presence(self, texts: list[str] | pa.StringArray) -> np.ndarray:
        """A row a text: 1 for each n-gram of the vocabulary that it holds.  Of Arrow texts one at a time becomes a Python string."""
        keys, columns = self.table()
        out = np.zeros((len(texts), len(self.keys)), np.float32)
        for row, text in zip(out, texts, strict=True):
            for number in grams((text.as_py() if isinstance(text, pa.Scalar) else text) or ""):
                at = slot(number)
                row[columns[at[keys[at] == number]]] = 1
        return out

    def kernel(self, present: np.ndarray) -> np.ndarray:
        """By text and landmark: the n-grams of both over the geometric mean of the numbers of either's."""
        if "_unpacked" not in self.__dict__:
            marks = np.unpackbits(self.landmarks, axis=1, count=len(self.keys)).astype(np.float32)
            self._unpacked = (marks / np.sqrt(np.maximum(1, marks.sum(1)))[:, None]).T.copy()
        return present @ self._unpacked / np.sqrt(np.maximum(1, present.sum(1)))[:, None]

    def values(self, texts: list[str] | pa.StringArray) -> np.ndarray:
        """By text and language."""
        return self.kernel(self.presence(texts)) @ self.weights + self.bias

    def predict(self, texts: list[str] | pa.StringArray) -> list[tuple[str, float]]:
        if not self.languages:
            return [(NONE, 0.0)] * len(texts)
        out = []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            values = self.values(part)
            best, scores = values.argmax(1), _logistic(_margin(values), self.curve)
            for text, b, s in zip(part, best, scores, strict=True):
                text = text.as_py() if isinstance(text, pa.Scalar) else text
                out.append((self.languages[b], float(s)) if text and has_letter(text) else (NONE, 0.0))
        return out


def slot(numbers: np.ndarray) -> np.ndarray:
    return ((numbers * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _margin(values: np.ndarray) -> np.ndarray:
    if values.shape[1] == 1:
        return np.ones(len(values))
    top = np.sort(values, axis=1)
    return top[:, -1] - top[:, -2]


def _logistic(margin: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * margin, -30, 30)))


def _fit_curve(margin: np.ndarray, right: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """A logistic curve of being right, with one made-up case of either kind at no margin, so that it stays finite."""
    x = np.stack([np.ones(len(margin) + 2), np.concatenate([margin, [0, 0]])], axis=1)
    y = np.concatenate([right, [0, 1]]).astype(float)
    w = np.zeros(2)
    keep = np.diag([1e-3, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def _vocabulary(texts: list[str]) -> np.ndarray:
    """Numbers of the n-grams that most texts hold, the smaller number first; one a slot."""
    held: Counter = Counter()
    for text in texts:
        parts = list(grams(text))
        if parts:
            held.update(np.unique(np.concatenate(parts)).tolist())
    keys = np.array(sorted(held, key=lambda k: (-held[k], k)), np.uint64)
    _, first = np.unique(slot(keys), return_index=True)
    return keys[np.sort(first)][:VOCABULARY]


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) rows in an order that says nothing of either; every third row of a language calibrates."""
    rows = [(t, y) for t, y in rows if has_letter(t)]
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model()
    by = {y: [t for t, other in rows if other == y] for y in languages}
    fitting = {y: [t for i, t in enumerate(texts) if i % 3 != 2] for y, texts in by.items()}
    texts, marks = [t for y in languages for t in fitting[y]], []
    each = max(2, LANDMARKS // len(languages))
    for y in languages:
        marks += fitting[y][:each]
    model = Model(languages, _vocabulary(texts))
    model.landmarks = np.packbits(model.presence(marks).astype(np.uint8), axis=1)
    among = model.kernel(model.presence(marks)).astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-6 * max(1.0, values[-1])
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([model.kernel(model.presence(texts[i : i + BATCH])) for i in range(0, len(texts), BATCH)])
    features = kernel.astype(float) @ nystrom
    labels = [languages.index(y) for y in languages for _ in fitting[y]]
    target = np.where(np.array(labels)[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    even = (1 / (share * len(languages)))[labels][:, None]  # each language counts the same
    with_bias = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    ridge = RIDGE * np.diag([*[1.0] * features.shape[1], 1e-6])
    solved = np.linalg.solve((with_bias * even).T @ with_bias + ridge, (with_bias * even).T @ target)
    model.weights, model.bias = nystrom @ solved[:-1], solved[-1]
    margin, right = np.zeros(0), np.zeros(0)
    for number, y in enumerate(languages):
        held = [t for i, t in enumerate(by[y]) if i % 3 == 2]
        for at in range(0, len(held), BATCH):
            got = model.values(held[at : at + BATCH])
            margin, right = np.append(margin, _margin(got)), np.append(right, got.argmax(1) == number)
    model.curve = _fit_curve(margin, right)
    return model


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of every language that a learnable row has.

    What is taken of a language are the rows whose hash is below its share of the
    hash's range, so that no task sorts a language's rows.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= LEARN_BYTES) & ~_held_out(id_col))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 40)).alias("_h"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    limit = F.lit(0)
    for language, n in counts.items():
        limit = F.when(F.col("_lang") == language, F.lit(int(min(1, 1.1 * MAX_LEARN / n) * (1 << 40)))).otherwise(limit)
    picked = rows.filter(F.col("_h") < limit).groupBy("_lang", "_h", "_id").agg(F.min("_text").alias("_text"))
    found = sorted(picked.select("_lang", "_h", "_id", "_text").collect(), key=lambda r: (r["_lang"], r["_h"], str(r["_id"])))
    seen: Counter = Counter()
    kept = []
    for r in found:
        seen[r["_lang"]] += 1
        if seen[r["_lang"]] <= MAX_LEARN:
            kept.append((r["_text"], r["_lang"]))
    return fit(kept)


def predict_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document, in one pass without a shuffle: ``FOUND``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column("text"))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.record_batch(cols, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, FOUND)
