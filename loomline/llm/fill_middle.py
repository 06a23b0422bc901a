"""Fill-in-the-middle: a text is cut at two places and its pieces are put in another order.

A text becomes an array of UTF-32 code points.  Each has a class (``UNITS``): itself,
so that every code point is a unit; or space, letter, digit and other, so that words
and gaps are; or the line it is on.  Units begin where neighbouring classes differ.
Two ranks from the id's digest choose the cuts among the boundaries, and the pieces
are sliced from the array and encoded again.

A text that holds a sentinel, an empty one, and those that the digest leaves out stay
``plain``.  ``restored`` parses the output by its form; as no piece holds a sentinel
and none can arise where a piece meets one, this gives the exact text.

A null text counts as empty; a null id is hashed as an empty string.  Repeated ids are
cut at the same ranks.  Whole texts are cut, one at a time and without state between
rows; an empty table gives an empty result.  Columns of any other name are neither
read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: rows that stay plain from here on, and rows that put the suffix first below.
PLAIN_FROM, SPM_BELOW = 90, 20

FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _kinds(points: np.ndarray) -> np.ndarray:
    """0 space, 1 letter, 2 digit, 3 other; a letter is what the code point's own class says."""
    found, back = np.unique(points, return_inverse=True)
    names = [chr(p) for p in found]
    of = np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 for c in names], np.int8)
    return of[back]


def _line_of(points: np.ndarray) -> np.ndarray:
    ends = points == 10
    return np.cumsum(ends) - ends


#: Classes of an array of code points; a unit is a run of one class.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"code point": lambda points: np.arange(len(points), dtype=np.int64), "run": _kinds, "line": _line_of}


def boundaries(points: np.ndarray, unit: str = "code point") -> np.ndarray:
    """Where units end: position 0, every place between two classes, and the end."""
    classes = UNITS[unit](points)
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def ranks(doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the digest of the id."""
    text = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[8 * i : 8 * i + 8], 16) for i in range(4))


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def transform(doc_id: int | None, text: str, unit: str = "code point") -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = boundaries(points, unit)
    n = len(ends) - 1
    a, b, kept, order = ranks(doc_id)
    if not n or kept % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (int(ends[i]) for i in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = map(_text, (points[:low], points[low:high], points[high:]))
    if order % 100 < SPM_BELOW:
        return n, "spm", low, high - low, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", low, high - low, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restored(output: str, form: str) -> str:
    """The text, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    cut, end = output.index(second), output.index(MIDDLE)
    one, two, middle = output[len(first) : cut], output[cut + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def _run(docs: DataFrame, id_col: str, text_col: str, schema: str, row: Callable[[int | None, str], tuple]) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names, kinds = zip(*[part.split() for part in schema.split(", ")], strict=True)
    kinds = [pa.int64() if k == "long" else pa.string() for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, *row(i, t.as_py())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], k) for k in kinds], names=list(names))

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code point") -> DataFrame:
    """A row a document with its output: ``FORMS``; n counts units."""
    return _run(docs, id_col, text_col, FORMS, lambda i, t: transform(i, t, unit))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code point") -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text rebuilt from it instead of the output."""

    def row(doc_id: int | None, text: str) -> tuple:
        n, form, prefix, middle, output = transform(doc_id, text, unit)
        return n, form, prefix, middle, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, restored(output, form)))

    return _run(docs, id_col, text_col, FORMS.replace("output string", "output_sha256 string, restored_sha256 string"), row)
