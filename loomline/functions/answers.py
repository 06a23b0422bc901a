"""Answer extraction and scoring expressions."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Signs of a program's operations, fixed values.
OPERATIONS = {"divide": "/", "multiply": "*", "add": "+", "subtract": "-"}


@F.pandas_udf(S.StringType())
def last_boxed(texts: pd.Series) -> pd.Series:
    """The content of the last \\boxed{} or \\fbox{}, braces matched; null without one.  Balanced braces aren't regular."""
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        at = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
        if at < 0:
            return None
        start, depth = text.index("{", at) + 1, 1
        for i in range(start, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[start:i]
        return None

    return texts.map(one).astype(object)


def extract_answer(text: Column) -> Column:
    """Boxed, else after "the answer is", else the last number."""
    boxed = F.regexp_extract(text, r"\\boxed\{([^}]*)\}", 1)
    stated = F.regexp_extract(text, r"(?i)the answer is:?\s*([^\s.,;]+)", 1)
    numbers = F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.coalesce(F.nullif(boxed, F.lit("")), F.nullif(stated, F.lit("")), F.try_element_at(numbers, F.lit(-1)))


def normalise_answer(answer: Column) -> Column:
    """Trimmed, lower case, without thousands separators, and without zeros after a decimal point."""
    plain = F.lower(F.trim(F.regexp_replace(answer, "[,$]", "")))
    return F.when(plain.rlike(r"^-?[0-9]+\.[0-9]*$"), F.regexp_replace(plain, r"\.?0*$", "")).otherwise(plain)


def answers_equal(a: Column, b: Column) -> Column:
    x, y = normalise_answer(a), normalise_answer(b)
    close = F.abs(F.try_to_number(x, F.lit("S999999999D999999")).cast("double") - F.try_to_number(y, F.lit("S999999999D999999")).cast("double")) < 1e-6
    return F.coalesce((x == y) | F.coalesce(close, F.lit(False)), F.lit(False))


def format_reward(text: Column) -> Column:
    return text.rlike(r"(?is)^\s*<think>.*?</think>\s*\S").cast("double")


def overlong_penalty(length: Column, limit: int, buffer: int) -> Column:
    """0 up to limit - buffer, then linear to -1 at the limit."""
    over = (length - (limit - buffer)) / F.lit(float(buffer))
    return F.when(length <= limit - buffer, 0.0).otherwise(-F.least(over, F.lit(1.0)))


def choice_letter(text: Column) -> Column:
    """The last bracketed letter A to D, else the last that stands alone."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    return F.coalesce(last(r"\(([A-D])\)"), last(r"\b([A-D])\b"))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's, of what a common beginning and end leave, a column of the table at a time as bits of whole numbers (Myers, Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    begin = len(os.path.commonprefix([a, b]))
    a, b = a[begin:], b[begin:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not b:
        return len(a)
    places: dict[str, list[int]] = {}
    for i, c in enumerate(b):
        places.setdefault(c, []).append(i)
    equal = {}
    for c, at in places.items():
        bits = bytearray(len(b) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        equal[c] = int.from_bytes(bits, "little")
    last, full, more, less, distance = len(b) - 1, (1 << len(b)) - 1, (1 << len(b)) - 1, 0, len(b)
    for c in a:
        same = equal.get(c, 0)
        vertical = same | less
        across = (((same & more) + more) ^ more) | same
        plus, minus = (less | ~(across | more)) & full, more & across
        distance += (plus >> last) - (minus >> last & 1)
        plus, minus = plus << 1 | 1, minus << 1
        more, less = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return distance


def anls(prediction: Column, answers: Column, threshold: float = 0.5) -> Column:
    """The best 1 - NL over the answers for NL under the threshold, else 0; 0 for an empty prediction."""
    def score(a: str | None, b: str | None) -> float:
        nl = 1.0 if a is None or b is None else edit_distance(a, b) / max(len(a), len(b), 1)
        return 1 - nl if nl < threshold else 0.0

    @F.arrow_udf("double")
    def best(said: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(said, right, strict=True)
        return pa.array([max((score(a.as_py(), b) for b in all_b.as_py() or []), default=None) for a, all_b in pairs], pa.float64())

    plain = lambda c: F.lower(F.trim(c))
    return F.when(F.length(F.trim(prediction)) == 0, 0.0).otherwise(best(plain(prediction), F.transform(answers, plain)))


def vqa_accuracy(prediction: Column, answers: Column) -> Column:
    """Mean over each answer left out of min(1, matches among the others / 3)."""
    hits = F.size(F.filter(answers, lambda a: a == prediction))
    return F.aggregate(answers, F.lit(0.0), lambda acc, a: acc + F.least(F.lit(1.0), (hits - F.when(a == prediction, 1).otherwise(0)) / F.lit(3.0)), lambda acc: acc / F.greatest(F.size(answers), F.lit(1)))


def relaxed_match(prediction: Column, truth: Column, tolerance: float = 0.05) -> Column:
    return F.when(truth == 0, prediction == 0).otherwise(F.abs(prediction - truth) <= tolerance * F.abs(truth))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - prod_{j<k} (n-c-j)/(n-j); the product is 0 once n - c < k."""
    terms = F.sequence(F.lit(0), F.lit(k - 1))
    miss = F.aggregate(terms, F.lit(1.0), lambda acc, j: acc * F.greatest((n - c - j).cast("double"), F.lit(0.0)) / F.greatest(n - j, F.lit(1)).cast("double"))
    return 1 - miss


def summary_sections(text: Column) -> tuple[Column, Column]:
    """The two parts of a "# Summary ... # Details ..." answer."""
    pattern = r"(?is)#\s*summary\s*(.*?)\s*#\s*details\s*(.*)"
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def infix(program: Column) -> Column:
    """``op(a,b), op(#0,c)`` as one infix expression: the last step with ``#n`` written out and ``const_n`` as n.

    Steps are separated by ", ", arguments by ",".  A reference to a step that is not
    there gives null; a step of an unknown operation stays a call.
    """
    signs = F.create_map(*(F.lit(x) for pair in OPERATIONS.items() for x in pair))

    def step(done: Column, text: Column) -> Column:
        raw = F.transform(F.split(F.regexp_extract(text, r"\((.*)\)", 1), ",", -1), lambda a: F.trim(a))
        at = lambda a: F.get(done, F.regexp_extract(a, r"^#(\d+)$", 1).try_cast("int"))
        args = F.transform(raw, lambda a: F.when(a.rlike(r"^#\d+$"), at(a)).otherwise(F.regexp_replace(a, r"const_(\d+)", "$1")))
        name = F.regexp_extract(text, r"^\s*(\w+)\s*\(", 1)
        sign = F.try_element_at(signs, name)
        call = F.concat(name, F.lit("("), F.when(~F.exists(args, F.isnull), F.array_join(args, ",")), F.lit(")"))
        known = F.when(F.size(args) >= 2, F.concat(F.lit("("), F.get(args, F.lit(0)), F.lit(" "), sign, F.lit(" "), F.get(args, F.lit(1)), F.lit(")")))
        bare = F.regexp_replace(text, r"const_(\d+)", "$1")
        return F.when(name == "", bare).when(sign.isNotNull(), known).otherwise(call)

    steps = F.aggregate(F.split(program, ", ", -1), F.array().cast("array<string>"), lambda done, text: F.concat(done, F.array(step(done, text))))
    return F.element_at(steps, -1)
