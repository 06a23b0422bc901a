"""Answers of mathematical texts: where they stand, and one way of writing them.

All are Catalyst expressions.  The rewriting is a table of rules in order, folded over
the text; a rule that reads the text more than once reads a lambda's variable, which is
evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no part of an answer, each alone or with an s, in this order; a point stands for any character.
UNITS = ["east", "degree", "mph", "kmph", "ft", "m sqaure", " m east", "sq m", "deg", "mile", "q .", "monkey", "prime", "ratio", "profit of rs", "rd", "o", "gm", "p . m", "lb", "tile", "per", "dm", "lt", "gain", "ab", "way", "west", "a .", "b .", "c .", "d .", "e .", "f .", "g .", "h .", "t", "a", "h", "no change", "men", "soldier", "pie", "bc", "excess", "st", "inches", "noon", "percent", "by", "gal", "kmh", "c", "acre", "rise", "a . m", "th", "π r 2", "sq", "mark", "l", "toy", "coin", "sq . m", "gallon", "° f", "profit", "minw", "yr", "women", "feet", "am", "pm", "hr", "cu cm", "square", "v â € ™", "are", "rupee", "rounds", "cubic", "cc", "mtr", "s", "ohm", "number", "kmph", "day", "hour", "minute", "min", "second", "man", "woman", "sec", "cube", "mt", "sq inch", "mp", "∏ cm ³", "hectare", "more", "sec", "unit", "cu . m", "cm 2", "rs .", "rs", "kg", "g", "month", "km", "m", "cm", "mm", "apple", "liter", "loss", "yard", "pure", "year", "increase", "decrease", "d", "less", "Surface", "litre", "pi sq m", "s .", "metre", "meter", "inch"]
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9}

# What is rewritten as it stands, in order, before units are taken off and after numbers in words are read.
EARLY = [("bmatrix", "pmatrix"), ("tfrac", "frac"), ("dfrac", "frac"), (r"\neq", r"\ne"), (r"\leq", r"\le"), (r"\geq", r"\ge"), (r"\left", ""), (r"\right", ""), (r"\{", "{"), (r"\}", "}")]
SIGNS = [(r"^{\circ}", ""), (r"^\circ", ""), (r"\$", ""), ("$", ""), (r"\(", ""), (r"\)", "")]
LATE = [("x=", ""), ("y=", ""), ("z=", ""), (r"x\in", ""), (r"y\in", ""), (r"z\in", ""), (r"x\to", ""), (r"y\to", ""), (r"z\to", ""), (r"\emptyset", "{}"), (r"(-\infty,\infty)", r"\mathbb{R}"), (r"\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0."), ("infinity", r"\infty")]

#: Data sets whose answers are letters (or any whose name has mmlu), and those that keep units.
LETTERED, WITH_UNITS = ("sat_math", "aqua"), ("carp_en", "minerva_math")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _plain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _unless_empty(text: Column, changed: Column) -> Column:
    return let(changed, lambda c: F.when(c != "", c).otherwise(text))


def without_units(text: Column) -> Column:
    """Twice through the units; one that would leave nothing stays.  A unit's pattern is only tried where its beginning is in the text."""
    units = UNITS + [f"{u}s" for u in UNITS]
    rules = F.array(*[F.struct(F.lit(u.split(".")[0]).alias("begin"), F.lit(rf"(?U)(^|\W){u}($|\W)").alias("pattern")) for u in units])

    def off(s: Column, rule: Column) -> Column:
        return F.when(F.contains(s, rule["begin"]), _unless_empty(s, F.regexp_replace(s, rule["pattern"], F.lit("$1$2")))).otherwise(s)

    once = lambda s: F.aggregate(rules, s, off)
    return once(once(text))


def number_of_words(text: Column) -> Column:
    """A text with a number in words becomes that number, one of digits alone loses its leading zeros; others, and those that name a power of ten or the point twice, stay."""
    values = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], float(pair[1]))])
    words = F.filter(F.split(F.lower(F.replace(text, F.lit("-"), F.lit(" "))), r"(?U)\s+"), lambda w: (w == "point") | F.map_contains_key(values, w))
    start = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("now"), F.lit(0.0).alias("unit"))

    def add(a: Column, w: Column) -> Column:
        v = F.coalesce(values[w], F.lit(0.0))
        fraction = a["unit"] > 0  # behind the point
        now = F.when(fraction, a["now"] + v * a["unit"]).when(v == 100, F.greatest(a["now"], F.lit(1.0)) * 100).when(v > 100, 0.0).otherwise(a["now"] + v)
        whole = F.when(~fraction & (v > 100), a["all"] + a["now"] * v).otherwise(a["all"])
        return F.struct(whole.alias("all"), now.alias("now"), F.when(fraction, a["unit"] / 10).when(w == "point", 0.1).otherwise(0.0).alias("unit"))

    def read(found: Column) -> Column:
        again = F.lit(False)
        for word in ("thousand", "million", "billion", "point"):
            again = again | (F.size(found) - F.size(F.array_remove(found, word)) > 1)
        total = let(F.aggregate(found, start, add), lambda a: F.round(a["all"] + a["now"], 9))
        said = let(total, lambda t: F.when(t == F.floor(t), F.floor(t).cast("string")).otherwise(t.cast("string")))
        return F.when((F.size(found) == 0) | again, text).otherwise(said)

    return F.when(text.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(let(words, read))


def _fractions(text: Column) -> Column:
    r"""``\frac1b`` and ``\frac12`` with braces; one that lacks its two parts leaves the text as it is."""
    lacking = text.rlike(r"(?s)\\frac[^{]?(?=\\frac|$)")
    braced = F.regexp_replace(F.regexp_replace(text, r"(?s)\\frac([^{])\{", r"\\frac{$1}{"), r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    return F.when(lacking, text).otherwise(braced)


def _slash(text: Column) -> Column:
    r"""``a/b`` of two whole numbers or roots as ``\frac``."""
    part = r"((?:0|-?[1-9][0-9]*)|[^/]*sqrt[^/]*)"
    return F.regexp_replace(text, f"^{part}/{part}$", r"\\frac{$1}{$2}")


def normalised(text: Column, keep_units: Column | bool = False) -> Column:
    """One way of writing an answer: no units, degrees, signs, spaces or styles, whole numbers without a point, fractions with braces."""
    keep = F.lit(keep_units) if isinstance(keep_units, bool) else keep_units
    s = F.rtrim(F.replace(_strip(text), F.lit("\n"), F.lit("")), F.lit("."))
    s = F.replace(s, F.lit(r"\!"), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(s, r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}"), r"\\end\{array\}", r"\\end{pmatrix}")
    s = _plain(s, EARLY)
    s = let(s, lambda t: _unless_empty(t, _strip(F.regexp_replace(t, r"\\text\{.*?\}$", ""))))
    s = let(s, lambda t: F.when(keep, t).otherwise(without_units(t)))
    s = let(_plain(s, SIGNS), number_of_words)
    s = _plain(F.regexp_replace(s, r"\\text\{(.*?)\}", "$1"), LATE)
    s = let(s, lambda t: F.when(F.contains(t, F.lit(r"\infty")), t).otherwise(F.replace(t, F.lit("inf"), F.lit(r"\infty"))))
    s = _plain(s, [(r"+\inity", r"\infty"), ("and", ""), (r"\mathbf", "")])
    s = F.regexp_replace(s, r"\\mbox\{.*?\}", "")
    s = let(s, lambda t: F.when(F.contains(t, F.lit("j")) & ~F.contains(t, F.lit("i")), F.replace(t, F.lit("j"), F.lit("i"))).otherwise(t))
    s = F.regexp_replace(F.regexp_replace(s, r"([0-9]+)\.0*([^0-9])", "$1$2"), r"([0-9]+)\.0*$", "$1")
    s = F.regexp_replace(s, r"^\.", "0.")
    s = F.regexp_replace(s, r"^[^=]{0,2}=([^=]*)$", "$1")
    s = F.regexp_replace(s, r"(?U)\\sqrt(\w+)", r"\\sqrt{$1}")
    return _slash(let(F.replace(s, F.lit(" "), F.lit("")), _fractions))


def _braced(text: Column) -> Column:
    """What stands between a brace that opens the text and its own end, all if that is missing."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (a["at"] + 1).alias("at"), F.when((a["end"] == 0) & (depth == 0), a["at"] + 1).otherwise(a["end"]).alias("end"))

    found = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    return let(found, lambda a: F.substring(text, F.lit(2), F.when(a["end"] > 0, a["end"] - 2).otherwise(F.length(text))))


def stated(text: Column, last_number: bool = True) -> Column:
    """The answer as it stands in the text, by the first of these that it has: the closing formula, a box, a sentence, the last number; else empty."""
    def box(ans: Column) -> Column:
        return F.when(F.startswith(ans, F.lit("{")), _braced(ans)).otherwise(_strip(F.substring_index(ans, "$", 1)))

    def after(mark: str) -> Column:
        return _strip(F.substring_index(text, mark, -1))

    formula = F.regexp_extract(text, r"(?s)final answer is \$(.*?)(?:\$\. I hope|$)", 1)
    second = F.regexp_extract(text, r"(?s)答案是(.*?)(?:答案是|$)", 1)
    number = F.coalesce(F.try_element_at(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"-?[0-9]*\.?[0-9]+"), F.lit(0)), F.lit(-1)), F.lit(""))
    has = lambda mark: F.contains(text, F.lit(mark))
    return (
        F.when(has("final answer is $") & has("$. I hope"), _strip(formula))
        .when(has("boxed"), let(F.substring_index(text, "boxed", -1), box))
        .when(has("he answer is"), after("he answer is"))
        .when(has("final answer is"), after("final answer is"))
        .when(has("答案是"), _strip(F.substring_index(_strip(second), "\n\n", 1)))
        .otherwise(number if last_number else F.lit(""))
    )


def letter(answer: Column) -> Column:
    """The last of A to E that stands alone, whatever its case, else the answer without points around it."""
    found = F.regexp_extract_all(F.upper(answer), F.lit(r"(?U)\b([A-E])\b"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.btrim(_strip(answer), F.lit(".")))


def extracted(text: Column, dataset: Column, last_number: bool = True) -> Column:
    """The answer of a text, normalised by the rules of its data set; null for a null text."""
    lettered = dataset.isin(*LETTERED) | F.contains(dataset, F.lit("mmlu"))
    answer = let(F.replace(text, F.lit("ки"), F.lit("")), lambda t: stated(t, last_number))
    answer = let(answer, lambda a: F.when(F.coalesce(lettered, F.lit(False)), letter(a)).otherwise(a))
    for pattern in (r"(?U)\n\s*", "^:", r"\.$", "/$"):
        answer = F.regexp_replace(answer, pattern, "")
    return F.when(text.isNotNull(), let(answer, lambda a: normalised(a, F.coalesce(dataset.isin(*WITH_UNITS), F.lit(False)))))
