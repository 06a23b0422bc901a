"""Chat rows: conversations, prompts, masks and their checks, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

# Fixed values.
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def conversation(prompt: Column, response: Column, reasoning: Column, think: bool, system: str | None = None) -> Column:
    """(role, content) messages.  Thinking keeps a response's own block or puts the reasoning in one; otherwise blocks go."""
    response, reasoning = F.coalesce(response, F.lit("")), F.coalesce(reasoning, F.lit(""))
    with_block = F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n"), response)
    said = F.when(response.contains("<think>") | (reasoning == ""), response).otherwise(with_block) if think else T.strip_think(response)
    return F.array(*([message("system", F.lit(system))] if system else []), message("user", prompt), message("assistant", said))


def choice_question(question: Column, choices: Column, answer: Column | None = None) -> Column:
    """The question with lettered choices and "Answer:", with the letter of the choice number ``answer`` if that is given."""
    listed = F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), F.trim(c), F.lit("\n")))
    head = F.concat(F.trim(question), F.lit("\n"), F.array_join(listed, ""), F.lit("Answer:"))
    return head if answer is None else F.concat(head, F.lit(" "), F.char(F.lit(65) + answer))


def with_shots(question: Column, shots: Column) -> Column:
    return F.concat(F.array_join(F.transform(shots, lambda s: F.concat(s, F.lit("\n\n"))), ""), question)


def repaired_punctuation(text: Column) -> Column:
    """``?.`` and ``!.`` become ``?``."""
    return F.replace(F.replace(text, F.lit("?."), F.lit("?")), F.lit("!."), F.lit("?"))


def keyword_arguments(json: Column) -> tuple[Column, Column]:
    """(map of an instruction's arguments without null ones, whether the JSON is valid)."""
    parsed = F.from_json(json, "map<string,string>")
    return F.map_filter(parsed, lambda k, v: v.isNotNull()), parsed.isNotNull()


def conflicts(instructions: Column, table: dict[str, list[str]]) -> Column:
    """Whether an instruction stands next to one that ``table`` says it conflicts with."""
    found = F.lit(False)
    for name, others in table.items():
        found = found | (F.array_contains(instructions, name) & F.arrays_overlap(instructions, F.array(*map(F.lit, others))))
    return found


def preference_ok(*texts: Column) -> Column:
    """All are texts with something in them."""
    ok = F.lit(True)
    for t in texts:
        ok = ok & (F.length(F.coalesce(t, F.lit(""))) > 0)
    return ok


def masked_spans(messages: DataFrame, target: str = "assistant", conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, start, end): character spans, in a conversation's texts laid end to end, that don't belong to the target role.

    A running sum in the order of the turns, so a conversation of any length streams through its task.
    """
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length(text), F.lit(0))
    placed = messages.select(conversation, role, size.alias("_n"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_at"))
    spans = placed.filter(F.coalesce(F.col(role), F.lit("")) != target)
    return spans.select(conversation, F.col("_at").cast("int").alias("start"), (F.col("_at") + F.col("_n")).cast("int").alias("end"))


def normalised_answer(text: Column) -> Column:
    """Lower case, one space for white space and punctuation (not for ', and none for -), number words as digits, no articles."""
    flat = F.regexp_replace(F.replace(T.standardise_whitespace(F.lower(text)), F.lit("-"), F.lit("")), r"[!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~\n\t]", " ")
    numbers = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    words = F.filter(F.split(flat, " "), lambda w: (w != "") & ~w.isin(ARTICLES))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(numbers, w), w)), " ")


def degraded(text: Column, seed: Column, words: int = 50) -> Column:
    """Up to ``words`` words in an order that only depends on word, place and seed: a negative example."""
    listed = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    keyed = F.transform(listed, lambda w, i: F.struct(F.md5(F.concat_ws(":", seed, i.cast("string"), w)).alias("h"), w.alias("w")))
    return F.array_join(F.transform(F.slice(F.array_sort(keyed), 1, words), lambda x: x["w"]), " ")


def consistent_language(completion: Column, marks: str, seed: Column, windows: int = 3, width: int = 100, least: float = 0.01) -> Column:
    """Whether most of some windows of words of the thinking (else of all) have the marks of the language; no for blank ones."""
    trace = F.coalesce(F.nullif(F.regexp_extract(completion, r"(?is)<think>(.*?)</think>", 1), F.lit("")), completion)
    words = F.filter(F.split(trace, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    room = F.greatest(F.size(words) - width, F.lit(0)) + 1
    votes = F.lit(0)
    for k in range(windows):
        start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", seed, F.lit(str(k)))), 1, 8), 16, 10).cast("long"), room.cast("long")).cast("int")
        window = F.array_join(F.slice(words, start + 1, F.lit(width)), " ")
        votes = votes + (T.diacritic_fraction(window, marks) > least).cast("int")
    return (F.size(words) > 0) & (votes >= windows // 2 + 1)
