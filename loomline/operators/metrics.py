"""Evaluation metrics as aggregates; ratios over nothing are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from .mixing import placed


def puzzle_scores(tests: DataFrame, puzzle: str, solved: str) -> DataFrame:
    """(puzzle, tests, credit, strict): the share of a puzzle's tests that are solved, and whether all are."""
    return tests.groupBy(puzzle).agg(F.count("*").alias("tests"), F.avg(F.col(solved).cast("double")).alias("credit"), F.bool_and(solved).alias("strict"))


def majority_at_k(answers: DataFrame, example: str, answer: str, order: str, truth: str, k: int) -> DataFrame:
    """(example, valid, top, hit): whether the truth is among the k most frequent answers, ties in order of first appearance.  Null answers are invalid."""
    counted = answers.filter(F.col(answer).isNotNull()).groupBy(example, answer).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(example).orderBy(F.desc("c"), "first"))).groupBy(example)
    tops = ranked.agg(F.sum("c").alias("valid"), F.max("c").alias("top"), F.collect_set(F.when(F.col("r") <= k, F.col(answer))).alias("_best"))
    truths = answers.groupBy(example).agg(F.max(truth).alias("_t"))
    joined = truths.join(tops, example, "left")
    return joined.select(example, F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("top", F.lit(0)).alias("top"), F.coalesce(F.array_contains("_best", F.col("_t")), F.lit(False)).alias("hit"))


def choice_accuracy(rows: DataFrame, by: list[str], said: Column, truth: Column, options: int) -> DataFrame:
    """(by..., n, accuracy, invalid): an answer that is none of the options counts 1/options."""
    credit = F.when(said.isNull(), 1 / options).when(said == truth, 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(credit).alias("accuracy"), F.avg(said.isNull().cast("double")).alias("invalid"))


def answer_accuracy(rows: DataFrame, said: Column, truth: Column) -> DataFrame:
    """(n, accuracy, invalid) over all rows; no rows give 0."""
    right = F.coalesce((said == truth).cast("double"), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(said.isNull().cast("double")), F.lit(0.0)).alias("invalid"))


def best_labels(rows: DataFrame, example: str, label: str, score: str) -> DataFrame:
    """(example, predicted): the label with the greatest score, the smallest of several."""
    best = rows.groupBy(example).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))).alias("b"))
    return best.select(example, F.col("b.l").alias("predicted"))


def bucket_accuracy(rows: DataFrame, label: str, predicted: str, bucket: str) -> DataFrame:
    """(accuracy, class_accuracy, bucket_accuracy, bucket_deviation): of all rows, and means over classes and buckets."""
    right = (F.col(label) == F.col(predicted)).cast("double")
    overall = rows.agg(F.avg(right).alias("accuracy"))
    classes = rows.groupBy(label).agg(F.avg(right).alias("a")).agg(F.avg("a").alias("class_accuracy"))
    buckets = rows.groupBy(bucket).agg(F.avg(right).alias("a")).agg(F.avg("a").alias("bucket_accuracy"), F.stddev_pop("a").alias("bucket_deviation"))
    return overall.join(classes).join(buckets)  # one row each


def entropy(rows: DataFrame, label: str) -> DataFrame:
    """Of the label's distribution, in nats."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return counts.agg(F.coalesce(-F.sum(F.col("p") * F.ln("p")), F.lit(0.0)).alias("entropy"))


def ranking_auc(rows: DataFrame, truth: str, score: str, buckets: int = 1 << 16) -> DataFrame:
    """Area under the ROC curve from the counts of each distinct score, ties counting half.

    What is below a score is summed by buckets of scores first, so that only those sums meet in one place.
    """
    by_score = rows.groupBy(score).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    ends = by_score.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))  # one row
    share = F.coalesce(F.try_divide((F.col(score) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    placed = by_score.crossJoin(F.broadcast(ends)).withColumn("_b", F.floor(share * (buckets - 1)))
    earlier = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(F.col("_b").alias("_k")).agg(F.sum("n").alias("_s")).select("_k", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    below = Window.partitionBy("_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(sums, F.col("_b").eqNullSafe(F.col("_k")))
    won = joined.withColumn("w", F.col("p") * (F.col("_before") + F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2))
    return won.agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def discounted_gain(rows: DataFrame, example: str, relevance: str, score: str, tie: str) -> DataFrame:
    """(example, ndcg): gain of the order by score against that by relevance; 0 if nothing is relevant."""
    placed = lambda *order: F.row_number().over(Window.partitionBy(example).orderBy(*order))
    ranked = rows.withColumn("_r", placed(F.desc(score), tie)).withColumn("_i", placed(F.desc(relevance), tie))
    gain = lambda place: F.sum(F.col(relevance) / F.log2(F.col(place) + 1.0))
    return ranked.groupBy(example).agg(gain("_r").alias("g"), gain("_i").alias("best")).select(example, ratio(F.col("g"), F.col("best")).alias("ndcg"))


def matching_scores(pairs: DataFrame, example: str, image: str, caption: str, score: str) -> DataFrame:
    """(example, text, image, whole): whether each image's own caption, each caption's own image, and both beat all others of the example.

    A pair is right if image and caption have the same number; equal scores don't beat.
    """
    right = F.col(image) == F.col(caption)
    own = pairs.filter(right).select(F.col(example).alias("_e"), F.col(image).alias("_n"), F.col(score).alias("_s"))
    wrong = pairs.filter(~right)
    beaten = lambda side: wrong.join(own, (F.col(example) == F.col("_e")) & (F.col(side) == F.col("_n"))).groupBy(example).agg(F.bool_and(F.col("_s") > F.col(score)).alias(side + "_ok"))
    both = pairs.select(example).distinct().join(beaten(image), example, "left").join(beaten(caption), example, "left")
    text, picture = (F.coalesce(F.col(f"{side}_ok"), F.lit(True)) for side in (image, caption))
    return both.select(example, text.alias("text"), picture.alias("image"), (text & picture).alias("whole"))


def first_word_match(rows: DataFrame, said: Column, references: Column) -> DataFrame:
    """Share of rows whose first word is the first word of one of the references."""
    first = lambda c: F.split(c, " ")[0]
    return rows.agg(F.coalesce(F.avg(F.array_contains(F.transform(references, first), first(said)).cast("double")), F.lit(0.0)).alias("first_word_match"))


def mean_over_examples(rows: DataFrame, example: str, value: str) -> DataFrame:
    """Mean of a value of each example, whose rows repeat it."""
    return rows.groupBy(example).agg(F.min(value).alias("v")).agg(F.avg("v").alias("mean"))


def trimmed_histogram(rows: DataFrame, value: str, bins: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(bin, n) of the values between two quantiles, in equal bins from the least to the greatest of them; the last is closed."""
    known = placed(rows.select(F.col(value).alias("v")).filter("v is not null"), ["v"], "_i", total="_n")

    def quantile(share: float) -> Column:
        """Between the two values whose ranks are next to the quantile's."""
        rank = F.lit(share) * (F.col("_n") - 1)
        at = lambda r: F.max(F.when(F.col("_i") == r, F.col("v")))
        below, above, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        return below + (above - below) * part

    ends = known.agg(F.array(quantile(low), quantile(high)).alias("q"))  # one row, of partial aggregates
    kept = known.select("v").join(F.broadcast(ends)).filter(F.col("v").between(F.col("q")[0], F.col("q")[1]))
    span = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    binned = kept.join(F.broadcast(span)).select(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)).alias("bin"))
    return binned.select(F.coalesce("bin", F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
