"""Votes, rankings and evaluation aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def votes(rows: DataFrame, by: list[str], prediction: str, score: str) -> DataFrame:
    """(by..., prediction, votes, mean_score, rank): by votes, then mean score, then prediction."""
    counted = rows.groupBy(*by, prediction).agg(F.count("*").alias("votes"), F.avg(score).alias("mean_score"))
    order = Window.partitionBy(*by).orderBy(F.desc("votes"), F.desc("mean_score"), prediction)
    return counted.withColumn("rank", F.row_number().over(order))


def attempts(ranked: DataFrame, by: list[str], prediction: str, k: int) -> DataFrame:
    """The k best predictions of each, padded by repeating the best."""
    best = ranked.filter(F.col("rank") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", prediction))).alias("a"))
    listed = F.transform("a", lambda x: x[prediction])
    return best.select(*by, F.slice(F.concat(listed, F.array_repeat(listed[0], k)), 1, k).alias("attempts"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_scores(counts: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1) from a confusion table; ratios over nothing are 0."""
    labels = counts.select(F.col(truth).alias("label")).union(counts.select(F.col(predicted))).distinct()
    hit = counts.filter(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("label"), F.col("n").alias("hit"))
    real = counts.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("real"))
    said = counts.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    joined = labels.join(hit, "label", "left").join(real, "label", "left").join(said, "label", "left").fillna(0)
    p, r = (F.coalesce(F.try_divide(F.col("hit"), F.col(c)), F.lit(0.0)) for c in ("said", "real"))
    return joined.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def macro_accuracy(rows: DataFrame, subject: str, correct: Column) -> DataFrame:
    """Unweighted mean of the subjects' accuracies."""
    return rows.groupBy(subject).agg(F.avg(correct.cast("double")).alias("accuracy")).agg(F.avg("accuracy").alias("macro_accuracy"))


def histogram(rows: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n, density) with the last bin closed."""
    at = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counted = rows.filter(F.col(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy()) * bins / (high - low))


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """Sum over bins of p * ln(p / q); bins that either lacks count 0."""
    joined = p.select("bin", F.col("density").alias("p")).join(q.select("bin", F.col("density").alias("q")), "bin")
    return joined.agg(F.coalesce(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))), F.lit(0.0)).alias("kl"))


def survival(rows: DataFrame, language: str, dataset: str, old: Column, new: Column) -> DataFrame:
    """Rates by language, by dataset and overall, in one pass."""
    marked = rows.select(F.col(language).alias("language"), F.col(dataset).alias("dataset"), old.cast("double").alias("o"), new.cast("double").alias("n"))
    return marked.groupingSets([("language",), ("dataset",), ()], "language", "dataset").agg(F.count("*").alias("total"), F.avg("o").alias("old_rate"), F.avg("n").alias("new_rate")).select("language", "dataset", "total", "old_rate", "new_rate")


#: Queries that go to every task at once; more are dealt into blocks of so many.
QUERY_BLOCK = 4096
#: Vectors in a task, about, if there are several blocks of queries; and those that the queries meet at a time.
VECTOR_BLOCK, STEP = 65_536, 512


def _matrix(table: pa.Table | pa.RecordBatch, vector: str) -> np.ndarray:
    column = table.column(vector)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return values.reshape(len(column), len(values) // max(1, len(column)))


class _Best:
    """The k best neighbours of each query so far, whatever the number of vectors that it has met."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, k: int):
        self.ids, self.block, self.k = ids, block, k
        self.score, self.other = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def meet(self, vectors: pa.Table | pa.RecordBatch, id_col: str, vector: str) -> None:
        for a in range(0, len(vectors) if len(self.ids) else 0, STEP):
            part = vectors.slice(a, STEP)
            other = part[id_col].to_numpy()
            score = self.block @ _matrix(part, vector).T
            score[(self.ids[:, None] == other[None, :]) | ~np.isfinite(score)] = -np.inf
            least = self.score[:, -1]  # what is below a query's k-th best can't be among them
            if len(other) >= self.k:
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
            q, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            if not len(q):
                continue
            rows, have = np.unique(q), np.isfinite(self.score)
            have[np.setdiff1d(np.arange(len(self.ids)), rows)] = False
            q, other, score = np.concatenate([q, np.nonzero(have)[0]]), np.concatenate([other[at], self.other[have]]), np.concatenate([score[q, at], self.score[have]])
            order = np.lexsort((other, -score, q))
            q, other, score = q[order], other[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            kept = rank < self.k
            self.score[rows] = -np.inf
            self.score[q[kept], rank[kept]], self.other[q[kept], rank[kept]] = score[kept], other[kept]

    def found(self) -> pa.RecordBatch:
        q, at = np.nonzero(np.isfinite(self.score))
        return pa.record_batch([pa.array(self.ids[q]), pa.array(self.other[q, at]), pa.array(self.score[q, at])], names=["query", "neighbour", "score"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, neighbour, score, rank) by inner product, for a stated query set against all vectors in blocks.

    Up to ``QUERY_BLOCK`` queries go to every task, and vectors don't move.  More are
    dealt into blocks, the vectors into blocks of about ``VECTOR_BLOCK``, and each pair
    of blocks is a task; neither set is gathered in one place.  A task's queries meet
    ``STEP`` vectors at a time and keep the k best of all before the shuffle.
    """
    schema = "query long, neighbour long, score double"
    vectors, n = vectors.select(id_col, vector), queries.count()
    if n <= QUERY_BLOCK:
        rows = queries.select(id_col, vector).toArrow()
        ids, block = rows[id_col].to_numpy(), _matrix(rows, vector)

        def best(batches):
            kept = _Best(ids, block, k)
            for batch in batches:
                kept.meet(batch, id_col, vector)
            yield kept.found()

        found = vectors.mapInArrow(best, schema)
    else:
        blocks, chunks = -(-n // QUERY_BLOCK), -(-vectors.count() // VECTOR_BLOCK)
        part = lambda count: F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = queries.select(id_col, vector, part(blocks).alias("_q"), every(chunks).alias("_v"))
        right = vectors.select(id_col, vector, part(chunks).alias("_v"), every(blocks).alias("_q"))

        def pair(key, q: pa.Table, v: pa.Table) -> pa.Table:
            kept = _Best(q[id_col].to_numpy(), _matrix(q, vector), k)
            kept.meet(v, id_col, vector)
            return pa.Table.from_batches([kept.found()])

        found = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(pair, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
