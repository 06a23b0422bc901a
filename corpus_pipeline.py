"""A training-corpus pipeline: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the folder that the cluster shares and reads it again as the next
stage's documents.  All stages but the last return the columns of documents,
whatever other columns those have.  Each row is judged and kept or dropped by itself,
so null and repeated ids need no special care.  A null text counts as empty and
stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import byte_bpe, compress_tox, fair_mix, line_templates, simhash
from loomline.llm.queries import tokenizer
from loomline.llm.scratch import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts toxic go; the labels are learnt from the stage's own documents."""
    return compress_tox.drop_toxic(docs, compress_tox.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in one document only; n_chars follows the text."""
    done = line_templates.drop_recurring(docs, counts=False)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows linked by their fingerprints the one with the smallest id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a copy that the mix takes; documents without words have nothing to mix and stay once."""
    return fair_mix.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids: a row a document, in no order."""
    return byte_bpe.encode_documents(docs, *tokenizer(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the classifier, XXH64 fingerprints or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
