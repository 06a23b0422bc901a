"""Sources: column projection with precedence, slices, shards and budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_tree(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All Parquet files under a folder; unreadable files are passed over and never deleted."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).parquet(folder)


def first_source(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first of several folders that holds readable Parquet."""
    for path in candidates:
        try:
            return parquet_tree(spark, path)
        except Exception as error:  # noqa: BLE001  Spark raises AnalysisException from several places
            if not re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", str(error)):
                raise
    raise FileNotFoundError(f"none of {candidates}")


def json_lines(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "DROPMALFORMED").json(path)


def text_blocks(spark: SparkSession, path: str, lines: int = 1000) -> DataFrame:
    """(file, block, text): plain text in blocks of up to ``lines`` lines a partition's share of a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"), "value")
    block = F.floor(F.col("i") / lines)
    grouped = rows.groupBy("file", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("v"))
    return grouped.select("file", "block", F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("text"))


def corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(file, text) of JSON lines, or of plain text a line each, in Unicode normal form C; lines that can't be read are passed over."""
    from ..operators.lexicon import nfc

    lines = json_lines(spark, path, f"{text} string") if re.search(r"\.jsonl?(\.gz)?$", path) else spark.read.text(path).withColumnRenamed("value", text)
    return lines.select(F.col("_metadata.file_path").alias("file"), nfc(F.col(text)).alias("text")).filter("text is not null")


def csv_puzzles(spark: SparkSession, path: str, least_rating: int = 0) -> DataFrame:
    schema = "source string, question string, answer string, rating int"
    return spark.read.schema(schema).option("header", True).csv(path).filter(F.col("rating") >= least_rating)


def json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON object a file, with the file's name as ``name``."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def with_solutions(challenges: DataFrame, solutions: DataFrame, keys: list[str], dummy: str = "[[0]]") -> DataFrame:
    return challenges.join(solutions, keys, "left").withColumn("solution", F.coalesce("solution", F.lit(dummy)))


def project_documents(rows: DataFrame, id_col: str, text: str = "text", metadata: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """(id, text, metadata struct<source,dataset,language>): a configured default wins, then the row's column, then its JSON metadata, then ''."""
    defaults = defaults or {}

    def field(name: str) -> Column:
        options = [F.lit(defaults[name])] if defaults.get(name) else []
        options += [F.nullif(F.col(name).cast("string"), F.lit(""))] if name in rows.columns else []
        options += [F.get_json_object(metadata, f"$.{name}")] if metadata else []
        return F.coalesce(*options, F.lit("")).alias(name)

    return rows.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*map(field, ("source", "dataset", "language"))).alias("metadata"))


def text_field(*columns: str) -> Column:
    """The first of several columns that isn't empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def split_slice(split: str) -> tuple[float, float]:
    """The shares of ``train[a%:b%]``: start and end."""
    m = re.fullmatch(r"[^\[\]]+(?:\[(?:(\d+(?:\.\d+)?)%)?:(?:(\d+(?:\.\d+)?)%)?\])?", split)
    if not m:
        raise ValueError(f"no split: {split}")
    return float(m[1] or 0) / 100, float(m[2] or 100) / 100


def shard(rows: DataFrame, key: str, shards: int, k: int) -> DataFrame:
    return rows.filter(F.pmod(F.col(key), F.lit(shards)) == k)


def windows_of_tokens(ids: Column, width: int) -> Column:
    """Whole windows of ``width`` tokens, none dropped in between."""
    n = F.floor(F.size(ids) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ids, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<int>>"))


def frame_indices(n_frames: Column, most: int) -> Column:
    """Up to ``most`` evenly spaced frame numbers."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n_frames - 1) / F.lit(max(1, most - 1))).cast("int"))
    return F.when(n_frames <= most, F.sequence(F.lit(0), n_frames - 1)).otherwise(F.array_distinct(spaced))


def by_position(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A written table with ``shard``, the number in its file's name, and ``row``, the place in that file.

    Tables that were written from the same partitions in the same order agree in both, as long as no task was cut
    into several files (``spark.sql.files.maxRecordsPerFile``).
    """
    shard = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"part-(\d+)", 1).cast("int")
    return rows.select("*", shard.alias("shard"), F.col("_metadata.row_index").alias("row"))
