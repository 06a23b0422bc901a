"""Interleaved web documents: an ordered array of text and image nodes a document.

``nodes`` is array<struct<kind, text, src>> with kind 'text' or 'image'.  What works
within a document is a Column over that array; what needs other documents moves
URLs only, never nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T


def is_image(node: Column) -> Column:
    return node["kind"] == "image"


def image_urls(nodes: Column) -> Column:
    """URLs of the images that have one, in order."""
    return F.transform(F.filter(nodes, lambda n: is_image(n) & (F.coalesce(n["src"], F.lit("")) != "")), lambda n: n["src"])


def url_counts(docs: DataFrame, nodes: str = "nodes") -> DataFrame:
    return docs.select(F.explode(image_urls(F.col(nodes))).alias("src")).groupBy("src").agg(F.count("*").alias("n"))


def drop_images(docs: DataFrame, banned: DataFrame, doc: str = "doc", nodes: str = "nodes") -> DataFrame:
    """``docs`` without the image nodes whose URL is among ``banned`` (src)."""
    used = docs.select(F.col(doc).alias("_d"), F.explode(F.array_distinct(image_urls(F.col(nodes)))).alias("src"))
    hit = used.join(banned.select("src").distinct(), "src", "left_semi").groupBy("_d").agg(F.collect_set("src").alias("_bad"))
    joined = docs.join(hit, F.col(doc) == F.col("_d"), "left")
    kept = F.filter(nodes, lambda n: ~(is_image(n) & F.coalesce(F.array_contains("_bad", n["src"]), F.lit(False))))
    return joined.withColumn(nodes, kept).select(*docs.columns)


def drop_frequent_images(docs: DataFrame, over: int = 10, doc: str = "doc", nodes: str = "nodes") -> DataFrame:
    """Images that all documents together use more than ``over`` times go."""
    return drop_images(docs, url_counts(docs, nodes).filter(F.col("n") > over), doc, nodes)


def drop_documents_with(docs: DataFrame, banned: DataFrame, doc: str = "doc", nodes: str = "nodes") -> DataFrame:
    """Documents that hold any of the ``banned`` URLs (src) go."""
    used = docs.select(F.col(doc).alias("_d"), F.explode(image_urls(F.col(nodes))).alias("src"))
    return docs.join(used.join(banned.select("src").distinct(), "src", "left_semi").select("_d").distinct(), F.col(doc) == F.col("_d"), "left_anti")


def drop_test_images(docs: DataFrame, digests: DataFrame, whole_document: bool, doc: str = "doc", nodes: str = "nodes", digest=F.md5, images: DataFrame | None = None) -> DataFrame:
    """Images whose digest is among the test set's ``digests`` (digest) go, or the documents that hold one.

    The digest is that of the bytes in ``images`` (src, content), so that a test image is found at any URL; without
    ``images`` it's that of the URL.
    """
    urls = docs.select(F.explode(image_urls(F.col(nodes))).alias("src")).distinct() if images is None else images.select("src", "content")
    digested = urls.select("src", digest("src" if images is None else "content").alias("digest"))
    found = digested.join(digests.select("digest").distinct(), "digest", "left_semi").select("src")
    return (drop_documents_with if whole_document else drop_images)(docs, found, doc, nodes)


def with_images(docs: DataFrame, images: DataFrame, doc: str = "doc", nodes: str = "nodes") -> DataFrame:
    """(doc, found, missing, content): how many images ``images`` (src, content) has, and their content in order."""
    used = docs.select(F.col(doc), F.posexplode_outer(image_urls(F.col(nodes))).alias("pos", "src"))
    joined = used.join(images.select("src", "content", F.lit(1).alias("_has")), "src", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "content")))), lambda x: x["content"])
    return joined.groupBy(doc).agg(F.count("_has").alias("found"), (F.count("src") - F.count("_has")).alias("missing"), listed.alias("content"))


def _runs(nodes: Column, starts: Column) -> Column:
    """The array cut at the ascending positions ``starts``, of which the first is 0."""
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(nodes)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(nodes, a + 1, b - a))


def _positions(nodes: Column) -> Column:
    return F.when(F.size(nodes) > 0, F.sequence(F.lit(0), F.greatest(F.size(nodes) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def merge_texts(nodes: Column, separator: str = "\n\n") -> Column:
    """Neighbouring text nodes become one."""
    starts = F.filter(_positions(nodes), lambda i: (i == 0) | is_image(F.get(nodes, i)) | is_image(F.get(nodes, i - 1)))
    merged = F.transform(_runs(nodes, starts), lambda run: F.when(is_image(run[0]), run[0]).otherwise(F.struct(run[0]["kind"].alias("kind"), F.array_join(F.transform(run, lambda n: n["text"]), separator).alias("text"), run[0]["src"].alias("src"))))
    return F.when(F.size(nodes) > 0, merged).otherwise(nodes)


def first_images(nodes: Column) -> Column:
    """An image that the document had before goes."""
    sources = F.transform(nodes, lambda n: F.when(is_image(n), n["src"]).otherwise(F.lit(None)))
    return F.filter(nodes, lambda n, i: ~is_image(n) | n["src"].isNull() | (F.array_position(sources, n["src"]) == i + 1))


def surplus_images(nodes: Column, most: int) -> Column:
    """Images after the first ``most`` go."""
    at = F.filter(_positions(nodes), lambda i: is_image(F.get(nodes, i)))
    last = F.when(F.size(at) > most, F.get(at, F.lit(most))).otherwise(F.size(nodes))
    return F.filter(nodes, lambda n, i: ~is_image(n) | (i < last))


def split_at(nodes: Column, marker: Column) -> Column:
    """Arrays of nodes between those whose text equals ``marker``, which belong to none; parts without an image go."""
    starts = F.filter(_positions(nodes), lambda i: (i == 0) | (F.get(nodes, i)["text"] == marker))
    parts = F.transform(_runs(nodes, starts), lambda run: F.filter(run, lambda n: ~F.coalesce(n["text"] == marker, F.lit(False))))
    return F.when(F.size(nodes) > 0, F.filter(parts, lambda run: F.exists(run, is_image)))


def has_both(nodes: Column) -> Column:
    return F.exists(nodes, is_image) & F.exists(nodes, lambda n: ~is_image(n))


def image_runs_ok(nodes: Column, most: int = 2) -> Column:
    """Doesn't end in two images and has no more than ``most`` in a row."""
    kinds = F.array_join(F.transform(nodes, lambda n: F.when(is_image(n), "i").otherwise("t")), "")
    return ~kinds.endswith("ii") & ~kinds.contains("i" * (most + 1))


def latest_per_image_set(docs: DataFrame, version: str, doc: str = "doc", nodes: str = "nodes") -> DataFrame:
    """Of documents with the same set of image URLs the one with the greatest version (then id); those without images stay."""
    signature = F.sha2(F.array_join(F.array_sort(F.array_distinct(image_urls(F.col(nodes)))), "\u0001"), 256)
    keyed = docs.filter(F.size(image_urls(F.col(nodes))) > 0).select(F.col(doc).alias("_d"), signature.alias("_s"), F.col(version).alias("_v"))
    last = keyed.groupBy("_s").agg(F.max(F.struct("_v", "_d")).alias("_m")).select("_s", F.col("_m._d").alias("_keep"))
    gone = keyed.join(last, "_s").filter("_d <> _keep").select("_d")
    return docs.join(gone, F.col(doc) == F.col("_d"), "left_anti")


def merged_by_image(rows: DataFrame, image: str, text: str, order: str) -> DataFrame:
    """(image, first, texts): rows of an image become one, texts in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(image).agg(F.min(order).alias("first"), F.array_join(listed, "\n").alias("texts"))


def size_ok(width: Column, height: Column, least: int = 150, most: int = 10_000, aspect: float = 3.0) -> Column:
    """Both sides within bounds and the aspect ratio between 1/aspect and aspect; missing sizes fail."""
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    return F.coalesce(width.between(least, most) & height.between(least, most) & ratio.between(1 / aspect, aspect), F.lit(False))


def rendered_pixels(rendered: Column, original: Column) -> Column:
    """A rendered size in pixels; a percentage is of the original."""
    number = F.regexp_extract(rendered, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.trim(rendered).endswith("%"), F.round(number * original / 100)).otherwise(F.round(number)).cast("long")


def format_ok(kind: Column, valid: list[str]) -> Column:
    """Of a valid format, or of none known."""
    return kind.isNull() | F.lower(kind).isin(valid)


def scores_ok(scores: dict[str, Column], cutoffs: dict[str, float]) -> Column:
    """No score above its cutoff; missing scores pass."""
    ok = F.lit(True)
    for name, cutoff in cutoffs.items():
        ok = ok & F.coalesce(scores[name] <= cutoff, F.lit(True))
    return ok


def average_hash(pixels: Column) -> Column:
    """Bits of an image's gray values that reach their mean, as text."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda acc, x: acc + x) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda x: F.when(x >= mean, "1").otherwise("0")), "")


def perceptual_bits(pixels: np.ndarray) -> int:
    """64-bit perceptual hash of a square gray image: its 8 x 8 lowest cosine coefficients against their median (the first left out)."""
    n = len(pixels)
    k, i = np.arange(8)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    low = basis @ pixels.astype(float) @ basis.T
    bits = (low >= np.median(low.ravel()[1:])).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


@F.arrow_udf(LongType())
def perceptual_hash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of arrays of gray values, row by row, of square images; null for others."""
    for images in batches:
        out = []
        for image in images:
            x = np.array(image.as_py() or [])
            side = int(round(len(x) ** 0.5))
            value = perceptual_bits(x.reshape(side, side)) if side >= 8 and side * side == len(x) else None
            out.append(value if value is None or value < 1 << 63 else value - (1 << 64))
        yield pa.array(out, pa.int64())


@dataclass(frozen=True)
class PairCutoffs:
    """Of an image and its texts; the defaults are those of web pairs, LISTED those of pairs from an index of images."""

    formats: tuple[str, ...] | None = ("jpg", "jpeg", "png", "webp")
    least_side: int = 100
    most_side: int = 10_000
    most_rendered: int = 100_000
    aspect: float = 3.0
    min_words: int = 3
    max_words: int = 256
    max_special: float = 0.4
    max_repetition: float = 0.3  #: share of a text's words that were there before
    min_stop_words: float = 0.0
    min_similarity: float = 0.2
    max_repeated: float = 1.0  #: share of words that are there more than once
    min_common: float = 0.0


LISTED = PairCutoffs(formats=None, least_side=150, min_words=1, max_repetition=1.0, max_repeated=0.7, min_common=0.7, min_similarity=-1.0)


def pair_image_ok(image: Column, cut: PairCutoffs = PairCutoffs()) -> Column:
    """Of a struct (format, width, height, rendered_width, rendered_height): an unknown format and unknown rendered sizes pass, unknown sizes don't."""
    ok = size_ok(image["width"], image["height"], cut.least_side, cut.most_side, cut.aspect)
    for c in ("rendered_width", "rendered_height"):
        ok = ok & F.coalesce(image[c].between(cut.least_side, cut.most_rendered), F.lit(True))
    return ok & format_ok(image["format"], list(cut.formats)) if cut.formats else ok


def _words_ok(words: Column, cut: PairCutoffs, common: Column | None) -> Column:
    n = F.size(words)
    ok = n.between(cut.min_words, cut.max_words) & (T.single_word_repetition(words) <= cut.max_repetition)
    if cut.min_stop_words > 0:
        ok = ok & (T.member_ratio(words, T.STOP_WORDS) >= cut.min_stop_words)
    if cut.max_repeated < 1:
        once = F.filter(F.array_distinct(words), lambda d: F.size(words) - F.size(F.array_remove(words, d)) == 1)
        ok = ok & (F.when(n.between(cut.min_words, cut.max_words), T.ratio(n - F.size(once), n)).otherwise(0.0) <= cut.max_repeated)
    if common is not None:
        ok = ok & (T.ratio(F.size(F.filter(words, lambda w: F.array_contains(common, w))), n) >= cut.min_common)
    return ok


def pair_text_ok(text: Column, similarity: Column, cut: PairCutoffs = PairCutoffs(), common: Column | None = None) -> Column:
    """A text's number of words, special characters, repetition and, if known, its likeness to the image; of ``common`` words (an array) enough, if given."""
    words_ok = F.transform(F.array(T.words(text)), lambda w: _words_ok(w, cut, common))[0]
    return (T.special_character_ratio(text) <= cut.max_special) & words_ok & F.coalesce(similarity >= cut.min_similarity, F.lit(True))


def filtered_pairs(pairs: DataFrame, cut: PairCutoffs = PairCutoffs(), common: Column | None = None, image: str = "image", texts: str = "texts", similarities: str = "similarities", in_tree: str = "in_tree") -> DataFrame:
    """The pairs whose image passes and that keep a text; ``texts`` (a map by kind) with those that pass alone, white space made plain.

    ``in_tree`` says whether the image is in the simplified page; ``similarities`` is a map by kind, where null and
    missing kinds pass.  The checks of a text are independent, so their order doesn't matter.
    """
    plain = F.transform_values(texts, lambda kind, t: T.standardise_whitespace(t))
    kept = F.map_filter(plain, lambda kind, t: t.isNotNull() & pair_text_ok(t, F.try_element_at(F.col(similarities), kind), cut, common))
    rows = pairs.filter(F.coalesce(F.col(in_tree), F.lit(False)) & pair_image_ok(F.col(image), cut))
    return rows.withColumn(texts, kept).filter(F.size(texts) > 0)
