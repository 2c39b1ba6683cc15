"""License scan by diagonal voting.

Every run of ``K`` words of every text is hashed with a rolling hash and joined to the places of equal
runs in the templates. A template that stands in a text puts all its votes on one diagonal (place in the
text less place in the template); inserted or missing words move the rest to a diagonal close by. Votes
are counted by diagonal, neighbouring diagonals are merged to spans, and a span counts as found if its
votes cover enough of the template without being thinly spread in the text. Where many words stand inserted,
a notice leaves several spans, each with a part of it; those that follow each other in the order of the
template within a share of its length are chained and judged together. A short phrase must be
covered wholly on a single diagonal, so it is found exactly where its words stand consecutively.

Templates are a parameter of fixed size, so their side of the join is broadcast; the votes, not the
texts, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lurescope.llm import arrow_text
from lurescope.llm.license_texts import NOTICES, PHRASES
from lurescope.llm.shingles import run_hashes

#: Words in a run; no phrase is shorter.
K = 3
#: Diagonals at most this far apart belong to one span.
NEAR = 4
#: Least share of a notice's words that a span covers, and of the span's words that votes cover.
COVER = 0.7
DENSE = 0.5
#: Spans with at least the share PART of a notice are chained over gaps of at most the share GAP of its words.
PART = 0.1
GAP = 0.5


def _hash_rows(texts: list[str]) -> list[np.ndarray]:
    words = arrow_text.alnum_words(pa.array(texts, pa.string()))
    hashes, offsets = run_hashes(words, K, whole_if_short=False)
    return [hashes[a:b].astype(np.int64) for a, b in zip(offsets[:-1], offsets[1:])]


def template_places(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(gram, template, label, exact, size, at): every run of every template; size is in runs."""
    every = [(text, label, True) for text, label in phrases] + [(text, label, False) for label, text in notices]
    rows = []
    for i, (grams, (_, label, exact)) in enumerate(zip(_hash_rows([t for t, _, _ in every]), every)):
        if not len(grams):
            raise ValueError(f"a template needs {K} words at least: {every[i][0]!r}")
        rows += [(int(g), i, label, exact, len(grams), at) for at, g in enumerate(grams.tolist())]
    return spark.createDataFrame(rows, "gram long, template int, label string, exact boolean, size int, at int")


def _grams(docs: DataFrame) -> DataFrame:
    """(doc_id, version, grams) of texts with at least one run of words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_text.blocks(batches):
            words = arrow_text.alnum_words(arrow_text.plain(block.column("text")))
            hashes, offsets = run_hashes(words, K, whole_if_short=False)
            for lo, hi in arrow_text.slices(offsets, 1 << 20):
                own = pa.array(hashes[offsets[lo] : offsets[hi]].astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array((offsets[lo : hi + 1] - offsets[lo]).astype(np.int32)), own)
                keys = [block.column(c).slice(lo, hi - lo) for c in ("doc_id", "version")]
                yield pa.RecordBatch.from_arrays([*keys, lists], names=["doc_id", "version", "grams"])

    return docs.mapInArrow(rows, "doc_id long, version long, grams array<long>")


def _word_counts(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_text.blocks(batches):
            words = arrow_text.alnum_words(arrow_text.plain(block.column("text")))
            columns = [block.column("doc_id"), block.column("version"), pa.array(words.lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "n_words"])

    return docs.mapInArrow(rows, "doc_id long, version long, n_words long")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal id and text are the same document; equal ids with other texts are not."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def diagonals(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, version, template, label, exact, size, diagonal, covered): votes by diagonal.

    ``covered`` holds the template places voted for, at most as many as the template has.
    """
    grams = _grams(_keyed(docs)).select("doc_id", "version", F.posexplode("grams").alias("place", "gram"))
    # Bounded: one row per run of the fixed templates.
    votes = grams.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("place") - F.col("at"))
    keys = ["doc_id", "version", "template", "label", "exact", "size", "diagonal"]
    return votes.groupBy(*keys).agg(F.array_sort(F.collect_set("at")).alias("covered"))


def spans(votes: DataFrame, near: int = NEAR, cover: float = COVER, dense: float = DENSE) -> DataFrame:
    """Verified spans (doc_id, version, label, exact, start, end, cover) in words, end exclusive.

    Phrases are judged by the diagonal alone; for notices neighbouring diagonals are merged first, and what then
    has only a part of a notice is chained.
    """
    by = ["doc_id", "version", "template"]
    order = Window.partitionBy(*by, "exact").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    opens = (F.col("exact") | gap.isNull() | (gap > near)).cast("int")
    merged = (
        votes.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(order))
        .groupBy(*by, "label", "exact", "size", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"),
            F.min(F.col("diagonal") + F.element_at("covered", 1)).alias("start"),
            (F.max(F.col("diagonal") + F.element_at("covered", -1)) + K).alias("end"),
        )
    )
    share = F.size("covered") / F.col("size")
    length = F.col("end") - F.col("start")
    found = F.when(F.col("exact"), share == 1).otherwise(
        (share >= cover) & (F.size("covered") + K - 1 >= dense * length)
    )
    judged = merged.withColumn("found", found)
    parts = judged.where(~F.col("found") & ~F.col("exact") & (share >= PART))
    # Rows of this frame are spans, few for each document and template.
    following = Window.partitionBy(*by).orderBy("start", "end", "span")
    last = F.lag(F.struct("end", F.array_max("covered").alias("at"))).over(following)
    follows = (F.col("start") - last["end"] <= GAP * F.col("size")) & (F.array_max("covered") > last["at"])
    chained = (
        parts.withColumn("opens", (~F.coalesce(follows, F.lit(False))).cast("int"))
        .withColumn("chain", F.sum("opens").over(following))
        .groupBy(*by, "label", "exact", "size", "chain")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
        .where(found)
    )
    columns = ["doc_id", "version", "label", "exact", "start", "end", share.alias("cover")]
    return judged.where("found").select(*columns).unionByName(chained.select(*columns))


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its spans, words and base figures.

    Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans. Nulls are
    empty texts; a text without a span has no labels, score 0 and null places; repeated rows stay;
    an empty table gives no rows; other columns are ignored.
    """
    templates = template_places(docs.sparkSession) if templates is None else templates
    found = spans(diagonals(docs, templates))
    base = F.when(F.col("exact"), F.col("start"))
    per_document = found.groupBy("doc_id", "version").agg(
        F.count(base).cast("long").alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_set(F.struct("start", "end", "label", "exact", "cover"))).alias("spans"),
    )
    words = _word_counts(_keyed(docs))
    same = words["doc_id"].eqNullSafe(per_document["doc_id"]) & (words["version"] == per_document["version"])
    joined = words.join(per_document, same, "left").drop(per_document["doc_id"], per_document["version"])
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
