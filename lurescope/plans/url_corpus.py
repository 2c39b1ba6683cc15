"""URL corpus: reconcile sources, features, leakage-free split and scaling, readiness report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.url_enriched import feature_names, with_enriched_features
from ..operators.dedup import group_urls, url_corpus
from ..operators.scaling import apply_scaler, fit_scaler
from ..operators.split import stratified_split
from ..session import materialise
from ..sources.tables import write_parquet

CONVENTION = "0 = phishing, 1 = legitimate"


@dataclass
class UrlCorpus:
    """Prepared corpus: every frame keeps the URL as row identity."""

    corpus: DataFrame
    features: list[str]
    split: DataFrame
    scaler: DataFrame
    scaled: DataFrame

    def legit_only(self) -> DataFrame:
        """Scaled legitimate training rows for novelty detection."""
        return legit_only(self.scaled.where(F.col("split") == "train")).drop("split")

    def write(self, path: str) -> None:
        write_parquet(self.corpus, f"{path}/corpus")
        write_parquet(self.scaled, f"{path}/splits", ["split"])
        write_parquet(self.legit_only(), f"{path}/legit_only")
        write_parquet(self.scaler, f"{path}/scaler")


def legit_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label") == 1).drop("label")


def prepare(
    union: DataFrame, sources: Sequence[str], exclude: Sequence[str] = (), seed: int = 42
) -> UrlCorpus:
    """From a source union to scaled splits.

    The feature table is the only wide intermediate. It is written once to the shared folder and
    then read by the scaler fit and by every later stage, instead of redoing the expressions.
    """
    names = feature_names(exclude)
    corpus = materialise(url_corpus(union, sources), "corpus")
    tagged = stratified_split(corpus, "url", "label", seed)
    split = materialise(with_enriched_features(tagged, "url", exclude), "features")
    scaler = fit_scaler(split.where(F.col("split") == "train"), names)
    return UrlCorpus(corpus, names, split, scaler, apply_scaler(split, scaler, names))


def feature_schema(features: Sequence[str], df: DataFrame) -> DataFrame:
    """Schema record of a feature table: position, name, count, convention and filled rows."""
    filled = df.agg(*(F.count(f).alias(f) for f in features)).unpivot([], list(features), "feature", "n_values")
    position = F.array_position(F.lit(list(features)), F.col("feature")) - 1
    return filled.select(
        position.cast("int").alias("position"), "feature", F.lit(len(features)).alias("n_features"),
        F.lit(CONVENTION).alias("convention"), "n_values",
    )


def readiness_url(union: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Readiness report as (section, name, value) rows.

    Source counts come from the union, everything else from one grouping by URL. Split sizes are
    arithmetic on the class counts, because the split is exact per class.
    """
    names = F.array(*map(F.lit, sources))
    source = F.get(names, F.col("priority"))
    label = lambda v: F.count_if(F.col("label") == v)
    per_source = union.groupBy("priority").agg(
        F.count(F.lit(1)).alias("rows"), label(0).alias("phishing_0"), label(1).alias("legit_1")
    )
    per_source = per_source.withColumn("source", source).unpivot(
        "source", ["rows", "phishing_0", "legit_1"], "measure", "value"
    ).select(F.concat(F.lit("source_"), "measure").alias("section"), F.col("source").alias("name"), "value")

    grouped = group_urls(union)
    clean = F.col("label") == F.col("label_max")
    cells = grouped.groupBy("priority", F.when(clean, F.col("label")).alias("label")).agg(
        F.count(F.lit(1)).alias("urls"), F.sum("n_rows").alias("rows")
    )
    kept = F.col("label").isNotNull()
    urls = lambda c: F.coalesce(F.sum(F.when(c, F.col("urls"))), F.lit(0))
    totals = cells.agg(
        F.sum("rows").alias("rows_before_dedup"),
        urls(~kept).alias("conflicting_urls_dropped"),
        urls(kept).alias("rows_after_dedup"),
        urls(F.col("label") == 0).alias("_c0"),
        urls(F.col("label") == 1).alias("_c1"),
        *(urls(kept & (F.col("priority") == i)).alias(f"_p{i}") for i in range(len(sources))),
    )
    train = {k: F.expr(f"({k} * 8) div 10") for k in ("_c0", "_c1")}
    rest = {k: F.col(k) - train[k] for k in train}
    val = {k: F.floor(rest[k] / 2).cast("bigint") for k in train}
    row = lambda section, name, value: F.struct(
        F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("bigint").alias("value")
    )
    rows = [
        *(row("dedup", c, F.col(c)) for c in ("rows_before_dedup", "conflicting_urls_dropped", "rows_after_dedup")),
        row("splits", "train", train["_c0"] + train["_c1"]),
        row("splits", "val", val["_c0"] + val["_c1"]),
        row("splits", "test", rest["_c0"] - val["_c0"] + rest["_c1"] - val["_c1"]),
        row("train_labels", "phishing_0", train["_c0"]),
        row("train_labels", "legit_1", train["_c1"]),
        *(row("source_mix", s, F.col(f"_p{i}")) for i, s in enumerate(sources)),
    ]
    derived = totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return per_source.unionByName(derived)
