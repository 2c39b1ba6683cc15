"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from lurescope.functions import recognise
from lurescope.functions.text import MAX_CHARS, MIN_CHARS, REDACTIONS, clean_text, redact_columns, redact_text, token_count, with_redaction, within_length
from lurescope.functions.url_basic import FEATURES as BASIC, with_basic_features
from lurescope.functions.url_enriched import FEATURES, feature_names, with_enriched_features
from lurescope.functions.urls import extract_urls
from lurescope.models import autoencoder, classifiers, context, iforest, ngram, reconstruction
from lurescope.operators import aggregates, dedup, joint, metrics, ranking, scaling, sequences, split
from lurescope.plans import joint_corpus, message_eval, text_corpus, url_corpus
from lurescope.session import materialise, scratch_path
from lurescope.sources import labels, tables, url_state

from . import inputs
from .inputs import emails, labelled_messages, scores, table

SOURCES = ("a", "b", "c")
SEQUENCE_LENGTH = 40


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; other columns pass through."""
    # Adding zero turns -0.0 into 0.0.
    return df.select(
        *(
            (F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        )
    )


# --- sources and sinks -------------------------------------------------------------------------

def _through_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    path = scratch_path(df.sparkSession, "csv")
    tables.write_csv(df, path)
    return tables.read_csv(df.sparkSession, path, columns)


def src_url_int_label(spark, sf):
    return labels.urls_int_label(_through_csv(inputs.url_source_a(spark, sf), ["URL", "label"]))


def src_url_str_label(spark, sf):
    return labels.urls_text_label(_through_csv(inputs.url_source_b(spark, sf), ["url", "type"]))


def src_url_null_label(spark, sf):
    return labels.urls_nullable_label(_through_csv(inputs.url_source_c(spark, sf), ["URL", "ClassLabel"]))


def union(spark: SparkSession, sf: str) -> DataFrame:
    return labels.union_sources(
        [
            labels.urls_int_label(inputs.url_source_a(spark, sf)),
            labels.urls_text_label(inputs.url_source_b(spark, sf)),
            labels.urls_nullable_label(inputs.url_source_c(spark, sf)),
        ]
    )


def email_label_flip(spark, sf):
    return emails(spark, sf).select("email_id", labels.flip_label(F.col("label")).alias("label"))


def email_label_map(spark, sf):
    raw = F.when(F.col("label") == 0, " Safe Email").when(F.col("label") == 1, "Phishing Email ").otherwise("n/a")
    code = labels.mapped_label(raw, {"Safe Email": 1, "Phishing Email": 0})
    return emails(spark, sf).select("email_id", code.alias("label"))


def sink_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "splits")
    corpus = dedup.url_corpus(union(spark, sf), SOURCES)
    tables.write_parquet(split.stratified_split(corpus, "url", "label"), path, ["split"])
    return tables.read_parquet(spark, path, ["url", "label", "source", "split"])


def sink_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "text")
    tables.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    back = tables.read_csv(spark, path, ["doc_id", "text"], multi_line=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


# --- corpora -----------------------------------------------------------------------------------

def url_union(spark, sf):
    return union(spark, sf).select("url", "label", "source")


def conflicting_urls(spark, sf):
    return dedup.conflicting_urls(union(spark, sf))


def corpus(spark, sf):
    return dedup.url_corpus(union(spark, sf), SOURCES)


def url_corpus_arriving(spark, sf):
    """The same corpus from sources that arrive one after the other, the last one first."""
    rows, path = union(spark, sf), scratch_path(spark, "url-state")
    for batch, source in enumerate(SOURCES[::-1]):
        url_state.merge_batch(path, rows.where(F.col("source") == source), batch, buckets=16)
    return url_state.corpus(spark, path, SOURCES)


def split_corpus(spark, sf):
    return split.stratified_split(corpus(spark, sf), "url", "label")


def text_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return dedup.keep_first(docs, ["text"], "doc_id", ["n_chars"])


def clean_corpus(spark, sf):
    return text_corpus.clean_corpus(labelled_messages(spark, sf))


def email_csv_source(spark, sf):
    """Labelled message CSV, end to end: written, read, normalised, cleaned."""
    path = scratch_path(spark, "messages")
    raw = labelled_messages(spark, sf).select(
        F.col("row_id").alias("id"), F.col("text").alias("Email Text"), F.col("label_raw").alias("Email Type")
    )
    tables.write_csv(raw, path)
    back = tables.read_csv(spark, path, ["id", "Email Text", "Email Type"], multi_line=True)
    return text_corpus.clean_corpus(labels.messages(back, row_id="id"))


def cross_source_dedup(spark, sf):
    conv = table(spark, sf, "conversations")
    return text_corpus.cross_source_dedup(
        {
            "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text"),
            "conversations": conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text"),
            "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text"),
        }
    )


def label_collapse(spark, sf):
    code = labels.collapse_label(F.col("event_type"), ["error", "purchase"], ["click", "view"])
    return table(spark, sf, "events").select("event_id", code.alias("label"))


def length_filter(spark, sf):
    rows = table(spark, sf, "documents").where(within_length(F.col("text"), MIN_CHARS, MAX_CHARS))
    return rows.select("doc_id", F.length("text").alias("chars"))


def stratified_split(spark, sf):
    return split.stratified_split(emails(spark, sf).select("email_id", "label"), "email_id", "label")


def seeded_sample(spark, sf):
    return split.seeded_sample(scores(spark, sf).select("key", "score"), "key", 5000)


def sample_per_class(spark, sf):
    return split.sample_per_class(scores(spark, sf).select("key", "y"), "key", "y", 4)


def source_exclusion(spark, sf):
    docs = text_dedup_with_source(spark, sf)
    return text_corpus.source_exclusion(docs, "src3")


def text_dedup_with_source(spark, sf):
    # Texts are only compared, so their digests travel instead.
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), "source")
    return dedup.keep_first(docs, ["digest"], "doc_id", ["source"])


# --- text --------------------------------------------------------------------------------------

def clean_text_query(spark, sf):
    return emails(spark, sf).select("email_id", clean_text(F.col("body")).alias("text"))


def redact_text_query(spark, sf):
    return emails(spark, sf).select("email_id", redact_text(clean_text(F.col("body"))).alias("text"))


def redaction_counts(spark, sf):
    rows = with_redaction(clean_text_query(spark, sf), "text")
    return rows.agg(*(F.sum(c).alias(c) for c in text_corpus.COUNTS))


_PATTERNS = [(re.compile(p), t) for t, p in REDACTIONS]


def python_redactor(text: pd.Series) -> pd.Series:
    """A user-supplied redactor: the same five patterns through the Python engine."""
    for pattern, token in _PATTERNS:
        text = text.str.replace(pattern, token, regex=True)
    return text


def redact_table(spark, sf):
    rows = emails(spark, sf).select("email_id", F.col("body").alias("text"), "label")
    return redact_columns(rows, ["text"])


def redact_table_plugin(spark, sf):
    rows = emails(spark, sf).select("email_id", F.col("body").alias("text"), "label")
    return redact_columns(rows, ["text"], python_redactor)


def _named_texts(spark, sf):
    """Documents that end with a customer's name and, in lower case, a nation's; and the table of both."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # The tables of customers and nations are numbered from 0.
    who = F.pmod(F.col("doc_id"), F.lit(customers.count())).alias("c_custkey")
    docs = table(spark, sf, "documents").select("doc_id", "text", who)
    joined = docs.join(customers, "c_custkey").join(nations, "c_nationkey")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" for "), "c_name", F.lit(" of "), F.lower("n_name"), F.lit("."))
    names = customers.select(F.col("c_name").alias("name"), F.lit("person").alias("kind"), F.lit(0.9).alias("score")).unionByName(
        nations.select(F.col("n_name").alias("name"), F.lit("place").alias("kind"), F.lit(0.6).alias("score"))
    )
    return joined.select("doc_id", text.alias("text")), names


def recognised_names(spark, sf):
    texts, names = _named_texts(spark, sf)
    found = recognise.recognise(texts, "text", recognise.name_parts(names, score="score"), with_numbers=False)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.start", "s.end", "s.score")


def redact_recognised(spark, sf):
    """Names and checksummed numbers of the documents' texts replaced, behind the redaction hook."""
    texts, names = _named_texts(spark, sf)
    return redact_columns(texts, ["text"], recognise.redactor(recognise.name_parts(names, score="score")))


def url_extract(spark, sf):
    return joint.message_urls(emails(spark, sf), "email_id", "body")


def casing_stats(spark, sf):
    return rounded(aggregates.casing_stats(table(spark, sf, "documents"), "text"))


def token_length_profile(spark, sf):
    docs = table(spark, sf, "documents").select(token_count(F.col("text")).alias("tokens"))
    # Several passes follow; only the narrow count column is kept for them.
    docs = materialise(docs, "tokens")
    return rounded(aggregates.token_length_profile(docs, "tokens"))


def token_length_histogram(spark, sf):
    docs = table(spark, sf, "documents").select(token_count(F.col("text")).alias("tokens"))
    return rounded(aggregates.clipped_histogram(materialise(docs, "tokens"), "tokens"))


# --- URL features and sequences ------------------------------------------------------------------

def url_features_enriched(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return rounded(with_enriched_features(pages, "url").drop("url"))


def url_features_basic(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return rounded(with_basic_features(pages, "url").drop("url"))


def features_nohttps(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return rounded(with_enriched_features(pages, "url", ["has_https"]).drop("url"))


def char_vocab(spark, sf):
    train = split_corpus(spark, sf).where(F.col("split") == "train")
    return sequences.char_vocab(train, "url")


def char_sequences(spark, sf):
    rows = materialise(split_corpus(spark, sf), "split")
    vocab = sequences.char_vocab(rows.where(F.col("split") == "train"), "url")
    encoded = sequences.pad_to_longest(sequences.encode_chars(rows, "url", vocab), "url")
    return encoded.select("url", "split", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"))


def char_sequences_padded(spark, sf):
    rows = materialise(split_corpus(spark, sf), "split")
    vocab = sequences.char_vocab(rows.where(F.col("split") == "train"), "url")
    encoded = sequences.encode_chars(rows, "url", vocab, max_len=SEQUENCE_LENGTH)
    return encoded.select("url", "split", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"))


def char_sequences_cut(spark, sf):
    return sequences.cut_report(split_corpus(spark, sf), "url", SEQUENCE_LENGTH)


# --- scaling -----------------------------------------------------------------------------------

def featured(spark, sf):
    """Corpus with split and enriched features."""
    return with_enriched_features(split_corpus(spark, sf), "url")


def fitted(rows: DataFrame) -> DataFrame:
    return scaling.fit_scaler(rows.where(F.col("split") == "train"), FEATURES)


def scaler_fit(spark, sf):
    return rounded(scaling.scaler_rows(fitted(featured(spark, sf))))


def scaled_features(spark, sf):
    return rounded(_prepared(spark, sf).scaled)


def legit_only(spark, sf):
    prepared = url_corpus.prepare(union(spark, sf), SOURCES)
    return rounded(prepared.legit_only().drop("source"))


def feature_health(spark, sf):
    return scaling.feature_health(featured(spark, sf), FEATURES)


def feature_schema(spark, sf):
    return url_corpus.feature_schema(feature_names(), featured(spark, sf))


def message_features(spark, sf, scaler, carry=()):
    return joint_corpus.scaled_message_urls(emails(spark, sf), scaler, carry)


def feature_shift(spark, sf):
    ready = _prepared(spark, sf)
    ours = ready.scaled.where(F.col("split") == "train")
    theirs = message_features(spark, sf, ready.scaler).where(F.col("url").isNotNull())
    return rounded(scaling.feature_shift(ours, theirs, FEATURES))


# --- joint corpus --------------------------------------------------------------------------------

def basic_scaler(spark, sf):
    train = split_corpus(spark, sf).where(F.col("split") == "train")
    return scaling.fit_scaler(with_basic_features(train, "url"), BASIC)


def joint_urls(spark, sf):
    return rounded(joint_corpus.url_table(emails(spark, sf), basic_scaler(spark, sf)))


def joint_text(spark, sf):
    return joint_corpus.text_table(emails(spark, sf))


def joint_completeness(spark, sf):
    mail = emails(spark, sf)
    urls = joint.message_urls(mail, "email_id", "body", keep_empty=True)
    return joint.completeness(mail.select("email_id"), urls.select("email_id"), "email_id")


def null_url_emails(spark, sf):
    mail = emails(spark, sf)
    without = mail.where(F.size(extract_urls(F.col("body"))) == 0).select("email_id")
    return mail.select("email_id", "label").join(without, "email_id", "left_semi")


def url_presence(spark, sf):
    rows = emails(spark, sf).select(F.size(extract_urls(F.col("body"))).alias("n_urls"))
    return rounded(joint.url_presence(rows))


def distances(spark, sf, carry=("label",), scaler=None):
    """Mean squared scaled feature per message URL; URL-less messages keep a null URL.

    Stored once, because both the neutral median and the maximum per message read it.
    """
    rows = message_features(spark, sf, scaler or _prepared(spark, sf).scaler, carry)
    score = scaling.mean_square(FEATURES).alias("dist")
    return materialise(rows.select("email_id", *carry, "url_index", "url", score), "dist")


def email_score_max_neutral(spark, sf):
    best = joint.max_per_message(distances(spark, sf), "email_id", ["dist"], ["label"])
    return rounded(best)


def message_scores(spark, sf):
    """Three scores per message: feature distance, character model, URL entropy."""
    ready = _prepared(spark, sf)
    bigrams = ngram.fit_bigrams(ready.split.where((F.col("split") == "train") & (F.col("label") == 1)), "url")
    mail = emails(spark, sf)
    rows = with_enriched_features(joint.message_urls(mail, "email_id", "body"), "url")
    scored = scaling.apply_scaler(rows.withColumn("entropy", F.col("url_entropy")), ready.scaler, FEATURES)
    scored = message_eval.bigram_scorer(bigrams)(scored.withColumn("dist", scaling.mean_square(FEATURES)), "chars")
    models = ["dist", "chars", "entropy"]
    stored = materialise(scored.select("email_id", *models), "scores")
    best = joint.attach_max(mail.select("email_id"), stored, "email_id", models)
    return joint.assemble_scores(mail.select("email_id", "label"), "email_id", [best])


def email_score_wide(spark, sf):
    return rounded(message_scores(spark, sf))


def joint_diagnostics(spark, sf):
    best = joint.max_per_message(distances(spark, sf), "email_id", ["dist"], ["label"])
    counts = emails(spark, sf).select("email_id", F.size(extract_urls(F.col("body"))).alias("n_urls"))
    rows = counts.join(best, "email_id").withColumn("label", labels.flip_label(F.col("label")))
    return rounded(joint.joint_diagnostics(rows, "n_urls", "label", "dist"))


# The ablated feature sets.
ABLATIONS = {
    "all": [],
    "no_https": ["has_https"],
    "no_https_entropy": ["has_https", "domain_entropy"],
    "no_top_shifted": ["has_https", "domain_entropy", "num_dots", "path_depth"],
}


def ablation_auc(spark, sf):
    """AUC of the per-message distance with features set to the training mean.

    All feature sets are scored in one pass as columns, then ranked together as groups.
    """
    rows = message_features(spark, sf, _prepared(spark, sf).scaler, ("label",))
    variants = {
        name: _neutral_distance(dropped).alias(name) for name, dropped in ABLATIONS.items()
    }
    scored = materialise(rows.select("email_id", "label", "url", *variants.values()), "dist")
    best = joint.max_per_message(scored, "email_id", list(ABLATIONS), ["label"])
    long = best.unpivot(["label"], list(ABLATIONS), "feature_set", "dist")
    return rounded(metrics.areas(long, "dist", "label", ["feature_set"]))


def _neutral_distance(dropped) -> Column:
    kept = [f for f in FEATURES if f not in dropped]
    return scaling.mean_square(kept) * len(kept) / len(FEATURES)


def fuse_scores(spark, sf):
    rows = scores(spark, sf).select("key", "score", "score2", (F.col("score") * F.col("score2")).alias("score3"))
    fused = joint.fuse_scores(rows, "key", ["score"], ["score2", "score3"])
    return fused


# --- aggregates ----------------------------------------------------------------------------------

def per_source_counts(spark, sf):
    return aggregates.per_source_counts(union(spark, sf))


def label_mix(spark, sf):
    return rounded(aggregates.mix(table(spark, sf, "documents").select("source"), "source"))


def class_balance(spark, sf):
    return rounded(aggregates.class_balance(emails(spark, sf).select("label")))


def score_summary(spark, sf):
    return rounded(aggregates.score_summary(scores(spark, sf), ["score", "score2"]), 9)


def score_separation(spark, sf):
    return rounded(aggregates.score_separation(scores(spark, sf), ["score", "score2"], "y"))


def quantile_grid(spark, sf):
    grid = ranking.quantiles(scores(spark, sf), "score", metrics.CANDIDATE_PROBS)
    return rounded(grid.select(F.col("q_index").cast("int").alias("q_index"), "value"), 9)


# --- metrics -------------------------------------------------------------------------------------

def _threshold(strategy):
    def run(spark, sf):
        rows = scores(spark, sf).where(F.col("split") == "val")
        picked = metrics.pick_thresholds(rows, "score", "y")
        return rounded(picked.where(F.col("strategy") == strategy), 9)
    return run


def metrics_at_threshold(spark, sf):
    return rounded(metrics.evaluate(scores(spark, sf), "score", "y", 0.35))


def metrics_at_half(spark, sf):
    return rounded(metrics.evaluate(scores(spark, sf), "score2", "y", 0.5, accuracy=True))


def strategy_report(spark, sf):
    rows = scores(spark, sf)
    val, test = rows.where(F.col("split") == "val"), rows.where(F.col("split") == "test")
    return rounded(metrics.strategy_report(val, test, "score", "y"), 9)


def auc_roc(spark, sf):
    return rounded(metrics.areas(scores(spark, sf), "score", "y").select("auc_roc"))


def average_precision(spark, sf):
    return rounded(metrics.areas(scores(spark, sf), "score", "y").select("auc_pr"))


def confusion_matrix(spark, sf):
    return metrics.confusion(scores(spark, sf), "score", "y", 0.35)


def roc_curve(spark, sf):
    return rounded(metrics.curves(scores(spark, sf), "score2", "y").select("threshold", "fpr", "tpr"))


def pr_curve(spark, sf):
    return rounded(metrics.curves(scores(spark, sf), "score2", "y").select("threshold", "precision", "recall"))


def score_histogram(spark, sf):
    # Edges have at most nine decimals, so nine keep them as they are, without ties.
    return rounded(metrics.score_histogram(scores(spark, sf), "score", "y"), 9)


def auc_inversion(spark, sf):
    long = scores(spark, sf).unpivot(["y"], ["score", "score2"], "model", "s")
    return rounded(metrics.inversion_check(long, "s", "y", ["model"]))


def page_scores(spark, sf):
    return _prepared(spark, sf).scaled.select(
        "url", scaling.mean_square(FEATURES).alias("dist"), F.col("domain_entropy").alias("entropy")
    )


def top_anomalous(spark, sf):
    return rounded(metrics.extremes_per_model(rounded(page_scores(spark, sf)), "url", ["dist", "entropy"]))


def least_anomalous(spark, sf):
    return rounded(
        metrics.extremes_per_model(rounded(page_scores(spark, sf)), "url", ["dist", "entropy"], largest=False)
    )


def top_errors(spark, sf):
    return metrics.top_errors(scores(spark, sf), "key", "score", "y", 0.5)


# --- models --------------------------------------------------------------------------------------

def _prepared(spark, sf):
    return url_corpus.prepare(union(spark, sf), SOURCES)


def _level_features(spark, sf):
    """The prepared corpus, and its scaled features without the last digits of their sums.

    Two URLs with equal features must be equal to a tree, in whatever order a feature was summed.
    """
    ready = _prepared(spark, sf)
    return ready, rounded(ready.scaled)


def iforest_fit(spark, sf):
    ready, scaled = _level_features(spark, sf)
    train = scaled.where(F.col("split") == "train")
    nodes = iforest.fit_forest(train, "url", ready.features)
    cut = F.when(F.col("left") != F.col("node"), F.col("threshold"))
    return rounded(nodes.select("tree", "node", "feature", cut.alias("threshold"), "path", "n_samples"))


def iforest_score(spark, sf):
    ready, scaled = _level_features(spark, sf)
    train = scaled.where(F.col("split") == "train")
    forest = iforest.fit_forest(train, "url", ready.features)
    scored = iforest.score_forest(scaled, ready.features, forest, "anomaly_score")
    return rounded(scored.select("url", "label", "split", "anomaly_score"))


def iforest_sweep(spark, sf):
    """Test metrics per (trees, samples) setting.

    One job grows the trees of all settings and one pass scores all of them.
    """
    ready, scaled = _level_features(spark, sf)
    train = scaled.where(F.col("split") == "train")
    settings = [(trees, samples) for trees in (100, 200, 300) for samples in (128, 256, 512)]
    nodes = materialise(iforest.fit_forests(train, "url", ready.features, settings), "forest")
    forests = {f"{t}_{n}": iforest.select_forest(nodes, t, n) for t, n in settings}
    held = scaled.where(F.col("split") != "train")
    scored = materialise(
        # Equal paths must give equal scores whatever the order they are summed in.
        rounded(iforest.score_forests(held, ready.features, forests).select("label", "split", *forests), 9), "scores"
    )
    long = scored.withColumn("y", labels.is_phishing(F.col("label"))).unpivot(
        ["y", "split"], list(forests), "setting", "s"
    )
    picked = metrics.pick_thresholds(long.where(F.col("split") == "val"), "s", "y", by=["setting"])
    test = long.where(F.col("split") == "test")
    limits = picked.where(F.col("strategy") == "f1").select("setting", "threshold")
    judged = test.join(F.broadcast(limits), "setting")
    cells = metrics.with_rates(metrics.confusion(judged, "s", "y", F.col("threshold"), ["setting"]))
    parts = F.split("setting", "_")
    return rounded(cells.join(metrics.areas(test, "s", "y", ["setting"]), "setting").select(
        parts[0].cast("int").alias("n_estimators"), parts[1].cast("int").alias("max_samples"),
        "auc_roc", "auc_pr", "f1", "precision", "recall", F.col("false_positive_rate").alias("fpr"),
    ))


def pca_recon_score(spark, sf):
    ready = _prepared(spark, sf)
    codec = reconstruction.fit_codec(ready.legit_only(), ready.features)
    scored = reconstruction.score_codec(ready.scaled, codec, "anomaly_score")
    return scored.select("url", "label", "split", "anomaly_score")


def pca_recon_bounds(spark, sf):
    """Scores without components and with all of them: the distance from the means, and zero."""
    ready = _prepared(spark, sf)
    legit, rows = ready.legit_only(), ready.scaled.select("url", *ready.features)
    for k, name in ((0, "none"), (len(ready.features), "all")):
        rows = reconstruction.score_codec(rows, reconstruction.fit_codec(legit, ready.features, k), name)
    return rounded(rows.select("url", "none", "all"))


def autoencoder_score(spark, sf):
    """Reconstruction error of a non-linear autoencoder fitted on the legitimate training rows."""
    ready = _prepared(spark, sf)
    rows = materialise(ready.scaled.select("url", "label", "split", *ready.features), "scaled")
    legit = rows.where((F.col("split") == "train") & (F.col("label") == 1))
    network = autoencoder.fit_network(legit, ready.features, "url", epochs=40)
    return autoencoder.score_network(rows, network, "anomaly_score").select("url", "label", "split", "anomaly_score")


def autoencoder_check(spark, sf):
    """Rows and valid scores, the legitimate rows' mean square, and whether their error is less than it."""
    ready = _prepared(spark, sf)
    rows = materialise(ready.scaled.select("url", "label", "split", *ready.features), "scaled")
    own = (F.col("split") == "train") & (F.col("label") == 1)
    network = autoencoder.fit_network(rows.where(own), ready.features, "url", epochs=8)
    scored = autoencoder.score_network(rows, network).withColumn("square", scaling.mean_square(ready.features))
    square = F.avg(F.when(own, F.col("square")))
    return rounded(scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("score") >= 0).alias("n_scored"),
        square.alias("mean_square"),
        (F.avg(F.when(own, F.col("score"))) < 0.9 * square).alias("improved"),
    ))


def char_context_score(spark, sf):
    """Mean loss of a URL under contexts of up to two characters with Kneser-Ney back-off."""
    rows = split_corpus(spark, sf)
    tree = context.fit_contexts(rows.where((F.col("split") == "train") & (F.col("label") == 1)), "url", 2)
    return rounded(context.score_contexts(rows, "url", "url", tree, ["split"]))


def char_context_gain(spark, sf):
    """Per split, rows and whether five characters of context lose less than one does."""
    rows = materialise(split_corpus(spark, sf), "split")
    train = rows.where((F.col("split") == "train") & (F.col("label") == 1))
    both = context.score_contexts(rows, "url", "url", context.fit_contexts(train, "url"), ["split"], "long")
    short = ngram.score_bigrams(rows, "url", "url", ngram.fit_bigrams(train, "url"), [], "short")
    return both.join(short, "url").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.avg("long") < F.avg("short")).alias("longer_is_better")
    )


def _fit_check(scored, target, score):
    """Rows, scores in range, and whether the weighted residuals of the training rows sum to zero.

    At the optimum of a logistic regression they do, as its intercept is not penalised.
    """
    weights = classifiers.class_weights(scored.where(F.col("split") == "train"), target).select(target, "weight")
    rows = scored.join(F.broadcast(weights), target, "left")
    own = (F.col("split") == "train") & F.col(target).isNotNull()
    residual = F.sum(F.when(own, F.col("weight") * (F.col(score) - F.col(target)))) / F.sum(F.when(own, F.col("weight")))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(score).between(0, 1)).alias("n_in_range"),
        (F.abs(residual) < 1e-3).alias("at_optimum"),
    )


def embedding_logreg_check(spark, sf):
    return _fit_check(embedding_logreg(spark, sf), "y", "semantic_score")


def text_logreg_check(spark, sf):
    return _fit_check(text_logreg(spark, sf), "label", "semantic_score")


def _gradient_check(train, target, score):
    """Per coefficient (-1 is the intercept) whether the penalised loss has no slope there."""
    return classifiers.gradient(train, target, score).select("term", (F.abs("gradient") < 1e-4).alias("at_optimum"))


def embedding_logreg_gradient(spark, sf):
    train = split.stratified_split(_vectors(spark, sf), "vec_id", "y").where(F.col("split") == "train")
    return _gradient_check(train, "y", classifiers.embedding_classifier(train, "embedding", "y"))


def char_ngram_score(spark, sf):
    rows = split_corpus(spark, sf)
    train = rows.where((F.col("split") == "train") & (F.col("label") == 1))
    return rounded(ngram.score_bigrams(rows, "url", "url", ngram.fit_bigrams(train, "url"), ["split"]))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 3).cast("int"))


def embedding_logreg(spark, sf):
    rows = split.stratified_split(_vectors(spark, sf), "vec_id", "y")
    score = classifiers.embedding_classifier(rows.where(F.col("split") == "train"), "embedding", "y")
    return score(rows, "semantic_score").select("vec_id", "y", "split", "semantic_score")


def l2_normalise(spark, sf):
    unit = classifiers.l2_normalise(F.col("embedding"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("dim", "value"))
    return rounded(rows)


def class_weights(spark, sf):
    return rounded(classifiers.class_weights(_vectors(spark, sf), "y"))


def text_logreg(spark, sf):
    mail = emails(spark, sf).select("email_id", "label", clean_text(F.col("body")).alias("text"))
    rows = materialise(split.stratified_split(mail, "email_id", "label"), "text")
    score = classifiers.text_classifier(rows.where(F.col("split") == "train"), "text", "label")
    return score(rows, "semantic_score").select("email_id", "label", "split", "semantic_score")


def _mean_model():
    def predict(batch: np.ndarray) -> np.ndarray:
        x = batch.astype(np.float64)
        return 1.0 / (1.0 + np.exp(-x.mean(axis=1)))
    return predict


def batch_predict(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = classifiers.batch_predict(rows, ["embedding"], _mean_model, DoubleType(), 512, input_shapes=[[64]])
    return rounded(scored.select("vec_id", "score"))


# --- messages through the fitted models ---------------------------------------------------------

def _fitted_models(ready):
    """Scorers fitted on the prepared corpus: forest, linear codec, character bigrams."""
    train = ready.scaled.where(F.col("split") == "train")
    forest = materialise(iforest.fit_forest(train, "url", ready.features), "forest")
    codec = reconstruction.fit_codec(ready.legit_only(), ready.features)
    by_feature = {"iso": message_eval.forest_scorer(forest, ready.features), "recon": message_eval.codec_scorer(codec)}
    bigrams = ngram.fit_bigrams(train.where(F.col("label") == 1), "url")
    return by_feature, {**by_feature, "chars": message_eval.bigram_scorer(bigrams)}


def _message_rows(spark, sf, ready):
    return message_features(spark, sf, ready.scaler, ("label",))


def message_model_scores(spark, sf):
    """Highest forest, reconstruction and character score per message."""
    ready = _prepared(spark, sf)
    _, scorers = _fitted_models(ready)
    return rounded(message_eval.message_scores(_message_rows(spark, sf, ready), scorers))


def message_model_report(spark, sf):
    ready = _prepared(spark, sf)
    _, scorers = _fitted_models(ready)
    scored = message_eval.message_scores(_message_rows(spark, sf, ready), scorers)
    return rounded(message_eval.model_report(scored, list(scorers)))


def held_out_model_report(spark, sf):
    """The held-out corpus through the message scoring path."""
    ready = _prepared(spark, sf)
    _, scorers = _fitted_models(ready)
    held = ready.scaled.where(F.col("split") == "test").withColumn("y", labels.is_phishing(F.col("label")))
    return rounded(message_eval.held_out_check(held, scorers, "y"))


def ablation_models(spark, sf):
    """AUC per message with features at their training mean, scored again by the fitted models."""
    ready = _prepared(spark, sf)
    by_feature, _ = _fitted_models(ready)
    return rounded(message_eval.ablation_report(_message_rows(spark, sf, ready), by_feature, ABLATIONS))


def semantic_report(spark, sf):
    """The text model's score per message: summary and quality at one half."""
    return rounded(message_eval.semantic_report(text_logreg(spark, sf), ["semantic_score"]))


def report_json_roundtrip(spark, sf):
    """All three readiness reports written as JSON and read back."""
    path = scratch_path(spark, "reports")
    url = readiness_url(spark, sf).select("section", "name", F.col("value").cast("double").alias("value"))
    text = tables.report_rows(readiness_text(spark, sf), "text")
    joint_rows = tables.report_rows(readiness_joint(spark, sf), "joint")
    tables.write_json_report(url.unionByName(text).unionByName(joint_rows), path)
    return tables.read_json_report(spark, path)


# --- reports -------------------------------------------------------------------------------------

def readiness_url(spark, sf):
    return url_corpus.readiness_url(union(spark, sf), SOURCES)


def readiness_text(spark, sf):
    return rounded(text_corpus.readiness_text(labelled_messages(spark, sf)))


def readiness_joint(spark, sf):
    return joint_corpus.readiness_joint(emails(spark, sf))


def flagship(spark, sf):
    """Messages to one AUC: extract, featurise, scale, score, roll up, evaluate."""
    best = joint.max_per_message(distances(spark, sf), "email_id", ["dist"], ["label"])
    return rounded(metrics.areas(best, "dist", "label"))


REGISTRY = {
    "email_distance_auc": flagship,
    "src_url_int_label": src_url_int_label,
    "src_url_str_label": src_url_str_label,
    "src_url_null_label": src_url_null_label,
    "email_label_flip": email_label_flip,
    "email_label_map": email_label_map,
    "sink_parquet_roundtrip": sink_parquet_roundtrip,
    "sink_csv_roundtrip": sink_csv_roundtrip,
    "char_sequences": char_sequences,
    "char_sequences_padded": char_sequences_padded,
    "char_sequences_cut": char_sequences_cut,
    "length_filter": length_filter,
    "features_nohttps": features_nohttps,
    "legit_only": legit_only,
    "null_url_emails": null_url_emails,
    "email_score_max_neutral": email_score_max_neutral,
    "joint_completeness": joint_completeness,
    "email_score_wide": email_score_wide,
    "clean_corpus": clean_corpus,
    "url_union": url_union,
    "conflicting_urls": conflicting_urls,
    "url_corpus": corpus,
    "text_dedup": text_dedup,
    "stratified_split": stratified_split,
    "seeded_sample": seeded_sample,
    "sample_per_class": sample_per_class,
    "cross_source_dedup": cross_source_dedup,
    "label_collapse": label_collapse,
    "clean_text": clean_text_query,
    "redact_text": redact_text_query,
    "redaction_counts": redaction_counts,
    "url_extract": url_extract,
    "joint_urls": joint_urls,
    "joint_text": joint_text,
    "casing_stats": casing_stats,
    "token_length_profile": token_length_profile,
    "redact_table": redact_table,
    "recognised_names": recognised_names,
    "redact_recognised": redact_recognised,
    "url_corpus_arriving": url_corpus_arriving,
    "char_vocab": char_vocab,
    "url_features_enriched": url_features_enriched,
    "url_features_basic": url_features_basic,
    "per_source_counts": per_source_counts,
    "label_mix": label_mix,
    "class_balance": class_balance,
    "url_presence": url_presence,
    "score_summary": score_summary,
    "score_separation": score_separation,
    "scaler_fit": scaler_fit,
    "feature_health": feature_health,
    "quantile_grid": quantile_grid,
    "scaled_features": scaled_features,
    "threshold_f1": _threshold("f1"),
    "threshold_youden": _threshold("youden"),
    "threshold_fpr": _threshold("fpr"),
    "metrics_at_threshold": metrics_at_threshold,
    "metrics_at_half": metrics_at_half,
    "strategy_report": strategy_report,
    "auc_roc": auc_roc,
    "average_precision": average_precision,
    "confusion_matrix": confusion_matrix,
    "roc_curve": roc_curve,
    "pr_curve": pr_curve,
    "score_histogram": score_histogram,
    "auc_inversion": auc_inversion,
    "feature_shift": feature_shift,
    "ablation_auc": ablation_auc,
    "joint_diagnostics": joint_diagnostics,
    "top_anomalous": top_anomalous,
    "least_anomalous": least_anomalous,
    "top_errors": top_errors,
    "iforest_fit": iforest_fit,
    "iforest_score": iforest_score,
    "iforest_sweep": iforest_sweep,
    "pca_recon_score": pca_recon_score,
    "char_ngram_score": char_ngram_score,
    "char_context_score": char_context_score,
    "char_context_gain": char_context_gain,
    "autoencoder_score": autoencoder_score,
    "autoencoder_check": autoencoder_check,
    "embedding_logreg_gradient": embedding_logreg_gradient,
    "embedding_logreg": embedding_logreg,
    "l2_normalise": l2_normalise,
    "class_weights": class_weights,
    "text_logreg": text_logreg,
    "batch_predict": batch_predict,
    "pca_recon_bounds": pca_recon_bounds,
    "embedding_logreg_check": embedding_logreg_check,
    "text_logreg_check": text_logreg_check,
    "email_csv_source": email_csv_source,
    "report_json_roundtrip": report_json_roundtrip,
    "token_length_histogram": token_length_histogram,
    "redact_table_plugin": redact_table_plugin,
    "message_model_scores": message_model_scores,
    "message_model_report": message_model_report,
    "held_out_model_report": held_out_model_report,
    "ablation_models": ablation_models,
    "semantic_report": semantic_report,
    "readiness_url": readiness_url,
    "readiness_text": readiness_text,
    "readiness_joint": readiness_joint,
    "feature_schema": feature_schema,
    "source_exclusion": source_exclusion,
    "fuse_scores": fuse_scores,
}
