"""Binary-classifier metrics on (score, target) tables; target is 1 for phishing, else 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import attach, ladder_quantiles, score_ladder

# Threshold candidates are these quantiles of the validation scores.
CANDIDATE_PROBS = [round(i / 100, 2) for i in range(1, 100)]
STRATEGIES = ("f1", "youden", "fpr")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields 0 for an empty denominator."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def labelled(df: DataFrame, score: str, target: str) -> DataFrame:
    """Rows that can be judged: unlabelled ones (null target) never enter a metric."""
    return df.where(F.col(target).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score)))


def target_ladder(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    return score_ladder(labelled(df, score, target), score, F.col(target) == 1, by)


def ladder_areas(ladder: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``auc_roc`` (ties count one half) and ``auc_pr`` (step-sum average precision) per group.

    A group without positives or without negatives has a null ``auc_roc``.
    """
    neg, cum_neg = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    below = cum_neg - neg
    won = F.sum(F.col("pos") * (below + neg / 2.0))
    pairs = F.max(F.col("total_pos").cast("double") * (F.col("total_n") - F.col("total_pos")))
    # Descending view of the same rung: everything at or above this score.
    above_n = F.col("total_n") - F.col("cum_n") + F.col("n")
    above_pos = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    steps = F.sum(F.col("pos") * above_pos / above_n)
    positives = F.max("total_pos")
    return ladder.groupBy(*by).agg(
        F.when(pairs > 0, won / pairs).alias("auc_roc"),
        ratio(steps, positives).alias("auc_pr"),
    )


def areas(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    return ladder_areas(target_ladder(df, score, target, by), by)


def curves(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Curve points, one per distinct score used as threshold: ROC and precision-recall."""
    ladder = target_ladder(df, score, target, by)
    tp = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    flagged = F.col("total_n") - F.col("cum_n") + F.col("n")
    negatives = F.col("total_n") - F.col("total_pos")
    return ladder.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(tp, F.col("total_pos")).alias("tpr"),
        ratio(flagged - tp, negatives).alias("fpr"),
        ratio(tp, flagged).alias("precision"),
        ratio(tp, F.col("total_pos")).alias("recall"),
    )


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": ratio(fp, fp + tn),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
    }


def confusion(df: DataFrame, score: str, target: str, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """``tn fp fn tp`` of ``score >= threshold`` as one conditional aggregation."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, truth = F.col(score) >= limit, F.col(target) == 1
    cells = {"tn": ~hit & ~truth, "fp": hit & ~truth, "fn": ~hit & truth, "tp": hit & truth}
    return labelled(df, score, target).groupBy(*by).agg(
        *(F.coalesce(F.count_if(c), F.lit(0)).alias(n) for n, c in cells.items())
    )


def with_rates(cells: DataFrame, names: Sequence[str] = ("precision", "recall", "f1", "false_positive_rate")) -> DataFrame:
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return cells.withColumns({n: rates[n] for n in names})


def evaluate(df: DataFrame, score: str, target: str, threshold: Column | float, accuracy: bool = False) -> DataFrame:
    """One row: rates and counts at a threshold plus both areas, unrounded."""
    names = ["precision", "recall", "f1", "false_positive_rate", *(["accuracy"] if accuracy else [])]
    cells = with_rates(confusion(df, score, target, threshold), names)
    return attach(cells, areas(df, score, target), ["auc_roc", "auc_pr"])


def threshold_table(ladder: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and criteria at each of the 99 quantile candidates of a ladder.

    The counts come from the running totals of the rungs that hold the candidates, so one pass
    over the ladder replaces 99 rescans of the scores.
    """
    grid = ladder_quantiles(ladder, CANDIDATE_PROBS, by)
    rung = F.col("rung")
    # No score lies strictly between a rung and the next, so a candidate flags everything above
    # its lower rung, and that rung itself when it equals the candidate.
    own = rung["score"] >= F.col("value")

    def above(count: str) -> Column:
        rest = rung[f"total_{count}"] - rung[f"cum_{count}"]
        return rest + F.when(own, rung[count]).otherwise(0)

    counted = grid.select(
        *by, "q_index", F.col("value").alias("threshold"),
        above("n").alias("_flagged"), above("pos").alias("tp"),
        rung["total_pos"].alias("_pos"), rung["total_n"].alias("_n"),
    ).withColumns({"fp": F.col("_flagged") - F.col("tp"), "fn": F.col("_pos") - F.col("tp")})
    counted = counted.withColumn("tn", F.col("_n") - F.col("_pos") - F.col("fp"))
    rated = with_rates(counted, ["recall", "f1", "false_positive_rate"])
    return rated.select(
        *by, "q_index", "threshold", "tn", "fp", "fn", "tp",
        F.col("recall").alias("tpr"), F.col("false_positive_rate").alias("fpr"), "f1",
        (F.col("recall") - F.col("false_positive_rate")).alias("youden"),
    )


def pick_thresholds(
    df: DataFrame, score: str, target: str, target_fpr: float = 0.10, by: Sequence[str] = ()
) -> DataFrame:
    """One row per strategy: chosen ``threshold`` and its ``strategy_value``.

    ``f1`` and ``youden`` take the lowest candidate with the best value. ``fpr`` takes, among the
    candidates within ``target_fpr``, the best true-positive rate and then the highest
    threshold; with no such candidate it falls back to ``youden``.
    """
    by = list(by)
    table = threshold_table(target_ladder(df, score, target, by), by)
    feasible = F.col("fpr") <= target_fpr

    def best(value: str) -> Column:
        top = F.max(F.struct(F.col(value).alias("v"), (-F.col("q_index")).alias("k"), F.col("threshold").alias("t")))
        return F.struct(top["t"].alias("threshold"), top["v"].alias("strategy_value"))

    within = F.max(F.when(feasible, F.struct(F.col("tpr").alias("v"), F.col("threshold").alias("t"))))
    chosen = table.groupBy(*by).agg(
        best("f1").alias("f1"),
        best("youden").alias("youden"),
        F.coalesce(
            F.when(
                within.isNotNull(),
                F.struct(within["t"].alias("threshold"), within["v"].alias("strategy_value")),
            ),
            best("youden"),
        ).alias("fpr"),
    )
    stacked = chosen.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("c")) for s in STRATEGIES])
        ).alias("_s"),
    )
    return stacked.select(*by, "_s.strategy", "_s.c.threshold", "_s.c.strategy_value")


def strategy_report(
    validation: DataFrame, test: DataFrame, score: str, target: str, target_fpr: float = 0.10
) -> DataFrame:
    """Thresholds chosen on validation rows, metrics on test rows: one row per strategy."""
    picked = pick_thresholds(validation, score, target, target_fpr)
    packed = picked.agg(
        *(
            F.max(F.when(F.col("strategy") == s, F.struct("threshold", "strategy_value"))).alias(s)
            for s in STRATEGIES
        )
    )
    judged = attach(labelled(test, score, target), packed, list(STRATEGIES))
    truth = F.col(target) == 1
    cells = []
    for s in STRATEGIES:
        hit = F.col(score) >= F.col(s)["threshold"]
        cells += [
            F.count_if(~hit & ~truth).alias(f"{s}_tn"), F.count_if(hit & ~truth).alias(f"{s}_fp"),
            F.count_if(~hit & truth).alias(f"{s}_fn"), F.count_if(hit & truth).alias(f"{s}_tp"),
            F.max(F.col(s)).alias(s),
        ]
    wide = judged.agg(*cells)
    rows = wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("strategy"),
                        F.col(s)["threshold"].alias("threshold"),
                        F.col(s)["strategy_value"].alias("strategy_value"),
                        *(F.col(f"{s}_{c}").alias(c) for c in ("tn", "fp", "fn", "tp")),
                    )
                    for s in STRATEGIES
                ]
            )
        ).alias("r")
    ).select("r.*")
    return attach(with_rates(rows), areas(test, score, target), ["auc_roc", "auc_pr"])


def inversion_check(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC as given and with score or label direction flipped (both flips give 1 - AUC)."""
    base = areas(df, score, target, by)
    return base.select(
        *by,
        "auc_roc",
        (1 - F.col("auc_roc")).alias("auc_flipped"),
        (F.col("auc_roc") < 0.5).alias("inverted"),
    )


def score_histogram(
    df: DataFrame, score: str, target: str, low: float | None = None, high: float | None = None, bins: int = 50
) -> DataFrame:
    """Per class counts and densities over equal-width bins; every judged row is counted.

    The range is that of the class's scores unless given; scores outside a given range count in the
    end bins. ``low`` and ``high`` come back as the bin's edges.
    """
    rows = labelled(df, score, target).select(F.col(target).alias("target"), F.col(score).cast("double").alias("_s"))
    own = rows.groupBy("target").agg(
        F.min("_s").alias("_low") if low is None else F.lit(float(low)).alias("_low"),
        F.max("_s").alias("_high") if high is None else F.lit(float(high)).alias("_high"),
    )
    # One row per class; classes without any spread get bins of width 1 / bins.
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    ranges = own.select("target", "_low", (span / bins).alias("_width"))
    placed = rows.join(F.broadcast(ranges), "target")
    slot = F.greatest(F.least(F.floor((F.col("_s") - F.col("_low")) / F.col("_width")), F.lit(bins - 1)), F.lit(0))
    counts = placed.groupBy("target", slot.cast("int").alias("bin"), "_low", "_width").agg(F.count(F.lit(1)).alias("n"))
    per_class = F.sum("n").over(Window.partitionBy("target"))
    return counts.select(
        "target",
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("high"),
        "n",
        (F.col("n") / (per_class * F.col("_width"))).alias("density"),
    )


def top_errors(df: DataFrame, key: str, score: str, target: str, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """Most confident errors: false positives by score down, false negatives by score up."""
    wrong = labelled(df, score, target).withColumn(
        "kind",
        F.when((F.col(score) >= threshold) & (F.col(target) == 0), "false_positive").when(
            (F.col(score) < threshold) & (F.col(target) == 1), "false_negative"
        ),
    ).where(F.col("kind").isNotNull())
    confidence = F.when(F.col("kind") == "false_positive", -F.col(score)).otherwise(F.col(score))
    window = Window.partitionBy("kind").orderBy(confidence, key)
    ranked = wrong.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    return ranked.select("kind", "rank", key, score)


def extremes(df: DataFrame, key: str, score: str, n: int = 5, largest: bool = True) -> DataFrame:
    """Top or bottom ``n`` rows by score, ties by key (a take-ordered plan)."""
    order = F.desc(score) if largest else F.asc(score)
    return df.orderBy(order, key).limit(n)


def extremes_per_model(df: DataFrame, key: str, scores: Sequence[str], n: int = 5, largest: bool = True) -> DataFrame:
    """:func:`extremes` for several score columns in long form (model, rank, key, score)."""
    long = df.unpivot([key], list(scores), "model", "score")
    order = F.desc("score") if largest else F.asc("score")
    window = Window.partitionBy("model").orderBy(order, key)
    return long.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n).select(
        "model", "rank", key, "score"
    )
