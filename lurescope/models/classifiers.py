"""Linear classifiers on embeddings and on hashed text, and batched inference of a user model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from ..operators.ranking import attach


def l2_normalise(vector: Column) -> Column:
    """Unit-length copy of an array column as doubles; the zero vector stays zero."""
    values = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.transform(values, lambda v: F.when(norm > 0, v / norm).otherwise(v))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (classes * n_class) per class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return attach(counts, overall, ["_all", "_k"]).select(
        target, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight")
    )


def _weighted(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    rows = df.where(F.col(target).isNotNull())
    weights = [(r[target], r["n"], r["weight"]) for r in class_weights(rows, target).limit(3).collect()]
    if {int(t) for t, _, _ in weights} != {0, 1}:
        raise ValueError("a binary target with both classes is needed")
    weight = F.lit(0.0)
    for value, _, w in weights:
        weight = F.when(F.col(target) == value, w).otherwise(weight)
    return rows.withColumn("_w", weight), sum(n for _, n, _ in weights)


def _logistic(rows: DataFrame, n: int, target: str, vector: str, c: float, max_iter: int):
    # sum(w * loss) * c + |b|^2 / 2 equals mean loss + reg * |b|^2 / 2 with reg = 1 / (c * n).
    return LogisticRegression(
        featuresCol=vector, labelCol=target, weightCol="_w", regParam=1.0 / (c * n),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9,
        probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class",
    ).fit(rows)


def embedding_classifier(
    train: DataFrame, embedding: str, target: str, c: float = 1.0, max_iter: int = 200
) -> Callable[[DataFrame, str], DataFrame]:
    """Balanced logistic regression on unit-length embeddings; returns a scoring function."""
    prepare = lambda df: df.withColumn("_x", array_to_vector(l2_normalise(F.col(embedding))))
    rows, n = _weighted(prepare(train), target)
    model = _logistic(rows.withColumn(target, F.col(target).cast("double")), n, target, "_x", c, max_iter)

    def score(df: DataFrame, out: str = "score") -> DataFrame:
        scored = model.transform(prepare(df))
        return scored.withColumn(out, vector_to_array("_p")[1]).select(*df.columns, out)

    score.vectors, score.penalty, score.model = prepare, 1.0 / (c * n), model
    return score


def gradient(train: DataFrame, target: str, score: Callable) -> DataFrame:
    """(term, gradient) of the penalised mean loss by every coefficient, and by the intercept as term -1.

    At the optimum all are zero. ``score`` is what a classifier of this module returned for ``train``.
    """
    rows, _ = _weighted(score(train, "_p1"), target)
    own = score.vectors(rows).select("_x", (F.col("_w") * (F.col("_p1") - F.col(target))).alias("_r"), "_w")
    total = own.agg(F.sum("_w").alias("_all"))

    vector = F.unwrap_udt("_x")
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    entries = own.select("_r", F.explode(F.arrays_zip(places.alias("i"), vector["values"].alias("v"))).alias("e"))
    by_term = entries.select(F.col("e.i").cast("long").alias("term"), (F.col("_r") * F.col("e.v")).alias("g"))
    constant = own.select(F.lit(-1).cast("long").alias("term"), F.col("_r").alias("g"))
    sums = by_term.unionByName(constant).groupBy("term").agg(F.sum("g").alias("g"))
    # One row per coefficient of the fitted model, which the driver holds already.
    weights = [(i, float(b)) for i, b in enumerate(score.model.coefficients.toArray())] + [(-1, 0.0)]
    every = train.sparkSession.createDataFrame(weights, "term long, b double").join(sums, "term", "left")
    return attach(every, total, ["_all"]).select(
        "term", (F.coalesce("g", F.lit(0.0)) / F.col("_all") + score.penalty * F.col("b")).alias("gradient")
    )


def text_classifier(
    train: DataFrame, text: str, target: str, buckets: int = 1 << 16, c: float = 1.0, max_iter: int = 50
) -> Callable[[DataFrame, str], DataFrame]:
    """Balanced logistic regression on hashed TF-IDF words; returns a scoring function.

    The score is the probability of class 1, the contract any text model must meet here.
    """
    tokenizer = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+", minTokenLength=1)
    hashing = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=buckets)

    def counts(df: DataFrame) -> DataFrame:
        safe = df.withColumn("_text", F.coalesce(text, F.lit("")))
        return hashing.transform(tokenizer.transform(safe))

    # Document frequencies and every solver round read the counts; a lost block is counted again.
    fitted = counts(train.where(F.col(target).isNotNull())).select("_tf", target).persist()
    idf = IDF(inputCol="_tf", outputCol="_x").fit(fitted)
    rows, n = _weighted(idf.transform(fitted), target)
    rows = rows.select("_x", "_w", F.col(target).cast("double").alias(target))
    model = _logistic(rows, n, target, "_x", c, max_iter)
    fitted.unpersist()

    def score(df: DataFrame, out: str = "score") -> DataFrame:
        scored = model.transform(idf.transform(counts(df)))
        return scored.withColumn(out, vector_to_array("_p")[1]).select(*df.columns, out)

    score.vectors, score.penalty, score.model = (lambda df: idf.transform(counts(df))), 1.0 / (c * n), model
    return score


def batch_predict(
    df: DataFrame, inputs: Sequence[str], make_predict: Callable, return_type: DataType,
    batch_size: int = 512, out: str = "score", input_shapes=None,
) -> DataFrame:
    """Score a table with any user model: ``make_predict`` loads it once per Python worker and
    returns a function from numpy batches to a numpy batch."""
    udf = predict_batch_udf(
        make_predict, return_type=return_type, batch_size=batch_size, input_tensor_shapes=input_shapes
    )
    return df.withColumn(out, udf(*inputs))
