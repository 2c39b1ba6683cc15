"""Reconstruction-error scorer: a linear autoencoder, that is, centred principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class LinearCodec:
    """Feature means and ``k`` component vectors: (k + 1) numbers per feature."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]

    def error(self) -> Column:
        """Mean squared reconstruction error as a JVM expression.

        The components are orthonormal, so the residual is the squared length that the ``k``
        projections do not explain.
        """
        centred = [F.col(f) - F.lit(m) for f, m in zip(self.features, self.mean)]
        total = _sum([c * c for c in centred])
        explained = _sum(
            [
                F.pow(_sum([c * F.lit(w) for c, w in zip(centred, row)]), F.lit(2.0))
                for row in self.components
            ]
        )
        return F.greatest(total - explained, F.lit(0.0)) / len(self.features)


def _sum(terms: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return total


def fit_codec(legit: DataFrame, features: Sequence[str], k: int = 8) -> LinearCodec:
    """Fit on legitimate rows only. The driver receives the means and a features x k matrix.

    Without components (``k`` = 0) the error is the mean squared distance from the means.
    """
    features = list(features)
    means = legit.agg(*(F.avg(f).alias(f) for f in features)).first()
    if k == 0:
        return LinearCodec(tuple(features), tuple(means), ())
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(legit.select(*features))
    pc = PCA(k=k, inputCol="_x", outputCol="_y").fit(vectors).pc.toArray()
    return LinearCodec(
        tuple(features), tuple(means), tuple(tuple(float(v) for v in pc[:, j]) for j in range(k))
    )


def score_codec(df: DataFrame, codec: LinearCodec, out: str = "score") -> DataFrame:
    return df.withColumn(out, codec.error())
