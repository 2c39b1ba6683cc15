import numpy as np
from pyspark.sql import functions as F

from lurescope.models import autoencoder, reconstruction


def curve(spark, n=1500, seed=3):
    """Points on a bent curve in six dimensions, and as many beside it at the same distances from the centre."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(-2, 2, n)
    base = np.column_stack([t, t**2 - 4 / 3, np.sin(3 * t), t, -t, np.abs(t) - 1])
    off = base.copy()
    off[:, 1] = -off[:, 1]
    off[:, 5] = -off[:, 5]
    rows = [(i, 1, *map(float, p)) for i, p in enumerate(base + rng.normal(0, 0.05, base.shape))]
    rows += [(n + i, 0, *map(float, p)) for i, p in enumerate(off + rng.normal(0, 0.05, base.shape))]
    names = [f"x{i}" for i in range(6)]
    return spark.createDataFrame(rows, ["key", "label", *names]), names


def auc(rows):
    good = np.array([r["score"] for r in rows if r["label"] == 1])
    bad = np.array([r["score"] for r in rows if r["label"] == 0])
    return (bad[:, None] > good[None, :]).mean()


def test_gradient_by_finite_differences():
    network = autoencoder.initial([f"x{i}" for i in range(5)], (4, 2, 4), 7)
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(9, 5))
    network = autoencoder.Network(network.features, network.sizes, network.parameters + rng.normal(0, 0.1, len(network.parameters)))
    _, gradient = network.gradient(rows)
    for i in range(len(gradient)):
        moved = []
        for step in (1e-6, -1e-6):
            theta = network.parameters.copy()
            theta[i] += step
            moved.append(autoencoder.Network(network.features, network.sizes, theta).gradient(rows)[0])
        assert abs((moved[0] - moved[1]) / 2e-6 - gradient[i]) < 1e-5


def test_sums_do_not_depend_on_partitions(spark):
    rows, names = curve(spark, 200)
    network = autoencoder.initial(names, (4, 1, 4), 2)
    flagged = rows.withColumn("held", F.col("key") % 7 == 0)
    one, many = (autoencoder.evaluate(flagged.repartition(n), network) for n in (1, 9))
    assert np.allclose(one[0], many[0]) and np.allclose(one[1], many[1]) and np.allclose(one[2], many[2])
    local = np.array([[r[n] for n in names] for r in flagged.where("not held").collect()])
    loss, gradient = network.gradient(local)
    assert np.allclose(one[0], loss / len(local)) and np.allclose(one[2], gradient / len(local))


def test_beats_principal_components_on_planted_rows(spark):
    rows, names = curve(spark)
    legit = rows.where("label = 1")
    network = autoencoder.fit_network(legit, names, "key", widths=(12, 2, 12), epochs=80)
    codec = reconstruction.fit_codec(legit, names, 2)
    curved = auc(autoencoder.score_network(rows, network).select("label", "score").collect())
    straight = auc(reconstruction.score_codec(rows, codec).select("label", "score").collect())
    assert curved > 0.85 and curved > straight + 0.1, (curved, straight)


def test_nulls_empty_tables_and_clashing_names(spark):
    rows, names = curve(spark, 60)
    with_null = rows.withColumn("x2", F.when(F.col("key") != 5, F.col("x2"))).withColumn("score", F.lit("mine")).withColumn("held", F.lit(1))
    network = autoencoder.fit_network(with_null.where("label = 1"), names, "key", widths=(3,), epochs=3)
    scored = autoencoder.score_network(with_null, network)
    assert scored.columns == with_null.columns
    assert [r["key"] for r in scored.where("score is null").collect()] == [5]
    none = autoencoder.fit_network(rows.limit(0), names, "key", widths=(3,), epochs=3)
    assert np.array_equal(none.parameters, autoencoder.initial(names, (3,), 42).parameters)
    assert autoencoder.score_network(rows.limit(0), none).count() == 0
