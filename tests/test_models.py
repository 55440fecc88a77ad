"""Models on planted signals: known coefficients, better than the mean, clusters found again."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tesela.operators import models

ROWS = 1500


@pytest.fixture(scope="module")
def planted(spark):
    """``y`` = 3 + 2 a - b, never negative and often 0; ``hay`` mostly where a > 0."""
    rng = random.Random(1)
    data = []
    for i in range(ROWS):
        a, b = rng.gauss(0, 1), rng.uniform(0, 4)
        rate = max(0.0, 3 + 2 * a - b)
        data.append((i, a, b, rate if rng.random() < 0.9 else 0.0, float((a + rng.gauss(0, 0.4)) > 0)))
    return spark.createDataFrame(data, "id bigint, a double, b double, y double, hay double").cache()


@pytest.fixture(scope="module")
def regression(planted):
    return models.split(models.assembled(planted, ["a", "b"], "y"), ["id"])


@pytest.fixture(scope="module")
def binary(planted):
    return models.split(models.assembled(planted, ["a", "b"], "hay"), ["id"])


def test_split_is_by_key(regression):
    train, test = regression
    assert train.count() + test.count() == ROWS and 0.6 < train.count() / ROWS < 0.8 and train.join(test, "id").count() == 0


@pytest.mark.parametrize("name", sorted(models.REGRESSORS))
def test_regressors_beat_the_mean(regression, name):
    score = models.regression(*regression, name).first()
    assert score.filas == regression[1].count() and score.r2 > 0.4 and score.mae < 1.2


def test_hurdle(regression):
    assert models.hurdle(*regression).first().r2 > 0.5


def test_coefficients_of_a_plane(spark):
    rng = random.Random(2)
    data = [(a, b, 1 + 2 * a - 0.5 * b) for a, b in ((rng.gauss(0, 3), rng.gauss(0, 1)) for _ in range(300))]
    df = spark.createDataFrame(data, "a double, b double, y double")
    got = [(r.variable, r.coeficiente) for r in models.coefficients(models.assembled(df, ["a", "b"], "y"), ["a", "b"]).collect()]
    sd = [r for r in df.agg(F.stddev_samp("a"), F.stddev_samp("b")).first()]
    assert [v for v, _ in got] == ["a", "b"] and [c for _, c in got] == pytest.approx([2 * sd[0], -0.5 * sd[1]], rel=1e-6)
    assert models.regression(*models.split(models.assembled(df, ["a", "b"], "y"), ["a"]), "linear").first().mae < 1e-6


def test_importances(regression):
    found = {r.variable: r.importancia for r in models.importances(regression[0], ["a", "b"]).collect()}
    assert found["a"] > found["b"] > 0 and sum(found.values()) == pytest.approx(1)


@pytest.mark.parametrize("name", sorted(models.CLASSIFIERS))
def test_classifiers_find_the_signal(binary, name):
    score = models.classification(*binary, name).first()
    assert score.auc > 0.85 and score.exactitud > 0.8 and score.brier < 0.2


def test_boosted_stumps(binary):
    score = models.adaboost(*binary).first()
    assert score.exactitud > 0.8 and 1 <= score.rondas <= 5


def test_ensembles_and_calibration(binary):
    by = {r.modelo: r for r in models.ensembles(*binary, ["id"]).collect()}
    assert set(by) == {"hard_vote", "soft_vote", "stacking"} and all(r.exactitud > 0.8 for r in by.values())
    by = {r.modelo: r for r in models.calibration(*binary, ["id"]).collect()}
    assert by["platt"].log_loss < 0.5 and by["isotonic"].brier < 0.15 and by["platt"].brier <= by["raw"].brier + 0.02


def test_trees_shrink_as_a_split_must_gain_more(regression):
    rows = models.tree_sizes(*regression).orderBy("ganancia").collect()
    leaves = [r.hojas for r in rows]
    assert leaves == sorted(leaves, reverse=True) and leaves[0] > leaves[-1] >= 1 and rows[0].mae < 1.0


def test_searches(regression):
    grid = models.grid_search(regression[0]).collect()
    assert len(grid) == 6 and min(grid, key=lambda r: r.mae).reg <= 0.1
    assert models.random_search(regression[0], 2).count() == 2


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(3)
    centres = [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]
    data = [(i, i % 3, [rng.gauss(x, 0.5) for x in centres[i % 3]]) for i in range(300)]
    return spark.createDataFrame(data, "vec_id bigint, label int, v array<double>").withColumn("features", array_to_vector("v")).cache()


def test_clusters(blobs):
    elbow = {r.k: r for r in models.kmeans_elbow(blobs, range(1, 5), starts=2).collect()}
    assert elbow[1].silueta is None and elbow[3].inercia < 0.1 * elbow[1].inercia and max(elbow.values(), key=lambda r: r.silueta or 0).k == 3
    for name in ("kmeans", "bisecting", "mezcla"):
        sizes = sorted(r.filas for r in models.clusterings(blobs, 3).where(F.col("modelo") == name).collect())
        assert sum(sizes) == 300 and (name == "mezcla" or sizes == [100, 100, 100])
    strength = {r.k: r.fuerza for r in models.half_strengths(blobs, "vec_id", (3, 5)).collect()}
    assert strength[3] == 1.0 and strength[5] < 0.9 and math.isfinite(strength[5])
