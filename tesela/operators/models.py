"""Model fitting on whole frames with pyspark.ml; every function returns a small frame of scores or sizes."""

from __future__ import annotations

import math
import random

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators.metrics import prediction_strength, probability_scores, regression_scores, roc_auc
from tesela.operators.sampling import hundredth
from tesela.runtime import cut


def assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows without a null among ``features`` and ``label``, with columns ``features`` and ``label`` for pyspark.ml."""
    rows = df.dropna(subset=[*features, label])
    rows = rows.select("*", F.col(label).cast("double").alias("label")) if label != "label" else rows
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def split(df: DataFrame, keys: list[str], share: int = 70) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of ``keys``: the same on every run and at every size."""
    bucket = hundredth(*keys)
    return df.where(bucket < share), df.where(bucket >= share)


REGRESSORS = {
    "linear": lambda: R.LinearRegression(),
    "ridge": lambda: R.LinearRegression(elasticNetParam=0.0, regParam=1.0),
    "tree": lambda: R.DecisionTreeRegressor(maxDepth=6, minInfoGain=0.001, seed=42),
    "forest": lambda: R.RandomForestRegressor(numTrees=20, maxDepth=6, seed=42),
    "bagging": lambda: R.RandomForestRegressor(numTrees=20, maxDepth=6, featureSubsetStrategy="all", seed=42),
    "gbt": lambda: R.GBTRegressor(maxIter=10, maxDepth=4, seed=42),
    "poisson": lambda: R.GeneralizedLinearRegression(family="poisson", link="log", maxIter=15),
}


def regression(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """Error metrics on ``test`` of the regressor ``name``, fitted on ``train``."""
    predicted = REGRESSORS[name]().fit(train).transform(test)
    return predicted.agg(*regression_scores("label", "prediction")).select(F.lit(name).alias("modelo"), "*")


def hurdle(train: DataFrame, test: DataFrame) -> DataFrame:
    """Error metrics of P(y > 0) times E[y | y > 0]."""
    some = C.RandomForestClassifier(labelCol="some", probabilityCol="ps", predictionCol="some_p", rawPredictionCol="some_r", numTrees=20, maxDepth=6, seed=42).fit(train.withColumn("some", (F.col("label") > 0).cast("double")))
    size = R.GBTRegressor(predictionCol="size_p", maxIter=10, maxDepth=4, seed=42).fit(train.where("label > 0"))
    predicted = size.transform(some.transform(test)).withColumn("prediction", vector_to_array("ps")[1] * F.greatest("size_p", F.lit(0.0)))
    return predicted.agg(*regression_scores("label", "prediction")).select(F.lit("hurdle").alias("modelo"), "*")


def coefficients(train: DataFrame, features: list[str]) -> DataFrame:
    """Standardised linear coefficients ranked by size."""
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train).transform(train)
    model = R.LinearRegression(featuresCol="scaled").fit(scaled)
    table = train.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(features, model.coefficients)], "variable string, coeficiente double")
    return table.orderBy(F.desc(F.abs("coeficiente")), "variable")


def importances(train: DataFrame, features: list[str]) -> DataFrame:
    """Random-forest importances."""
    model = REGRESSORS["forest"]().fit(train)
    return train.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())], "variable string, importancia double")


CLASSIFIERS = {
    "logistic": lambda: C.LogisticRegression(weightCol="weight"),
    "tree": lambda: C.DecisionTreeClassifier(impurity="entropy", maxDepth=5, seed=42),
    "forest": lambda: C.RandomForestClassifier(numTrees=20, maxDepth=6, seed=42),
    "gbt": lambda: C.GBTClassifier(maxIter=10, maxDepth=4, seed=42),
    "naive_bayes": lambda: C.NaiveBayes(modelType="gaussian"),
    "svm": lambda: C.LinearSVC(maxIter=30),
}


def weighted(df: DataFrame) -> DataFrame:
    """Add ``weight`` that gives both classes the same total."""
    shares = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = shares.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(shares.join(total, how="cross")), "label").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def score_of(predicted: DataFrame) -> DataFrame:
    """Add ``p``: the probability of class 1, or the logistic of the margin where the model has none."""
    if "probability" in predicted.columns:
        return predicted.withColumn("p", vector_to_array("probability")[1])
    return predicted.withColumn("p", F.lit(1.0) / (F.exp(-vector_to_array("rawPrediction")[1]) + 1))


def classification(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """AUC, Brier score, log loss and accuracy on ``test``."""
    predicted = cut(score_of(CLASSIFIERS[name]().fit(weighted(train)).transform(test)).select("label", F.round("p", 9).alias("p")))
    return predicted.agg(*probability_scores("label", "p")).join(roc_auc(predicted, "label", "p"), how="cross").select(F.lit(name).alias("modelo"), "auc", "brier", "log_loss", "exactitud")


def adaboost(train: DataFrame, test: DataFrame, rounds: int = 5) -> DataFrame:
    """Scores of boosted stumps: each round weighs up the rows that the last stump got wrong, and stumps vote by the logarithm of their odds."""
    rows, votes = cut(train.select("features", "label").withColumn("weight", F.lit(1.0))), []
    for _ in range(rounds):
        stump = C.DecisionTreeClassifier(maxDepth=1, weightCol="weight", seed=42).fit(rows)
        told = stump.transform(rows).select("features", "label", "weight", (F.col("prediction") != F.col("label")).alias("_wrong"))
        wrong, total = told.agg(F.sum(F.when(F.col("_wrong"), F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
        error = min(max(wrong / total, 1e-9), 1 - 1e-9) if total else 0.5
        if error >= 0.5:
            break
        vote = math.log((1 - error) / error)
        votes.append((stump, vote))
        rows = cut(told.select("features", "label", (F.col("weight") * F.when(F.col("_wrong"), math.exp(vote)).otherwise(1.0)).alias("weight")))
    out = test.select("features", "label").withColumn("_score", F.lit(0.0))
    for stump, vote in votes:
        out = stump.transform(out).select("features", "label", (F.col("_score") + vote * (2 * F.col("prediction") - 1)).alias("_score"))
    out = out.withColumn("p", F.lit(1.0) / (F.exp(-F.col("_score")) + 1))
    return out.agg(*probability_scores("label", "p")).select(F.lit("adaboost").alias("modelo"), F.lit(len(votes)).alias("rondas"), "*")


def tree_sizes(train: DataFrame, test: DataFrame, gains: tuple[float, ...] = (0.0, 0.001, 0.01, 0.1)) -> DataFrame:
    """Leaves, depth and held-out MAE of a regression tree for growing least gains of a split, which take the place of pruning by cost."""
    out = []
    for gain in gains:
        tree = R.DecisionTreeRegressor(maxDepth=8, minInfoGain=gain, seed=42).fit(train)
        mae = RegressionEvaluator(metricName="mae").evaluate(tree.transform(test))
        out.append((gain, (tree.numNodes + 1) // 2, tree.depth, float(mae)))
    return train.sparkSession.createDataFrame(out, "ganancia double, hojas int, profundidad int, mae double")


def half_strengths(df: DataFrame, row: str, ks: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """Prediction strength by number of clusters: k-means is fitted on either half of the rows (by a hash of ``row``), and the second half's clusters are judged by the first half's model."""
    train, test = split(df, [row], 50)
    out = None
    for k in ks:
        there, here = (K.KMeans(k=k, seed=42).fit(part) for part in (train, test))
        both = there.transform(here.transform(test).withColumnRenamed("prediction", "propio")).withColumnRenamed("prediction", "ajeno")
        one = prediction_strength(both, "propio", "ajeno").select(F.lit(k).alias("k"), "fuerza")
        out = one if out is None else out.unionByName(one)
    return out


def random_search(train: DataFrame, tries: int = 6, seed: int = 42) -> DataFrame:
    """Mean cross-validated error of an elastic net at parameters drawn at random: the penalty log-uniformly, its mixture uniformly."""
    draw = random.Random(seed)
    lr = R.LinearRegression()
    maps = [{lr.regParam: 10 ** draw.uniform(-3, 1), lr.elasticNetParam: draw.random()} for _ in range(tries)]
    cv = CrossValidator(estimator=Pipeline(stages=[lr]), estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="mae"), numFolds=3, seed=seed, parallelism=2).fit(train)
    rows = [(float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(m)) for g, m in zip(maps, cv.avgMetrics)]
    return train.sparkSession.createDataFrame(rows, "reg double, mezcla double, mae double")


def ensembles(train: DataFrame, test: DataFrame, keys: list[str], names: tuple[str, ...] = ("logistic", "tree", "naive_bayes")) -> DataFrame:
    """Scores of hard voting, soft voting and stacking (a second-level logistic regression on the members' probabilities)."""
    first, second = split(train, keys, 50)
    models = {n: CLASSIFIERS[n]().fit(weighted(first)) for n in names}

    def members(df: DataFrame) -> DataFrame:
        for n, m in models.items():
            df = score_of(m.transform(df)).withColumn(f"p_{n}", F.col("p")).drop("p", "probability", "rawPrediction", "prediction")
        return df

    stack_in = VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="stack")
    top = C.LogisticRegression(featuresCol="stack").fit(stack_in.transform(members(second)))
    out = members(test)
    votes = sum(((F.col(f"p_{n}") >= 0.5).cast("int") for n in names), F.lit(0))
    soft = sum((F.col(f"p_{n}") for n in names), F.lit(0.0)) / len(names)
    out = score_of(top.transform(stack_in.transform(out))).withColumn("hard", (votes * 2 > len(names)).cast("double")).withColumn("soft", soft)
    rows = [out.agg(*probability_scores("label", c)).select(F.lit(n).alias("modelo"), "*") for n, c in (("hard_vote", "hard"), ("soft_vote", "soft"), ("stacking", "p"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def calibration(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of raw, Platt-scaled and isotonic probabilities of a margin classifier."""
    first, second = split(train, keys, 50)
    svm = CLASSIFIERS["svm"]().fit(first)
    margin = lambda df: svm.transform(df).withColumn("m", vector_to_array("rawPrediction")[1]).drop("prediction", "rawPrediction")
    as_vector = VectorAssembler(inputCols=["m"], outputCol="mv")
    held, seen = as_vector.transform(margin(second)), as_vector.transform(margin(test))
    platt = C.LogisticRegression(featuresCol="mv").fit(held)
    iso = R.IsotonicRegression(featuresCol="m").fit(held)
    raw = seen.withColumn("p", F.lit(1.0) / (F.exp(-F.col("m")) + 1))
    parts = [("raw", raw), ("platt", score_of(platt.transform(seen))), ("isotonic", iso.transform(seen).withColumn("p", F.col("prediction")))]
    rows = [df.agg(*probability_scores("label", "p")).select(F.lit(n).alias("modelo"), "*") for n, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def kmeans_elbow(df: DataFrame, ks: range = range(1, 20), starts: int = 1) -> DataFrame:
    """Least inertia over ``starts`` seeds for each number of clusters, and its silhouette from two clusters on."""
    out = []
    for k in ks:
        if k == 1:
            one = df.agg(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).select("s.variance", "s.count").first()
            out.append((1, float(sum(one[0])) * (one[1] - 1), None))
            continue
        model = min((K.KMeans(k=k, seed=42 + i).fit(df) for i in range(starts)), key=lambda m: m.summary.trainingCost)
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(df)))))
    return df.sparkSession.createDataFrame(out, "k int, inercia double, silueta double")


def clusterings(df: DataFrame, k: int = 4) -> DataFrame:
    """Cluster sizes under k-means, bisecting k-means (for Ward's hierarchy) and a Gaussian mixture."""
    models = [("kmeans", K.KMeans(k=k, seed=42)), ("bisecting", K.BisectingKMeans(k=k, seed=42)), ("mezcla", K.GaussianMixture(k=k, seed=42, maxIter=20))]
    out = None
    for name, m in models:
        sizes = m.fit(df).transform(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("modelo"), F.col("prediction").alias("grupo"), "filas")
        out = sizes if out is None else out.unionByName(sizes)
    return out


def grid_search(train: DataFrame) -> DataFrame:
    """Mean cross-validated error per parameter combination of an elastic net."""
    lr = R.LinearRegression()
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1, 1.0]).addGrid(lr.elasticNetParam, [0.0, 1.0]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[lr]), estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mae"), numFolds=3, seed=42, parallelism=2).fit(train)
    rows = [(float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(m)) for g, m in zip(grid, cv.avgMetrics)]
    return train.sparkSession.createDataFrame(rows, "reg double, mezcla double, mae double")
