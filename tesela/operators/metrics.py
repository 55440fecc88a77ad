"""Scores of classifiers, regressors and clusterings as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.operators.ranking import ordered, with_totals
from tesela.runtime import cut


def regression_scores(actual: str, predicted: str) -> list[Column]:
    """Rows, MAE, RMSE, WMAPE (0 where there is no actual), MAPE (over actuals other than 0), R2."""
    a, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted).cast("double")
    return [
        F.count(e).alias("filas"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.coalesce(F.sum(F.abs(e)) / F.nullif(F.sum(F.when(e.isNotNull(), F.abs(a))), F.lit(0.0)), F.lit(0.0)).alias("wmape"),
        F.avg(F.try_divide(F.abs(e), F.nullif(F.abs(a), F.lit(0.0)))).alias("mape"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(F.when(e.isNotNull(), a)) * F.count(e), F.lit(0.0))).alias("r2"),
    ]


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion counts and the rates from them; a rate without cases is null."""
    y, p = F.col(label), F.col(predicted)
    n = df.agg(F.count_if((y == 1) & (p == 1)).alias("vp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 0) & (p == 0)).alias("vn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    r = lambda a, b: F.try_divide(a, b)
    vp, fp, vn, fn = (F.col(c) for c in ("vp", "fp", "vn", "fn"))
    return n.select("*", r(vp, vp + fn).alias("sensibilidad"), r(vn, vn + fp).alias("especificidad"), r(vp, vp + fp).alias("precision"), r(vp + vn, vp + vn + fp + fn).alias("exactitud"), r(2 * vp, 2 * vp + fp + fn).alias("f1"), ((r(vp, vp + fn) + r(vn, vn + fp)) / 2).alias("exactitud_balanceada"))


def by_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """``umbral, orden, tpr, fpr`` for each distinct score taken as threshold. Scores are aggregated first."""
    counts = df.groupBy(F.col(score).alias("umbral")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    upto = with_totals(ordered(counts, [F.desc("umbral")], "orden", {"_tp": "_p", "_fp": "_q"}), {"_all_p": F.sum("_p"), "_all_q": F.sum("_q")})
    return upto.select("umbral", "orden", F.try_divide("_tp", "_all_p").alias("tpr"), F.try_divide("_fp", "_all_q").alias("fpr"))


def youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold with the greatest TPR - FPR; of equals the highest."""
    return by_threshold(df, label, score).select("umbral", "tpr", "fpr", (F.col("tpr") - F.col("fpr")).alias("j")).orderBy(F.desc("j"), F.desc("umbral")).limit(1)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule over distinct scores."""
    t = cut(by_threshold(df, label, score))
    last = t.select((F.col("orden") + 1).alias("orden"), F.col("tpr").alias("_t"), F.col("fpr").alias("_f"))
    area = (F.col("fpr") - F.coalesce("_f", F.lit(0.0))) * (F.col("tpr") + F.coalesce("_t", F.lit(0.0))) / 2
    return t.join(last, "orden", "left").select(area.alias("a")).agg(F.sum("a").alias("auc"))


def probability_scores(label: str, p: str) -> list[Column]:
    """Brier score, log loss (probabilities kept off 0 and 1), accuracy at one half."""
    y, q = F.col(label).cast("double"), F.col(p)
    safe = F.least(F.greatest(q, F.lit(1e-15)), F.lit(1 - 1e-15))
    return [F.avg((q - y) * (q - y)).alias("brier"), F.avg(-(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))).alias("log_loss"), F.avg(F.when((q >= 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("exactitud")]


def reliability(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed share per equal-width probability bin; empty bins are left out."""
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("tramo")).agg(F.count(F.lit(1)).alias("filas"), F.avg(p).alias("prob_media"), F.avg(F.col(label).cast("double")).alias("observado"))


def prediction_strength(df: DataFrame, test: str, train: str) -> DataFrame:
    """The least share, over test clusters of two or more, of member pairs that the train model also puts together; from counts, without pairs."""
    n = df.groupBy(test, train).agg(F.count(F.lit(1)).alias("n"))
    each = n.groupBy(test).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("juntos"), F.sum("n").alias("total"))
    return each.where("total > 1").select((F.col("juntos") / (F.col("total") * (F.col("total") - 1))).alias("s")).agg(F.min("s").alias("fuerza"))


def silhouette_squared(df: DataFrame, row: str, vector: str, cluster: str) -> DataFrame:
    """``row, silueta`` per point with squared euclidean distance, from cluster sums: mean squared distance to a cluster needs only its size, sum and sum of squares.

    Clusters are few; a point of a cluster of one has 0.
    """
    dims = df.select(row, F.col(cluster).alias("_c"), F.posexplode(F.col(vector)).alias("_d", "_x")).withColumn("_x", F.col("_x").cast("double"))
    means = dims.groupBy("_c", "_d").agg(F.avg("_x").alias("_m"), F.avg(F.col("_x") * F.col("_x")).alias("_q"))
    clusters = means.groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_mean"), F.sum("_q").alias("_sq"))
    sizes = df.groupBy(F.col(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    table = clusters.join(sizes, "_c").agg(F.collect_list(F.struct("_c", "_mean", "_sq", "_n")).alias("_t"))
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    gap = lambda t: F.aggregate(F.zip_with("_x", t["_mean"], lambda a, b: a * a - 2 * a * b), F.lit(0.0), lambda s, v: s + v) + t["_sq"]
    rows = df.select(row, F.col(cluster).alias("_own"), x.alias("_x")).join(F.broadcast(table), how="cross").withColumn("_g", F.transform("_t", lambda t: F.struct(t["_c"].alias("c"), gap(t).alias("g"), t["_n"].alias("n"))))
    own = F.filter("_g", lambda t: t["c"] == F.col("_own"))[0]
    a = own["g"] * own["n"] / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_g", lambda t: t["c"] != F.col("_own")), lambda t: t["g"]))
    return rows.select(row, F.when(own["n"] == 1, 0.0).otherwise((b - a) / F.greatest(a, b)).alias("silueta"))


def silhouette_euclidean(df: DataFrame, row: str, vector: str, cluster: str, block: int = 500) -> DataFrame:
    """``row, silueta`` per point with euclidean distance, every pair of points compared, in pairs of blocks of about ``block`` rows.

    Rows without a vector or cluster are left out; a point of a cluster of one, or with all distances zero, has 0, and where
    there is only one cluster it is null. Time grows with the square of the rows.
    """
    import numpy as np
    import pandas as pd

    def distances(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, xs, labels, ys in zip(pdf["ids"], pdf["xs"], pdf["labels"], pdf["ys"]):
            x, y = np.asarray(xs).reshape(len(ids), -1), np.asarray(ys).reshape(len(labels), -1)
            names, place = np.unique(labels, return_inverse=True)
            sums = np.array([np.bincount(place, np.sqrt(((y - v) ** 2).sum(axis=1)), len(names)) for v in x])
            out.append(pd.DataFrame({"_id": np.repeat(ids, len(names)), "_c": np.tile(names, len(ids)), "_d": sums.ravel()}))
        return pd.concat(out)

    rows = df.select(F.col(row).cast("bigint").alias("_id"), F.col(cluster).cast("bigint").alias("_own"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("_x")).dropna()
    blocks = rows.groupBy(F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-rows.count() // block)))).alias("_b")).agg(F.collect_list(F.struct("_id", "_own", "_x")).alias("_r"))
    part = lambda f: F.transform("_r", lambda r: r[f])
    left = blocks.select(F.col("_b").alias("_a"), part("_id").alias("ids"), F.flatten(part("_x")).alias("xs"))
    right = blocks.select("_b", part("_own").alias("labels"), F.flatten(part("_x")).alias("ys"))
    sums = left.crossJoin(right).groupBy("_a", "_b").applyInPandas(distances, "_id bigint, _c bigint, _d double").groupBy("_id", "_c").agg(F.sum("_d").alias("_d"))
    sizes = rows.groupBy(F.col("_own").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    each = sums.join(sizes, "_c").join(rows.select("_id", "_own"), "_id")
    own = F.col("_c") == F.col("_own")
    ab = each.groupBy("_id").agg(F.max(F.when(own, F.col("_n"))).alias("_n"), F.max(F.when(own, F.try_divide(F.col("_d"), F.col("_n") - 1))).alias("_in"), F.min(F.when(~own, F.col("_d") / F.col("_n"))).alias("_out"))
    value = F.coalesce(F.try_divide(F.col("_out") - F.col("_in"), F.greatest("_in", "_out")), F.lit(0.0))
    return ab.select(F.col("_id").alias(row), F.when(F.col("_out").isNotNull(), F.when(F.col("_n") == 1, 0.0).otherwise(value)).alias("silueta"))
