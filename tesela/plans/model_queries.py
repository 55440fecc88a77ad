"""Model queries over whole tables. Least squares and Gaussian naive Bayes have SQL twins, by normal equations and by
moments; the scores of the others depend on the optimiser and are tested on planted signals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.operators import metrics, models, panel, windows
from tesela.plans import panel_queries
from tesela.plans.registry import Registry
from tesela.sources.tables import table

query = Registry()
FEATURES = ["reclamos_count_lag_1", "reclamos_count_lag_7", "tiempo_total_operativo_min_lag_1", "tiempo_total_operativo_min_roll_7_mean", "costo_total_compuesto_ars_lag_1", "costo_total_compuesto_ars_roll_28_mean", "lluvia_mm_lag_1", "lluvia_mm_roll_7_mean", "day_of_week", "month", "quarter"]
TARGETS = [f"y_{m}_t1" for m in panel.TARGETS.values()]


def _panel(spark, d):
    rows = panel.calendar_features(panel.supervised(panel_queries.zone_panel(spark, d))).where("target_available_t1")
    return windows.forward_filled(rows, "zona_id", "fecha", FEATURES).dropna(subset=[*FEATURES, *TARGETS])


def _regression(spark, d):
    return models.split(models.assembled(_panel(spark, d), FEATURES, "y_reclamos_count_t1"), ["zona_id", "fecha"])


def _binary(spark, d):
    rows = _panel(spark, d).withColumn("hay", (F.col("y_reclamos_count_t1") > 0).cast("double"))
    return models.split(models.assembled(rows, FEATURES, "hay"), ["zona_id", "fecha"])


def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


_CALENDAR = {"day_of_week": "isodow(fecha) - 1", "month": "month(fecha)", "quarter": "quarter(fecha)"}
_UNIT = {f: 1e4 if f.startswith("costo") else 1e2 if f.startswith("tiempo") else 1.0 for f in FEATURES}  # keeps the elimination exact enough; least squares don't depend on it
_ROWS = (
    panel_queries._SUPERVISED
    + ", w as (select zona_id, fecha, "
    + ", ".join(f"cast({_CALENDAR[c]} as double) as {c}" if c in _CALENDAR else f"cast(coalesce({c}, last_value({c} ignore nulls) over v) as double) as {c}" for c in FEATURES)
    + ", cast(y_reclamos_count_t1 as double) as y, ('0x' || md5(zona_id || '|' || fecha)[1:8])::bigint % 100 as parte from s where target_available_t1 window v as (partition by zona_id order by fecha rows unbounded preceding)), "
    + f"x as (select zona_id, fecha, parte, y, [1.0, {', '.join(f'{f} / {_UNIT[f]}' for f in FEATURES)}]::double[] as v, [1.0, {', '.join(FEATURES)}]::double[] as u from w where "
    + " and ".join(f"{c} is not null" for c in [*FEATURES, "y"])
    + ")"
)
_N = len(FEATURES) + 1


def _solved(name: str, train: str, ridge: bool = False) -> str:
    """CTE ``<name>_b`` with the least-squares coefficients ``b`` (intercept first) on the rows of x where ``train``: the normal equations by elimination.

    A ridge of 1 is measured in standard deviations of the features and of the target, as in the library."""
    more = lambda i, j: f" + count(*) * var_pop(v[{i}]) / stddev_pop(y)" if ridge and i == j > 1 else ""
    gram = ", ".join("[" + ", ".join([f"sum(v[{i}] * v[{j}]){more(i, j)}" for j in range(1, _N + 1)] + [f"sum(v[{i}] * y)"]) + "]" for i in range(1, _N + 1))
    step = f"list_transform(range(1, {_N + 1}), lambda i: case when i = k then list_transform(m[k], lambda z: z / m[k][k]) else list_transform(range(1, {_N + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) end)"
    return f"{name}_g as (select [{gram}] as m from x where {train}), {name}_e as (select 1 as k, m from {name}_g union all select k + 1, {step} from {name}_e where k <= {_N}), {name}_b as (select list_transform(m, lambda r: r[{_N + 1}]) as b from {name}_e where k = {_N + 1})"


_ERRORS = "count(e) as filas, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(coalesce(sum(abs(e)) / nullif(sum(abs(y)), 0), 0), 6) as wmape, round(avg(abs(e) / nullif(abs(y), 0)), 6) as mape, round(1 - sum(e * e) / nullif(var_pop(y) * count(e), 0), 6) as r2"


def _scored(name: str, test: str) -> str:
    return f"(select y, y - list_dot_product(v, b) as e from x, {name}_b where {test})"


def _linear(train: str, test: str, ridge: bool = False) -> str:
    return _ROWS.replace("\nwith ", "\nwith recursive ", 1) + ", " + _solved("a", train, ridge) + f" select '{'ridge' if ridge else 'linear'}' as modelo, {_ERRORS} from {_scored('a', test)}"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "wmape", "mape", "r2")})


def _fit(name):
    def fit(spark, d):
        return _rounded(models.regression(*_regression(spark, d), name))

    fit.__name__ = f"fit_{name}"
    fit.__doc__ = f"Held-out error of the {name} regressor for next-day claims."
    query(_linear("parte < 70", "parte >= 70", name == "ridge") if name in ("linear", "ridge") else None)(fit)


for _name in models.REGRESSORS:
    _fit(_name)


_F = range(2, _N + 1)
_BAYES = (
    _ROWS
    + f", c as (select y > 0 as c, count(*) as k, [{', '.join(f'avg(u[{i}])' for i in _F)}] as mu, [{', '.join(f'var_pop(u[{i}])' for i in _F)}] as va from x where parte < 70 group by 1), "
    + f"e as (select 1e-9 * greatest({', '.join(f'var_pop(u[{i}])' for i in _F)}) as e from x where parte < 70), "
    + "g as (select zona_id, fecha, y > 0 as y, c.c, ln(cast(k as double)) + "
    + " + ".join(f"(-0.5 * ln(2 * pi() * (va[{i - 1}] + e)) - pow(u[{i}] - mu[{i - 1}], 2) / (2 * (va[{i - 1}] + e)))" for i in _F)
    + " as l from x, c, e where parte >= 70), "
    "qq as (select cast(any_value(y) as integer) as y, round(1 / (1 + exp(max(l) filter (where not c) - max(l) filter (where c))), 9) as p from g group by zona_id, fecha), "
    "t as (select p, sum(count(*) filter (where y = 1)) over w / sum(count(*) filter (where y = 1)) over () as tpr, sum(count(*) filter (where y = 0)) over w / sum(count(*) filter (where y = 0)) over () as fpr from qq group by p window w as (order by p desc rows unbounded preceding)), "
    "a as (select (fpr - coalesce(lag(fpr) over w, 0)) * (tpr + coalesce(lag(tpr) over w, 0)) / 2 as x from t window w as (order by p desc)), z as (select y, p, least(greatest(p, 1e-15), 1 - 1e-15) as s from qq) "
    "select 'naive_bayes' as modelo, (select round(sum(x), 6) from a) as auc, round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(s) + (1 - y) * ln(1 - s))), 6) as log_loss, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as exactitud from z"
)


def _classify(name):
    def classify(spark, d):
        out = models.classification(*_binary(spark, d), name)
        return out.withColumns({c: F.round(c, 6) for c in ("auc", "brier", "log_loss", "exactitud")})

    classify.__name__ = f"classify_{name}"
    classify.__doc__ = f"Held-out scores of the {name} classifier for any claim next day."
    query(_BAYES if name == "naive_bayes" else None)(classify)


for _name in models.CLASSIFIERS:
    _classify(_name)


@query()
def fit_hurdle(spark, d):
    """Held-out error of the hurdle model."""
    return models.hurdle(*_regression(spark, d))


_CUT = "date '2025-04-01'"


def _out_of_time(spark, d):
    rows = models.assembled(_panel(spark, d), FEATURES, "y_reclamos_count_t1")
    return rows.where("fecha < date'2025-04-01'"), rows.where("fecha >= date'2025-04-01'")


@query(_linear(f"fecha < {_CUT}", f"fecha >= {_CUT}"))
def fit_out_of_time(spark, d):
    """Error of the linear regressor on the days from a cut date on."""
    return _rounded(models.regression(*_out_of_time(spark, d), "linear"))


@query(
    _ROWS.replace("\nwith ", "\nwith recursive ", 1)
    + f", {_solved('a', 'parte < 70')}, {_solved('t', f'fecha < {_CUT}')}, r as (select {_ERRORS} from {_scored('a', 'parte >= 70')}), o as (select {_ERRORS} from {_scored('t', f'fecha >= {_CUT}')}) "
    "select 'linear' as modelo, r.mae as mae_azar, o.mae as mae_tiempo, r.wmape as wmape_azar, o.wmape as wmape_tiempo, round(o.wmape - r.wmape, 6) as diferencia from r, o"
)
def fit_comparison(spark, d):
    """The linear regressor's error on random days beside that on later days."""
    split = {"azar": _regression(spark, d), "tiempo": _out_of_time(spark, d)}
    azar, tiempo = (_rounded(models.regression(*parts, "linear")).select("modelo", F.col("mae").alias(f"mae_{n}"), F.col("wmape").alias(f"wmape_{n}")) for n, parts in split.items())
    return azar.join(tiempo, "modelo").withColumn("diferencia", F.round(F.col("wmape_tiempo") - F.col("wmape_azar"), 6))


@query(
    panel_queries._FORECAST.replace("\nwith ", "\nwith recursive ", 1)
    + _ROWS[len(panel_queries._PANEL):]
    + f", {_solved('a', 'parte < 70')}, hh as (select y_reclamos as y, y_reclamos - base_reclamos as e from b join x on b.zona_id = x.zona_id and b.fecha = x.fecha where parte >= 70) "
    f"select *, row_number() over (order by wmape, modelo) as puesto from (select 'linear' as modelo, {_ERRORS} from {_scored('a', 'parte >= 70')} union all select 'heuristico', {_ERRORS} from hh)"
)
def fit_synthesis(spark, d):
    """The heuristic forecast and the linear regressor on the same held-out days, ranked."""
    train, test = _regression(spark, d)
    linear = _rounded(models.regression(train, test, "linear"))
    held = panel_queries.forecast(spark, d).join(test.select("zona_id", "fecha"), ["zona_id", "fecha"])
    heuristic = _rounded(held.agg(*metrics.regression_scores("y_reclamos", "base_reclamos")).select(F.lit("heuristico").alias("modelo"), "*"))
    return linear.unionByName(heuristic).withColumn("puesto", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("wmape", "modelo")))  # two rows


@query(
    _ROWS.replace("\nwith ", "\nwith recursive ", 1)
    + f", {_solved('a', 'parte < 70')}, d as (select "
    + ", ".join(f"stddev_samp(v[{i + 2}]) as s{i}" for i in range(len(FEATURES)))
    + " from x where parte < 70) "
    + " union all ".join(f"select '{c}' as variable, round(b[{i + 2}] * s{i}, 6) as coeficiente from a_b, d" for i, c in enumerate(FEATURES))
)
def linear_coefficients(spark, d):
    """Standardised coefficients ranked by size."""
    return models.coefficients(_regression(spark, d)[0], FEATURES).withColumn("coeficiente", F.round("coeficiente", 6))


@query()
def forest_importances(spark, d):
    """Random-forest importances."""
    return models.importances(_regression(spark, d)[0], FEATURES)


@query()
def fit_ensembles(spark, d):
    """Hard vote, soft vote and stacking."""
    return models.ensembles(*_binary(spark, d), ["fecha", "zona_id"])


@query()
def fit_calibration(spark, d):
    """Raw, Platt and isotonic probabilities."""
    return models.calibration(*_binary(spark, d), ["fecha", "zona_id"])


@query()
def fit_adaboost(spark, d):
    """Held-out scores of boosted stumps."""
    return models.adaboost(*_binary(spark, d))


@query()
def fit_tree_sizes(spark, d):
    """Leaves and held-out error of a tree by the least gain of a split."""
    return models.tree_sizes(*_regression(spark, d))


@query()
def fit_random_search(spark, d):
    """Cross-validated error at random parameters."""
    return models.random_search(_regression(spark, d)[0])


@query()
def fit_half_strengths(spark, d):
    """Prediction strength of k-means by halves."""
    return models.half_strengths(_vectors(spark, d), "vec_id")


@query()
def fit_kmeans_elbow(spark, d):
    """Inertia and silhouette by number of clusters."""
    return models.kmeans_elbow(_vectors(spark, d))


@query()
def fit_clusterings(spark, d):
    """Cluster sizes of three clusterings."""
    return models.clusterings(_vectors(spark, d))


@query()
def fit_grid_search(spark, d):
    """Cross-validated error per parameter combination."""
    return models.grid_search(_regression(spark, d)[0])


QUERIES, ORACLES = query.QUERIES, query.ORACLES
