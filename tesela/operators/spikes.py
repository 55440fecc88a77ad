"""Implausible readings per source: plausibility rules, stuck values, and peaks over a threshold.

A reading is judged as its log-ratio to the source's own level, less a seasonal shift. Peaks are residuals
beyond a per-source threshold; a generalised Pareto distribution fitted to the excesses by moments
turns a fixed risk into a cutoff per source. Readings beyond the cutoffs are candidates for spikes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.operators.instants import MONTHS, civil_days, month_length
from tesela.operators.quantiles import exact_quantile, exact_quantiles
from tesela.operators.runs import day_runs, equal_runs
from tesela.runtime import cut, fixed, lookup

#: The seasonal shift is kept within a factor of two either way, and the peak threshold at or within that
#: factor, so that every reading four times off its source's level is among the peaks.
SHIFT = math.log(2.0)


def source_ratios(rows: DataFrame, row: str, source: str, value: str, level_p: float) -> DataFrame:
    """``rows`` with a source and a positive finite ``value``, with ``level``, the exact quantile ``level_p`` of the source's values."""
    rows = rows.where(F.col(source).isNotNull() & (F.col(value) > 0) & (F.col(value) < float("inf")))
    return lookup(rows, cut(exact_quantile(rows, source, value, level_p, "level")), [source], "inner", spread=F.xxhash64(row))


def peaks_over_threshold(df: DataFrame, row: str, source: str, season: str, value: str, level_p: float, two_sided: bool, risk: float = 1e-3) -> DataFrame:
    """Residuals and tail cutoffs of positive finite readings; other rows are left out.

    Gives ``row, source, season, value`` with ``level`` (the exact quantile ``level_p`` of the source), ``residual`` (natural log-ratio to it, less the
    season's shift, at nine decimals), ``upper`` and ``lower`` (peak thresholds, exact quantiles 0.9 and 0.1 of the residuals within SHIFT), ``tail_upper`` and
    ``tail_lower`` (cutoffs that a reading passes with probability ``risk``), ``is_peak`` and ``is_beyond``. A source with fewer than two excesses, or with
    equal ones, has its threshold plus their mean as cutoff. All rows enter all statistics. Unless ``two_sided``, low
    residuals are no peaks and ``lower`` and ``tail_lower`` are null.
    """
    ratio = F.col(value) / F.col("level")
    # a ratio too small or too large for a double still has a logarithm
    logs = F.coalesce(F.when(ratio < float("inf"), F.ln(ratio)), F.ln(value) - F.ln("level"))
    raw = source_ratios(df.select(row, source, season, value), row, source, value, level_p).withColumn("_raw", logs)
    seasons = raw.groupBy(source, season).agg(F.sum("_raw").alias("_s"), F.count(F.lit(1)).alias("_k"))
    overall = seasons.groupBy(source).agg((F.sum("_s") / F.sum("_k")).alias("_mean"))
    shift = F.greatest(F.lit(-SHIFT), F.least(F.lit(SHIFT), F.col("_s") / F.col("_k") - F.col("_mean")))
    shifts = seasons.join(overall, source).select(source, F.col(season).alias("_season"), shift.alias("_shift"))
    shifts = shifts.withColumn("_season", F.coalesce(F.col("_season").cast("string"), F.lit("")))
    resid = lookup(raw.withColumn("_season", F.coalesce(F.col(season).cast("string"), F.lit(""))), cut(shifts), [source, "_season"], "inner", spread=F.xxhash64(row))
    resid = cut(resid.withColumn("residual", F.round(F.col("_raw") - F.col("_shift"), 9)).drop("_raw", "_shift", "_season"))
    bounds = exact_quantiles(resid, source, "residual", {"_q9": 0.9} | ({"_q1": 0.1} if two_sided else {}))
    lower = F.greatest(F.lit(-SHIFT), F.round("_q1", 9)) if two_sided else F.lit(None).cast("double")
    bounds = bounds.select(source, lower.alias("lower"), F.least(F.lit(SHIFT), F.round("_q9", 9)).alias("upper"))
    marked = lookup(resid, cut(bounds), [source], "inner", spread=F.xxhash64(row))
    over, under = F.col("residual") - F.col("upper"), F.col("lower") - F.col("residual")
    tails = marked.groupBy(source).agg(
        F.count(F.lit(1)).alias("_n"), F.max("upper").alias("_up"), F.max("lower").alias("_lowr"),
        *[f(F.when(x > 0, x)).alias(f"_{side}_{n}") for side, x in (("hi", over), ("lo", under)) for n, f in (("k", F.count), ("m", F.avg), ("v", F.var_samp))],
    )

    def beyond(side: str) -> Column:
        """The excess that is passed with probability ``risk``, by the moment fit of a generalised Pareto distribution."""
        k, m, v = (F.col(f"_{side}_{x}") for x in "kmv")
        shape = (F.lit(1.0) - m * m / v) / 2
        scale = m * (m * m / v + 1) / 2
        share = F.lit(risk) * F.col("_n") / k
        pareto = F.when(F.abs(shape) < 1e-6, -scale * F.ln(share)).otherwise(scale / shape * (F.pow(share, -shape) - 1))
        return F.when(k == 0, 0.0).when((k < 2) | (v <= 1e-12) | (share >= 1), m).otherwise(pareto)

    cutoffs = tails.select(source, F.col("_up").alias("upper"), F.col("_lowr").alias("lower"), F.round(F.col("_up") + beyond("hi"), 9).alias("tail_upper"), F.round(F.col("_lowr") - beyond("lo"), 9).alias("tail_lower"))
    out = lookup(resid, cut(cutoffs), [source], "inner", spread=F.xxhash64(row))
    passes = lambda up, low: (F.col("residual") > F.col(up)) | F.coalesce(F.col("residual") < F.col(low), F.lit(False))
    return out.withColumn("is_peak", passes("upper", "lower")).withColumn("is_beyond", passes("tail_upper", "tail_lower"))


def spike_candidates(df: DataFrame, row: str, source: str, season: str, value: str, level_p: float, two_sided: bool, times: float, risk: float = 0.05) -> DataFrame:
    """The rows of ``peaks_over_threshold`` beyond their source's tail cutoffs, among them every reading more than ``times`` off its level.

    Wrong readings are part of the tail that is fitted, so ``risk`` should be some times their share. A reading ``times`` off
    has a log-ratio past ``ln(times)``, of which its season takes SHIFT at most; a cutoff that lies farther out than what
    remains is held there, less room for the rounding of residuals.
    """
    reach = F.lit(math.log(times) - SHIFT - 1e-8)
    scored = peaks_over_threshold(df, row, source, season, value, level_p, two_sided, risk)
    high = F.col("residual") > F.least(reach, "tail_upper")
    low = F.col("residual") < F.greatest(-reach, "tail_lower")
    return scored.where(high | low if two_sided else high)


def rain_readings(sheets: DataFrame) -> DataFrame:
    """Hand-copied sheets as ``fila, fuente, fecha, mes, valor``: readable numbers on real dates, other rows left out.

    A number may use a decimal comma, blanks and a trailing mm; a month may be a name or a number; a
    two-digit year is 20xx.
    """
    number = F.regexp_extract(F.col("lluvia_mm"), r"(?i)^[\s ]*([-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+))[\s ]*(?:mm\.?)?[\s ]*$", 1)
    names = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for n in v for x in (n, k)])
    month_text = F.lower(F.trim("mes_extraido"))
    y, m, d = F.trim(F.col("año_extraido")).try_cast("int"), F.coalesce(F.try_element_at(names, month_text), month_text.try_cast("int")), F.trim("dia").try_cast("int")
    rows = fixed(sheets.select("row_idx", "pluviometro", "lluvia_mm", "`año_extraido`", "mes_extraido", "dia"), _v=F.translate(number, ",", ".").try_cast("double"), _y=F.when(y < 100, y + 2000).otherwise(y), _m=m, _d=d)
    rows = rows.where((F.col("_y") >= 1) & (F.col("_y") <= 9999) & (F.col("_d") >= 1) & (F.col("_d") <= month_length(F.col("_y"), F.col("_m"))) & F.col("_v").isNotNull())
    day = F.date_from_unix_date(civil_days(F.col("_y"), F.col("_m"), F.col("_d")).cast("int"))
    return rows.select(F.col("row_idx").alias("fila"), F.col("pluviometro").alias("fuente"), day.alias("fecha"), F.col("_m").alias("mes"), F.col("_v").alias("valor"))


def rain_flags(readings: DataFrame, stuck_days: int = 5, top_mm: float = 1825.0, times: float = 4.0) -> DataFrame:
    """``fila, clase`` of wrong rain readings: impossible, else stuck, else spike.

    Stuck covers all rows of the days of a run. Spikes are the candidates beyond the gauge's tail cutoff that pass ``times`` its 90th
    percentile of positive possible readings. Readings without a gauge can only be impossible.
    """
    readings = cut(readings)
    impossible = (F.col("valor") < 0) | (F.col("valor") > top_mm) | F.isnan("valor")
    possible = readings.where(~impossible)
    stuck = day_runs(possible.where("valor > 0"), "fuente", "fecha", "valor").where(F.col("run_length") >= stuck_days).select("fuente", "fecha", "valor", F.lit(True).alias("_stuck"))
    candidates = spike_candidates(possible, "fila", "fuente", "mes", "valor", 0.9, False, times)
    spikes = candidates.where(F.col("valor") > times * F.col("level")).select("fila", F.lit(True).alias("_spike"))
    marked = readings.join(stuck, ["fuente", "fecha", "valor"], "left").join(spikes, "fila", "left")
    kind = F.when(impossible, "impossible").when(F.col("_stuck"), "stuck").when(F.col("_spike"), "spike")
    return marked.select("fila", kind.alias("clase")).where("clase is not null")


def route_answers(cache: DataFrame) -> DataFrame:
    """Route answers with status ok as ``fila, fuente, orden, hora, metros, valor, ritmo``."""
    asked = F.try_to_timestamp("requested_at")
    rows = cache.where(F.col("routing_status") == "ok")
    micros = F.unix_micros(asked)
    return rows.select(F.col("cache_row_id").alias("fila"), F.col("sede_id").alias("fuente"), micros.alias("orden"), F.hour(asked).alias("hora"), F.col("distance_m").alias("metros"), F.col("duration_s").alias("valor"), F.try_divide("duration_s", "distance_m").alias("ritmo"))


def _impossible_route(top_s: float, top_kmh: float) -> Column:
    v = F.col("valor")
    return v.isNull() | F.isnan(v) | (v <= 0) | (v > top_s) | F.coalesce(F.col("metros") / 1000 > top_kmh * v / 3600, F.lit(False))


def possible_answers(answers: DataFrame, top_s: float = 86_400.0, top_kmh: float = 250.0) -> DataFrame:
    """The answers whose duration can be true."""
    return answers.where(~_impossible_route(top_s, top_kmh))


def route_flags(answers: DataFrame, stuck_rows: int = 5, top_s: float = 86_400.0, top_kmh: float = 250.0, times: float = 4.0) -> DataFrame:
    """``fila, clase`` of wrong route durations: impossible, else stuck, else spike.

    A null duration is not finite. An answer without a positive distance has no pace and can't be a spike. Spikes are the candidates
    beyond the source's tail cutoffs on either side that are ``times`` off its median pace.
    """
    answers = cut(answers)
    impossible = _impossible_route(top_s, top_kmh)
    stuck = equal_runs(answers, "fila", "fuente", "orden", "valor").where(F.col("run_length") >= stuck_rows).select("fila", F.lit(True).alias("_stuck"))
    candidates = spike_candidates(answers.where(~impossible), "fila", "fuente", "hora", "ritmo", 0.5, True, times)
    off = (F.col("ritmo") > times * F.col("level")) | (F.col("ritmo") < F.col("level") / times)
    spikes = candidates.where(off).select("fila", F.lit(True).alias("_spike"))
    kind = F.when(impossible, "impossible").when(F.col("_stuck"), "stuck").when(F.col("_spike"), "spike")
    return answers.join(stuck, "fila", "left").join(spikes, "fila", "left").select("fila", kind.alias("clase")).where("clase is not null")


def tail_readings(rows: DataFrame, season: str, value: str, level_p: float, two_sided: bool, risk: float = 1e-3) -> DataFrame:
    """``fila, fuente, residuo, corte_bajo, corte_alto, pico, fuera`` for each reading: whether it is a peak, and whether it lies beyond its source's tail cutoffs at ``risk``."""
    scored = peaks_over_threshold(rows, "fila", "fuente", season, value, level_p, two_sided, risk)
    return scored.select("fila", "fuente", F.col("residual").alias("residuo"), F.col("tail_lower").alias("corte_bajo"), F.col("tail_upper").alias("corte_alto"), F.col("is_peak").alias("pico"), F.col("is_beyond").alias("fuera"))


def tail_cutoffs(readings: DataFrame) -> DataFrame:
    """Per source of ``tail_readings``: readings, peaks and readings beyond the cutoffs."""
    total = lambda c: F.sum(F.col(c).cast("bigint"))
    return readings.groupBy("fuente").agg(F.count(F.lit(1)).alias("lecturas"), total("pico").alias("picos"), total("fuera").alias("fuera"))
