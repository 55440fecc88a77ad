"""Column functions: each maps columns to a column inside generated code, no Python worker.

Nulls give null unless a docstring says otherwise; unreadable texts give null, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesela.operators.instants import MONTHS

# Accented capitals and their plain letters.
ACCENTED, PLAIN = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC"


def hhmm(text: Column) -> Column:
    """``HH:MM`` from the last four digits of a text, padded on the left; null unless a time of day."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    last = F.right(F.concat(F.lit("0000"), digits), F.lit(4))
    good = (F.length(digits) > 0) & (F.substring(last, 1, 2) <= "23") & (F.substring(last, 3, 2) <= "59")
    return F.when(good, F.concat(F.substring(last, 1, 2), F.lit(":"), F.substring(last, 3, 2)))


def at_hhmm(day: Column, time: Column) -> Column:
    """A date text ``yyyy-MM-dd`` and an ``HH:MM`` text as a timestamp without zone; midnight without a time."""
    stamp = F.concat(day, F.lit(" "), F.coalesce(time, F.lit("00:00")))
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def service_name(text: Column, missing: str = "SIN_SERVICIO") -> Column:
    """Upper case without accents and with single blanks; ``missing`` for null or blank."""
    plain = F.translate(F.upper(F.trim(F.regexp_replace(text, "\\s+", " "))), ACCENTED, PLAIN)
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(missing))


def service_label(text: Column) -> Column:
    """Trimmed upper case; null for blank. Keeps accents."""
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def month_number(name: Column) -> Column:
    """Number of a month name, ignoring case and outer blanks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in MONTHS.items() for n in v for x in (n, k)]), F.lower(F.trim(name)))


def date_of(y: Column, m: Column, d: Column) -> Column:
    """A date from its parts; null if there is no such day."""
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def number_or_null(text: Column) -> Column:
    """A double; null for text that is none, and for NaN."""
    v = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def coordinate(text: Column) -> Column:
    """A coordinate text with decimal comma or point as a double."""
    return F.trim(F.replace(text, F.lit(","), F.lit("."))).try_cast("double")


def composite_key(*parts: Column) -> Column:
    """Whole numbers joined by ``-``, one that is none written as ``<NA>``; never null."""
    return F.concat_ws("-", *[F.coalesce(p.try_cast("bigint").cast("string"), F.lit("<NA>")) for p in parts])


def place_key(lat: Column, lon: Column) -> Column:
    """``lat_lon`` at five decimals."""
    return F.format_string("%.5f_%.5f", F.bround(lat, 5), F.bround(lon, 5))


def minutes_between(a: Column, b: Column) -> Column:
    """Absolute minutes between two timestamps."""
    return F.abs(F.timestamp_diff("SECOND", a, b)) / 60.0


def season(day: Column) -> Column:
    """Quarter of the calendar year, 1 to 4."""
    return (F.floor((F.month(day) - 1) / 3) + 1).cast("int")


def rain_code(code: Column) -> Column:
    """Kind of an observation code: missing, plain_a, evento_intenso, marca_horaria, otro_codigo; never null."""
    text = F.upper(F.regexp_replace(F.coalesce(code, F.lit("")), "\\s", ""))
    return F.when(text == "", "missing").when(text == "A", "plain_a").when(text.contains("R"), "evento_intenso").when(text.rlike("[=°/]"), "marca_horaria").otherwise("otro_codigo")


def binned(v: Column, ends: list[tuple[float, str]], above: str, missing: str) -> Column:
    """Label of the first bin whose closed upper end holds ``v``; ``above`` beyond the last, ``missing`` for null."""
    return reduce(lambda acc, e: acc.when(v <= e[0], e[1]), ends, F.when(v.isNull(), missing)).otherwise(above)


def rain_level(mm: Column) -> Column:
    """Rain class of the daily panel: dry, light to 10 mm, moderate to 30 mm, intense."""
    return binned(mm, [(0.0, "seco"), (10.0, "leve"), (30.0, "moderada")], "intensa", "sin_dato")


def rain_bucket(mm: Column) -> Column:
    """Rain class of the exploration: 0, to 5, to 20, more."""
    return binned(mm, [(0.0, "0"), (5.0, "0-5"), (20.0, "5-20")], ">20", "sin_dato")


def first_present(*values: Column) -> Column:
    """The first text that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def source_label(*branches: tuple[str, Column], last: str = "global_fallback") -> Column:
    """Which of several columns a coalesce takes: the name of the first that is not null, else ``last``."""
    return reduce(lambda acc, b: acc.when(b[1].isNotNull(), b[0]), branches[1:], F.when(branches[0][1].isNotNull(), branches[0][0])).otherwise(last)


def scaled(v: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Linear scaling of [low, high]; a null goes to the lower end, a flat range to the middle."""
    inside = F.lit(to_low) + (v - low) / F.nullif(high - low, F.lit(0.0)) * (to_high - to_low)
    return F.when(v.isNull(), to_low).when(high == low, (to_low + to_high) / 2).otherwise(inside)


def palette_bin(share: Column, colours: int) -> Column:
    """Equal-width bin number of a share from 0 to 1."""
    return F.least(F.floor(share * colours), F.lit(colours - 1)).cast("int")


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is 0."""
    return F.try_divide(a, F.nullif(b, b * 0))


def thousands(v: Column) -> Column:
    """A whole number with points between thousands; a dash for null."""
    return F.coalesce(F.translate(F.format_number(v, 0), ",", "."), F.lit("—"))


def logistic(margin: Column) -> Column:
    """``1 / (1 + exp(-x))``."""
    return F.lit(1.0) / (F.exp(-margin) + 1)


def distance(kind: str, a: Column, b: Column, p: float = 3.0) -> Column:
    """Euclidean, manhattan, chebyshev or minkowski distance of two arrays of equal length."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = lambda f: F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + f(g))
    if kind == "euclidean":
        return F.sqrt(total(lambda g: g * g))
    if kind == "manhattan":
        return total(lambda g: g)
    if kind == "chebyshev":
        return F.array_max(gaps)
    return F.pow(total(lambda g: F.pow(g, F.lit(p))), F.lit(1.0 / p))


def plane_km(lat: Column, lon: Column, ref_lat: float) -> tuple[Column, Column]:
    """Local kilometres north and east of the origin, on a plane that fits near ``ref_lat``."""
    import math

    return lat * 110.574, lon * (111.320 * math.cos(math.radians(ref_lat)))


def feature_family(name: str) -> str:
    """Family of a feature by its column name: the first rule that fits."""
    if name.startswith("y_"):
        return "target"
    for mark, family in (("_lag_", "lag"), ("_roll_", "rolling")):
        if mark in name:
            return family
    if name.startswith("lluvia") or name in ("llovio", "observacion_codigo"):
        return "weather"
    if name in ("fecha", "day_of_week", "month", "quarter", "is_weekend", "zona_id", "cluster_root"):
        return "calendar_or_key"
    return "zone_or_claims" if name.startswith(("zona_", "reclamos_")) else "base_feature"


def title_case(text: Column) -> Column:
    """First letter of each word upper case, the others lower, single blanks between."""
    return F.initcap(F.trim(F.regexp_replace(text, "\\s+", " ")))


def number_or_error(text: Column) -> Column:
    """A double; null stays null, and text that is no number raises when the row is read."""
    v = text.cast("string")
    number = F.trim(v).try_cast("double")
    return F.when(v.isNull(), None).when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a number: "), v)).cast("double"))


def run_id(at) -> str:
    """Name of a run by its UTC time, as ``20250131T235959Z``."""
    import datetime as dt

    return at.astimezone(dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
