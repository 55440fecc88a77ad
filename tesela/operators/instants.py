"""Mixed spellings of points in time to one UTC instant.

All spellings are alternatives of one regular expression with named groups. One replacement by the
JVM's regex engine writes the named groups of the alternative that matched into a delimited text, so
every value is matched once, inside the generated code; ranges are then checked on integers and the
instant is assembled from day numbers. Python workers are not involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.runtime import fixed, small

# Month names by number, Spanish, English and Portuguese.
MONTHS = {
    1: ["enero", "ene", "january", "jan", "janeiro"],
    2: ["febrero", "feb", "february", "fevereiro", "fev"],
    3: ["marzo", "mar", "march", "março", "marco"],
    4: ["abril", "abr", "april", "apr"],
    5: ["mayo", "may", "maio", "mai"],
    6: ["junio", "jun", "june", "junho"],
    7: ["julio", "jul", "july", "julho"],
    8: ["agosto", "ago", "august", "aug"],
    9: ["septiembre", "setiembre", "sep", "sept", "set", "september", "setembro"],
    10: ["octubre", "oct", "october", "outubro", "out"],
    11: ["noviembre", "nov", "november", "novembro"],
    12: ["diciembre", "dic", "december", "dec", "dezembro", "dez"],
}

_W = "[\\s\\u00a0\\u202f]"
_MON = "(?:" + "|".join(sorted((n for v in MONTHS.values() for n in v), key=len, reverse=True)) + ")"
_BETWEEN = f"(?:{_W}+del?{_W}+|{_W}*[-/.,]{_W}*|\\.?{_W}+)"

_DATES = [
    "(?<y1>\\d{4})[-/.](?<m1>\\d{1,2})[-/.](?<d1>\\d{1,2})",
    "(?<y2>\\d{4})(?<m2>\\d{2})(?<d2>\\d{2})",
    "(?<a>\\d{1,2})[-/.](?<b>\\d{1,2})[-/.](?<c>\\d{4}|\\d{2})",
    f"(?<d3>\\d{{1,2}}){_BETWEEN}(?<n3>{_MON}){_BETWEEN}(?<y3>\\d{{4}}|\\d{{2}})",
    f"(?<n4>{_MON})\\.?{_W}+(?<d4>\\d{{1,2}})(?:st|nd|rd|th)?,?{_W}+(?<y4>\\d{{4}})",
    f"(?<y5>\\d{{4}}){_BETWEEN}(?<n5>{_MON}){_BETWEEN}(?<d5>\\d{{1,2}})",
]
_RUN_ON = "(?<y6>\\d{4})(?<m6>\\d{2})(?<d6>\\d{2})(?<h6>\\d{2})(?<i6>\\d{2})(?:(?<s6>\\d{2})(?:[.,]?\\d{1,9})?)?"
_TIMES = [
    "(?<h1>\\d{1,2})[:.](?<i1>\\d{2})(?:[:.](?<s1>\\d{2})(?:[.,]\\d+)?)?",
    "(?<h2>\\d{2})(?<i2>\\d{2})(?:(?<s2>\\d{2})(?:[.,]\\d+)?)?",
    "(?<h3>\\d{1,2})h(?<i3>\\d{2})?",
    f"(?<h4>\\d{{1,2}})(?={_W}*(?:[ap]{_W}*\\.?{_W}*m|hs|hrs|h\\b|horas))",
]
_HALF = f"(?:{_W}*(?<ap>[ap]){_W}*\\.?{_W}*m\\.?(?![a-z]))?(?:{_W}*(?:hs|hrs|horas|h)\\.?(?![a-z]))?"
_ZONE = f"(?:{_W}*(?<u>Z|UTC|GMT))?(?:{_W}*(?<o>[-+\\u2212]\\d{{1,2}}(?::?\\d{{2}})?))?(?:{_W}*\\[?(?<z>[A-Za-z]+(?:/[A-Za-z0-9_+-]+)*)\\]?)?"
_TIME = "(?:" + "|".join(_TIMES) + ")" + _HALF
_EPOCH = "(?<e>[-+]?\\d{9,11}|\\d{13}|\\d{16}|\\d{19})(?:\\.\\d+)?"
_DAY_NAME = f"(?:[a-z\\u00e1\\u00e9]{{2,9}}\\.?,?{_W}+)?"
_GAP = f"(?:{_W}*[T,;]{_W}*|{_W}+(?:a{_W}+las{_W}+|-{_W}+)?)"

#: Every spelling of a point in time, and of a date alone.
PATTERN = f"(?i)^{_W}*(?:{_EPOCH}|(?:{_RUN_ON}|{_DAY_NAME}(?:" + "|".join(_DATES) + f")(?:{_GAP}{_TIME})?){_ZONE}){_W}*$"
_CLOCK_DIGITS = "(?<h5>\\d{0,2}?)(?<i5>\\d{1,2})(?:\\.0?)?"
#: Every spelling of a time of day alone; digits only are read from the right as hmm or hhmm, six as hhmmss.
CLOCK = f"(?i)^{_W}*(?:(?<h7>\\d{{2}})(?<i7>\\d{{2}})(?<s7>\\d{{2}})|(?<h8>\\d)(?<i8>\\d{{2}})(?<s8>\\d{{2}})|{_CLOCK_DIGITS}|(?:" + "|".join(t for t in _TIMES if "<h2>" not in t) + f"){_HALF})(?:{_W}*(?:Z|UTC|GMT))?{_W}*$"

_MARK, _SEP = "\u001e", "\u001f"
_FIELDS = {
    "y": ["y1", "y2", "y3", "y4", "y5", "y6"],
    "m": ["m1", "m2", "m6"],
    "n": ["n3", "n4", "n5"],
    "d": ["d1", "d2", "d3", "d4", "d5", "d6"],
    "a": ["a"],
    "b": ["b"],
    "c": ["c"],
    "h": ["h1", "h2", "h3", "h4", "h6"],
    "i": ["i1", "i2", "i3", "i6"],
    "s": ["s1", "s2", "s6"],
    "ap": ["ap"],
    "u": ["u"],
    "o": ["o"],
    "z": ["z"],
    "e": ["e"],
}
_CLOCK_FIELDS = {"h": ["h1", "h3", "h4", "h5", "h7", "h8"], "i": ["i1", "i3", "i5", "i7", "i8"], "s": ["s1", "s7", "s8"], "ap": ["ap"]}


def _matched(text: Column, pattern: str, fields: dict[str, list[str]]) -> Column:
    """The named groups of the one match, marked and delimited, in the order of ``fields``; the text itself without a match."""
    to = _MARK + _SEP.join("".join(f"${{{g}}}" for g in groups) for groups in fields.values())
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def _groups(matched: Column) -> Column:
    """The groups in a text made by ``_matched`` as an array; null without a match."""
    return F.when(matched.startswith(_MARK), F.split(F.substring(matched, 2, 1_000_000), _SEP))


def _parts(array: Column, fields: dict[str, list[str]]) -> dict[str, Column]:
    return {k: F.nullif(array[i], F.lit("")) for i, k in enumerate(fields)}


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic on a year that begins in March."""
    yy = y.cast("bigint") - F.when(m <= 2, 1).otherwise(0)
    shifted = (m + F.when(m > 2, -3).otherwise(9)).cast("bigint")
    day_of_year = _div(shifted * 153 + 2, 5) + d - 1
    return yy * 365 + _div(yy, 4) - _div(yy, 100) + _div(yy, 400) + day_of_year - 719468


def month_length(y: Column, m: Column) -> Column:
    """Days of a month; null for a month outside 1 to 12."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).when(m.between(1, 12), 31)


def _month_number(name: Column) -> Column:
    by_name = [(n, k) for k, v in MONTHS.items() for n in v]
    numbers = F.create_map(*[F.lit(x) for pair in by_name for x in pair])
    return F.try_element_at(numbers, F.lower(name))


def _date_parts(p: dict[str, Column], order: Column) -> tuple[Column, Column, Column]:
    """Year, month and day as integers, unchecked. ``order`` is DMY, MDY or YMD and settles three bare numbers."""
    a, b, c = _int(p["a"]), _int(p["b"]), _int(p["c"])
    last, own = F.when(F.length(p["c"]) == 2, c + 2000).otherwise(c), F.when(F.length(p["y"]) == 2, _int(p["y"]) + 2000).otherwise(_int(p["y"]))
    short_ymd = (order == "YMD") & (F.length(p["c"]) == 2)
    y = F.when(p["a"].isNull(), own).when(short_ymd, a + 2000).otherwise(last)
    m = F.when(p["a"].isNull(), F.coalesce(_int(p["m"]), _month_number(p["n"]))).when(order == "MDY", a).otherwise(b)
    d = F.when(p["a"].isNull(), _int(p["d"])).when(short_ymd, c).when(order == "MDY", b).otherwise(a)
    return y, m, d


def _checked_days(y: Column, m: Column, d: Column) -> Column:
    """Day number of a date; null unless it exists."""
    return F.when((y >= 1) & (d >= 1) & (d <= month_length(y, m)), civil_days(y, m, d))


def _hour(p: dict[str, Column]) -> Column:
    """Hour from 0 to 23 with a. m. and p. m. applied, unchecked."""
    h, half = F.coalesce(_int(p["h"]), F.when(p["i"].isNotNull(), F.lit(0))), F.lower(p["ap"])
    return F.when(half.isNull(), h).when(h == 12, F.when(half == "a", 0).otherwise(12)).when((half == "p") & (h < 12), h + 12).otherwise(h)


def _checked_seconds(h: Column, i: Column, s: Column) -> Column:
    """Second of the day; null unless it exists."""
    return F.when(h.between(0, 23) & i.between(0, 59) & s.between(0, 59), h * 3600 + i * 60 + s).cast("bigint")


def _offset_seconds(p: dict[str, Column]) -> Column:
    """Seconds east of UTC that the text itself states as an offset, Z, UTC or GMT; else null."""
    digits = F.regexp_replace(p["o"], "[^0-9]", "")
    hours = _int(F.when(F.length(digits) <= 2, digits).otherwise(F.substring_index(F.regexp_replace(digits, "(..)$", ":$1"), ":", 1)))
    minutes = _int(F.when(F.length(digits) > 2, F.right(digits, F.lit(2))).otherwise("0"))
    sign = F.when(p["o"].startswith("+"), 1).otherwise(-1)
    return F.when(p["o"].isNotNull(), sign * (hours * 3600 + minutes * 60)).when(p["u"].isNotNull() | F.upper(p["z"]).isin("UTC", "GMT", "Z"), 0).cast("bigint")


def zone_names(spark: SparkSession) -> list[str]:
    """Names of all time zones the JVM knows."""
    return sorted(str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _known_zone(name: Column, names: list[str]) -> Column:
    """``name`` in the spelling of a known zone, whatever its case; else null."""
    known = F.from_json(F.lit("{" + ",".join(f'"{n.lower()}":"{n}"' for n in names) + "}"), "map<string,string>")
    return F.when(name.isNotNull(), F.try_element_at(known, F.lower(name)))


def _in_zone(local: Column, zone: Column) -> Column:
    """UTC seconds of a local second count: of two instants the earlier, for a skipped time the offset before the change."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def utc_seconds(df: DataFrame, stamp: str, date: str, clock: str, order: str, zone: str, out: str = "utc_s") -> DataFrame:
    """Add ``out``: the Unix second of each row, fraction cut off.

    ``stamp`` counts if it gives a real date and a time of day; else the date in ``date`` with the time in
    ``clock`` (00:00 where that is unreadable or absent). ``order`` (DMY, MDY, YMD; a null is read as DMY)
    settles bare numeric dates that do not begin with the year; ``zone`` is the IANA zone of a text that states none.
    Nulls, empty and meaningless texts, dates that do not exist, and unknown zones give null. Bare numbers
    of 9 to 11, 13, 16 or 19 digits are counts of s, ms, us or ns since 1970, those of 8, 12, 14 or more compact dates.
    Repeated rows stay; other columns are passed through, whatever their names, an earlier ``out`` excepted.
    """
    names = zone_names(df.sparkSession)
    number = {c: f"_k_{i}" for i, c in enumerate(df.columns)}  # out of the way of the helpers' names
    kept = [F.col(k).alias(c) for c, k in number.items() if c != out]
    df = df.select(*[F.col(f"`{c}`").alias(k) for c, k in number.items()])
    of = lambda c: F.col(number[c])
    order_c = F.coalesce(F.upper(F.trim(of(order))), F.lit("DMY"))
    df = fixed(df, _t_ta=_matched(of(stamp), PATTERN, _FIELDS), _t_tb=_matched(of(date), PATTERN, _FIELDS), _t_tc=_matched(of(clock), CLOCK, _CLOCK_FIELDS))
    df = fixed(df, _t_a=_groups(F.col("_t_ta")), _t_b=_groups(F.col("_t_tb")), _t_c=_groups(F.col("_t_tc")))
    a, b, c = _parts(F.col("_t_a"), _FIELDS), _parts(F.col("_t_b"), _FIELDS), _parts(F.col("_t_c"), _CLOCK_FIELDS)
    digits = F.length(F.regexp_replace(a["e"], "[^0-9]", ""))
    (ya, ma, da), (yb, mb, db) = _date_parts(a, order_c), _date_parts(b, order_c)
    second = lambda p: F.coalesce(_int(p["s"]), F.lit(0))
    minute = lambda p: F.coalesce(_int(p["i"]), F.lit(0))
    df = fixed(
        df, _t_count=a["e"].try_cast("bigint"), _t_per=F.when(digits == 19, 10**9).when(digits == 16, 10**6).when(digits == 13, 1000).otherwise(1).cast("bigint"),
        _t_ya=ya, _t_ma=ma, _t_da=da, _t_ha=_hour(a), _t_ia=minute(a), _t_sa=second(a), _t_oa=_offset_seconds(a), _t_za=a["z"],
        _t_yb=yb, _t_mb=mb, _t_db=db, _t_hc=_hour(c), _t_ic=minute(c), _t_sc=second(c), _t_ob=_offset_seconds(b),
    )
    t = lambda *names: [F.col(f"_t_{n}") for n in names]
    df = fixed(
        df,
        _t_e=F.expr("(_t_count - pmod(_t_count, _t_per)) div _t_per"),
        _t_la=_checked_days(*t("ya", "ma", "da")) * 86400 + _checked_seconds(*t("ha", "ia", "sa")),
        _t_lb=_checked_days(*t("yb", "mb", "db")) * 86400 + F.coalesce(_checked_seconds(*t("hc", "ic", "sc")), F.lit(0)),
        _t_zn=_known_zone(F.col("_t_za"), names),
        _t_zc=_known_zone(F.trim(of(zone)), names),
    )
    e, la, oa, zn, lb, ob, zc = t("e", "la", "oa", "zn", "lb", "ob", "zc")
    first = F.when(oa.isNotNull(), la - oa).when(la.isNotNull(), _in_zone(la, F.coalesce(zn, zc)))
    then = F.when(ob.isNotNull(), lb - ob).when(lb.isNotNull(), _in_zone(lb, zc))
    return fixed(df, **{out: F.coalesce(e, first, then)}).select(*kept, out)


def claim_instants(tramites: DataFrame, canales: DataFrame) -> DataFrame:
    """The UTC second of every claim's start in the manner of its channel: ``row_idx, utc_s`` for readable starts.

    ``canales`` is a reference table with one row per channel (of several the smallest counts); it is broadcast
    only after its rows are counted. A channel it lacks leaves only starts that state their own zone.
    """
    manner = canales.where(F.col("canal").isNotNull()).groupBy("canal").agg(F.min(F.struct("zona_horaria", "orden_fecha")).alias("_m")).select(F.col("canal").alias("_canal"), F.col("_m.zona_horaria").alias("_zona"), F.col("_m.orden_fecha").alias("_orden"))
    rows = tramites.select("row_idx", "canal", "dt_inicio", "fechainicio", "horainicio")
    joined = rows.join(small(manner), F.col("canal") == F.col("_canal"), "left")
    return utc_seconds(joined, "dt_inicio", "fechainicio", "horainicio", "_orden", "_zona").where("utc_s is not null").select("row_idx", "utc_s")
