"""Column expressions that read instants from free-form timestamp text.

The text's grammar is tried form by form (year first, compact, numeric day and
month, day-month-name, month-name-day, Unix seconds and milliseconds); wall
times are placed in a named zone and accepted only where the zone maps them to
exactly one instant.  Everything stays in built-in expressions.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
KNOWN_ZONES = sorted(zoneinfo.available_timezones())

# Month names and abbreviations (English, German, French, Spanish).
MONTHS = {
    1: "january jan januar jän jänner janvier janv enero ene",
    2: "february feb februar févr février fev fevrier febrero",
    3: "march mar märz mär maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juil juillet julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
# Zone abbreviations and their offset from UTC in minutes.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

_WORD = r"[a-zß-ÿ]+"
_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)(.*)$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(t\d.*)?$"
_NUMERIC = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?!\d)(.*)$"
_DAY_NAME = rf"^(?:{_WORD}\.?,? )?(\d{{1,2}})(?:\.|st|nd|rd|th|er|º)? (?:de )?({_WORD})\.?,?(?: de)? (\d{{4}})(?!\d)(.*)$"
_NAME_DAY = rf"^(?:{_WORD}\.?,? )?({_WORD})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?!\d)(.*)$"
_ZONE = r"((?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?"
_CLOCK = rf"^[t, ]*(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)? ?(am|pm|a\.m\.|p\.m\.)? ?{_ZONE}(\[[a-z0-9_/+-]+\])?$"
_CLOCK_COMPACT = rf"^t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?()? ?{_ZONE}()$"
_ZONE_ONLY = rf"^ ?{_ZONE}$"
_OFFSET = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"


def _map(pairs: list[tuple[object, object]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, null for an impossible date."""
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    whole = y.isNotNull() & m.isNotNull() & d.isNotNull() & (y >= 1)
    return F.when(whole, F.unix_date(text.try_cast("date")))


def wall_candidates(local_us: Column, tz: Column) -> Column:
    """All instants (microseconds, ascending) that show ``local_us`` on a clock in zone ``tz``."""

    def offset(us: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), tz)) - us

    both = F.array(local_us - offset(local_us - DAY_US), local_us - offset(local_us + DAY_US))
    return F.array_sort(F.array_distinct(F.filter(both, lambda c: c + offset(c) == local_us)))


def first_moment(local_us: Column, tz: Column) -> Column:
    """First instant of the local day beginning at ``local_us``, also where midnight is skipped."""
    before = local_us - DAY_US
    shift = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(before), tz)) - before
    return F.coalesce(F.try_element_at(wall_candidates(local_us, tz), F.lit(1)), local_us - shift)


def with_instants(df: DataFrame, raw: str, tz: str, order: str, out: str = "utc_us") -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01 UTC that ``raw`` denotes, or null.

    ``tz`` is the zone of wall times (null or unknown: wall times stay
    unresolved), ``order`` is ``DMY`` or ``MDY`` for numeric dates (otherwise a
    numeric date counts only if both orders agree or one is impossible).
    Null, blank, impossible, skipped and repeated wall times give null.  The
    steps are projections of their own, so that no subexpression is repeated.
    """
    months = _map([(name, number) for number, names in MONTHS.items() for name in names.split()])
    col, x, form, rest = F.col, F.col("_x"), F.col("_form"), F.col("_rest")
    ext = F.regexp_extract

    def named(c: Column) -> Column:
        return F.try_element_at(months, F.when(c != "", c))

    forms = {"a": _YEAR_FIRST, "b": _COMPACT, "c": _NUMERIC, "d": _DAY_NAME, "e": _NAME_DAY}
    kept = df.columns
    text = F.lower(F.regexp_replace(F.regexp_replace(col(raw), r"[\s\u00a0]+", " "), "^ | $", ""))
    step = df.withColumn("_x", F.when(text.rlike(r"\d"), text))
    choice = F.when(x.rlike(r"^(\d{10}|\d{13})$"), "u")
    for name, pattern in forms.items():
        choice = choice.when(x.rlike(pattern), name)
    step = step.withColumn("_form", choice)

    def groups(*which: int) -> Column:
        """The chosen groups of the form that matched."""
        out = F.lit(None).cast("string")
        for (name, pattern), i in zip(forms.items(), which):
            if i:
                out = F.when(form == name, ext(x, pattern, i)).otherwise(out)
        return out

    step = step.select(
        *kept, "_x", "_form",
        _int(groups(1, 1, 4, 3, 3)).alias("_y"), groups(2, 2, 0, 2, 1).alias("_m"), _int(groups(3, 3, 0, 1, 2)).alias("_d"),
        _int(groups(0, 0, 1, 0, 0)).alias("_n1"), _int(groups(0, 0, 3, 0, 0)).alias("_n2"), F.coalesce(groups(4, 4, 5, 4, 4), F.lit("")).alias("_rest"),
    )
    step = step.withColumn("_mo", F.when(form.isin("d", "e"), named(col("_m"))).otherwise(_int(col("_m"))))
    step = step.withColumns({"_dmy": _date(col("_y"), col("_n2"), col("_n1")), "_mdy": _date(col("_y"), col("_n1"), col("_n2"))})
    either = F.when(col("_dmy").isNull() | col("_mdy").isNull() | (col("_dmy") == col("_mdy")), F.coalesce("_dmy", "_mdy"))
    numeric = F.when(col(order) == "DMY", col("_dmy")).when(col(order) == "MDY", col("_mdy")).otherwise(either)
    step = step.withColumn("_day", F.when(form == "c", numeric).otherwise(_date(col("_y"), col("_mo"), col("_d"))))
    step = step.withColumn("_shape", F.when(rest.rlike(_CLOCK_COMPACT), 2).when(rest.rlike(_CLOCK), 1).when(rest.rlike(_ZONE_ONLY), 0))

    def clock(i: int) -> Column:
        return F.when(col("_shape") == 2, ext(rest, _CLOCK_COMPACT, i)).when(col("_shape") == 1, ext(rest, _CLOCK, i))

    step = step.withColumns(
        {
            "_hour": _int(clock(1)), "_min": _int(clock(2)), "_sec": F.coalesce(_int(clock(3)), F.lit(0)),
            "_us": F.coalesce(_int(F.rpad(F.substring(clock(4), 1, 6), 6, "0")), F.lit(0)), "_half": F.substring(clock(5), 1, 1),
            "_zone": F.when(col("_shape") == 0, ext(rest, _ZONE_ONLY, 1)).otherwise(clock(6)),
        }
    )
    hour, half, zone = col("_hour"), col("_half"), col("_zone")
    end = (hour == 24) & (col("_min") == 0) & (col("_sec") == 0) & (col("_us") == 0)
    off_h, off_m = _int(ext(zone, _OFFSET, 2)), F.coalesce(_int(ext(zone, _OFFSET, 3)), F.lit(0))
    step = step.withColumns(
        {
            "_h24": F.when((half == "") & ((hour <= 23) | end), hour).when((half != "") & hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)),
            "_off": F.coalesce(
                F.try_element_at(_map(list(ZONE_MINUTES.items())), F.when(zone != "", zone)),
                F.when((off_h <= 18) & (off_m <= 59), F.when(ext(zone, _OFFSET, 1) == "-", -1).otherwise(1) * (off_h * 60 + off_m)),
            ),
            "_tz": F.when(col(tz).isin(KNOWN_ZONES), col(tz)),
        }
    )
    within = F.when((col("_min") <= 59) & (col("_sec") <= 59), ((col("_h24") * 60 + col("_min")) * 60 + col("_sec")).cast("long") * 1_000_000 + col("_us"))
    step = step.withColumn("_local", col("_day").cast("long") * DAY_US + F.when(col("_shape") == 0, F.lit(0).cast("long")).otherwise(within))
    wall = (zone == "") & col("_tz").isNotNull() & col("_local").isNotNull()
    step = step.withColumns({"_walls": F.when(wall, wall_candidates(col("_local"), col("_tz"))), "_first": F.when(wall, first_moment(col("_local"), col("_tz")))})
    placed = F.when((col("_shape") == 0) | (col("_h24") == 24), col("_first")).when(F.size("_walls") == 1, F.try_element_at("_walls", F.lit(1)))
    instant = (
        F.when(form == "u", x.try_cast("long") * F.when(F.length(x) == 10, 1_000_000).otherwise(1_000))
        .when(zone != "", col("_local") - col("_off").cast("long") * 60_000_000)
        .when(zone == "", placed)
    )
    return step.select(*kept, instant.alias(out))
