"""Mixed timestamp forms, precisions and zones turned into one moment in UTC.

An ordered cascade of anchored patterns rewrites each text into the fields
``year|month|day|hour|minute|second|fraction|am-pm|zone``; the first pattern that fits decides, the fields are
then checked strictly, and one builder makes the moment. Everything is a built-in expression, so the scan, the
patterns and the zone rules run in one generated stage without a shuffle.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and the zone letters that are understood, in minutes east of UTC.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "februar": 2, "märz": 3, "mär": 3, "mai": 5, "juni": 6, "juli": 7, "okt": 10, "oktober": 10, "dez": 12, "dezember": 12,
}
ZONE_LETTERS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "bst": 60, "wet": 0, "west": 60, "cet": 60, "cest": 120, "met": 60, "mez": 60, "mesz": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "jst": 540,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AP = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}))?"
_WORD = r"([^\W\d_]{3,9})\.?"
_WEEKDAY = r"(?:[^\W\d_]{2,9}\.?,?\s+)?"

#: Name, pattern, replacement to year|month|day|hour|minute|second|fraction|am-pm|zone.
FORMS = (
    ("year first", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|,?\s+){_TIME}{_AP}{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("compact", r"^((?:19|20)\d{2})(\d{2})(\d{2})(?:[Tt_ ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?(Z|z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("day and month name", rf"(?U)^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]+{_WORD},?[\s-]+(\d{{4}}|\d{{2}})(?:(?:[Tt]|,?\s+){_TIME}{_AP}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month name and day", rf"(?U)^{_WEEKDAY}{_WORD}[\s-]+(\d{{1,2}})(?:st|nd|rd|th)?,?[\s-]+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_AP}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("year last", rf"(?U)^{_WEEKDAY}{_WORD}\s+(\d{{1,2}})\s+{_TIME}(?:\s+([A-Za-z]{{2,5}}))?\s+(\d{{4}})(?:\s+([+-]\d{{2}}:?\d{{2}}))?$", "$8|$1|$2|$3|$4|$5|$6||$7$9"),
)
#: Day, month and year as numbers: which comes first follows the locale (or the dots).
NUMERIC = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:(?:[Tt]|,?\s+){_TIME}{_AP}{_ZONE})?$"
EPOCH = r"^\d{10}(?:\d{3}|\d{6}|\d{9})?$|^\d{10}\.\d+$"
SERIAL = r"^\d{5}(?:[.]\d+)?$"
_DAY = 86_400_000_000


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.lower(key))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def fields(value: Column, locale: Column | None = None) -> Column:
    """The nine fields as one ``|``-joined text, null where no pattern fits."""
    v = F.regexp_replace(value, r"(?U)^\s+|(?<!\s)\s+$|\|", "")
    for _, pattern, to in FORMS:  # what one pattern has rewritten holds bars, so none of the later ones fits it
        v = F.regexp_replace(v, pattern, to)
    day_first, month_first = "$4|$3|$1|$5|$6|$7|$8|$9|$10", "$4|$1|$3|$5|$6|$7|$8|$9|$10"
    order = F.lit(day_first)
    if locale is not None:
        order = F.when(F.coalesce(F.lower(locale).rlike("^en[-_]us$|^us$"), F.lit(False)) & ~value.contains("."), month_first).otherwise(day_first)
    v = F.regexp_replace(v, F.lit(NUMERIC), order)
    return F.when(v.contains("|"), v)


def known_zones(df: DataFrame) -> list[str]:
    """Names of all zones the JVM knows (a fixed set of a few hundred), or the standard library where the JVM is out of reach."""
    try:
        return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # a remote session has no JVM here
        return sorted(available_timezones() - {"Factory", "localtime"})


def _step(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """``added`` behind a generator of one row: later filters and projections don't copy its expressions into themselves."""
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(c) for c, x in added.items()]))))


def normalise_timestamps(
    df: DataFrame,
    value: str,
    zone: str | None = None,
    locale: str | None = None,
    out: str = "utc_us",
    status: str | None = None,
    default_zone: str = "UTC",
    ambiguous: str = "first",
    nonexistent: str = "before",
) -> DataFrame:
    """Add ``out``: microseconds since 1970-01-01 UTC of the text in column ``value``, null where it names no real day.

    A bare day is 00:00 UTC. A time without zone is read in the row's ``zone`` (``default_zone`` where that is
    null, blank or unknown). ``locale`` decides the order of purely numeric days and months: ``en-US`` has the month first,
    all others, null included, the day; dots always put the day first. Digit runs are calendar digits (8, 12, 14),
    counts since 1970 in s, ms, us or ns (10, 13, 16, 19) or spreadsheet days (5). Digits beyond
    microseconds are cut. ``ambiguous`` is ``first``, ``last`` or ``null``; ``nonexistent`` is ``before`` (the offset
    before the change is kept), ``after`` or ``null``. ``status`` names an optional column with ``zoned``, ``local``,
    ``day``, ``ambiguous``, ``nonexistent`` or null.

    Null, empty and blank texts, empty tables and unreadable forms give null. Rows are neither dropped nor
    merged, so repeated rows stay; other columns pass through whatever their names.
    """
    for name, given, allowed in (("ambiguous", ambiguous, ("first", "last", "null")), ("nonexistent", nonexistent, ("before", "after", "null"))):
        if given not in allowed:
            raise ValueError(f"{name} is one of {allowed}, not {given!r}")
    keep = list(df.columns)
    tmp = "__ts"
    while any(c.startswith(tmp) for c in keep):
        tmp += "_"
    col = lambda name: F.col(f"`{name}`")
    raw = F.regexp_replace(col(value).cast("string"), r"(?U)^\s+|(?<!\s)\s+$", "")
    staged = _step(df, {f"{tmp}v": raw, f"{tmp}f": F.split(fields(col(value).cast("string"), col(locale) if locale else None), r"\|", 9)})
    at = lambda i: F.col(f"{tmp}f")[i]
    month = F.coalesce(_int(at(1)), _lookup(MONTHS, at(1)))
    year = F.when(F.length(at(0)) == 2, _int(at(0)) + F.when(_int(at(0)) < 70, 2000).otherwise(1900)).otherwise(_int(at(0)))
    half = F.lower(at(7))
    hour24 = _int(at(3))
    hour = (
        F.when(half == "", hour24)
        .when(~hour24.between(1, 12), F.lit(None).cast("int"))
        .otherwise(hour24 % 12 + F.when(half == "p", 12).otherwise(0))
    )
    timed = at(3) != ""
    second = F.concat(F.when(at(5) == "", "0").otherwise(at(5)), F.lit("."), F.rpad(F.substring(at(6), 1, 6), 6, "0")).try_cast("decimal(16,6)")
    moment = F.try_make_timestamp(year, month, _int(at(2)), F.when(timed, hour).otherwise(0), F.when(timed, F.when(at(4) == "", 0).otherwise(_int(at(4)))).otherwise(0), F.when(timed, second).otherwise(F.lit(0).cast("decimal(16,6)")), F.lit("UTC"))
    letters = F.regexp_replace(at(8), r"(?i)^(?:UTC|GMT)(?=[+-])", "")
    sign = F.when(letters.startswith("-"), -1).otherwise(1)
    numeric_offset = sign * (F.regexp_extract(letters, r"^[+-](\d{1,2})", 1).try_cast("int") * 60 + F.coalesce(F.regexp_extract(letters, r"^[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0)))
    offset = F.when(letters.rlike(r"^[+-]"), numeric_offset).otherwise(_lookup(ZONE_LETTERS, letters))
    v = F.col(f"{tmp}v")
    digits = F.length(F.regexp_extract(v, r"^\d+", 0))
    count = F.regexp_extract(v, r"^\d+", 0).try_cast("bigint")
    fraction = F.rpad(F.substring(F.regexp_extract(v, r"\.(\d+)$", 1), 1, 6), 6, "0").try_cast("bigint")
    epoch = F.when(v.rlike(EPOCH), F.when(digits == 10, count * 1_000_000 + F.coalesce(fraction, F.lit(0))).when(digits == 13, count * 1000).when(digits == 16, count).otherwise(F.floor(count / 1000).cast("bigint")))
    # Whole spreadsheet days are bare days; a fraction is a time of day without zone. Day 0 is 1899-12-30, 25,569 days before 1970.
    serial_day = (F.regexp_extract(v, r"^\d{5}", 0).try_cast("bigint") - 25_569) * _DAY
    serial_time = F.floor(F.concat(F.lit("0"), F.regexp_extract(v, r"\.\d+$", 0)).try_cast("decimal(20,12)") * _DAY).cast("bigint")
    serial = v.rlike(SERIAL)
    if zone is None:
        zone_name = F.lit(default_zone)
    else:
        z = F.trim(col(zone).cast("string"))
        zone_name = F.when(z.isin(known_zones(df)), z).otherwise(F.lit(default_zone))
    staged = _step(staged, {f"{tmp}l": F.when(serial, serial_day + F.coalesce(serial_time, F.lit(0))).otherwise(F.unix_micros(moment)), f"{tmp}z": zone_name, f"{tmp}e": epoch, f"{tmp}o": F.when(serial | (at(8) == ""), F.lit(None).cast("int")).otherwise(offset)})
    local, zoned = F.col(f"{tmp}l"), F.coalesce((at(8) != "") & ~serial, F.lit(False))
    has_time = F.when(serial, v.contains(".")).otherwise(timed)
    utc = lambda us: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), F.col(f"{tmp}z")))
    wall = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col(f"{tmp}z")))
    first = utc(local)
    in_zone = first
    gap = wall(first) != local
    again = F.coalesce(*[F.when(wall(first + m * 60_000_000) == local, first + m * 60_000_000) for m in (60, 30, 120)])
    if ambiguous != "first":
        in_zone = F.when(again.isNull(), in_zone).otherwise(again if ambiguous == "last" else F.lit(None).cast("bigint"))
    if nonexistent != "before":
        # the offset after the change is the one in force a day later
        after = local - (wall(first + _DAY) - (first + _DAY))
        in_zone = F.when(~gap, in_zone).otherwise(after if nonexistent == "after" else F.lit(None).cast("bigint"))
    result = F.when(F.col(f"{tmp}e").isNotNull() & ~F.col(f"{tmp}v").rlike(r"^(?:19|20)\d{12}$"), F.col(f"{tmp}e")).when(zoned, local - F.col(f"{tmp}o").cast("bigint") * 60_000_000).when(~has_time, local).otherwise(in_zone)
    added = {out: result}
    if status:
        added[status] = F.when(result.isNull() & ~gap & again.isNull(), None).when(F.col(f"{tmp}e").isNotNull() | zoned, "zoned").when(~has_time, "day").when(gap, "nonexistent").when(again.isNotNull(), "ambiguous").otherwise("local")
    done = _step(staged.drop(*[c for c in added if c in keep]), added)
    return done.select(*[col(c) for c in keep if c not in added], *[col(c) for c in added])
