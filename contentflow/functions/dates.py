"""Date expressions. Results are TIMESTAMP_NTZ in UTC, whatever the session time zone is."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.text import let, non_empty, strip


def utc(moment: datetime | str) -> Column:
    """A literal UTC time."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def minus_days(as_of: datetime | str, days: float) -> datetime:
    start = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)
    return start - timedelta(days=days)


def _plus_seconds(base: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return base + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def from_unix_micros(micros: Column) -> Column:
    return _plus_seconds(utc("1970-01-01 00:00:00"), micros.cast("decimal(20,0)") / F.lit(1_000_000))


def from_apple_nanos(nanos: Column) -> Column:
    """Nanoseconds since 2001-01-01 to a time, cut to microseconds."""
    micros = F.floor(nanos.cast("decimal(20,0)") / F.lit(1000))
    return _plus_seconds(utc("2001-01-01 00:00:00"), micros / F.lit(1_000_000))


def to_apple_nanos(moment: datetime | str) -> int:
    """The cutoff for a pushed-down filter on the raw column."""
    when = moment if isinstance(moment, datetime) else datetime.fromisoformat(moment)
    gap = when - datetime(2001, 1, 1)
    return ((gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds) * 1_000


_ISO = (
    r"^(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?)?"
    r" ?([Zz]|[+-]\d{2}:?\d{2})?$"
)
_RFC = (
    r"^(?:[A-Za-z]{3,9},? +)?(\d{1,2}) +([A-Za-z]{3})[a-z]* +(\d{4})"
    r"(?: +(\d{1,2}):(\d{2})(?::(\d{2}))?)?(?: +([A-Za-z]{1,4}|[+-]\d{4}))?$"
)
_ASCTIME = r"^[A-Za-z]{3} +([A-Za-z]{3}) +(\d{1,2}) +(\d{2}):(\d{2}):(\d{2}) +(\d{4})$"
_LONG = r"^([A-Za-z]{3})[a-z]* +(\d{1,2}), +(\d{4})(?: +(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"


# Each pattern rewrites a date it matches to one form: mark, then year, month, day, hour, minute, second, zone.
_MARK = "\x1f"
_FORMS = (
    (_ISO, "$1 $2 $3 $4 $5 $6 $7"),
    (_RFC, "$3 $2 $1 $4 $5 $6 $7"),
    (_ASCTIME, "$6 $1 $2 $3 $4 $5 "),
    (_LONG, "$3 $1 $2 $4 $5 $6 "),
)


def _month(name: Column) -> Column:
    at = F.instr(F.lit(V.MONTHS), F.lower(name))
    by_name = F.when((F.length(name) == 3) & (at % 3 == 1), F.floor((at + 2) / 3).cast("string"))
    return F.when(name.rlike("^[0-9]"), name).otherwise(by_name)


def _moment(fields: Column) -> Column:
    """UTC time of the array (mark, year, month, day, hour, minute, second, zone); NULL for other arrays."""
    _, year, month, day, hour, minute, second, zone = (F.get(fields, F.lit(n)) for n in range(8))

    def two(c: Column) -> Column:
        return F.lpad(F.coalesce(non_empty(c), F.lit("0")), 2, "0")

    # Seconds may carry a fraction, which must not be cut.
    seconds = F.when(F.length(second) < 2, two(second)).otherwise(second)
    written = F.concat(
        year, F.lit("-"), two(_month(month)), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"),
        two(minute), F.lit(":"), seconds,
    )
    known_month = _month(month).isNotNull()
    offset = F.coalesce(_offset_seconds(zone), F.lit(0))
    return F.when((F.size(fields) == 8) & known_month, _plus_seconds(written.try_cast("timestamp_ntz"), -offset))


def _offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC; 0 without a zone; NULL for an unknown zone name."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    numeric = sign * (
        F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    )
    named = F.lit(None).cast("int")
    for name, hours in V.ZONE_HOURS.items():
        named = F.when(F.upper(zone) == name, hours * 3600).otherwise(named)
    return F.when(zone == "", 0).when(zone.rlike("^[+-]"), numeric).otherwise(named)


# Free forms are read by what their parts are, wherever these stand. A time of day, with or without its half:
_TIME = r"(?<![0-9:])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]{1,6})?)[0-9]*)?(?: ?([ap])\.?m\b\.?)?(?![0-9:])"
_HOUR = r"(?<![0-9:])([0-9]{1,2}) ?([ap])\.?m\b\.?"
_FREE_ZONE = r"^ ?([+-][0-9]{2}:?[0-9]{2}|[a-z]{1,5})(?![a-z0-9])"
_MONTH_NAME = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
# What may stand between the parts, and says nothing.
_FILLER = r"\b(?:mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?|at|on|of|the)\b\.?"
_LONGEST = 64


def _free_form(text: Column) -> Column:
    """The fields of a date in a free form, as `_moment` takes them; NULL for anything that is not wholly understood.

    Day and month: a written month is the month, and the number before a written year, or the first one, the day. Three
    numbers are year, month, day if the first has four digits or is above 31, else month, day, year, unless that
    month is above 12: then the day comes first. Years of two digits are those from 1969 to 2068. A date needs all three parts.
    """

    def of(low: Column) -> Column:
        time, hour = F.regexp_extract(low, _TIME, 0), F.regexp_extract(low, _HOUR, 0)
        return let(F.when(time != "", time).otherwise(hour), lambda clock: behind(low, clock))

    def behind(low: Column, clock: Column) -> Column:
        # A zone stands right behind the time.
        at = F.instr(low, clock)
        after = F.substring(low, at + F.length(clock), F.length(low))
        word = F.regexp_extract(after, _FREE_ZONE, 1)
        is_zone = (clock != "") & (word != "") & ~word.rlike(rf"^(?:{_MONTH_NAME})$") & ~word.rlike(f"^{_FILLER}$")
        left = F.struct(
            F.when(is_zone, word).otherwise("").alias("zone"),
            F.when(clock == "", low).otherwise(F.concat(
                F.substring(low, F.lit(1), at - 1), F.lit(" "), F.when(is_zone, F.regexp_replace(after, _FREE_ZONE, "")).otherwise(after),
            )).alias("rest"),
        )
        return let(left, lambda found: date_of(clock, found["zone"], found["rest"]))

    def date_of(clock: Column, zone: Column, rest: Column) -> Column:
        a_month = rf"(?<![a-z])({_MONTH_NAME})(?![a-z])"
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, a_month, " "), _FILLER, " "), "(?<=[0-9])(?:st|nd|rd|th)\\b", " ")
        parts = F.struct(
            F.substring(F.regexp_extract(rest, a_month, 1), 1, 3).alias("month"),
            F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0)).alias("numbers"),
            # Only separators may be left beside the numbers, and one month.
            (~plain.rlike("[^0-9 ,./-]") & (F.regexp_count(rest, F.lit(a_month)) <= 1)).alias("understood"),
        )
        return let(parts, lambda p: let(ordered(p["month"], p["numbers"]), lambda date: F.when(p["understood"], fields(date, clock, zone))))

    def ordered(month: Column, numbers: Column) -> Column:
        one, two, three = (F.get(numbers, F.lit(n)) for n in range(3))

        def big(n: Column) -> Column:
            return (F.length(n) >= 3) | (n.try_cast("int") > 31)

        def small(n: Column) -> Column:
            return n.try_cast("int") <= 12

        named = F.when(big(one), F.array(one, month, two)).otherwise(F.array(two, month, one))
        counted = (
            F.when(big(one) & ~small(two) & small(three), F.array(one, three, two))
            .when(big(one), F.array(one, two, three))
            .when(small(one), F.array(three, one, two))
            .otherwise(F.array(three, two, one))
        )
        compact = F.array(F.substring(one, 1, 4), F.substring(one, 5, 2), F.substring(one, 7, 2))
        return (
            F.when((month != "") & (F.size(numbers) == 2), named)
            .when((month == "") & (F.size(numbers) == 3), counted)
            .when((month == "") & (F.size(numbers) == 1) & (F.length(one) == 8), compact)
        )

    def fields(date: Column, clock: Column, zone: Column) -> Column:
        year, month, day = (F.get(date, F.lit(n)) for n in range(3))
        century = F.when(F.length(year) != 2, year).when(year.try_cast("int") < 69, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
        half, hour = F.regexp_extract(clock, "([ap])\\.?m", 1), F.regexp_extract(clock, "^[0-9]+", 0).try_cast("int")
        by_half = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
        written = F.when(clock == "", "").otherwise(by_half.cast("string"))
        minute, second = F.regexp_extract(clock, ":([0-9]{2})", 1), F.regexp_extract(clock, ":[0-9]{2}:([0-9.]+)", 1)
        good = (F.length(century) == 4) & (F.length(day) <= 2) & written.isNotNull()
        return F.when(good, F.array(F.lit(""), century, month, day, written, minute, second, zone))

    return F.when(F.length(text) <= _LONGEST, let(F.lower(text), of))


def parse_date(text: Column) -> Column:
    """ISO 8601, RFC 2822, C `asctime` and `Month d, yyyy` dates as UTC, else free forms (`_free_form`); NULL for anything else.

    A time with an unknown zone name is read as UTC.
    """
    rewritten = strip(text)
    for pattern, form in _FORMS:
        # A rewritten date starts with the mark, so no later pattern matches it again.
        rewritten = F.regexp_replace(rewritten, pattern, _MARK + form.replace(" ", _MARK))

    def read(r: Column) -> Column:
        return F.when(F.startswith(r, F.lit(_MARK)), let(F.split(r, _MARK, -1), _moment)).otherwise(let(_free_form(r), _moment))

    return let(rewritten, read)


def first_date(*texts: Column) -> Column:
    """The first text that parses, in the given order (published, updated, created)."""
    if len(texts) == 1:
        return parse_date(texts[0])
    # One copy of the expression in the plan, whatever the number of texts.
    return F.get(F.filter(F.transform(F.array(*texts), parse_date), lambda d: d.isNotNull()), F.lit(0))


def stamp(moment: Column, pattern: str) -> Column:
    return F.date_format(moment, pattern)
