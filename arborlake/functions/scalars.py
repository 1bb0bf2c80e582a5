"""Column expressions: missing markers, typed parsing, dates and their parts, number formats."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Spellings of numbers that are not finite, and the names of date parts, in order.
NON_FINITE = r"(?i)^[+-]?(?:inf|infinity|nan)$"
DATE_PARTS = (
    "Year", "Month", "Week", "Day", "Dayofweek", "Dayofyear", "Is_month_end", "Is_month_start", "Is_quarter_end", "Is_quarter_start",
    "Is_year_end", "Is_year_start", "Hour", "Minute", "Second", "Elapsed",
)


def matches_marker(value: Column, marker) -> Column:
    """Whether a value is the missing marker: null never, and equality is of the marker's type."""
    text = value.cast("string")
    if marker is None:
        found = text == ""
    elif isinstance(marker, bool):
        found = F.lower(text) == str(marker).lower()
    elif isinstance(marker, float) and math.isnan(marker):
        found = F.isnan(value.try_cast("double"))
    elif isinstance(marker, int):
        found = text.try_cast("bigint") == marker
    elif isinstance(marker, float):
        found = text.try_cast("double") == marker
    else:
        found = text == str(marker)
    return F.coalesce(found, F.lit(False))


def without_marker(value: Column, marker="") -> Column:
    return F.when(~matches_marker(value, marker), value)


def parsed_number(text: Column) -> Column:
    """A finite number or null; spellings that only one engine takes for numbers are null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_text(value: Column) -> Column:
    """A number given to a text column: whole ones keep one decimal."""
    whole = F.concat(value.cast("bigint").cast("string"), F.lit(".0"))
    return F.when(value == F.floor(value), whole).otherwise(value.cast("string"))


#: Formats that date columns are tried with, in order of preference: strftime and Spark pattern.
_BASES = (
    ("%Y-%m-%d", "yyyy-M-d"), ("%Y/%m/%d", "yyyy/M/d"), ("%m/%d/%Y", "M/d/yyyy"), ("%d/%m/%Y", "d/M/yyyy"), ("%m-%d-%Y", "M-d-yyyy"),
    ("%d-%m-%Y", "d-M-yyyy"), ("%m/%d/%y", "M/d/yy"), ("%d/%m/%y", "d/M/yy"), ("%m-%d-%y", "M-d-yy"), ("%d-%m-%y", "d-M-yy"),
    ("%d-%b-%Y", "d-MMM-yyyy"), ("%d %b %Y", "d MMM yyyy"), ("%b %d, %Y", "MMM d, yyyy"), ("%B %d, %Y", "MMMM d, yyyy"), ("%d %B %Y", "d MMMM yyyy"),
)
_TIMES = (("%H:%M:%S", "H:m:s"), ("%H:%M:%S%.f", "H:m:s.[SSSSSSSSS][SSSSSS][SSS]"), ("%H:%M", "H:m"), ("%I:%M:%S %p", "h:m:s a"), ("%I:%M %p", "h:m a"))


def date_formats() -> list[tuple[str, str]]:
    """(strftime format, Spark pattern) of every candidate, in order of preference."""
    out = []
    for base, pattern in _BASES:
        out += [(f"{base} {t}", f"{pattern} {p}") for t, p in _TIMES] + [(base, pattern)]
    out += [(f"%Y-%m-%dT{t}", f"yyyy-M-d'T'{p}") for t, p in _TIMES[:3]]
    out += [(f"%Y-%m-%dT{t}%z", f"yyyy-M-d'T'{p}XX") for t, p in (_TIMES[1], _TIMES[0])]
    out += [("%Y%m%d%H%M%S", "yyyyMMddHHmmss"), ("%Y%m%d%H%M", "yyyyMMddHHmm"), ("%Y%m%d", "yyyyMMdd")]
    return out + list(_TIMES)


#: Parts of strftime formats and of Spark patterns.
_PARTS = {"Y": "yyyy", "m": "M", "d": "d", "y": "yy", "H": "H", "M": "m", "S": "s", "p": "a", "I": "h", "b": "MMM", "B": "MMMM", "j": "D", "z": "XX", "%": "%"}


def spark_pattern(fmt: str) -> str:
    """The Spark pattern of a strftime format; letters between its parts are quoted."""
    known = dict(date_formats())
    if fmt in known:
        return known[fmt]
    out = ""
    for part, text in re.findall(r"%\.?([A-Za-z%])|([^%]+)", fmt):
        out += _PARTS[part] if part else re.sub("[A-Za-z]+", lambda m: f"'{m[0]}'", text)
    return out


def parse_date(text: Column, fmt: str) -> Column:
    """A timestamp or null. With a year it must be 1900 to 2100; times alone are of 1900-01-01; two-digit
    years from 70 on are of the last century."""
    stamp = F.try_to_timestamp(text.cast("string"), F.lit(spark_pattern(fmt)))
    if "%y" in fmt:
        stamp = F.when(F.year(stamp) >= 2070, stamp - F.expr("INTERVAL 100 YEAR")).otherwise(stamp)
    if "%Y" in fmt or "%y" in fmt:
        return F.when(F.year(stamp).between(1900, 2100), stamp)
    return stamp - F.expr("INTERVAL 70 YEAR")


def date_part(stamp: Column, part: str) -> Column:
    """A part of DATE_PARTS as a number; weeks are ISO weeks and Mondays are day 0."""
    month_end, month_start = F.to_date(stamp) == F.last_day(stamp), F.dayofmonth(stamp) == 1
    made = {
        "Year": F.year(stamp), "Month": F.month(stamp), "Week": F.weekofyear(stamp), "Day": F.dayofmonth(stamp), "Dayofweek": F.weekday(stamp),
        "Dayofyear": F.dayofyear(stamp), "Is_month_end": month_end, "Is_month_start": month_start,
        "Is_quarter_end": month_end & (F.month(stamp) % 3 == 0), "Is_quarter_start": month_start & (F.month(stamp) % 3 == 1),
        "Is_year_end": month_end & (F.month(stamp) == 12), "Is_year_start": month_start & (F.month(stamp) == 1),
        "Hour": F.hour(stamp), "Minute": F.minute(stamp), "Second": F.second(stamp), "Elapsed": F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), stamp.cast("timestamp_ntz")),
    }
    return made[part].cast("int").cast("long") if part.startswith("Is_") else made[part].cast("long")


def date_part_names(column: str) -> list[str]:
    """Names of a date column's parts: its name without a final Date or date, then the part."""
    prefix = column[:-4] if column.endswith(("Date", "date")) else column
    return [prefix + part for part in DATE_PARTS]


def common_prefix(names: list[str]) -> str:
    """What names share at their start, without digits, underscores, hyphens, stops and spaces at its end."""
    first, last = min(names), max(names)
    n = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
    return first[:n].rstrip("0123456789_-. ")


def significant(value: float, digits: int) -> str:
    """Digits significant digits; powers of ten where the number is long or below a thousandth."""
    if value == 0:
        return "0"
    exponent = math.floor(math.log10(abs(value)))
    if exponent >= digits or exponent < -3:
        mantissa, power = f"{value:.{max(0, digits - 1)}e}".split("e")
        return f"{mantissa}e{int(power)}"
    text = f"{value:.{max(0, digits - 1 - exponent)}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text
