"""Text clean-up and text-to-value expressions used by type inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that the reader takes as missing (public pandas.read_csv default).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Boolean spellings that the reader recognises.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"
DOUBLE_SHAPE = r"(?i)^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity)\s*$"

# English month names as dates abbreviate them.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Candidate date formats in order of preference: (name, shape, rewrite to year-month-day).
_TIME = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"
_ZONE = r"(?:Z|[+-]\d{2}:\d{2})"
_MONTH = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?"
)
_WEEKDAY = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?"
_HALF = r" ?([ap])\.?m\.?"
FREE = "free form"
DATE_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", rf"^\d{{4}}-\d{{2}}-\d{{2}} {_TIME}$", None),
    ("yyyy-MM-dd'T'HH:mm:ss", rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}$", None),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$", None),
    ("M/d/yyyy", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    ("d/M/yyyy", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
    ("yyyy/MM/dd", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    ("d-M-yyyy", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    ("yyyy-MM-dd HH:mm:ssXXX", rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]{_TIME}{_ZONE}$", None),
    ("M/d/yyyy HH:mm:ss", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) ({_TIME})$", "$3-$1-$2 $4"),
    ("d/M/yyyy HH:mm:ss", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) ({_TIME})$", "$3-$2-$1 $4"),
    ("d-MMM-yyyy", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$", "$3-$2-$1"),
    ("d.M.yyyy", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
    # the month by name, before or behind the day: every value is read on its own, as year|month|day|time|half
    (
        FREE,
        rf"(?i)^(?:{_WEEKDAY},? )?(?:({_MONTH})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})"
        rf"|(\d{{1,2}})(?:st|nd|rd|th)?[ -]({_MONTH})\.?,?[ -](\d{{4}}))(?:,? (?:at )?({_TIME})(?:{_HALF})?)?$",
        "$3$6|$1$5|$2$4|$7|$8",
    ),
]

# What a text looks like: digits become 9, ASCII letters a.
_ALIKE = ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "a" * 52)
#: Texts above this length have no look; the longest date is shorter.
LONGEST_LOOK = 48
INTEGER_LOOK = r"^\s*[+-]?9+\s*$"
DOUBLE_LOOK = r"^\s*[+-]?(9+\.?9*|\.9+)\s*$"
#: Integers of so many characters fit into 64 bits.
SAFE_DIGITS = 18
_TIME_LOOK = r"9{1,2}:99(?::99(?:\.9{1,6})?)?"
_FREE_LOOK = (
    rf"^(?:a+,? )?(?:a+\.? 9{{1,2}}(?:aa)?,? 9{{4}}|9{{1,2}}(?:aa)?[ -]a+\.?,?[ -]9{{4}})"
    rf"(?:,? (?:aa )?{_TIME_LOOK}(?: ?a\.?a\.?)?)?$"
)


def look(value: Column) -> Column:
    """The text with digits and letters made alike; NULL if it is long or has no digit."""
    alike = F.translate(value, *_ALIKE)
    return F.when((F.char_length(value) <= LONGEST_LOOK) & F.contains(alike, F.lit("9")), alike)


def date_look(i: int) -> str:
    """Pattern of the looks that texts of date format i have."""
    name, shape, _ = DATE_FORMATS[i]
    if name == FREE:
        return _FREE_LOOK
    return shape.replace(r"\d", "9").replace("[A-Za-z]", "a").replace("[T ]", "[a ]").replace("T", "a").replace("Z", "a")


def na_to_null(value: Column) -> Column:
    return F.when(~value.isin(NA_TOKENS), value)


def strip(value: Column) -> Column:
    """Remove blanks of any kind (tab, newline, no-break space) at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def title_case(value: Column) -> Column:
    """Capital after every non-letter: ``o'neil-smith`` becomes ``O'Neil-Smith``."""
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def to_integer(value: Column) -> Column:
    return F.when(value.rlike(INTEGER_SHAPE), F.trim(value).try_cast("bigint"))


def to_double(value: Column) -> Column:
    return F.when(value.rlike(DOUBLE_SHAPE), F.trim(value).try_cast("double"))


def to_boolean(value: Column) -> Column:
    return F.when(value.isin(TRUE_TOKENS), F.lit(True)).when(value.isin(FALSE_TOKENS), F.lit(False))


def parse_shaped(value: Column, i: int) -> Column:
    """Parse text that has the shape of date format i: rewritten to year-month-day, then a
    cast without a formatter, so no exception is thrown per bad value."""
    name, shape, rewrite = DATE_FORMATS[i]
    if name == FREE:
        parts = F.split(F.regexp_replace(value, shape, rewrite), r"\|")
        return F.transform(F.array(parts), _parse_free)[0]  # the parts are found once a value
    iso = value if rewrite is None else F.regexp_replace(value, shape, rewrite)
    if "HH" in name:  # times without seconds
        iso = F.regexp_replace(iso, r"([T ]\d{1,2}:\d{2})(?=Z|[+-]|$)", "$1:00")
    if name == "yyyy-MM-dd HH:mm:ssXXX":  # an instant, given in UTC
        local = iso.try_cast("timestamp").cast("timestamp_ntz")
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    if name == "d-MMM-yyyy":
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(value, shape, 2)))
        iso = F.regexp_replace(iso, "[A-Za-z]{3}", F.when(month > 0, month).cast("string"))
    return iso.try_cast("timestamp_ntz")


def _parse_free(parts: Column) -> Column:
    """Timestamp of year, month name, day, time and half of the day; the last two may be empty."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(parts[1], 1, 3)))
    day = F.concat_ws("-", parts[0], F.lpad(month.cast("string"), 2, "0"), F.lpad(parts[2], 2, "0"))
    time, half = parts[3], F.lower(parts[4])
    hour = F.substring_index(time, ":", 1).try_cast("int")
    behind = F.regexp_replace(F.substring(time, F.instr(time, ":"), F.lit(20)), r"^(:\d{2})$", "$1:00")
    hour = (
        F.when(half == "", hour)
        .when(~hour.between(1, 12), F.lit(None))
        .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    text = F.when(time == "", day).otherwise(F.concat(day, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), behind))
    return text.try_cast("timestamp_ntz")


def to_timestamp(value: Column, date_format: str) -> Column:
    """Parse by one of DATE_FORMATS; NULL where the text does not fit."""
    i = [name for name, _, _ in DATE_FORMATS].index(date_format)
    return F.when(value.rlike(DATE_FORMATS[i][1]), parse_shaped(value, i))
