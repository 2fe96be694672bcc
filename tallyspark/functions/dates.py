"""Reading dates from text: one declared format per column, digits, zones and clock words."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats a column may be in (month-first ahead of day-first), the digit
# counts that spell a date, the words read as the clock, and words after a time that are no zone.
FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm",
    "M/d/yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yy", "M/d/yy H:mm",
    "d/M/yyyy", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d.M.yyyy", "d.M.yyyy H:mm",
    "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy",
)
DAY_FIRST = {"M/d/yyyy": "d/M/yyyy", "M/d/yyyy H:mm:ss": "d/M/yyyy H:mm:ss", "M/d/yyyy H:mm": "d/M/yyyy H:mm"}
DIGITS = {8: "yyyyMMdd", 12: "yyyyMMddHHmm", 14: "yyyyMMddHHmmss"}
CLOCK_WORDS = ("now", "today")
#: How a cell of a format looks whose every part has all its digits: a cast reads it as the formatter does, and faster.
WRITTEN_OUT = {"yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "yyyy-MM-dd HH:mm:ss": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"}
NOT_ZONES = ("MON", "TUE", "TUES", "WED", "WEDS", "THU", "THUR", "THURS", "FRI", "SAT", "SUN", "HRS")
# End of fixed values.

_CLOCK = r"\d:\d\d(?::\d\d(?:\.\d+)?)?\s*(?:[AP]\.?M\.?\s*)?"
_ZONE = r"(?:Z|[A-Z]{3,5}|(?:UTC|GMT)?\s*[+-]\d\d?(?::?\d\d)?)"
ZONED = r"(?i)" + _CLOCK + r"(?!(?:" + "|".join(NOT_ZONES) + r")\b)" + _ZONE + r"(?:\s+\d{4})?$"
MERIDIEM = r"(?<=\d)\s*([AaPp])\.?\s?[Mm]?\.?(?![A-Za-z])"


def written_out(text: Column, *formats: str | None) -> Column:
    """Whether a cell is in one of the formats with all its digits; such a cell is no blank, no clock word and has no zone."""
    out = F.lit(False)
    for fmt in formats:
        if fmt in WRITTEN_OUT:
            out = out | text.rlike(WRITTEN_OUT[fmt])
    return F.coalesce(out, F.lit(False))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def is_digits(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[0-9]+$"), F.lit(False))


def spelled_date(text: Column) -> Column:
    """An all-digit cell as the date its digits spell; null for any other count of digits."""
    t = F.trim(text)
    out = F.lit(None).cast("timestamp_ntz")
    for size, fmt in DIGITS.items():
        out = F.when(F.length(t) == size, read(t, fmt)).otherwise(out)
    return F.when(is_digits(text), out)


def has_zone(text: Column) -> Column:
    """A time of day followed by a zone: a name, an offset, Z."""
    return F.coalesce(F.trim(text).rlike(ZONED), F.lit(False))


def is_clock_word(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(list(CLOCK_WORDS)), F.lit(False))


def plain_meridiem(text: Column) -> Column:
    """am, p.m., a or p after a time written as AM or PM."""
    marked = F.regexp_replace(text, MERIDIEM, " $1M")
    for low, up in ((" aM", " AM"), (" pM", " PM")):
        marked = F.replace(marked, F.lit(low), F.lit(up))
    return marked


def read(text: Column, fmt: str) -> Column:
    """Text in exactly one format as a zone-free timestamp; null where it is not. Words in any case.

    Parsed as UTC and rebuilt from the epoch, so the session's zone and its clock changes play no part. Text without the format's
    marks is not tried, since a formatter that fails costs far more than one that reads.
    """
    marks = [F.contains(text, F.lit(mark)) for mark in sorted(set(fmt)) if not mark.isalpha() and mark != "'"]
    if "MMM" in fmt:
        text = F.initcap(F.lower(text))
    moment = F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(fmt + " xx")))
    seconds = (moment.cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.when(reduce(lambda a, b: a & b, marks), moment) if marks else moment


#: What a text is made of: its runs of digits as one digit, its runs of letters as one letter, and its marks.
_FIELDS = ((r"[0-9]+", "0"), (r"\p{L}+", "a"))
#: A number with a sign; readers take one for any number of a format, though its marks do not show it.
_SIGNED = r"(^|[^0-9])[+-][0-9]"


def _made_of(fmt: str) -> str:
    """What every text in a format is made of: fields of letters are names, of others numbers."""
    plain = re.sub(r"MMM+|a+", "w", fmt.replace("'T'", "w"))
    return re.sub(r"w+", "a", re.sub(r"[yMdHhmsS]+", "0", plain))


def listed_format(text: Column) -> Column:
    """The first listed format that reads a cell, or null. Only formats that cells of its digits, letters and marks can be in are tried,
    since a formatter that fails costs far more than one that reads; all of them for a cell with a signed number."""
    alike: dict[str, list[str]] = {}
    for fmt in FORMATS:
        alike.setdefault(_made_of(fmt), []).append(fmt)

    def walked(text: Column) -> Column:
        made_of = text
        for field, short in _FIELDS:
            made_of = F.regexp_replace(made_of, field, short)
        tried = F.element_at(F.create_map(*[c for k, v in alike.items() for c in (F.lit(k), F.array(*[F.lit(f) for f in v]))]), made_of)
        tried = F.coalesce(tried, F.when(text.rlike(_SIGNED), F.array(*[F.lit(f) for f in FORMATS])))

        def first(found: Column, fmt: Column) -> Column:
            worded = F.when(F.contains(fmt, F.lit("MMM")), F.initcap(F.lower(text))).otherwise(text)
            reads = F.try_to_timestamp(F.concat(worded, F.lit(" +0000")), F.concat(fmt, F.lit(" xx"))).isNotNull()
            return F.coalesce(found, F.when(reads, fmt))

        return F.aggregate(tried, F.lit(None).cast("string"), first)

    plainly = F.lit(None).cast("string")
    for fmt, form in WRITTEN_OUT.items():
        plainly = F.when(text.rlike(form) & text.try_cast("timestamp_ntz").isNotNull(), fmt).otherwise(plainly)
    # the ways of an unusual cell are kept inside one small expression
    return F.coalesce(plainly, F.get(F.transform(F.array(text), walked), F.lit(0)))
