"""Text as columns: visible lines, inert markdown, redaction, cells that are safe to export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points a reader cannot see (nothing drawn, order changed, or hidden text).
UNSEEN_RANGES = (
    (0x0000, 0x001F), (0x007F, 0x009F), (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C),
    (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x2800, 0x2800), (0x3164, 0x3164), (0xE000, 0xF8FF), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0000, 0xE0FFF), (0xF0000, 0x10FFFF),
)
# White space of any script, as one class.
SPACE_RANGES = (
    (0x0009, 0x000D), (0x001C, 0x0020), (0x0085, 0x0085), (0x00A0, 0x00A0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
# Code points a spreadsheet cell cannot hold.
UNWRITABLE = (*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFE, 0xFFFF)
CELL_LIMIT = 32_767
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
REDACTED_EMAIL = "redacted@example.com"
REALM = "REALM"
ACCESS, REFRESH = "TEST-ACCESS", "TEST-REFRESH"
USER_STAND_IN = "qbo-user-"
FORMULA_STARTS = "=+-@"
# End of fixed values.


def char_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


SPACES = char_class(SPACE_RANGES) + "+"
# the look-ahead lets common characters fail on one comparison
UNSEEN = "(?![!-~])" + char_class(UNSEEN_RANGES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")


def one_line(text: Column) -> Column:
    """One line of visible text; null as nothing. Text that hides nothing is collapsed once."""
    def shown(line: Column) -> Column:
        return F.when(line.rlike(UNSEEN), collapse(F.regexp_replace(line, UNSEEN, ""))).otherwise(line)

    return let(F.coalesce(collapse(text), F.lit("")), shown)


def _backticks(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def _quoted(part: Column, fence: Column) -> Column:
    pad = F.when(part.startswith("`") | part.endswith("`"), " ").otherwise("")
    return F.when(part == "", "").otherwise(F.concat(fence, pad, part, pad, fence))


def code_span(text: Column) -> Column:
    """One line of inert markdown code."""
    return let(one_line(text), lambda line: _quoted(line, _backticks(line)))


def md_code(text: Column) -> Column:
    """A code span for a page that is matched on as text: a zero-width space after every ``@``,
    pipes written as entities between spans."""
    line = F.replace(one_line(text), F.lit("@"), F.lit("@\u200b"))

    def spans(b: Column) -> Column:
        return F.array_join(F.transform(F.split(b["line"], r"\|"), lambda p: _quoted(p, b["fence"])), "&#124;")

    return let(let(line, lambda x: F.struct(x.alias("line"), _backticks(x).alias("fence"))), spans)


# -- redaction --------------------------------------------------------------------

def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, REDACTED_EMAIL)


# -- export -------------------------------------------------------------------------

def _code_point(code: int) -> str:
    return f"[U+{code:04X}]"


_UNWRITABLE_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in UNWRITABLE) + "]"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _shown(text: Column) -> Column:
    for code in UNWRITABLE:
        text = F.regexp_replace(text, f"\\x{{{code:X}}}", _code_point(code))
    return text


def utf16_units(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(_ASTRAL))


def export_cell(text: Column) -> Column:
    """``shown`` (text as a cell can hold it), ``replaced`` (characters shown as code points) and
    ``cut`` (whether it was cut at the cell limit with a note of its length)."""
    odd = text.rlike(_UNWRITABLE_CLASS)
    whole = F.when(odd, _shown(text)).otherwise(text)
    full = utf16_units(whole)
    tail = F.format_string(" [cut: shown in full, the text would run to %,d characters; a cell holds 32,767]", full)
    start = F.struct((F.lit(CELL_LIMIT) - F.length(tail)).alias("room"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(acc: Column, char: Column) -> Column:
        width = F.when(char.rlike(_UNWRITABLE_CLASS), len(_code_point(0))).when(char.rlike(_ASTRAL), 2).otherwise(1)
        fits = acc["open"] & (width <= acc["room"])
        return F.struct((acc["room"] - F.when(fits, width).otherwise(0)).alias("room"),
                        (acc["kept"] + F.when(fits, 1).otherwise(0)).alias("kept"), fits.alias("open"))

    kept = F.aggregate(F.split(text, ""), start, step)["kept"]
    over = full > CELL_LIMIT
    head = F.when(over, F.substring(text, F.lit(1), kept))
    shown = F.when(over, F.concat(F.when(odd, _shown(head)).otherwise(head), tail)).otherwise(whole)
    source = F.when(over, head).otherwise(text)
    return F.struct(shown.alias("shown"), F.regexp_count(source, F.lit(_UNWRITABLE_CLASS)).alias("replaced"),
                    over.alias("cut"))


def export_cells(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with text columns as cells can hold them, and one row counting every change."""
    wide = rows.withColumns({f"_{c}": export_cell(F.col(c)) for c in columns})
    cells = F.array(*[F.col(f"_{c}") for c in columns])
    changes = wide.select(F.inline(cells)).agg(
        F.coalesce(F.sum("replaced"), F.lit(0)).cast("bigint").alias("replaced"),
        F.count_if(F.col("replaced") > 0).alias("cells"), F.count_if("cut").alias("cut"))
    fitted = wide.withColumns({c: F.col(f"_{c}.shown") for c in columns}).drop(*[f"_{c}" for c in columns])
    return fitted, changes


def not_a_formula(text: Column) -> Column:
    """Text a spreadsheet cannot read as a formula: an apostrophe ahead of a formula start."""
    return F.when(F.substring(text, 1, 1).isin(list(FORMULA_STARTS)), F.concat(F.lit("'"), text)).otherwise(text)
