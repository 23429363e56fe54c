"""Lines of an exported transcript: placeholders, centring, filling, dates, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_spaces, wrap_words

# Fixed values ---------------------------------------------------------------------------------------------------
#: Fields of a case and their defaults.
CASE_FIELDS = {
    "header_line_1": "", "header_line_2": "", "header_line_3": "", "header_line_4": "", "email": "", "mobile": "",
    "complainant": "", "criminal_case_no": "0000", "case_for": "", "accused": "", "proceeding": "",
    "hearing_date": "", "hearing_time": "", "hearing_period": "afternoon", "place": "", "judge_name": "",
    "public_prosecutor": "", "defense_counsel": "", "court_interpreter": "", "court_stenographer": "",
    "order_text": "", "certifier_name": "",
}
PAGE_WIDTH = 88
RULE = "x" + "-" * (PAGE_WIDTH - 2) + "x"
BODY_INDENT = 8
BODY_LINES_PER_PAGE = 45
# -----------------------------------------------------------------------------------------------------------------


def value(field: str) -> Column:
    return trim_spaces(F.coalesce(F.col(field), F.lit("")))


def case_field(stored: Column, field: str) -> Column:
    """The stored value unless it is null or empty, else the field's default."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.lit(CASE_FIELDS[field]))


def normalize_case_no(column: Column) -> Column:
    """Letters and digits in lower case; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+", "")


def file_slug(column: Column, default: str = "transcript") -> Column:
    """Runs of anything but letters and digits become one underscore, none at the ends; empty gives the default."""
    slug = F.btrim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def display_date(column: Column) -> Column:
    """2024-01-05 as January 05, 2024; anything else as it is; null as ''."""
    raw = trim_spaces(F.coalesce(column, F.lit("")))
    valid = F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(raw, F.lit("yyyy-M-d")))
    return F.coalesce(F.date_format(valid, "MMMM dd, yyyy"), raw)


def display_time(column: Column) -> Column:
    """14:05 as 2:05; anything else as it is; null as ''."""
    raw = trim_spaces(F.coalesce(column, F.lit("")))
    valid = F.when(raw.rlike(r"^\d{1,2}:\d{1,2}$"), F.try_to_timestamp(raw, F.lit("H:m")))
    return F.coalesce(F.date_format(valid, "h:mm"), raw)


def blank_or_value(column: Column, width: int = 28) -> Column:
    return let(trim_spaces(F.coalesce(column, F.lit(""))), lambda raw: F.when(raw == "", F.lit("_" * width)).otherwise(raw))


def center(column: Column, width: Column | int = PAGE_WIDTH) -> Column:
    """Centred; an odd space goes to the left if the width is odd, else to the right."""
    width = F.lit(width) if isinstance(width, int) else width


    def pad(text: Column) -> Column:
        spare = F.greatest(width - F.length(text), F.lit(0))
        left = F.floor(spare / 2).cast("int") + spare.bitwiseAND(width).bitwiseAND(F.lit(1))
        return F.concat(F.repeat(F.lit(" "), left), text, F.repeat(F.lit(" "), spare - left))

    return let(column, pad)


def right(column: Column, width: int = PAGE_WIDTH) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(column), F.lit(0))), column)


def left_right(left: Column, right_: Column, width: int = PAGE_WIDTH) -> Column:
    """Both at the ends of a line, or one space apart if they don't fit."""


    def fill(both: Column) -> Column:
        a, b = both["a"], both["b"]
        room = F.lit(width) - F.length(a) - F.length(b)
        return F.when(room <= 1, F.btrim(F.concat(a, F.lit(" "), b))).otherwise(F.concat(a, F.repeat(F.lit(" "), F.greatest(room, F.lit(0))), b))

    return let(F.struct(left.alias("a"), right_.alias("b")), fill)


def wrap_line(column: Column, width: int = PAGE_WIDTH, indent: int = 0) -> Column:
    """array<string>: a blank line stays blank, one that fits gets the indent, others are wrapped, indent included."""
    pad = F.lit(" " * indent)

    def wrap(line: Column) -> Column:
        wrapped = F.transform(wrap_words(line, max(20, width) - indent), lambda s: F.concat(pad, s))
        return F.when(trim_spaces(line) == "", F.array(F.lit(""))).when(F.length(line) <= width, F.array(F.concat(pad, line))).otherwise(wrapped)

    return let(column, wrap)


def _lines(*columns: Column) -> Column:
    return F.flatten(F.transform(F.array(*columns), lambda s: wrap_line(s)))


def _role(field: str, role: str) -> tuple[Column, Column, Column]:
    return center(blank_or_value(F.col(field))), center(F.lit(role)), F.lit("")


def front_page() -> Column:
    """array<string> from the columns of CASE_FIELDS (dates and times as they are to be shown)."""
    # The wording and widths below.
    held = lambda field, width: blank_or_value(F.col(field), width)
    complainant, accused = F.concat(held("complainant", 30), F.lit(",")), F.concat(held("accused", 30), F.lit(","))
    column_width = F.greatest(F.length(complainant), F.length(accused), F.lit(34))
    taken = F.concat(
        F.lit("of the stenographic notes taken down by the undersigned during the "), held("proceeding", 18), F.lit(" in the above-entitled case held on "), held("hearing_date", 14),
        F.lit(" at "), held("hearing_time", 8), F.lit(" o'clock in the "), held("hearing_period", 12), F.lit(" at the "), held("place", 24), F.lit(" before the "), held("judge_name", 24), F.lit(", Presiding Judge."),
    )
    none = F.lit("")
    return _lines(
        *(center(held(f"header_line_{i}", 36)) for i in (1, 2, 3, 4)),
        center(F.concat(F.lit("Email Add: "), held("email", 28))), center(F.concat(F.lit("Mobile Number: "), held("mobile", 16))), none,
        left_right(complainant, F.concat(F.lit("Criminal Case No. "), held("criminal_case_no", 8))),
        left_right(center(F.lit("- versus -"), column_width), F.concat(F.lit("For: "), held("case_for", 26))), none,
        accused, F.lit(" " * 12 + "Accused."), F.lit(RULE), none, center(F.lit("T R A N S C R I P T")), none, taken, none, F.lit("A P P E A R A N C E S:"), none,
        *_role("public_prosecutor", "Public Prosecutor"), *_role("defense_counsel", "Counsel for the Accused"), F.lit("P R E S E N T:"), none,
        *_role("court_interpreter", "Court Interpreter"), *_role("court_stenographer", "Court Stenographer"), F.lit(RULE),
    )


def page_header(page_no: Column, total: Column) -> Column:
    """array<string>: the running header of a page."""
    held = lambda field, width: blank_or_value(F.col(field), width)
    return F.array(
        F.lit("TSN"), F.concat(F.lit("Criminal Case No. "), held("criminal_case_no", 8)), F.concat(held("complainant", 19), F.lit(" vs. "), held("accused", 19)),
        F.concat(F.lit("For: "), held("case_for", 26)), F.when(value("proceeding") == "", F.lit("Trial")).otherwise(value("proceeding")),
        left_right(F.concat(F.lit("Page "), page_no.cast("string"), F.lit(" of "), total.cast("string")), held("hearing_date", 14)), F.lit(RULE),
    )


def certification_page() -> Column:
    # The wording and widths below.
    certifier = blank_or_value(F.coalesce(F.nullif(F.col("certifier_name"), F.lit("")), F.col("court_stenographer")), 20)
    none = F.lit("")
    return F.array(
        F.lit(RULE), none, F.lit("I HEREBY CERTIFY THAT THIS IS TRUE AND CORRECT TO THE BEST OF MY KNOWLEDGE AND BELIEF."), none, none, none,
        F.concat(F.lit("___    "), certifier), F.lit("         Stenographer"),
    )
