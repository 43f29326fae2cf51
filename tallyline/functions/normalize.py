"""Canonical forms of invoice fields as column expressions (no Python worker)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters with their digits; legal tokens dropped anywhere; legal tokens dropped at the end;
# currency words dropped from amounts; layouts in which dates are read, in order of preference.
LOOKALIKE = {"O": "0", "I": "1", "L": "1", "S": "5", "B": "8", "Z": "2", "G": "6"}
LEGAL_ANYWHERE = ("PT", "CV", "UD", "FA")
LEGAL_AT_END = (
    "TBK", "PERSERO", "PKP", "LTD", "LIMITED", "INC", "INCORPORATED", "LLC", "PLLC", "PTE", "PTY", "PLC", "GMBH", "AG", "SA", "SAS", "SARL",
    "SRL", "SPA", "BV", "NV", "AB", "AS", "APS", "OY", "SDN", "BHD", "KK", "KFT", "CORP", "CORPORATION", "CO",
)
CURRENCY_WORDS = ("rp", "idr", "usd", "eur", "gbp")
DATE_LAYOUTS = ("yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy")


def invoice_no_canonical(raw: Column) -> Column:
    """Upper case without separators, look-alike letters beside a digit read as digits. Null gives ''.

    Whether a letter stands beside a digit is asked of the text as it was: letters turn into lower-case place holders
    first (which are no digits, so nothing cascades) and into digits at the end.
    """
    text = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9A-Za-z]+", ""))
    for letter in LOOKALIKE:
        text = F.regexp_replace(text, f"(?<=[0-9]){letter}|{letter}(?=[0-9])", letter.lower())
    return F.translate(text, "".join(LOOKALIKE).lower(), "".join(LOOKALIKE.values()))


def vendor_canonical(raw: Column) -> Column:
    """Upper-case tokens in order, without legal forms. Null gives ''."""
    text = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"(?U)\s+", " ")
    tokens = F.filter(F.split(F.regexp_replace(text, r"[.,/()\-]+", " "), " +"), lambda t: (t != "") & ~t.isin(*LEGAL_ANYWHERE))
    ends = "|".join(LEGAL_AT_END)
    return F.regexp_replace(F.array_join(tokens, " "), rf"(?:^| )(?:{ends})(?: (?:{ends}))*$", "")


def vendor_key(canonical: Column) -> Column:
    """The tokens of a canonical vendor name sorted, so that their order doesn't count."""
    return F.array_join(F.array_sort(F.split(canonical, " ")), " ")


def tax_id_canonical(raw: Column) -> Column:
    """The digits. Null gives ''."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]+", "")


def amount_parsed(raw: Column) -> Column:
    """Whole units of an amount written in a common way; null if it isn't one or exceeds 64 bits.

    With both separators the later is the decimal one. One kind alone groups thousands if every group after the first
    has three digits, else it is the decimal one. Halves round away from zero.
    """
    words = "|".join(CURRENCY_WORDS)
    text = F.regexp_replace(raw, rf"(?i)\b(?:{words})\b\.?", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[^\d.,\-]", ""), "^[., ]+|[., ]+$", "")
    comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    last_comma = F.length(text) - F.instr(F.reverse(text), ",")
    last_dot = F.length(text) - F.instr(F.reverse(text), ".")

    def single(mark: str) -> Column:
        parts = F.split(text, rf"\{mark}")
        thousands = F.forall(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.length(p) == 3)
        return F.when(thousands, F.array_join(parts, "")).otherwise(F.replace(text, F.lit(mark), F.lit(".")))

    plain = (
        F.when(comma & dot & (last_comma > last_dot), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & dot, F.replace(text, F.lit(","), F.lit("")))
        .when(comma, single(","))
        .when(dot, single("."))
        .otherwise(text)
    )
    number = F.when(plain.rlike(r"^-?\d*\.?\d*$") & plain.rlike(r"\d"), plain)
    return F.round(number.try_cast("decimal(38,10)"), 0).try_cast("bigint")


def billing_period(day: Column) -> Column:
    """'yyyy-MM', '' for null."""
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(""))


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose day is moved into the month if it lies outside."""
    last = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.make_date(year, month, F.least(F.greatest(day, F.lit(1)), last))


def date_parsed(raw: Column) -> Column:
    """A date in the first of DATE_LAYOUTS that fits; null if none does. Month names in any case, blanks collapsed."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\.+$", ""), r"\s+", " ")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(layout)).cast("date") for layout in DATE_LAYOUTS))


def loose_text(raw: Column) -> Column:
    """Lower-case letters and digits only: how two fields are compared for display."""
    return F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z0-9]+", "")
