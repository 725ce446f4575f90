"""Column expressions: cleaning, validation, classification, safe arithmetic and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ANNUAL_MIN_DAYS = 300
QUARTER_MAX_DAYS = 120
PER_SHARE_KEYS = ("eps_basic", "eps_diluted")
SHARE_KEYS = ("shares_basic", "shares_diluted", "shares_outstanding")
DOC_TYPES = ("10-K", "10-Q", "8-K")
QUARTERS = ("Q1", "Q2", "Q3", "Q4", "FY")
AXIS_LABELS = {
    "ProductOrServiceAxis": "Product/Service",
    "StatementGeographicalAxis": "Geography",
    "StatementBusinessSegmentsAxis": "Operating Segment",
    "ConsolidationItemsAxis": "Consolidation",
}


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def clean_ticker(c: Column) -> Column:
    """Upper case, stripped; empty and "nan" are null."""
    up = F.upper(strip(c))
    return F.when(~up.isin("", "NAN"), up)


def is_ticker(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"), F.lit(False))


def is_doc_type(c: Column) -> Column:
    return F.coalesce(c.isin(*DOC_TYPES), F.lit(False))


def is_quarter(c: Column) -> Column:
    return F.coalesce(c.isin(*QUARTERS), F.lit(False))


def is_iso_date(c: Column) -> Column:
    """A date of the form yyyy-mm-dd that is on the calendar."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def bare_concept(c: Column) -> Column:
    """Without what stands before the first colon."""
    return F.regexp_replace(c, r"^[^:]*:", "")


def period(c: Column) -> Column:
    """instant_<end> or duration_<start>_<end> as struct(period_type, period_start, period_end); null for other keys."""
    parts = F.split(c, "_")
    kind, n = F.element_at(parts, 1), F.size(parts)

    def day(i: int) -> Column:
        return F.try_to_date(F.try_element_at(parts, F.lit(i)), "yyyy-MM-dd")

    fields = {"period_type": kind, "period_start": F.when(kind == "duration", day(2)), "period_end": F.when(kind == "duration", day(3)).otherwise(day(2))}
    shaped = ((kind == "instant") & (n == 2)) | ((kind == "duration") & (n == 3))
    return F.when(shaped & fields["period_end"].isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))


def keeps_period(kind: Column, start: Column, end: Column, form: Column) -> Column:
    """Instants always; durations of a year for annual forms and of a quarter for the others; without a start never."""
    days = F.datediff(end, start)
    return F.coalesce(F.when(kind == "instant", True).when(form == "10-K", days >= ANNUAL_MIN_DAYS).otherwise(days <= QUARTER_MAX_DAYS), F.lit(False))


def unit(key: Column) -> Column:
    return F.when(key.isin(*PER_SHARE_KEYS), "USD/shares").when(key.isin(*SHARE_KEYS), "shares").otherwise("USD")


def axis_label(axis: Column) -> Column:
    bare = bare_concept(axis)
    out = F.coalesce(F.nullif(bare, F.lit("")), F.lit("Segment"))
    for name, label in AXIS_LABELS.items():
        out = F.when(bare == name, label).otherwise(out)
    return out


def filing_quarter(form: Column, end: Column) -> Column:
    return F.when(form == "10-K", "FY").otherwise(F.coalesce(F.concat(F.lit("Q"), F.quarter(end)), F.lit("Q?")))


def trade_side(code: Column) -> Column:
    c = F.upper(strip(F.coalesce(code, F.lit(""))))
    return F.when(c == "P", "buy").when(c == "S", "sell").otherwise("other")


def number(c: Column) -> Column:
    """Double, null if it cannot be read or is NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    """Null where either side is null or the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def is_stale(stamp: Column, now: Column, days: int) -> Column:
    """Missing or unreadable stamps are stale, and those at least so many whole days old."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(stamp))) / 86_400)
    return F.coalesce(age >= days, F.lit(True))


def verdict(upside: Column) -> Column:
    return F.when(upside >= 0.20, "cheap").when(upside <= -0.20, "expensive").when(upside.isNotNull(), "fair")


def clamp_doc_type(c: Column) -> Column:
    up = F.upper(strip(c))
    return F.when(c.isNull(), None).when(up.isin("10-K", "10-Q"), up).otherwise("10-K")


def change_label(current: Column, previous: Column) -> Column:
    """Of a position between two quarters; nulls are zero."""
    cur, prev = F.coalesce(current, F.lit(0.0)), F.coalesce(previous, F.lit(0.0))
    return F.when((prev <= 0) & (cur > 0), "new").when((cur <= 0) & (prev > 0), "exited").when(cur > prev, "added").when(cur < prev, "trimmed").otherwise("unchanged")


def moved(current: Column, previous: Column, tolerance: float = 0.05) -> Column:
    """Relative change of at least the tolerance; null if either side is."""
    scale = F.greatest(F.abs(previous), F.abs(current), F.lit(1e-9))
    return F.when(current.isNotNull() & previous.isNotNull(), F.abs(current - previous) / scale >= tolerance)


def close_to(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def first_line(c: Column, limit: int = 140) -> Column:
    return F.substring(F.substring_index(c, "\n", 1), 1, limit)


def cut_payload(payload: Column, is_table: Column, limit: int = 2000, row_end: str = "</tr>") -> Column:
    """At most `limit` characters; a table is cut behind its last whole row, if one ends within them."""
    head = F.substring(payload, 1, limit)
    rows = F.regexp_extract(head, rf"(?s)^.*{row_end}", 0)
    return F.when(F.length(payload) <= limit, payload).when(is_table & (rows != ""), rows).otherwise(head)


def fixed(c: Column, digits: int, grouped: bool = False) -> Column:
    """A number with so many digits behind the point, rounded from its exact binary value; halves go to the even digit."""
    shown = F.format_number(c.cast("double"), digits)
    return shown if grouped else F.replace(shown, F.lit(","), F.lit(""))


def money(c: Column) -> Column:
    """Dollars by billions, millions or whole."""
    size = F.abs(c)
    return F.when(c.isNull(), "n/a").when(size >= 1e9, F.concat(F.lit("$"), fixed(c / 1e9, 1), F.lit("B"))).when(size >= 1e6, F.concat(F.lit("$"), fixed(c / 1e6, 1), F.lit("M"))).otherwise(F.concat(F.lit("$"), fixed(c, 0, True)))


def percent(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.concat(fixed(c * 100, 1), F.lit("%")))


def times(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.concat(fixed(c, 1), F.lit("x")))


def flow_tone(buys: Column, sells: Column) -> Column:
    return F.when(buys > sells, "positive").when(sells > buys, "negative").otherwise("neutral")


def verdict_tone(c: Column) -> Column:
    return F.when(c == "cheap", "positive").when(c == "expensive", "negative").otherwise("neutral")


def flag_tone(direction: Column) -> Column:
    return F.when(direction == "bull", "positive").when(direction == "bear", "negative").otherwise("neutral")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def dollars_text(c: Column) -> Column:
    """Dollars by billions, millions, thousands or whole, without a zero behind the point; a dash where there is no number."""
    size, sign = F.abs(c), F.when(c < 0, "−").otherwise("")

    def compact(scale: float, mark: str) -> Column:
        return F.concat(sign, F.lit("$"), F.regexp_replace(fixed(size / scale, 1), r"\.0$", ""), F.lit(mark))

    return F.when(~F.coalesce(_finite(c), F.lit(False)), "—").when(size >= 1e9, compact(1e9, "B")).when(size >= 1e6, compact(1e6, "M")).when(size >= 1e3, compact(1e3, "K")).otherwise(F.concat(sign, F.lit("$"), fixed(size, 0, True)))


def shares_text(c: Column) -> Column:
    """A number of shares by millions, thousands or whole, with one digit below ten of a unit; a dash where there is no number."""
    size = F.abs(c)

    def compact(scale: float, mark: str) -> Column:
        return F.concat(F.when(size >= 10 * scale, fixed(c / scale, 0)).otherwise(fixed(c / scale, 1)), F.lit(mark))

    return F.when(~F.coalesce(_finite(c), F.lit(False)), "—").when(size >= 1e6, compact(1e6, "M")).when(size >= 1e3, compact(1e3, "K")).otherwise(fixed(c, 0, True))


def price_text(c: Column) -> Column:
    return F.when(_finite(c), F.concat(F.lit("$"), fixed(c, 2)))


def share_of_book_text(c: Column) -> Column:
    """Percent of a book; null where there is none."""
    return F.when(_finite(c) & (c != 0), F.concat(F.when(c >= 10, fixed(c, 0)).otherwise(fixed(c, 1)), F.lit("%")))


def change_tone(label: Column) -> Column:
    return F.when(label.isin("new", "added"), "positive").when(label.isin("trimmed", "exited"), "negative").otherwise("neutral")


#: Parts of an error's text and what the user reads, in order.
ERRORS = (
    (("no xbrl", "not found", "no filing", "no matching"), "Couldn't find {ticker}'s {doc_type} on EDGAR — it may not exist or use a different ticker."),
    (("rate", "429", "too many", "throttl"), "SEC EDGAR is rate-limiting right now — try {ticker} again in a moment."),
    (("timeout", "timed out", "connection", "network", "resolve", "getaddrinfo", "ssl"), "Couldn't reach SEC EDGAR right now — try {ticker} again shortly."),
)
ANY_ERROR = "Couldn't fetch {ticker}'s {doc_type} right now — please try again."


def friendly_error(message: Column, ticker: Column, doc_type: Column) -> Column:
    """What the user reads of an error: the first rule with a part that the text holds."""
    low = F.lower(F.coalesce(message, F.lit("")))

    def said(text: str) -> Column:
        return F.replace(F.replace(F.lit(text), F.lit("{ticker}"), ticker), F.lit("{doc_type}"), doc_type)

    out = said(ANY_ERROR)
    for needles, text in reversed(ERRORS):
        found = F.lit(False)
        for n in needles:
            found = found | low.contains(n)
        out = F.when(found, said(text)).otherwise(out)
    return out


def clamped(value: Column, low: int, high: int) -> Column:
    """A number of results inside its bounds."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


#: Bounds of what may be asked for.
INSIDER_LIMIT, FUND_TOP, SEARCH_TOP = (1, 30), (1, 100), (1, 20)
