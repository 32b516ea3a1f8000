"""Normalising scalars: formats, links, identifiers, dates, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespan.functions.decisions import ladder, mentions, text_of

# Media types and file endings.
MEDIA_TYPES = {
    "text/html": "HTML",
    "application/xhtml+xml": "HTML",
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
    "application/msword": "DOCX",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX",
    "application/vnd.ms-excel": "XLSX",
}
ENDINGS = {".html": "HTML", ".htm": "HTML", ".docx": "DOCX", ".doc": "DOCX", ".xlsx": "XLSX", ".xls": "XLSX", ".pdf": "PDF"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def media_format(content_type: Column) -> Column:
    """Format by media type without its parameters, else null."""
    return _lookup(F.lower(F.trim(F.element_at(F.split(text_of(content_type), ";"), 1))), MEDIA_TYPES)


def ending(url: Column) -> Column:
    """The lower-case file ending of a url's path, "" if it has none."""
    path = F.regexp_replace(F.regexp_replace(text_of(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"[^/.](\.[A-Za-z0-9]+)$", 1))


def ending_format(url: Column) -> Column:
    return _lookup(ending(url), ENDINGS)


def magic_format(content: Column) -> Column:
    """Format by the first bytes; a zip container reports ZIP until its names are read."""
    head = F.decode(F.substring(content, 1, 16), "ISO-8859-1")
    low = F.lower(head)
    return ladder("UNKNOWN", ("PDF", low.startswith("%pdf")), ("ZIP", head.startswith("PK\x03\x04")), ("HTML", low.startswith("<!doctype") | low.startswith("<html") | low.startswith("<?xml")))


def detect_format(content_type: Column, url: Column, content: Column) -> Column:
    return F.coalesce(media_format(content_type), ending_format(url), magic_format(content))


def link_type(href: Column) -> Column:
    h = text_of(href)
    by_ending = F.coalesce(ending_format(h), F.lit("HTML"))
    return F.when((h == "") | (h == "#"), "UNRESOLVED").when(h.startswith("#"), "INTERNAL_ANCHOR").when(by_ending == "HTML", "HTML_SOP").otherwise(by_ending)


def with_scheme(url: Column) -> Column:
    u = F.trim(text_of(url))
    return F.when(u == "", F.lit(None)).when(u.rlike("^(https?://|file://|/)"), u).otherwise(F.concat(F.lit("https://"), u))


def normalise_url(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.element_at(F.split(text_of(url), "#"), 1), "/+$", "")


def clean_name(text: Column) -> Column:
    """Upper-case letters and blanks before the first ``$``, digit or "HMO"."""
    head = F.regexp_replace(text_of(text), r"(?i)(?s)(\$|[0-9]|\bHMO\b).*$", "")
    return F.trim(F.upper(F.regexp_replace(head, "[^A-Za-z ]", "")))


def product_line(product: Column) -> Column:
    p = F.lower(text_of(product))
    return ladder("Commercial", ("Medicare", p.contains("medicare")), ("Medicaid", p.contains("medicaid")))


def line_of_business(group: Column, plan: Column, matched_product: Column) -> Column:
    """Keywords of group and plan name, else the product matched by name."""
    names = F.lower(F.concat_ws(" ", text_of(group), text_of(plan)))
    return ladder("Commercial", ("Medicare", mentions(names, "medicare")), ("Medicaid", mentions(names, "medicaid")), ("Medicare", product_line(matched_product) == "Medicare"), ("Medicaid", product_line(matched_product) == "Medicaid"))


def digits(value: Column) -> Column:
    return F.regexp_replace(text_of(value), "[^0-9]", "")


def is_npi(value: Column) -> Column:
    return text_of(value).rlike("^[0-9]{10}$")


def content_hash(content: Column) -> Column:
    return F.left(F.sha2(content, 256), F.lit(16))


def block_id(html: Column) -> Column:
    return F.concat(F.lit("html-"), F.left(F.sha1(text_of(html)), F.lit(12)))


def endpoint_key(method: Column, url: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(" ", F.upper(method), url), 256), F.lit(32))


def without_nul(text: Column) -> Column:
    return F.translate(text_of(text), "\x00", "")


def shorten(text: Column, n: int = 80) -> Column:
    """At most ``n`` characters and an ellipsis."""
    t = F.trim(text_of(text))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("…")))


def decision_group(section: Column, table_name: Column) -> Column:
    """The ``[section]`` in front of a text, else the table's name."""
    return F.coalesce(F.nullif(F.regexp_extract(text_of(section), r"^\s*\[([^\]]+)\]", 1), F.lit("")), text_of(table_name))


def parse_iso(value: Column) -> Column:
    """ISO date-time, ``Z`` allowed; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text_of(value), "Z$", "+00:00"))


def parse_date(value: Column) -> Column:
    """Strict yyyy-MM-dd, else null."""
    v = F.trim(text_of(value))
    return F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), v.try_cast("date"))


def iso_text(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm:ss a")


def duration_text(ms: Column) -> Column:
    """``1m 04s``, or seconds alone below a minute."""
    s = F.floor(ms / 1000).cast("int")
    minutes = F.floor(s / 60).cast("int")
    return F.when(ms.isNull(), F.lit(None)).when(minutes > 0, F.format_string("%dm %02ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))


def minutes_between(start: Column, end: Column, places: int) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 60e6, places)


def opt_out_status(end: Column, now: Column) -> Column:
    """Whether an opt-out that ends at ``end`` still holds at ``now``."""
    at = F.coalesce(F.try_to_timestamp(text_of(end), F.lit("MM/dd/yyyy")), parse_iso(end))
    return F.when(at.isNull(), "Unknown").when(at >= now, "Yes").otherwise("No (Expired)")


def money(value: Column) -> Column:
    """A plain amount, ``.5`` allowed, else null."""
    v = F.regexp_replace(F.regexp_replace(F.trim(text_of(value)), "[$,]", ""), r"^\.", "0.")
    return F.when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), v.try_cast("double"))


def whole_number(value: Column) -> Column:
    return value.try_cast("int")
