"""Codes, routing targets and tokens found in text, as Column expressions.

Patterns keep to what Java and RE2 read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespan.functions.decisions import ladder, text_of

# Patterns of codes and routing phrases.
EOB = r"\b([EFW][0-9]{2})\b"
EX_GROUP = r"EX\s*(?:CODE\s*)?([0-9]{3}(?:\s*/\s*[0-9]{3})*)"
SYSTEM = r"\bF([3-5])\b"
DOCUMENT_CODE = r"\b([EFW][0-9]{2,3})\b|EX\s*[Cc]ode\s+([A-Za-z0-9]{2,5})|\b(OCA|o01|020|003|346|CDD|F3|F4|F5)\b"
GOTO_VERB = r"(?i)(?:skip to|proceed to|go to|directly to|jump to)\s+step\s+([0-9]+)"
GOTO_DIRECTLY = r"(?i)step\s+([0-9]+)\s+directly"
NEXT_STEP = r"(?i)\b(?:proceed|continue|go|move|advance|on)\s+to\s+(?:the\s+)?next\s+step\b"
DOCUMENT_WORDS = r"(?i)\b(P&P|Policy|Procedure|Calculator|Codes?\s+List|Bulletin|Process|Validation|Instruction|Glossary|Attachment)\b"
PERIOD = r"(?i)([0-9]+)\s+(days?|months?|years?)"


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(pattern), F.lit(group))


def eob_codes(text: Column) -> Column:
    return F.array_distinct(all_matches(F.upper(text_of(text)), EOB))


def ex_codes(text: Column) -> Column:
    chunks = F.array_join(all_matches(F.upper(text_of(text)), EX_GROUP), "/")
    return F.array_distinct(all_matches(chunks, r"([0-9]{3})"))


def denial_codes(text: Column) -> Column:
    return F.when(F.upper(text_of(text)).contains("CDD"), F.array(F.lit("CDD"))).otherwise(F.array().cast("array<string>"))


def system_codes(text: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(F.upper(text_of(text)), SYSTEM), lambda n: F.concat(F.lit("F"), n)))


def all_codes(text: Column) -> Column:
    return F.struct(eob_codes(text).alias("eob"), ex_codes(text).alias("ex"), denial_codes(text).alias("denial"), system_codes(text).alias("sysact"))


def document_codes(text: Column) -> Column:
    """Codes of the wider pattern, as it reads documents; in order, once each."""
    whole = all_matches(text, DOCUMENT_CODE, 0)
    return F.array_distinct(F.transform(whole, lambda m: F.regexp_replace(m, r"^EX\s*[Cc]ode\s+", "")))


def first_goto(text: Column) -> Column:
    t = text_of(text)
    verb, direct = F.regexp_extract(t, GOTO_VERB, 1), F.regexp_extract(t, GOTO_DIRECTLY, 1)
    return F.coalesce(F.nullif(verb, F.lit("")), F.nullif(direct, F.lit(""))).try_cast("int")


def all_gotos(text: Column) -> Column:
    """Targets of verb phrases, then of "directly" phrases, once each."""
    found = F.concat(all_matches(text, GOTO_VERB), all_matches(text, GOTO_DIRECTLY))
    return F.array_distinct(F.transform(found, lambda n: n.try_cast("int")))


def resolve_goto(text: Column, nav_op: Column, nav_step: Column, current: Column) -> Column:
    """Structured target, else explicit number, else the step after ``current``."""
    onward = nav_op.isin("next", "proceed") | text_of(text).rlike(NEXT_STEP)
    return F.coalesce(F.when(nav_op == "goto", nav_step), first_goto(text), F.when((current >= 1) & F.coalesce(onward, F.lit(False)), current + 1)).cast("int")


def as_list(values: Column) -> Column:
    """Trimmed entries without blanks and lone dashes."""
    return F.filter(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.trim(v)), lambda v: (v != "") & (v != "-"))


def code_type(code: Column) -> Column:
    c = F.upper(F.trim(text_of(code)))
    return ladder(
        "UNKNOWN",
        ("EOB", c.rlike("^[EFW][0-9]{2}$")),
        ("EX", c.rlike("^[0-9]{3}$")),
        ("DENIAL", c.isin("CDD", "CDS", "CDA")),
        ("SYSTEM_ACT", c.rlike("^F[3-9]$")),
        ("POS", c.rlike("^[0-9]{2}$")),
        ("REVENUE", c.rlike("^[0-9]{4}$")),
        ("CPT", c.rlike("^([A-Z][0-9]{4}|[0-9]{5})$")),
    )


def cpt_base(raw: Column) -> Column:
    """Five digits of a numeric code, padded; other codes as they are."""
    s = F.trim(text_of(raw))
    return F.when(s.rlike("^[0-9]+$"), F.when(F.length(s) >= 5, F.substring(s, 1, 5)).otherwise(F.lpad(s, 5, "0"))).otherwise(s)


def cpt_modifiers(raw: Column) -> Column:
    """The two last digits of a numeric code of over five."""
    s = F.trim(text_of(raw))
    return F.when(s.rlike("^[0-9]{6,}$"), F.array(F.right(s, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def modifier_tokens(policy: Column) -> Column:
    """Two-letter and two-digit tokens of a policy text, sorted, once each."""
    tokens = F.transform(all_matches(policy, "([A-Za-z0-9]+)"), F.upper)
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike("^([0-9]{2}|[A-Z]{2})$"))))


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(all_matches(F.lower(text_of(text)), "([a-z0-9]{3,})")))


def approximate_tokens(text: Column) -> Column:
    """Token count where no tokenizer is at hand."""
    return F.floor(F.length(text_of(text)) / 3).cast("int") + 1


def looks_like_reference(text: Column) -> Column:
    words = F.size(F.filter(F.split(text_of(text), r"\s+"), lambda w: w != ""))
    return (words >= 3) & text_of(text).rlike(DOCUMENT_WORDS)


def limit_period(text: Column) -> Column:
    """First "N days/months/years": number and unit in the plural."""
    n = F.regexp_extract(text_of(text), PERIOD, 1).try_cast("int")
    unit = F.regexp_replace(F.lower(F.regexp_extract(text_of(text), PERIOD, 2)), "s$", "")
    return F.struct(n.alias("n"), F.when(n.isNotNull(), F.concat(unit, F.lit("s"))).alias("unit"))
