"""Dispositions and statuses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Disposition and status vocabularies.
PRECEDENCE = ("DENY", "STOP", "PEND", "REFER", "BYPASS", "WAIVE", "CONDITIONAL", "SYSTEM", "ALLOW")
ADVERSE = ("DENY", "STOP", "REFER", "REFERRAL", "PEND", "PENDED")
CLEAN_TYPES = ("ALLOW", "APPROVE", "APPROVED", "PAY", "PASS")
HALTING = ("DENY", "STOP")
COVERAGE_TOOLS = ("cbd_coverage", "check_medicare_coverage", "check_coverage_commercial", "check_coverage_medicaid")
MET_TOKENS = ("met", "match", "matched", "pass", "passed", "clean", "allow", "ok")
NOT_MET_TOKENS = ("not-met", "notmet", "fail", "failed", "deny", "denied", "defect", "stop", "refer", "referral", "pend", "pended")
INCONCLUSIVE_TOKENS = ("inconclusive", "unknown", "indeterminate", "n/a", "na")
OUT_OF_SCOPE_PHRASES = ("out of scope", "out-of-scope", "stop further auditing", "stop auditing further")
REVIEWERS = ("NURSE", "SPECIALIST", "MEDICAL DIRECTOR", "CLINICAL REVIEW", "MANUAL REVIEW", "REVIEWER", "ADJUSTER", "REFER THE CLAIM", "REFER FOR", "REFER TO A ")
PRE_RULE_TYPES = ("DENY", "ALLOW", "BYPASS", "OVERRIDE", "ELIGIBILITY", "REFER", "NOTE", "WAIVE", "PEND")


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def mentions(text: Column, *phrases: str) -> Column:
    """Whether any phrase occurs."""
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def ladder(default: str, *steps: tuple[str, Column]) -> Column:
    """The label of the first step that holds."""
    label, first = steps[0]
    chain = F.when(first, label)
    for label, condition in steps[1:]:
        chain = chain.when(condition, label)
    return chain.otherwise(default)


def classify_decision(text: Column) -> Column:
    """The authoritative disposition of a rule's text; routing and
    out-of-scope phrases are no dispositions."""
    t = F.regexp_replace(F.upper(text_of(text)), "[-_]+", " ")
    return ladder(
        "CONDITIONAL",
        ("DENY", mentions(t, "CDD", "DENY", "DENIAL", "DENIED")),
        ("BYPASS", mentions(t, "BYPASS", "OVERRIDE")),
        ("PEND", t.contains("PEND")),
        ("WAIVE", t.contains("WAIVE")),
        ("ALLOW", t.rlike(r"\bALLOW\b") | (t.contains("PROCESS") & t.contains("F3"))),
        ("REFER", t.contains("REFERRAL") | (t.contains("REFER") & mentions(t, *REVIEWERS))),
        ("STOP", t.contains("STOP") & ~t.contains("OUT OF SCOPE")),
    )


def classify_decision_document(text: Column) -> Column:
    """The variant for text read from procedure documents."""
    t = F.lower(text_of(text))
    return ladder(
        "CONDITIONAL",
        ("DENY", mentions(t, "deny", "denial", "zero out", "reduce to 0")),
        ("BYPASS", t.contains("bypass")),
        ("ALLOW", t.contains("allow")),
        ("PEND", mentions(t, "pend", "f5")),
        ("WAIVE", t.contains("waive")),
        ("REFER", mentions(t, "refer to", "follow the", "proceed to", "skip to")),
        ("STOP", mentions(t, "does not apply", "this p&p")),
        ("SYSTEM", mentions(t, "(f3)", "(f4)", "process the claim", "save the claim")),
    )


def classify_decision_flat(text: Column, denial_codes: Column) -> Column:
    """The variant of the flat writer, which also knows the denial codes found."""
    t = F.upper(text_of(text))
    return ladder(
        "CONDITIONAL",
        ("DENY", (F.coalesce(F.size(denial_codes), F.lit(0)) > 0) | mentions(t, "CDD", "DENY", "DENIAL")),
        ("BYPASS", mentions(t, "BYPASS", "OVERRIDE")),
        ("PEND", t.contains("PEND")),
        ("ALLOW", t.contains("ALLOW") | (t.contains("PROCESS") & t.contains("F3"))),
        ("WAIVE", t.contains("WAIVE")),
        ("STOP", mentions(t, "STOP", "DO NOT")),
    )


def classify_precondition(declared: Column, is_exception: Column, action: Column, condition: Column) -> Column:
    """The type of a rule found in a section before the steps."""
    given = F.upper(text_of(declared))
    t = F.upper(F.concat(text_of(action), F.lit(" "), text_of(condition)))
    found = ladder(
        "NOTE",
        ("OVERRIDE", F.coalesce(is_exception, F.lit(False))),
        ("DENY", t.contains("DENY")),
        ("ALLOW", t.contains("ALLOW")),
        ("BYPASS", mentions(t, "BYPASS", "OVERRIDE")),
        ("PEND", t.contains("PEND")),
        ("WAIVE", t.contains("WAIVE")),
    )
    return F.when(given.isin(*PRE_RULE_TYPES), given).otherwise(found)


def is_out_of_scope(*texts: Column) -> Column:
    return mentions(F.lower(F.concat_ws(" ", *map(text_of, texts))), *OUT_OF_SCOPE_PHRASES)


def infer_aggregation(output: Column, has_children: Column) -> Column:
    o = F.lower(text_of(output))
    return ladder(
        "FIRST_MATCH",
        ("LEAF", ~has_children),
        ("ANY", mentions(o, "any pair", "any of the above")),
        ("XOR_ONE", mentions(o, "only one subrule", "exactly one")),
        ("ALWAYS_MET", o.contains("always") & o.contains("met")),
    )


def map_aggregation(rule: Column) -> Column:
    """The kind that an explicit rule names, else null."""
    s = F.lower(F.trim(text_of(rule)))
    return (
        F.when(s.contains("applicable"), "APPLICABLE_ONLY")
        .when(s.isin("any_clean", "any", "any_match"), "ANY")
        .when(mentions(s, "xor", "exactly_one", "only_one"), "XOR_ONE")
        .when(s.contains("first"), "FIRST_MATCH")
        .when(s.contains("always"), "ALWAYS_MET")
    )


def rule_status(raw: Column) -> Column:
    """Met, Not-Met, Inconclusive, Skipped, or "" where the word is unknown."""
    s = F.regexp_replace(F.lower(F.trim(text_of(raw))), "[_ ]", "-")
    return ladder("", ("Skipped", s.isin("skipped", "skip")), ("Met", s.isin(*MET_TOKENS)), ("Not-Met", s.isin(*NOT_MET_TOKENS)), ("Inconclusive", s.isin(*INCONCLUSIVE_TOKENS)))


def audit_status(raw: Column) -> Column:
    """CLEAN, DEFECT, INCONCLUSIVE, or "" for what was skipped."""
    s = rule_status(raw)
    return ladder("INCONCLUSIVE", ("CLEAN", s == "Met"), ("DEFECT", s == "Not-Met"), ("", s == "Skipped"))


def decision_status(decision: Column) -> Column:
    d = F.upper(F.trim(text_of(decision)))
    return ladder("", ("DEFECT", d.isin(*ADVERSE)), ("CLEAN", d.isin(*CLEAN_TYPES)), ("INCONCLUSIVE", d == "INCONCLUSIVE"))


def _clean_exclusion(out_of_scope: Column, codes: Column) -> Column:
    return F.coalesce(out_of_scope, F.lit(False)) & (F.coalesce(F.size(codes), F.lit(0)) <= 0)


def applies_defect(skipped: Column, matched: Column, decision: Column) -> Column:
    """A rule that fired with an adverse disposition."""
    return ~F.coalesce(skipped, F.lit(False)) & F.coalesce(matched, F.lit(False)) & F.upper(text_of(decision)).isin(*ADVERSE)


def evaluation_status(skipped: Column, out_of_scope: Column, codes: Column, explicit: Column, matched: Column, decision: Column) -> Column:
    """The status of one evaluation."""
    told, hit = rule_status(explicit), F.coalesce(matched, F.lit(False))
    return (
        F.when(F.coalesce(skipped, F.lit(False)) | _clean_exclusion(out_of_scope, codes), "Skipped")
        .when(told != "", told)
        .when(hit & F.upper(text_of(decision)).isin(*ADVERSE), "Not-Met")
        .when(hit, "Met")
        .otherwise("Inconclusive")
    )


# Aggregates: use them in agg().
def step_status(skipped: Column, out_of_scope: Column, codes: Column, explicit: Column, matched: Column, decision: Column) -> Column:
    """The audit status of a step from its evaluations."""
    seen = ~F.coalesce(skipped, F.lit(False)) & ~_clean_exclusion(out_of_scope, codes)
    adverse = F.bool_or(seen & applies_defect(skipped, matched, decision))
    judged = F.bool_or(seen & (F.coalesce(matched, F.lit(False)) | (rule_status(explicit) != "")))
    return ladder("Inconclusive", ("Skipped", ~F.bool_or(seen)), ("Not-Met", adverse), ("Met", judged))


def fold_rule_status(status: Column) -> Column:
    """Any Not-Met, else all Met, else Inconclusive; skipped ones don't count."""
    s = F.when(rule_status(status) == "", "Inconclusive").otherwise(rule_status(status))
    counted = F.count_if(s != "Skipped")
    return ladder("Inconclusive", ("Skipped", counted == 0), ("Not-Met", F.count_if(s == "Not-Met") > 0), ("Met", F.count_if(s == "Met") == counted))


def fold_audit_status(status: Column) -> Column:
    """Any DEFECT, else all CLEAN, else INCONCLUSIVE; skipped ones don't count."""
    s = audit_status(status)
    counted = F.count_if(s != "")
    return ladder("INCONCLUSIVE", ("INCONCLUSIVE", counted == 0), ("DEFECT", F.count_if(s == "DEFECT") > 0), ("CLEAN", F.count_if(s == "CLEAN") == counted))


def precedence(decision: Column) -> Column:
    """Rank of a disposition, the most severe at 0, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, PRECEDENCE)), text_of(decision))
    return F.when(at > 0, at - 1).otherwise(len(PRECEDENCE)).cast("int")
