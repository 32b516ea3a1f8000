"""Blocks of a claim's print image beside its service lines, as columns over the
image's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The layout of the blocks.
HEADER_ROW = r"(?s)(\|1\s+INSUREDS ID NUMBER.*?ID#:\s+[^\|]+?\|)"
HEADER_LABELS = ("HIC#", "RTE:", "ATTCH:", "KEYER:", "DT:")
RELATION_BLOCK = r"(?s)(\|5.*?\|6\s+PAT\s+RELATION.*?\|7\s+INSURED\s+ADDRESS)"
PLAN_BLOCK = r"(?s)\|7C\s+INSURANCE PLAN OR PROGRAM NAME, PAYOR ID AND SPC\s*\|(.*?)(?=\|+\-\+|\|\|\s*7D\s+IS THERE)"
PLAN = r"([0-9]{4,6})\s+([A-Z]{1,3}/[A-Z][A-Z/ ]+)"
ADDRESS_BLOCK = r"(?s)\|7E\s+INSURANCE ADDRESS\s*\|(.*?)(?=\|+\-\+|\|\|\s*9D\s+EMPLOYERS\|\|\s*S[0-9]+\s+)"
PAY_TO = r"\|34\s+PAY-TO PROVIDER NPI:\s*([0-9]{10})?\s*(?:CLRNG HOUSE CLAIM ID:\s*([A-Z0-9]+))?"
CONTROL_ROW = r"(?m)^\s*\|\s*([0-9]{3})\s*\|\s*([0-9]+)\s*\|"
EPSDT_ROW = r"(?m)^\s*\|\s*([0-9]{3})\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _even(text: Column) -> Column:
    """Blanks as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def header_fields(content: Column) -> Column:
    """First words behind HIC#, RTE and ATTCH in the first box, each cut at the
    labels that may follow; null without the box."""
    row = _found(content, HEADER_ROW)

    def between(label: str) -> Column:
        rest = "|".join(HEADER_LABELS[HEADER_LABELS.index(label) + 1 :])
        value = _even(F.regexp_extract(row, rf"(?s){label}\s*(.*?)(?:{rest}|$)", 1))
        word = F.regexp_replace(F.split(value, " ")[0], r"[^A-Z0-9\-]", "")
        return F.when(value.rlike(r"^[A-Z#]+:$") | (value == ""), "").otherwise(word)

    return F.struct(*(F.when(row.isNotNull(), between(label)).alias(name) for label, name in (("HIC#", "hic"), ("RTE:", "rte"), ("ATTCH:", "attch"))))


def patient_relation(content: Column) -> Column:
    """Code and word of box 6."""
    return _found(F.regexp_extract(content, RELATION_BLOCK, 1), r"\b([0-9]{2}/[A-Z]+)\b")


def payer(content: Column) -> Column:
    """Payer id and plan class of the first line of box 7C that has both."""
    lines = F.filter(F.transform(_lines(F.regexp_extract(content, PLAN_BLOCK, 1)), lambda t: _even(F.btrim(t, F.lit(" |")))), lambda t: t.rlike(PLAN))
    first = F.get(lines, F.lit(0))
    return F.struct(_found(first, PLAN).alias("payor_id"), F.trim(_found(first, PLAN, 2)).alias("spc"))


def insurance_address(content: Column) -> Column:
    """The right column of box 7E as one line."""
    cells = F.transform(_lines(F.regexp_extract(content, ADDRESS_BLOCK, 1)), lambda t: _even(F.regexp_extract(t, r"^\s*\|.*?\|\s*([^|]+?)\s*\|", 1)))
    return F.nullif(F.array_join(F.filter(cells, lambda t: t != ""), " "), F.lit(""))


def pay_to(content: Column) -> Column:
    """Pay-to provider number and clearing house claim id of box 34."""
    return F.struct(_found(content, PAY_TO).alias("npi"), _found(content, PAY_TO, 2).alias("clearing_house_id"))


def line_extras(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Service lines (claim_id, line_no) with the control numbers of the image
    (claim_id, content), by order, and the indicators behind the 24H header, by
    line number, the last of a line."""
    numbers = F.regexp_extract_all("content", F.lit(CONTROL_ROW), F.lit(2))
    control = claims.select("claim_id", F.posexplode(numbers).alias("pos", "line_item_control_no")).select("claim_id", (F.col("pos") + 1).alias("line_no"), "line_item_control_no")
    section = F.regexp_extract("content", r"(?s)(24H\s+EPSDT\s+IND.*)", 1)
    parts = F.arrays_zip(*(F.regexp_extract_all(section, F.lit(EPSDT_ROW), F.lit(i)).alias(n) for i, n in enumerate(("no", "epsdt_ind", "family_planning_ind"), 1)))
    marks = claims.select("claim_id", F.posexplode(parts).alias("pos", "m")).select("claim_id", F.col("m.no").cast("int").alias("line_no"), "pos", F.nullif(F.trim("m.epsdt_ind"), F.lit("")).alias("epsdt_ind"), F.nullif(F.trim("m.family_planning_ind"), F.lit("")).alias("family_planning_ind"))
    last = Window.partitionBy("claim_id", "line_no").orderBy(F.desc("pos"))
    marks = marks.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "pos")
    return lines.join(control, ["claim_id", "line_no"], "left").join(marks, ["claim_id", "line_no"], "left")
