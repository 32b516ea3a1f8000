"""Small tables that Spark and DuckDB read from the same Python rows, and the
claim tables derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(value) -> str:
    """A value as SQL that both engines read."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        raise TypeError("lists are written as joined text")
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


class Rows:
    """Rows with a schema such as ``"k int, v string"``."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [part.split()[0] for part in schema.split(", ")]

    def spark(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A derived table for DuckDB, with casts in its first row."""
        types = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
        kinds = [types[part.split()[1]] for part in self.schema.split(", ")]
        lines = ["(" + ", ".join(f"CAST({literal(v)} AS {k})" if not i else literal(v) for v, k in zip(row, kinds)) + ")" for i, row in enumerate(self.rows)]
        return f"(SELECT * FROM (VALUES {', '.join(lines)}) AS v({', '.join(self.names)}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, df[c].cast("timestamp"))
    return df


PHRASES = Rows(
    "k int, phrase string",
    list(
        enumerate(
            [
                "Deny the claim with EOB E51 and EX code 020/001",
                "Allow and process the claim (F3)",
                "Proceed to step 4",
                "Skip to Step 7 if the member is eligible, go to step 9 otherwise",
                "Refer the claim to a nurse reviewer",
                "Refer to the Duplicate Handling SOP",
                "Stop further auditing - out-of-scope",
                "Pend (F5) for medical director review",
                "Bypass the edit and override W46",
                "Waive the copay",
                "STOP",
                "Do not reimburse; CDD applies, EX Code 346",
                "Continue to the next step",
                "See step 8 directly",
                "CDML_DISALL_EXCD is populated",
                "Save the claim (F4) - this P&P does not apply",
                "any of the above rules is met",
                "Exactly one subrule must be met",
                "always mark as met",
                "take the first matching row",
                "Zero out the line: F24, F55, F24",
                "Follow the Coverage Policy Procedure Bulletin",
                "within 90 days of service",
                "12 Months after the paid date",
                "",
                None,
                "jump to step 12 and step 3 directly",
                "Referral needed, EX 003 or EX code 020 / 001",
                "reduce to 0 and deny",
                "advance to next step",
                "HMO plan: Standard Medicare $10 copay",
                "Process under Medicaid 99213 with modifiers 25, 59 and XE; not XS1",
            ]
        )
    ),
)

#: orders with a phrase each: o_orderkey, phrase
PHRASED_SQL = f"(SELECT o_orderkey, phrase FROM orders JOIN {PHRASES.sql()} p ON p.k = o_orderkey % {len(PHRASES.rows)})"


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"cast(o_orderkey % {len(PHRASES.rows)} as int) as k")
    return orders.join(PHRASES.spark(spark), "k").select("o_orderkey", "phrase")


RULES = Rows(
    "rule_key string, sop_id int, source string, step_number int, canvas_pos int, shape_id string, decision_type string, is_out_of_scope boolean, is_final boolean, aggregation string, applicable_when string, goto_step int, codes string, manual_oos boolean, attr string, lo double, hi double, alo double, nav_op string, nav_step int",
    [
        ("pre:1", 100, "precondition", None, 0, "s0", "DENY", False, False, "LEAF", "", None, "E01", False, "total", 480000.0, 1e12, 0.0, None, None),
        ("pre:2", 100, "precondition", None, 1, "s0", "STOP", False, False, "LEAF", "", None, "E02", True, "total", 0.0, 1e12, 0.0, None, None),
        ("step:100:1:0", 100, "decision", 1, 2, "s1", "CONDITIONAL", False, False, "LEAF", "", 3, "", False, "lines", 1.0, 2.0, 0.0, None, None),
        ("step:100:1:1", 100, "decision", 1, 3, "s1", "CONDITIONAL", False, False, "LEAF", "", 1, "W46", False, "qty", 10.0, 90.0, 0.0, None, None),
        ("step:100:2:0", 100, "decision", 2, 4, "s2", "PEND", False, False, "APPLICABLE_ONLY", "when large", None, "E51", False, "qty", 120.0, 1e9, 100.0, None, None),
        ("step:100:2:1", 100, "decision", 2, 5, "s2", "REFER", False, False, "APPLICABLE_ONLY", "when returned", None, "E52", False, "returned", 2.0, 1e9, 1.0, None, None),
        ("step:100:2:2", 100, "decision", 2, 6, "s2", "BYPASS", False, False, "LEAF", "", None, "F24", False, "prio", 1.0, 2.0, 0.0, None, None),
        ("step:100:3:0", 100, "decision", 3, 7, "s3", "DENY", False, False, "LEAF", "", None, "E60,E61", False, "returned", 3.0, 1e9, 0.0, None, None),
        ("step:100:4:0", 100, "decision", 4, 8, "s4", "STOP", True, True, "LEAF", "", None, "", False, "prio", 5.0, 5.0, 0.0, None, None),
        ("step:100:4:1", 100, "decision", 4, 9, "s4", "DENY", True, False, "LEAF", "", None, "E70", False, "total", 0.0, 1e12, 0.0, None, None),
        ("step:100:5:0", 100, "decision", 5, 10, "s5", "ALLOW", False, True, "LEAF", "", None, "F3", False, "prio", 4.0, 4.0, 0.0, None, None),
        ("step:100:6:0", 100, "decision", 6, 11, "s6", "WAIVE", False, False, "LEAF", "", None, "W47", False, "disc", 0.08, 1.0, 0.0, None, None),
        ("step:200:1:0", 200, "decision", 1, 12, "s7", "CONDITIONAL", False, False, "LEAF", "", None, "", False, "lines", 3.0, 5.0, 0.0, "goto", 3),
        ("step:200:2:0", 200, "decision", 2, 13, "s8", "DENY", False, False, "LEAF", "", 9, "E80", False, "disc", 0.09, 1.0, 0.0, None, None),
        ("step:200:3:0", 200, "decision", 3, 14, "s9", "PEND", False, False, "LEAF", "", None, "E51,E90", False, "prio", 1.0, 1.0, 0.0, "stop", None),
        ("custom:1", 200, "decision", None, 15, "s10", "SYSTEM", False, False, "LEAF", "", None, "F4", False, "total", 200000.0, 1e12, 0.0, None, None),
        ("custom:2", 200, "decision", None, 16, "s10", "DENY", False, False, "LEAF", "", None, "E99", False, "disc", 0.10, 1.0, 0.0, None, None),
        ("step:300:1:0", 300, "decision", 1, 17, "s11", "CONDITIONAL", False, False, "LEAF", "", None, "", True, "total", 0.0, 1e12, 0.0, None, None),
        ("step:300:2:0", 300, "decision", 2, 18, "s11", "REFER", False, False, "LEAF", "", None, "E33", False, "lines", 6.0, 99.0, 0.0, None, None),
    ],
)

#: Where each rule comes from: two source rules in one step, one over two steps,
#: sections only, and neither.
STEP_KEYS = Rows(
    "rule_key string, yaml_rule_id string, section_id string",
    [
        ("step:100:1:0", "Y1", "1"), ("step:100:1:1", "Y2", "1"), ("step:100:2:0", "", "2"), ("step:100:2:1", None, "2"), ("step:100:2:2", "", "2b"),
        ("step:100:3:0", None, "3"), ("step:100:4:0", "Y4", "4"), ("step:100:4:1", "Y4", "4"), ("step:100:5:0", "Y5", ""), ("step:100:6:0", "", None),
        ("step:200:1:0", "Y7", "1"), ("step:200:2:0", "Y7", "2"), ("step:200:3:0", "Y8", "3"), ("custom:1", None, None), ("custom:2", "", ""),
        ("step:300:1:0", "Y9", "1"), ("step:300:2:0", "Y9", "2"), ("pre:1", None, "0"), ("pre:2", None, "0"),
    ],
)

CLAIMS_SQL = """(SELECT o_orderkey AS claim_id, o_totalprice AS total, CAST(count(l_orderkey) AS DOUBLE) AS lines,
  coalesce(sum(l_quantity), 0.0) AS qty, coalesce(max(l_discount), 0.0) AS disc,
  CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) AS returned,
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_orderpriority)"""

VERDICTS_SQL = f"""(SELECT claim_id, r.*, v BETWEEN lo AND hi AS matched, v >= alo AS applicable FROM (
  SELECT claim_id, unnest(['total', 'lines', 'qty', 'disc', 'returned', 'prio']) AS a, unnest([total, lines, qty, disc, returned, prio]) AS v
  FROM {CLAIMS_SQL}) c JOIN {RULES.sql()} r ON r.attr = c.a)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric facts of each claim."""
    from pyspark.sql import functions as F

    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sums = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    joined = orders.join(sums, orders["o_orderkey"] == sums["l_orderkey"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return joined.select(F.col("o_orderkey").alias("claim_id"), F.col("o_totalprice").alias("total"), zero("lines"), zero("qty"), zero("disc"), zero("returned"), F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"))


def rules(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    df = RULES.spark(spark)
    return df.withColumn("codes", F.when(F.col("codes") == "", F.array().cast("array<string>")).otherwise(F.split("codes", ",")))


def bounds(spark: SparkSession) -> DataFrame:
    """The bounds that rules compare facts with: attr, bound."""
    from pyspark.sql import functions as F

    return RULES.spark(spark).select("attr", F.explode(F.array("lo", "hi", "alo")).alias("bound"))


def verdicts(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """Verdicts of simple range predicates: each fact of a claim meets the rules
    about it in an equi join."""
    from pyspark.sql import functions as F

    facts = facts.unpivot("claim_id", ["total", "lines", "qty", "disc", "returned", "prio"], "attr", "v")
    asked = RULES.spark(spark).select("rule_key", "attr", "lo", "hi", "alo", "nav_op", "nav_step")
    return facts.join(asked, "attr").select("claim_id", "rule_key", F.col("v").between(F.col("lo"), F.col("hi")).alias("matched"), (F.col("v") >= F.col("alo")).alias("applicable"), "nav_op", "nav_step")
