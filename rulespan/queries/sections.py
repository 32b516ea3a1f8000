"""Procedure documents rendered for every customer in one of three shapes, and what
each operator on sections, steps and tables has to read in them.

Expected rows are written out by shape; ``{k}`` stands for the customer's key in
documents and rows alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators import markup as mk
from rulespan.operators import sections as sc
from rulespan.queries import fixtures as fx
from rulespan.sources.staging import dealt, stage

c = F.col

SHAPES = [
    # a primary step table with an if/then grid and a group table in its cells,
    # business and label tables, notes, a second step table
    """<html><head><title> Timely  filing {k}</title><style>td {color: red}</style></head><body><h1>Ignored</h1>
<p>Effective Date: 01/02/2024 and Revision date 3-4-2025</p>
<table><tr><th>Platform</th><th>LOB</th><th>Audience</th><th>State/Div</th></tr><tr><td>Facets {k}</td><td>Medicaid, Medicare</td><td></td><td>TX</td></tr><tr><td></td><td>CHIP</td><td>Adjusters</td><td></td></tr></table>
<table><tr><td colspan="2">Overview of it</td></tr><tr><td id="s{k}">Scope</td><td>Applies to all claims of {k}<ul><li>Deny with E51 <ul><li>late ones</li></ul></li><li>Keep</li></ul><p>Note: read the whole policy</p></td></tr><tr><td>Details</td><td>is a column name only</td></tr></table>
<div><h2>Purpose</h2><p>To audit claims in time</p></div>
<table><tr><th>Step</th><th>Action</th></tr>
<tr><td>1</td><td><p>Is the claim {k} on time?</p><ul><li>Yes - Skip to Step 3</li><li>No – Deny with E52<ul><li>No: a detail<ul><li>no deeper one</li></ul></li></ul></li><li>All items match: go on</li></ul></td></tr>
<tr><td>2</td><td>Check the plan of the member<table><tr><th>If</th><th>Then</th></tr><tr><td>A{k}</td><td>Pend (F5)</td></tr></table><blockquote>Mind the gap</blockquote><a href="/x">Claims Policy Bulletin</a></td></tr>
<tr><td>3</td><td><em>Note this</em><strong>Which group is it?</strong><table><tr><th>Group</th><th>Limit</th></tr><tr style="background-color:#FFF176"><td>G{k}</td><td>90 days <ul><li>Exception for newborns</li><li>none</li></ul></td></tr><tr><td>H</td><td>Member submitted: 2 years</td></tr></table> then process the claim</td></tr></table>
<span>Refund steps ↑ Back to top</span>
<table><tr><th>No</th><th>Action</th></tr><tr><td>4</td><td>Ask for the refund</td></tr><tr><td>5</td><td>Save the claim now, save the claim (F4)</td></tr></table></body></html>""",
    # steps by headings, lists and tables of their own; a label table that is a
    # step's; a section around a claimed list
    """<body><h2>Step 2 – Document search {k}</h2><ul><li>Open the document list</li><li>Find n{k}</li></ul>
<h3>Background</h3><ol><li>unclaimed</li></ol>
<table><tr><td>5</td><td>Submission types are read</td></tr><tr><td>If</td><td>Then</td></tr><tr><td>Paper {k}</td><td>Scan it first of all</td></tr></table>
<table><tr><td>Group</td><td>Guidelines of the group</td></tr><tr><td>Late</td><td>Within 30 days of service</td></tr></table>
<div><p>Search</p><div><h3>Step 7</h3><ul><li>Look it up in the system</li></ul></div></div>
<div style="background:#fdecea">Do not release {k}</div><aside>Beside it</aside><p>Tip: use the index</p></body>""",
    # a layout table around everything, attachments and code lists
    """<table><tr><td><table><tr id="r1"><td>Valid POTF</td><td>These are accepted as attachment:<ul><li>EOB of n{k}<ul><li>signed</li></ul></li><li>Letter</li></ul></td></tr><tr><td>Invalid forms</td><td>Never taken<ul><li>Fax</li></ul></td></tr><tr id="invalid-potf-{k}"><td>Others</td><td>Also out, as they say<ul><li>Mail</li></ul></td></tr></table></td>
<td><table><tr><td>Reason Code list</td><td>Look at all of the codes<ul><li>W46 late</li><li>W47 <ul><li>F24 odd</li></ul></li></ul></td></tr></table></td></tr></table>
<table><tr><td colspan="3">A wide headline of {k}</td></tr></table>""",
]
_RENDERED = "CASE c_custkey % 3 " + " ".join(f"WHEN {i} THEN {fx.literal(s)}" for i, s in enumerate(SHAPES)) + " END"


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = dealt(fx.table(spark, sf_dir, "customer").select(c("c_custkey").alias("doc_id")), "doc_id")
    shapes = fx.Rows("shape int, html string", list(enumerate(SHAPES))).spark(spark)
    both = keys.withColumn("shape", (c("doc_id") % 3).cast("int")).join(F.broadcast(shapes), "shape")
    return both.select("doc_id", F.replace("html", F.lit("{k}"), c("doc_id").cast("string")).alias("html"))


def parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, table rows and cells, each written once.  They are merged, never
    broadcast: texts repeat, so files and shuffles are far below their size in
    memory, by which a broadcast would pass the driver."""
    found = stage(mk.nodes(rendered(spark, sf_dir))).hint("merge")
    return found, sc.table_rows(found), stage(sc.table_cells(found)).hint("merge")


def flat(values: str) -> F.Column:
    return F.array_join(values, "|")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What :func:`parsed` gives, and the step tables in their order."""
    found, rows, cells = parsed(spark, sf_dir)
    return found, rows, cells, sc.ranked_step_tables(sc.step_tables(rows, cells))


def primary(rows: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    return stage(sc.step_cells(rows, cells, tables.filter("place = 1")))


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, cells = parsed(spark, sf_dir)
    return sc.metadata(found, cells)


def business_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, cells = parsed(spark, sf_dir)
    return sc.business_fields(rows, cells).select("doc_id", "platform", "product", "state_div", flat("lob").alias("lob"), flat("audience").alias("audience"))


def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with whether they stay beside the steps."""
    found, rows, cells, tables = parts(spark, sf_dir)
    sections = stage(sc.labelled_sections(found, rows, cells, tables))
    kept = sc.unclaimed_sections(found, sections, sc.step_claims(found, rows, cells)).select("doc_id", "ord", F.lit(True).alias("kept"))
    return sections.join(kept, ["doc_id", "ord"], "left").select("doc_id", "ord", "name", "section_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows, cells, tables = parts(spark, sf_dir)
    sections = stage(sc.labelled_sections(found, rows, cells, tables))
    return sc.section_items(found, sections).select("doc_id", "section", "ord", "item_type", "text", flat("codes").alias("codes"), flat("sub_items").alias("sub_items"))


def document_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows, cells, tables = parts(spark, sf_dir)
    return sc.step_details(found, primary(rows, cells, tables)).drop("tbl").withColumn("referenced", flat("referenced"))


def step_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows, cells, tables = parts(spark, sf_dir)
    return sc.step_branches(found, primary(rows, cells, tables)).drop("tbl").withColumn("codes", flat("codes"))


def step_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows, cells, tables = parts(spark, sf_dir)
    steps = primary(rows, cells, tables)
    return sc.notes(found, steps).join(steps.select("doc_id", c("node").alias("of"), "number"), ["doc_id", "of"]).select("doc_id", "number", "ord", "annotation_type", "text")


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.notes(parsed(spark, sf_dir)[0])


def step_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows, cells = parsed(spark, sf_dir)
    return sc.step_inventory(sc.step_claims(found, rows, cells)).select("doc_id", "number", "title", "n_rows", "raw_text")


def group_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group tables in step cells, the first of each cell."""
    found, rows, cells, tables = parts(spark, sf_dir)
    steps = primary(rows, cells, tables)
    first = stage(sc.first_inside(sc.group_tables(found, rows, cells), steps))
    named = first.join(steps.select("doc_id", c("node").alias("of"), "number"), ["doc_id", "of"])
    return sc.group_rows(found, rows, cells, first).join(named, ["doc_id", "tbl"]).drop("tbl", "of").withColumn("special_notes", flat("special_notes"))


def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows, cells = parsed(spark, sf_dir)
    return sc.reference_tables(found, rows, cells).withColumn("contents", flat("contents"))


def sub_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows, cells, tables = parts(spark, sf_dir)
    return sc.sub_steps(found, rows, cells, stage(tables)).select("doc_id", "sub", "name", "number", "question", "is_terminal", "raw_text")


#: By query: the columns, and the rows that each document of a shape gives.
EXPECTED = {
    "document_metadata": (
        "shape int, title string, effective_date string, revision_date string",
        [
            (0, 'Timely filing {k}', '01/02/2024', '3-4-2025'),
            (1, '', '', ''),
            (2, 'A wide headline of {k}', '', ''),
        ],
    ),
    "business_fields": (
        "shape int, platform string, product string, state_div string, lob string, audience string",
        [
            (0, 'Facets {k}', '', 'TX', 'CHIP', 'Adjusters'),
        ],
    ),
    "labelled_sections": (
        "shape int, ord int, name string, section_id string, kept boolean",
        [
            (0, 0, 'Scope', 's{k}', True),
            (0, 1, 'A{k}', '', False),
            (0, 2, 'G{k}', '', False),
            (0, 3, 'H', '', False),
            (0, 4, 'Purpose', '', True),
            (0, 5, 'Is the claim {k} on time?', '', False),
            (1, 0, '5', '', False),
            (1, 1, 'Paper {k}', '', False),
            (1, 2, 'Late', '', False),
            (1, 3, 'Step 2 – Document search {k}', '', False),
            (1, 4, 'Search', '', False),
            (1, 5, 'Step 7', '', False),
            (2, 0, 'Valid POTF', '', True),
            (2, 1, 'Invalid forms', '', True),
            (2, 2, 'Others', '', True),
            (2, 3, 'Reason Code list', '', True),
        ],
    ),
    "section_items": (
        "shape int, section int, ord int, item_type string, text string, codes string, sub_items string",
        [
            (0, 0, 0, 'RULE', 'Deny with E51 late ones', 'E51', 'late ones'),
            (0, 0, 1, 'RULE', 'Keep', '', ''),
            (0, 0, 2, 'INFO', 'Note: read the whole policy', '', ''),
            (0, 2, 0, 'RULE', 'Exception for newborns', '', ''),
            (0, 2, 1, 'RULE', 'none', '', ''),
            (0, 5, 0, 'RULE', 'Yes - Skip to Step 3', '', ''),
            (0, 5, 1, 'RULE', 'No – Deny with E52 No: a detail no deeper one', 'E52', 'No: a detail no deeper one|no deeper one'),
            (0, 5, 2, 'RULE', 'All items match: go on', '', ''),
            (1, 3, 0, 'RULE', 'Open the document list', '', ''),
            (1, 3, 1, 'RULE', 'Find n{k}', '', ''),
            (1, 4, 0, 'RULE', 'Look it up in the system', '', ''),
            (1, 5, 0, 'RULE', 'Look it up in the system', '', ''),
            (2, 0, 0, 'RULE', 'EOB of n{k} signed', '', 'signed'),
            (2, 0, 1, 'RULE', 'Letter', '', ''),
            (2, 1, 0, 'RULE', 'Fax', '', ''),
            (2, 2, 0, 'RULE', 'Mail', '', ''),
            (2, 3, 0, 'RULE', 'W46 late', 'W46', ''),
            (2, 3, 1, 'RULE', 'W47 F24 odd', 'W47|F24', 'F24 odd'),
        ],
    ),
    "document_steps": (
        "shape int, number long, question string, branch_yes string, branch_no string, skip_to_step_yes int, skip_to_step_no int, referenced string, is_terminal boolean, raw_text string",
        [
            (0, 1, 'Is the claim {k} on time?', 'Yes - Skip to Step 3', 'No: a detail no deeper one', 3, None, '', False, 'Is the claim {k} on time? Yes - Skip to Step 3 No – Deny with E52 No: a detail no deeper one All items match: go on'),
            (0, 2, 'Check the plan of the member', '', '', None, None, 'Claims Policy Bulletin', False, 'Check the plan of the member If Then A{k} Pend (F5) Mind the gap Claims Policy Bulletin'),
            (0, 3, 'Which group is it?', '', '', None, None, '', True, 'Note this Which group is it? Group Limit G{k} 90 days Exception for newborns none H Member submitted: 2 years then process the claim'),
        ],
    ),
    "step_branches": (
        "shape int, number long, ord int, condition_if string, action string, decision string, codes string, skip_to_step int",
        [
            (0, 1, 0, 'Yes', 'Skip to Step 3', 'REFER', '', 3),
            (0, 1, 1, 'No', 'Deny with E52 No: a detail no deeper one', 'DENY', 'E52', None),
            (0, 1, 2, 'No', 'a detail no deeper one', 'CONDITIONAL', '', None),
            (0, 1, 3, 'All items match', 'go on', 'CONDITIONAL', '', None),
        ],
    ),
    "step_notes": (
        "shape int, number long, ord int, annotation_type string, text string",
        [
            (0, 2, 0, 'NOTE', 'Mind the gap'),
            (0, 3, 0, 'HIGHLIGHT', 'G{k} 90 days Exception for newborns none'),
            (0, 3, 1, 'NOTE', 'Note this'),
            (0, 3, 2, 'EXCEPTION', 'Exception for newborns'),
        ],
    ),
    "document_notes": (
        "shape int, ord int, annotation_type string, text string",
        [
            (0, 0, 'HIGHLIGHT', 'G{k} 90 days Exception for newborns none'),
            (0, 1, 'NOTE', 'Mind the gap'),
            (0, 2, 'NOTE', 'Note: read the whole policy'),
            (0, 3, 'NOTE', 'Note this'),
            (1, 0, 'ALERT', 'Do not release {k}'),
            (1, 1, 'NOTE', 'Beside it'),
            (1, 2, 'TIP', 'Tip: use the index'),
        ],
    ),
    "step_inventory": (
        "shape int, number long, title string, n_rows int, raw_text string",
        [
            (0, 1, 'Is the claim {k} on time? Yes - Skip to Step 3 No – Deny with E52 No: a detail no deeper one All items match: go on', 1, 'Is the claim {k} on time? Yes - Skip to Step 3 No – Deny with E52 No: a detail no deeper one All items match: go on'),
            (0, 2, 'Check the plan of the member Mind the gap Claims Policy Bulletin', 2, 'Check the plan of the member Mind the gap Claims Policy Bulletin\nA{k} | Pend (F5)'),
            (0, 3, 'Note this Which group is it? then process the claim', 5, 'Note this Which group is it? then process the claim\nGroup | Limit\nG{k} | 90 days Exception for newborns none\nH | Member submitted: 2 years\nNo | Action'),
            (0, 4, 'Ask for the refund', 1, 'Ask for the refund'),
            (0, 5, 'Save the claim now, save the claim (F4)', 1, 'Save the claim now, save the claim (F4)'),
            (1, 2, 'Open the document list', 2, 'Open the document list\nFind n{k}'),
            (1, 5, 'Submission types are read', 4, 'Submission types are read\nPaper {k} | Scan it first of all\nGroup | Guidelines of the group\nLate | Within 30 days of service'),
            (1, 7, 'Look it up in the system', 1, 'Look it up in the system'),
        ],
    ),
    "group_limits": (
        "shape int, ord int, group_name string, limit_days int, limit_months int, limit_years int, member_submitted_only boolean, special_notes string, raw_text string, is_highlighted boolean, number long",
        [
            (0, 0, 'G{k}', 90, None, None, False, 'Exception for newborns', '90 days Exception for newborns none', True, 3),
            (0, 1, 'H', None, None, 2, True, '', 'Member submitted: 2 years', False, 3),
        ],
    ),
    "reference_lists": (
        "shape int, ord int, name string, table_type string, contents string",
        [
            (2, 0, 'Valid POTF These are accepted as attachment: EOB of n{k} signed Letter Invalid forms Never taken Fax Others Also out, as they say Mail', 'POTF_INVALID', 'W46 late|W47 F24 odd'),
            (2, 1, 'Valid POTF', 'POTF_VALID', 'EOB of n{k} signed|Letter'),
            (2, 2, 'Invalid forms', 'POTF_INVALID', 'Fax'),
            (2, 3, 'Others', 'POTF_INVALID', 'Mail'),
            (2, 4, 'Reason Code list', 'CODE_LOOKUP', 'W46 late|W47 F24 odd|F24 odd'),
        ],
    ),
    "sub_procedures": (
        "shape int, sub int, name string, number long, question string, is_terminal boolean, raw_text string",
        [
            (0, 0, 'Refund steps', 4, '[Refund steps Step 4] Ask for the refund', False, 'Ask for the refund'),
            (0, 0, 'Refund steps', 5, '[Refund steps Step 5] Save the claim now, save the claim (F4)', True, 'Save the claim now, save the claim (F4)'),
        ],
    ),
}


def statement(schema: str, rows: list[tuple]) -> str:
    """The rows of each customer's shape, with its key for ``{k}``."""
    table = fx.Rows(schema, rows)
    text = {part.split()[0] for part in schema.split(", ") if part.endswith(" string")}
    columns = ", ".join(f"replace({n}, '{{k}}', c_custkey::VARCHAR) AS {n}" if n in text else n for n in table.names if n != "shape")
    return f"SELECT c_custkey AS doc_id, {columns} FROM customer JOIN {table.sql()} AS v ON v.shape = c_custkey % 3"


_FUNCTIONS = (document_metadata, business_fields, labelled_sections, section_items, document_steps, step_branches, step_notes, document_notes, step_inventory, group_limits, reference_lists, sub_procedures)
QUERIES = {f.__name__: (f, statement(*EXPECTED[f.__name__])) for f in _FUNCTIONS}
