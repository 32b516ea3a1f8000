"""Tool records cut to a claim's token budget.

A record may take what those before it have left, and what it takes depends on
that: a recurrence within a claim.  Only records over the least budget are in
doubt, and every record in doubt that is settled uses up budget, so a few turns
settle all: each turn settles the first one of every claim, and all that come
after the budget is gone.  Between turns only sizes travel; a record's text is
read where it lies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions.jsontext import codes_in, is_empty, pruned
from rulespan.sources.staging import stage

c = F.col

# Budgets in tokens, and the columns of coverage grids that matter.
TOTAL, MOST, LEAST = 130_000, 110_000, 5_000
COVERAGE_KEY = "descCode"
COVERAGE_KEEP = (
    "descCode", "descName", "diagnosis", "serviceType", "covered",
    "authorization", "modifier", "telehealth", "behavioralProviderTypes",
    "placeOfService", "limitType", "limitAmount", "limitQuantity",
    "limitTimeframe", "ageLimits", "ageLimitsMin", "ageLimitsMax",
    "effectiveDate", "termDate", "lob", "parityClassification",
    "requiredCptCodes", "requiredCodes", "asamLevel", "stateMandate",
)
TRIMMED = "rows trimmed to the most claim-relevant to fit context"
FILTERED = "coverage rows filtered to the claim's procedure code(s); audit columns dropped"
TEXT_PER_TOKEN = 3


def tokens_by_length(text: str) -> int:
    """A careful count for JSON where no encoder is at hand."""
    return len(text) // 3 + 1


def words_of(value) -> set[str]:
    return set(re.findall(r"[a-z0-9]{3,}", json.dumps(value, default=str).lower()))


def projected(row):
    """A coverage row's columns that matter."""
    return {k: v for k, v in row.items() if k in COVERAGE_KEEP and not is_empty(v)} if isinstance(row, dict) else row


def cut_result(result, claim, budget: int, tokens: Callable[[str], int]):
    """A pruned result that is over its budget, cut: a coverage grid to the rows
    of the claim's codes, else the longest list to the rows that share most
    words with the claim, else the text's head."""
    size = lambda v: tokens(json.dumps(v, default=str))
    lists = {k: v for k, v in result.items() if isinstance(v, list)} if isinstance(result, dict) else {}
    key = max(lists, key=lambda k: len(json.dumps(lists[k], default=str)), default=None)
    if key is None or not lists[key]:
        text = json.dumps(result, default=str)
        return {"_truncated_text": text[: budget * TEXT_PER_TOKEN], "_total_chars": len(text)}
    rows, rest = lists[key], {k: v for k, v in result.items() if k != key}
    if isinstance(rows[0], dict) and COVERAGE_KEY in rows[0]:
        codes = codes_in(claim)
        fitting = [projected(r) for r in rows if isinstance(r, dict) and str(r.get(COVERAGE_KEY)) in codes]
        out = {**rest, key: fitting, "_filtered": {"kept": len(fitting), "total": len(rows), "claim_codes": sorted(codes), "note": FILTERED}}
        if fitting and size(out) <= budget:
            return out
        rows = [projected(r) for r in rows]
    told, taken, kept = words_of(claim), size(rest), []
    for row in sorted(rows, key=lambda r: -len(words_of(r) & told)):
        taken += size(row)
        if kept and taken > budget:
            break
        kept.append(row)
    return {**rest, key: kept, "_filtered": {"kept": len(kept), "total": len(rows), "note": TRIMMED}}


def _read(text: str | None):
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def compacted(records: DataFrame, claims: DataFrame, total: int = TOTAL, most: int = MOST, least: int = LEAST, tokens: Callable[[str], int] = tokens_by_length) -> DataFrame:
    """``records`` (claim_id, ord, record) as (claim_id, ord, budget, tokens, record):
    what each JSON record may take and takes, and its text, in the order of
    ``ord`` within a claim, for the ``claims`` (claim_id, claim).

    Results lose empty values and bookkeeping; one that is then over its budget
    is cut.  A record without a result, or that is no JSON object, has no
    budget (null) and stays as it is; so does its size count.  A claim that is
    not known, or null, shares no words.  (claim_id, ord) must be unique; a
    null claim_id is a claim of its own.
    """
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, text, took = [], [], []
            for raw in batch.column("record").to_pylist():
                record = _read(raw)
                if isinstance(record, dict) and record.get("result") is not None:
                    record["result"] = pruned(record["result"])
                    size.append(tokens(json.dumps(record["result"], default=str)))
                    text.append(json.dumps(record, default=str))
                else:
                    size.append(None)
                    text.append(raw if record is None else json.dumps(record, default=str))
                took.append(tokens(text[-1] or ""))
            yield pa.RecordBatch.from_arrays([batch.column("claim_id"), batch.column("ord"), pa.array(size, pa.int64()), pa.array(took, pa.int64()), pa.array(text, pa.string())], names=["claim_id", "ord", "size", "took", "record"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, took = [], []
            for raw, claim, budget in zip(*(batch.column(n).to_pylist() for n in ("record", "claim", "budget"))):
                record = json.loads(raw)
                record["result"] = cut_result(record["result"], _read(claim) or {}, budget, tokens)
                text.append(json.dumps(record, default=str))
                took.append(tokens(text[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("claim_id"), batch.column("ord"), batch.column("budget"), pa.array(took, pa.int64()), pa.array(text, pa.string())], names=["claim_id", "ord", "budget", "took", "record"])

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    keys = f"claim_id {kinds['claim_id']}, ord {kinds['ord']}"
    every = stage(records.select("claim_id", "ord", "record").mapInArrow(sized, f"{keys}, size long, took long, record string"))
    w = Window.partitionBy("claim_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    doubt = F.coalesce(c("size") > least, F.lit(False))
    sizes = stage(every.select("claim_id", "ord", "size", "took", doubt.alias("doubt"), F.lit(None).cast("long").alias("budget")))
    cuts = None
    while True:
        spent = F.coalesce(F.sum(F.when(~c("doubt"), c("took"))).over(before), F.lit(0))
        left = F.greatest(F.lit(least), F.least(F.lit(most), F.lit(total) - spent)).cast("long")
        first = F.coalesce(F.sum(c("doubt").cast("int")).over(before), F.lit(0)) == 0
        now = sizes.withColumns({"left": left, "now": c("doubt") & (first | (left == least))})
        now = stage(now.withColumns({"budget": F.when(c("now"), c("left")).otherwise(c("budget")), "over": c("now") & (c("size") > c("left"))}))
        if now.filter("now").isEmpty():
            sizes = now
            break
        over = now.filter("over").select("claim_id", "ord", "budget")
        texts = every.select(c("claim_id").alias("c2"), c("ord").alias("o2"), "record")
        ready = over.join(texts, over["claim_id"].eqNullSafe(texts["c2"]) & (over["ord"] == texts["o2"])).drop("c2", "o2")
        ready = ready.join(claims.select(c("claim_id").alias("c2"), "claim"), c("claim_id") == c("c2"), "left").drop("c2")
        done = stage(ready.mapInArrow(cut, f"{keys}, budget long, took long, record string"))
        cuts = done if cuts is None else cuts.union(done)
        fresh = done.select(c("claim_id").alias("c2"), c("ord").alias("o2"), c("took").alias("t2"))
        both = now.join(fresh, now["claim_id"].eqNullSafe(fresh["c2"]) & (now["ord"] == fresh["o2"]), "left")
        sizes = stage(both.select("claim_id", "ord", "size", F.coalesce("t2", "took").alias("took"), (c("doubt") & ~c("now")).alias("doubt"), "budget"))
    spent = F.coalesce(F.sum("took").over(before), F.lit(0))
    left = F.greatest(F.lit(least), F.least(F.lit(most), F.lit(total) - spent)).cast("long")
    out = sizes.select("claim_id", "ord", F.when(c("size").isNotNull(), F.coalesce("budget", left)).alias("budget"), c("took").alias("tokens"))
    texts = every.select("claim_id", "ord", "record")
    if cuts is not None:
        short = cuts.select(c("claim_id").alias("c2"), c("ord").alias("o2"), c("record").alias("short"))
        texts = texts.join(short, texts["claim_id"].eqNullSafe(short["c2"]) & (texts["ord"] == short["o2"]), "left").select("claim_id", "ord", F.coalesce("short", "record").alias("record"))
    texts = texts.select(c("claim_id").alias("c2"), c("ord").alias("o2"), "record")
    return out.join(texts, out["claim_id"].eqNullSafe(texts["c2"]) & (out["ord"] == texts["o2"])).drop("c2", "o2")
