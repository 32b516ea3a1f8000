"""Runs saved at once, files as rows, batches over several files."""

import json

from pyspark.sql import functions as F

from rulespan.sources import runs as rn
from rulespan.sources.files import Files
from rulespan.streaming import batches as bt
from rulespan.streaming.progress import event_stream


def test_a_save_counts_whole_or_as_failed(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    runs = spark.createDataFrame([(1, "RUNNING"), (2, "TERMINATED_EARLY")], "run_id long, status string")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, v string")
    assert rn.save_runs(folder, runs, {"rows": rows, "tools": rows}) == "SAVED"
    broken = rows.withColumn("v", F.raise_error(F.lit("no more room")))
    assert rn.save_runs(folder, runs.withColumn("run_id", F.col("run_id") + 10), {"rows": rows, "tools": broken}) == "FAILED"
    rows.write.parquet(f"{folder}/rows/save=cut-off")  # a save that died before its manifest row
    out = {r["run_id"]: (r["status"], "no more room" in r["error_message"]) for r in rn.saved(spark, folder, "runs").collect()}
    assert out == {1: ("COMPLETED", False), 2: ("TERMINATED_EARLY", False), 11: ("FAILED", True), 12: ("FAILED", True)}
    assert sorted((r["run_id"], r["v"]) for r in rn.saved(spark, folder, "rows").collect()) == [(1, "a"), (2, "b")]


def test_files_are_rows_and_so_are_their_errors(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text(json.dumps({"sop_rules": [{"id": 1}]}))
    (tmp_path / "d/b.json").write_text("{broken")
    (tmp_path / "d/c.yaml").write_text("sop_metadata: {}\n")
    spark.dataSource.register(Files)
    read = spark.read.format("rule_files").option("paths", f"{tmp_path}/d,{tmp_path}/gone.json,{tmp_path}/d/a.json")
    out = {r["path"].rsplit("/", 1)[1]: r for r in read.load().collect()}
    assert set(out) == {"a.json", "b.json", "c.yaml", "gone.json"}
    assert out["gone.json"]["error"].startswith("FileNotFoundError") and out["gone.json"]["content"] is None
    assert bytes(out["b.json"]["content"]) == b"{broken" and out["b.json"]["error"] is None
    rules = {r["path"].rsplit("/", 1)[1]: r for r in read.option("rules", "true").load().collect()}
    assert json.loads(rules["a.json"]["rules"]) == [{"id": 1}] and all(rules[n]["error"] and rules[n]["rules"] is None for n in ("b.json", "c.yaml", "gone.json"))


def test_batches_over_several_files(spark, tmp_path):
    rows = [("a", "1", "COMPLETED", 3), ("b", "1", "FETCH_FAILED", 1), ("a", "2", "FAILED", 3), ("a", "1", "FAILED", 3), ("c", "1", "COMPLETED", 9), ("a", "3", "TERMINATED_EARLY", 3)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "batch_id string, claim_id string, status string, total long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    out = bt.batch_events(event_stream(spark, f"file://{tmp_path}/in", files=1)).collect()
    sums = {r["batch_id"]: (r["status"], r["completed"], r["failed"]) for r in out if r["kind"] == "summary"}
    assert sums == {"a": ("PARTIAL", 2, 1), "b": ("FAILED", 0, 1)}  # a claim that comes again counts once, c waits
    assert sorted(r["batch_id"] for r in out if r["kind"] == "batch_start") == ["a", "b", "c"] and sum(r["kind"] == "claim" for r in out) == 5
