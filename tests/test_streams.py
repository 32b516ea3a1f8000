"""Streams over several files that come out of time order, one a micro-batch."""

from datetime import datetime
from types import SimpleNamespace

from rulespan.queries import streams
from rulespan.streaming import progress


def test_windows_count_late_files(spark, tmp_path, monkeypatch):
    days = [10, 1, 5, 1, 12, 5]
    for d in days:
        rows = [(datetime(2024, 1, d, h), "view") for h in (1, 23)]
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    one = SimpleNamespace(**vars(progress) | {"event_stream": lambda s, path: progress.event_stream(s, path, files=1)})
    monkeypatch.setattr(streams, "p", one)
    found = {r["start"].day: r["n"] for r in streams.event_windows(spark, str(tmp_path)).collect()}
    assert found == {d: 2 * days.count(d) for d in days}
