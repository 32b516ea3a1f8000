"""Files of this machine or of a shared mount as rows, one partition a file.

``spark.dataSource.register(Files)``, then ``spark.read.format("rule_files")``
with ``paths`` (several joined by commas; a folder stands for its files).  A
file that is missing or cannot be read is a row with its error, never a failed
job.  With ``rules`` set, YAML and JSON rule documents are opened: their rules
come as JSON text, a document without any is an error row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "path string, size long, sha256 string, content binary, rules string, error string"
BLOCK = 1 << 20


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def rules_of(content: bytes, name: str) -> str:
    """The rules of a document as JSON text; raises with the reason if it has none."""
    if name.endswith(".json"):
        document = json.loads(content)
    else:
        try:
            import yaml
        except ImportError as why:
            raise ValueError("YAML documents need PyYAML") from why
        document = yaml.safe_load(content)
    if not isinstance(document, dict):
        raise ValueError("the root must be a mapping with sop_metadata and sop_rules")
    if not isinstance(document.get("sop_rules"), list) or not document["sop_rules"]:
        raise ValueError("a filled list sop_rules is needed")
    return json.dumps(document["sop_rules"], default=str)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], rules: bool):
        self.paths, self.rules = paths, rules

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in map(Path, self.paths):
            found += sorted(str(p) for p in path.rglob("*") if p.is_file()) if path.is_dir() else [str(path)]
        return [_File(p) for p in dict.fromkeys(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = Path(partition.value)
        digest, parts = hashlib.sha256(), []
        try:
            with path.open("rb") as file:
                while block := file.read(BLOCK):
                    digest.update(block)
                    parts.append(block)
        except OSError as why:
            yield str(path), None, None, None, None, f"{type(why).__name__}: {why.strerror}"
            return
        content, rules, error = b"".join(parts), None, None
        if self.rules:
            try:
                rules = rules_of(content, path.name)
            except Exception as why:  # a broken document is a row like a missing one
                error = f"{type(why).__name__}: {why}".split("\n")[0]
        yield str(path), len(content), digest.hexdigest(), bytearray(content), rules, error


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rule_files"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options.get("paths", "").split(",") if p]
        if not paths:
            raise ValueError("the option paths is needed")
        return _Reader(paths, self.options.get("rules", "false").lower() == "true")
