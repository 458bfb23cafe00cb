"""A manifest as one CSV file and one README beside it, which appear together or not at all.

`rows.write.format("manifest")` after `register(spark)`. Every task writes a part into a staging folder beside the target and names
it in its commit message; what a lost or repeated task left is not named and not taken. The commit joins the named parts in
order of their partitions, writes the README from the counts that tasks sent, and renames the staging folder to the target, the
only step that shows. An existing target is never touched: the write fails when it begins, and again if one appeared meanwhile.

Options: path; title; passed (a column, counted where it is PASS); groups (a column, counted by value; meant for few values);
unique (a column, counted where it is null); template (name of a further CSV with the columns named in template_columns and no
rows). Nulls are empty fields; quotes, commas and line ends are quoted; an empty table gives a header alone.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes that the commit copies at once.
COPY_BYTES = 1 << 20


def _store(path: str):
    """(file system, path within it): of a URI, or of a plain path on a file system that all machines mount."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: file, partition, rows, and counts as JSON."""

    name: str
    partition: int
    counts: str


class ManifestWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns = options, schema.fieldNames()
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        self._free()

    def _free(self) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} exists")

    def _line(self, values) -> bytes:
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerow("" if v is None else v for v in values)
        return text.getvalue().encode()

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId() if task else 0
        name = f"part-{number:08d}-{uuid.uuid4().hex}.csv"
        store, staging = _store(self.staging)
        store.create_dir(staging, recursive=True)
        wanted = {k: self.columns.index(self.options[k]) for k in ("passed", "groups", "unique") if self.options.get(k)}
        rows = passed = unique = 0
        groups: Counter = Counter()
        with store.open_output_stream(f"{staging}/{name}") as out:
            for row in iterator:
                out.write(self._line(row))
                rows += 1
                passed += "passed" in wanted and row[wanted["passed"]] == "PASS"
                unique += "unique" in wanted and row[wanted["unique"]] in (None, "")
                if "groups" in wanted:
                    groups[str(row[wanted["groups"]])] += 1
        return Part(name, number, json.dumps({"rows": rows, "passed": passed, "unique": unique, "groups": groups}))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        store, staging = _store(self.staging)
        whole = f"{staging}/whole"
        store.create_dir(whole, recursive=True)
        with store.open_output_stream(f"{whole}/manifest.csv") as out:
            out.write(self._line(self.columns))
            for part in parts:
                with store.open_input_stream(f"{staging}/{part.name}") as source:
                    while piece := source.read(COPY_BYTES):
                        out.write(piece)
        if self.options.get("template"):
            with store.open_output_stream(f"{whole}/{self.options['template']}") as out:
                out.write(self._line(self.options.get("template_columns", "id").split(",")))
        with store.open_output_stream(f"{whole}/README.md") as out:
            out.write(self._readme([json.loads(p.counts) for p in parts]).encode())
        self._free()
        store.move(whole, _store(self.path)[1])
        store.delete_dir(staging)

    def _readme(self, counts: list[dict]) -> str:
        total = {k: sum(c[k] for c in counts) for k in ("rows", "passed", "unique")}
        lines = [f"# {self.options.get('title', 'Manifest')}", "", f"- Rows: {total['rows']}"]
        lines += [f"- Passed: {total['passed']} of {total['rows']}"] if self.options.get("passed") else []
        lines += [f"- Unique: {total['unique']}"] if self.options.get("unique") else []
        groups = sum((Counter(c["groups"]) for c in counts), Counter())
        lines += [f"- {k}: {v}" for k, v in sorted(groups.items())]
        return "\n".join([*lines, "", "Columns: " + ", ".join(self.columns), ""])

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, staging = _store(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest"

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        if overwrite:
            raise ValueError("a manifest is never overwritten")
        return ManifestWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ManifestSource)
