"""Sink for evaluations: nested JSON per scenario and flat CSV per option, written from one pass over the rows.

Tasks write staged parts; only the driver's commit moves the parts of successful attempts into place, so a failed job
leaves nothing behind and a repeated attempt leaves no second copy.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "eval_files"
KINDS = {"scenarios": "json", "options": "csv"}


@dataclass
class Parts(WriterCommitMessage):
    """Staged files of one task attempt, by kind."""

    files: dict[str, str]


class EvalWriter(DataSourceArrowWriter):
    """Rows are (json string, lines array<string>): one document and the CSV lines of its options."""

    def __init__(self, path: str, header: str, overwrite: bool):
        self.path, self.header, self.overwrite = path, header, overwrite
        self.staging = f"_staged-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + posixpath.abspath(self.path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, root = self._store()
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        files = {k: f"{root}/{self.staging}/{k}/{name}.{end}" for k, end in KINDS.items()}
        for file in files.values():
            store.create_dir(posixpath.dirname(file), recursive=True)
        with store.open_output_stream(files["scenarios"]) as documents, store.open_output_stream(files["options"]) as lines:
            lines.write(f"{self.header}\n".encode())
            for batch in iterator:
                documents.write("".join(f"{d}\n" for d in batch.column("json").to_pylist()).encode())
                lines.write("".join(f"{x}\n" for row in batch.column("lines").to_pylist() for x in row or []).encode())
        return Parts(files)

    def commit(self, messages: list[Parts | None]) -> None:
        store, root = self._store()
        for kind in KINDS:
            if self.overwrite and store.get_file_info(f"{root}/{kind}").type != fs.FileType.NotFound:
                store.delete_dir(f"{root}/{kind}")
            store.create_dir(f"{root}/{kind}", recursive=True)
        for parts in messages:
            for kind, file in (parts.files if parts else {}).items():
                store.move(file, f"{root}/{kind}/{self.staging[8:16]}-{posixpath.basename(file)}")
        self._clear(store, root)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class EvalFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> EvalWriter:
        return EvalWriter(self.options["path"], self.options["header_line"], overwrite)


def write_eval(evaluated: DataFrame, path: str, scenario: list[str], option: list[str], options: str = "o", mode: str = "overwrite") -> None:
    """Writes `path`/scenarios (JSON lines with all options nested) and `path`/options (CSV, one row per option).

    `evaluated` has one row per scenario with its options as an array of structs. `scenario` and `option` name the flat
    columns; lists are joined by `+`.
    """
    spark = evaluated.sparkSession
    spark.dataSource.register(EvalFiles)
    inner = {f.name: f.dataType for f in evaluated.schema[options].dataType.elementType.fields}
    outer = {f.name: f.dataType for f in evaluated.schema.fields}

    def flat(value, kind):
        return F.array_join(value, "+") if kind.typeName() == "array" else value

    def line(x):
        return F.to_csv(F.struct(*[flat(F.col(c), outer[c]).alias(c) for c in scenario], *[flat(x[c], inner[c]).alias(f"option_{c}") for c in option]))

    names = ",".join([*scenario, *[f"option_{c}" for c in option]])
    rows = evaluated.select(F.to_json(F.struct(*[F.col(c) for c in dict.fromkeys([*scenario, options])])).alias("json"), F.transform(options, line).alias("lines"))
    rows.write.format(FORMAT).option("header_line", names).mode(mode).save(path)
