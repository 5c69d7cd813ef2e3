"""A keyed table as a Python data source: insert if absent, or replace.

``rows.write.format("keyed").option("path", p).option("kind", "insert" or "replace").mode("append").save()`` writes one commit. Each task
writes one Parquet file and reports it in its commit message; only when all tasks have ended does the driver list the files of that commit in one small
manifest, which it writes under another name and then moves. A file that is in no manifest is never read, so a task or job that failed leaves no
rows. ``read`` gives one row for each key: of the replacing commits the last, else of the inserting commits the first; several rows of one commit
are settled by ``least`` (say, the depth at which a paper was found) and a hash of the row, and all columns come from one and the same row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

KINDS = ("insert", "replace")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[dict]:
    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = []
    for info in sorted((i for i in found if i.path.endswith(".json")), key=lambda i: i.path):
        with system.open_input_stream(info.path) as file:
            out.append(json.loads(file.read()))
    return out


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class KeyedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "insert")
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        self.number = max((m["number"] for m in _manifests(self.path)), default=-1) + 1

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        folder, writer, rows = f"{root}/data/kind={self.kind}/number={self.number}", None, 0
        file = f"{folder}/{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    writer = pq.ParquetWriter(file, batch.schema, filesystem=system)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(file.removeprefix(f"{root}/") if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.file]
        manifest = {"number": self.number, "kind": self.kind, "files": sorted(m.file for m in done), "rows": sum(m.rows for m in done)}
        system, root = _open(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        name = f"{root}/commits/{self.number:012d}"
        with system.open_output_stream(f"{name}.writing") as out:
            out.write(json.dumps(manifest).encode())
        system.move(f"{name}.writing", f"{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/{m.file}")


class KeyedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed"

    def writer(self, schema: Any, overwrite: bool) -> KeyedWriter:
        if overwrite:
            raise ValueError("a keyed table is appended to; option kind=replace replaces rows by key")
        return KeyedWriter(dict(self.options))


def append(rows: DataFrame, path: str, kind: str) -> None:
    """One commit of ``kind`` (insert or replace)."""
    rows.sparkSession.dataSource.register(KeyedTable)
    rows.write.format("keyed").option("path", path).option("kind", kind).mode("append").save()


def read(spark: SparkSession, path: str, key: str, least: str | None = None) -> DataFrame | None:
    """One row for each key that is not null; None before the first commit with rows."""
    files = [f"{path.rstrip('/')}/{f}" for m in _manifests(path) for f in m["files"]]
    if not files:
        return None
    rows = spark.read.option("basePath", f"{path.rstrip('/')}/data").parquet(*files)
    columns = [c for c in rows.columns if c not in ("kind", "number")]
    replaces = F.col("kind") == "replace"
    near = [F.when(F.col(least).isNull(), 1).otherwise(0), F.col(least)] if least else []
    order = F.struct(F.when(replaces, 0).otherwise(1), F.when(replaces, -F.col("number")).otherwise(F.col("number")), *near, F.xxhash64(*columns))
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*(c for c in columns if c != key)), order).alias("_best"))
    return best.select(key, "_best.*").select(*columns)
