"""CSV with metadata lines, read record by record and written part by part.

Reading: a file, or each member of a ZIP archive, is a record of bytes that a task of its own reads, with quotes, line breaks in
quotes, and leading metadata lines as the format has them. Only leading lines that begin with # are metadata.

Writing: ``poi_csv`` is a data source whose tasks write their rows as parts beside the file; at commit the parts, in
order, become one file under its metadata lines and header, which takes the old one's place in one step. If a task
fails, or a check that each row must pass, the parts go and the old file stays as it is. Path and parts lie in a folder that
driver and executors share.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

RECORDS = "file string, member string, at long, header array<string>, cells map<string,string>"


def _records(text: io.TextIOBase, strict: bool) -> Iterator[tuple[int, list[str] | None, dict[str, str] | None]]:
    """The header as record 0, then records of values by column from 1 on."""
    line = text.readline()
    while line.startswith("#"):
        line = text.readline()
    lines = (x for part in ([line], text) for x in part)
    reader = csv.reader(lines)
    names = next(reader, None)
    if not names:
        return
    yield 0, names, None
    for at, own in enumerate((r for r in reader if r), 1):
        if strict and len(own) > len(names):
            raise ValueError(f"record {at} has more values than columns")
        cells = dict(zip(names, own + [""] * (len(names) - len(own)), strict=False))
        if strict and "name" in cells and not cells["name"].strip():
            raise ValueError(f"record {at} has no name")
        yield at, None, cells


def records(spark: SparkSession, path: str, encoding: str = "utf-8-sig", member: str | None = None, strict: bool = False, errors: str = "strict") -> DataFrame:
    """``RECORDS`` of CSV files, or of the members of ZIP archives (those whose name ends with ``member``); a path without files gives none.

    ``strict``: a record that is longer than the header, or that has a blank ``name``, fails the read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], RECORDS)

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                if not content.startswith(b"PK\x03\x04"):
                    yield pd.DataFrame({"file": [file], "member": [""], "content": [content]})
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    for name in sorted(packed.namelist()):
                        if member is None or name.endswith(member):
                            yield pd.DataFrame({"file": [file], "member": [name], "content": [packed.read(name)]})

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, name, content in batch.itertuples(index=False):
                rows: list[tuple] = []
                for k, header, cells in _records(io.TextIOWrapper(io.BytesIO(content), encoding, errors, newline=""), strict):
                    rows.append((file, name, k, header, cells))
                    if len(rows) == 2048:
                        yield pd.DataFrame(rows, columns=["file", "member", "at", "header", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "member", "at", "header", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = files.mapInPandas(unpacked, "file string, member string, content binary")
    # A task for each member, however large the archive.
    return parts.repartition("file", "member").mapInPandas(parsed, RECORDS)


def read_strict(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns of a CSV file as trimmed strings, in order; missing values are empty. Long records and blank names fail the read.

    Data rows may begin with #. Files of a pattern must have the first one's columns.
    """
    found = records(spark, path, strict=True)
    first = found.where("at = 0").select("file", "header").orderBy("file").first()
    if first is None:
        raise ValueError("no header")
    names = first["header"]
    if missing := [c for c in required if c not in [n.strip() for n in names]]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    value = lambda c: F.regexp_replace(F.coalesce(F.element_at("cells", F.lit(c)), F.lit("")), r"(?U)^\s+|\s+$", "")
    return found.where("at > 0").select(*(value(c).alias(c.strip()) for c in names))


@dataclass
class _Part(WriterCommitMessage):
    at: int
    name: str
    rows: int
    sources: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.metadata: dict[str, str | None] = json.loads(options.get("metadata", "{}"))
        self.never = json.loads(options.get("never", "[]"))
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """A part of a task's rows; attempts have parts of their own."""
        os.makedirs(self.parts, exist_ok=True)
        at = TaskContext.get().partitionId()
        name, n, sources = f"{at:06}-{uuid.uuid4().hex}", 0, set()
        with open(f"{self.parts}/{name}", "w", encoding="utf-8", newline="") as f:
            sink = csv.writer(f, lineterminator="\n")
            for r in rows:
                values = ["" if v is None else v for v in r]
                if any(w in str(v).lower() for w in self.never for v in values):
                    raise ValueError("a row has a text that must not be published")
                sink.writerow(values)
                n += 1
                if "sources" in self.columns:
                    sources |= {s.strip() for s in str(values[self.columns.index("sources")]).split(",") if s.strip()}
            f.flush()
            os.fsync(f.fileno())
        return _Part(at, name, n, sorted(sources))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.at)
        known = {"total_records": str(sum(m.rows for m in done)), "source_scope": ",".join(sorted({s for m in done for s in m.sources}))}
        mode = os.stat(self.path).st_mode & 0o777 if os.path.exists(self.path) else 0o644
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)))
        try:
            with os.fdopen(handle, "wb") as f:
                head = io.StringIO()
                head.writelines(f"# {k}={known[k] if v is None else v}\n" for k, v in self.metadata.items())
                csv.writer(head, lineterminator="\n").writerow(self.columns)
                f.write(head.getvalue().encode())
                for m in done:
                    with open(f"{self.parts}/{m.name}", "rb") as part:
                        shutil.copyfileobj(part, f)
                f.flush()
                os.fsync(f.fileno())
            os.chmod(temporary, mode)
            os.replace(temporary, self.path)
        except BaseException:
            if os.path.exists(temporary):
                os.unlink(temporary)
            raise
        finally:
            shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class CsvSink(DataSource):
    """``poi_csv``. Options: path; metadata, a JSON object in order, in which null total_records and source_scope are found while writing; never, a JSON array of lower-case texts that no row may have."""

    @classmethod
    def name(cls) -> str:
        return "poi_csv"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), [f.name for f in schema.fields])


def write(rows: DataFrame, path: str, metadata: dict[str, str | None], never: tuple[str, ...] = ()) -> None:
    """K1, K3, K4: replace a file by metadata lines, header and rows, written in parallel, in the order of ``rows``."""
    rows.sparkSession.dataSource.register(CsvSink)
    text = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) if t not in ("string", "int", "bigint", "double") else F.col(f"`{c}`") for c, t in rows.dtypes))
    text.write.format("poi_csv").mode("append").option("metadata", json.dumps(metadata)).option("never", json.dumps(never)).option("path", path).save()
