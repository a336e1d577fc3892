"""CSV readers with declared schemas: no inference pass, unreadable cells become NULL.

Columns of header files are found by name in every file, so extra columns and changed orders do
no harm. A narrow job opens each file and reads up to the end of its first line, however large the
file is; files are then read in groups of one header.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import BinaryIO
from urllib.parse import quote as quoted

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.scalar import parsed_date

CORRUPT = "_corrupt_record"


def _struct(spark: SparkSession, ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Bytes read at a time until the first line with text ends.
PROBE_BYTES = 64 * 1024


def first_line(stream: BinaryIO) -> str | None:
    """The first line with text, read in pieces up to its end; None if there is none."""
    data = b""
    while piece := stream.read(PROBE_BYTES):
        data = (data + piece).lstrip(b" \t\r\n")
        end = min((i for i in (data.find(b"\n"), data.find(b"\r")) if i >= 0), default=-1)
        if end >= 0:
            data = data[:end]
            break
    return data.decode("utf-8-sig", "replace").strip() or None


def _opened(path: str) -> pa.NativeFile:
    """A stream of the file's bytes, unpacked by its ending as Spark does."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        store, inner = pyarrow.fs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    else:
        store, inner = pyarrow.fs.FileSystem.from_uri(quoted(path, safe=":/@"))
    return store.open_input_stream(inner, compression="detect", buffer_size=0)


def first_lines(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    """``file, header, opened`` of every file: listed by Spark, opened by tasks, read up to the first line's end.

    ``opened`` is false where only Spark's own readers reach the store.
    """
    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, headers, opened = batch.column("path").to_pylist(), [], []
            for path in files:
                try:
                    stream = _opened(path)
                except (pa.ArrowInvalid, NotImplementedError, ImportError, OSError):
                    headers.append(None)
                    opened.append(False)
                    continue
                with stream:
                    headers.append(first_line(stream))
                opened.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(headers, pa.string()), pa.array(opened)],
                                             names=["file", "header", "opened"])

    # Of this source only paths are asked for, so no file is read by the listing.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).select("path")
    return listed.mapInArrow(probe, "file string, header string, opened boolean")


def _scanned_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, header`` by Spark's text reader, which reads whole files: for stores that tasks cannot open."""
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    return lines.where("at = 0 AND value <> ''").groupBy("file").agg(F.min_by("value", "line").alias("header"))


def _headers(spark: SparkSession, paths: list[str], recursive: bool) -> dict[str, list[str]]:
    """Files by header line: one row per file reaches the driver, as with Spark's own file listing."""
    groups: dict[str, list[str]] = {}
    found = first_lines(spark, paths, recursive).collect()
    closed = [row["file"] for row in found if not row["opened"]]
    for row in [*found, *(_scanned_lines(spark, closed).collect() if closed else [])]:
        if row["header"]:
            groups.setdefault(row["header"], []).append(row["file"])
    return groups


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, quote: str = '"', escape: str = '"',
             sep: str = ",", recursive: bool = False) -> DataFrame:
    """Read header CSV files and keep the columns of ``schema`` with their types.

    ``path`` is one path or a list. Files may order their columns differently: each is read by its own
    header. A cell that does not fit its type becomes NULL.
    """
    reader = (spark.read.option("header", True).option("quote", quote).option("escape", escape)
              .option("sep", sep).option("mode", "PERMISSIVE").option("enforceSchema", False))
    fields = _struct(spark, schema).fields
    parts = []
    for files in _headers(spark, [path] if isinstance(path, str) else list(path), recursive).values():
        raw = reader.csv(files)
        present = {c.lower(): c for c in raw.columns}
        missing = [f.name for f in fields if f.name.lower() not in present]
        if missing:
            raise ValueError(f"{files[0]}: columns {missing} not found in {raw.columns}")
        parts.append(raw.select(*[
            F.col(f"`{present[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) for f in fields]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _struct(spark, schema))


def read_csv_tree(spark: SparkSession, path: str | Sequence[str], schema: str, **options: str) -> DataFrame:
    """Read every CSV file below a directory as one table."""
    return read_csv(spark, path, schema, recursive=True, **options)


def read_positional_csv(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",",
                        corrupt: str | None = None) -> DataFrame:
    """Read headerless files (one path or a list) by position. ``corrupt`` names a column for lines that do not fit."""
    declared = _struct(spark, schema)
    reader = spark.read.option("header", False).option("sep", sep).option("mode", "PERMISSIVE")
    if corrupt:
        declared = declared.add(corrupt, "string")
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(declared).csv(path if isinstance(path, str) else list(path))


def typed(df: DataFrame, types: dict[str, str], dates: dict[str, str] | None = None) -> DataFrame:
    """Convert text columns: ``{column: type}`` and ``{column: date format}``; bad cells give NULL."""
    columns = {c: F.col(c).try_cast(t) for c, t in types.items()}
    columns.update({c: parsed_date(F.col(c).cast("string"), fmt) for c, fmt in (dates or {}).items()})
    return df.withColumns(columns)


def unreadable_counts(raw: DataFrame, parsed: DataFrame, columns: list[str]) -> DataFrame:
    """``column, unreadable``: cells with text in ``raw`` that are NULL in ``parsed``.

    Counted from each table in one aggregate: filled cells before minus filled cells after.
    """
    def filled(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("column"),
                          F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(name)) for c in columns]
        return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))

    both = filled(raw, "before").join(filled(parsed, "after"), "column")
    return both.select("column", (F.col("before") - F.col("after")).alias("unreadable"))
