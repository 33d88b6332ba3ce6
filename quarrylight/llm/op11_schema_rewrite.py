"""Rewrite of files whose schema drifted: fields are known by their ids, whatever they are called, wherever they stand, and
whichever are missing or narrower.

Rows get their ranks from a range-partitioned sort: each range counts its rows, the counts are prefix-summed, and a row's rank is
its range's offset plus its place. RANGES is a constant, so the counts, their sums and the broadcast of the offsets are of
constant size. Each file then belongs to one task of mapInArrow, which streams it: a row group at a time in memory.

Files survive lost executors: a task writes under a name of its own beside the folder and renames when done; the rewrite reads
the starting files and writes replacements beside them; only when all are there and reported does another job rename them over
the starting files. Each step can run again with the same outcome.

Nulls stay nulls; a column that a file doesn't have gets its default in every row. Rows without a client_id come first, those of one
client_id go by a hash of their other columns; rows that are wholly equal are interchangeable. An empty table has no files.
Texts of any length pass through, of as many rows at a time as Arrow's batches have. Columns that are no field of the schema
are not read. Folders must be reachable by pyarrow.fs from every executor (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, read_table

#: Ranges of the sort, whatever the input's size.
RANGES = 256
#: Rows that are read, digested or written at a time.
ROWS = 8192
FIELD_ID = b"PARQUET:field_id"


@dataclass(frozen=True)
class Field:
    """A field of the evolved schema: its id, name, Arrow type, and what rows of files without it get."""

    id: int
    name: str
    type: pa.DataType
    default: object = None

    def arrow(self, name: str | None = None, type_: pa.DataType | None = None) -> pa.Field:
        return pa.field(name or self.name, type_ or self.type, True, {FIELD_ID: str(self.id).encode()})


CLIENTS = (
    Field(1, "client_id", pa.int64()), Field(2, "master_id", pa.int64()), Field(3, "source", pa.string()), Field(4, "updated_at", pa.timestamp("us")), Field(5, "name", pa.string()),
    Field(6, "email", pa.string()), Field(7, "city", pa.string()), Field(8, "nation_id", pa.int64(), -1), Field(9, "segment", pa.string(), "none"), Field(10, "balance", pa.float64()),
)
_SPARK = {pa.int64(): "long", pa.string(): "string", pa.timestamp("us"): "timestamp_ntz", pa.float64(): "double"}


# --- ranks ---------------------------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, order: list[str], ranges: int = RANGES) -> tuple[DataFrame, int]:
    """The rows with their _rank (from 0) by the columns `order`, and how many there are. Rows of one key go by a hash of their
    other columns, and are dealt by key, hash and their place in the input, so that no range has to take all rows of a
    frequent key and the sample that finds the ranges has but a few numbers a row."""
    rest = [c for c in rows.columns if c not in order]
    placed = rows.withColumns({"_hash": F.xxhash64(*rest, F.lit(0)), "_input": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(ranges, *order, "_hash", "_input").sortWithinPartitions(*order, "_hash", "_input").drop("_hash", "_input")
    at = F.monotonically_increasing_id()  # the partition's number times 2^33, plus the row's place
    stored = materialize(dealt.select("*", at.alias("_at")), "ranges").withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
    counts = stored.groupBy("_range").agg(F.count("*").alias("n"))  # at most `ranges` rows from here on
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("_range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    total = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = stored.join(F.broadcast(offsets.select("_range", "offset")), "_range")
    return out.withColumn("_rank", F.col("offset") + F.col("_place")).drop("_range", "_place", "offset"), total


# --- files ---------------------------------------------------------------------------------------------------------------


class Folder:
    """Where files are, for tasks: each is written under another name first, so that none is ever half there."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.fs, self.root = fs.FileSystem.from_uri(self.uri)

    def path(self, file_no: int, sub: str = "files") -> str:
        return f"{self.root}/{sub}/file-{file_no:05d}.parquet"

    def uri_of(self, file_no: int) -> str:
        return f"{self.uri}/files/file-{file_no:05d}.parquet"

    def there(self, path: str) -> bool:
        return self.fs.get_file_info(path).type == fs.FileType.File

    def writer(self, path: str, schema: pa.Schema) -> _Writer:
        return _Writer(self, path, schema)


class _Writer:
    def __init__(self, folder: Folder, path: str, schema: pa.Schema):
        self.folder, self.path = folder, path
        self.own = f"{folder.root}/attempts/{uuid.uuid4().hex}.parquet"
        for at in (self.own, path):
            folder.fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = pq.ParquetWriter(self.own, schema, filesystem=folder.fs)

    def close(self) -> None:
        self.out.close()
        self.folder.fs.move(self.own, self.path)


def drifted(fields: tuple[Field, ...], version: int) -> list[pa.Field]:
    """The fields of a starting file by the bits of its version: 1 name and email are called each other's names; 2 columns after the
    first are in reverse; 4 nation_id and segment are missing; 8 balance is a float and nation_id an int."""
    swapped = {"name": "email", "email": "name"} if version & 1 else {}
    narrow = {"balance": pa.float32(), "nation_id": pa.int32()} if version & 8 else {}
    out = [f.arrow(swapped.get(f.name), narrow.get(f.name)) for f in fields if not (version & 4 and f.name in ("nation_id", "segment"))]
    return [out[0], *reversed(out[1:])] if version & 2 else out


def version_of(file_no: int, seed: int = 19) -> int:
    v = zlib.crc32(f"{seed}:{file_no}".encode()) % 24
    return v if v <= 15 else 0


def id_of(field: pa.Field) -> int:
    return int((field.metadata or {}).get(FIELD_ID, b"-1"))


def rebuilt(batch: pa.RecordBatch, fields: tuple[Field, ...]) -> pa.RecordBatch:
    """A batch in the evolved schema: each column by its id, widened, or its default."""
    by_id = {id_of(f): i for i, f in enumerate(batch.schema)}
    columns = [batch.column(by_id[f.id]).cast(f.type) if f.id in by_id else pa.repeat(pa.scalar(f.default, f.type), batch.num_rows) for f in fields]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.arrow() for f in fields]))


# --- jobs ----------------------------------------------------------------------------------------------------------------

_MADE = "file_no long, version long, path string"
_REPORT = "file_no long, version long, start_columns string, rewritten boolean"


def write_files(rows: DataFrame, n_files: int, fields: tuple[Field, ...], uri: str, seed: int = 19) -> DataFrame:
    """rows: the fields' columns, file_no (below n_files) and _rank. Starting files in the folder; what there are, as a table."""
    names = {f.id: f.name for f in fields}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, writer, no = Folder(uri), None, None
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index("file_no"))
            at = 0
            while at < batch.num_rows:
                now = numbers[at].as_py()
                upto = at + pc.sum(pc.equal(numbers.slice(at), now)).as_py()  # rows come sorted by file
                if now != no:
                    if writer:
                        yield close(writer, no, folder)
                    kind = pa.schema(drifted(fields, version_of(now, seed)))
                    no, writer = now, folder.writer(folder.path(now), kind)
                part = batch.slice(at, upto - at)
                columns = [part.column(part.schema.get_field_index(names[id_of(f)])).cast(f.type) for f in kind]
                writer.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=kind))
                at = upto
        if writer:
            yield close(writer, no, folder)

    def close(writer: _Writer, no: int, folder: Folder) -> pa.RecordBatch:
        writer.close()
        return pa.RecordBatch.from_pylist([{"file_no": no, "version": version_of(no, seed), "path": folder.uri_of(no)}], schema=pa.schema([("file_no", pa.int64()), ("version", pa.int64()), ("path", pa.string())]))

    dealt = rows.select(*names.values(), "file_no", "_rank").repartitionById(max(n_files, 1), F.col("file_no").cast("int")).sortWithinPartitions("file_no", "_rank").drop("_rank")
    return materialize(dealt.mapInArrow(write, _MADE), "started")


def one_task_a_file(files: DataFrame, n_files: int) -> DataFrame:
    return files.repartitionById(max(n_files, 1), F.col("file_no").cast("int"))


def rewrite(files: DataFrame, n_files: int, fields: tuple[Field, ...], uri: str) -> DataFrame:
    """files: file_no, version. Replaces every file of a version other than 0; a report of all of them."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with pq.ParquetFile(folder.path(r["file_no"]), filesystem=folder.fs) as start:
                    out.append({"file_no": r["file_no"], "version": r["version"], "start_columns": ",".join(start.schema_arrow.names), "rewritten": r["version"] != 0})
                    if r["version"] != 0:
                        writer = folder.writer(folder.path(r["file_no"], "replacements"), pa.schema([f.arrow() for f in fields]))
                        for part in start.iter_batches(ROWS):
                            writer.out.write_batch(rebuilt(_with_ids(part, start.schema_arrow), fields))
                        writer.close()
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file_no", pa.int64()), ("version", pa.int64()), ("start_columns", pa.string()), ("rewritten", pa.bool_())]))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        for batch in batches:
            for no in batch.column(0).to_pylist():
                if folder.there(at := folder.path(no, "replacements")):  # else an earlier attempt has moved it
                    folder.fs.move(at, folder.path(no))
            yield batch

    report = materialize(one_task_a_file(files.select("file_no", "version"), n_files).mapInArrow(replace, _REPORT), "report")
    moved = report.where("rewritten").select("file_no")
    one_task_a_file(moved, n_files).mapInArrow(commit, "file_no long").write.format("noop").mode("overwrite").save()
    folder = Folder(uri)
    for sub in ("attempts", "replacements"):
        if folder.fs.get_file_info(f"{folder.root}/{sub}").type == fs.FileType.Directory:
            folder.fs.delete_dir(f"{folder.root}/{sub}")
    return report


def _with_ids(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch under the file's schema, whose fields have the ids."""
    return pa.RecordBatch.from_arrays(batch.columns, schema=schema)


def _shown(column: pa.Array, scale: int | None) -> pa.Array:
    """A column as strings, null as '?': times as microseconds, doubles as the floor of scale times their value (those that are not
    finite by their name)."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us")).cast(pa.int64())
    elif pa.types.is_floating(column.type):
        column = pa.array([None if v is None else str(math.floor(scale * v)) if math.isfinite(v) else str(v) for v in column.to_pylist()], pa.string())
    return pc.fill_null(column.cast(pa.string()), "?")


def digests(files: DataFrame, n_files: int, uri: str, scale: int = 1 << 20) -> DataFrame:
    """files: file_no. Of every final file, streamed: rows, nulls, digests of ids and rows, names of columns."""
    kinds = pa.schema([("file_no", pa.int64()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("ids_sha256", pa.string()), ("rows_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        for batch in batches:
            out = []
            for no in batch.column(0).to_pylist():
                ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
                with pq.ParquetFile(folder.path(no), filesystem=folder.fs) as f:
                    for part in f.iter_batches(ROWS):
                        if not part.num_rows:
                            continue
                        columns = [_shown(c, scale) for c in part.columns]
                        for digest, values, by in ((ids, columns[0], b","), (rows, pc.binary_join_element_wise(*columns, "|"), b"\n")):
                            digest.update((by if n else b"") + by.join(v.encode() for v in values.to_pylist()))
                        n, nulls = n + part.num_rows, nulls + sum(c.null_count for c in part.columns)
                    out.append({"file_no": no, "n_rows": n, "n_nulls": nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": rows.hexdigest(), "columns": ",".join(f.schema_arrow.names), "path": folder.uri_of(no)})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return one_task_a_file(files.select("file_no"), n_files).mapInArrow(read, "file_no long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, columns string, path string")


def drift_and_rewrite(clients: DataFrame, most_files: int = 250, fields: tuple[Field, ...] = CLIENTS, ranges: int = RANGES) -> DataFrame:
    """Sort the rows, write them as drifted starting files, rewrite those, and tell of every final file; see the contract's columns."""
    spark = clients.sparkSession
    rows = clients.select(*(F.col(f.name).cast(_SPARK[f.type]).alias(f.name) for f in fields))
    key = rows.withColumn("_crc", F.crc32(F.col(fields[0].name).cast("string").cast("binary")))
    sorted_rows, n = ranked(key, ["_crc", fields[0].name], ranges)
    each = 1 + n // most_files
    n_files = -(-n // each)
    uri = new_path(spark, "rewrite")
    started = write_files(sorted_rows.withColumn("file_no", F.floor(F.col("_rank") / each)), n_files, fields, uri)
    report = rewrite(started, n_files, fields, uri)
    found = materialize(digests(started, n_files, uri), "digests")
    return found.join(report, "file_no").select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")


def op11_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_and_rewrite(read_table(spark, sf_dir, "clients"))
