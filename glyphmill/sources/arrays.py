"""Flat array files: a matrix with a row for each id, in ``.npy`` files that are read in ranges of rows.

A table (id, vec) of ids 0 to n - 1 is written as files of at most ``rowsPerFile`` rows; the folder's manifest, written last,
names them with their first ids, so that files of lost or repeated tasks are never read. A path that ends in ``.npy`` is one
file from elsewhere, whose row numbers are the ids.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from glyphmill.sources.parts import open_folder

_MANIFEST = "manifest.json"
_TYPES = {"float32": T.FloatType(), "float64": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType()}


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    start: int
    stop: int


def _header(store, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, bytes before the rows) of an array file."""
    with store.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(f)
        if by_column or len(shape) != 2 or dtype.name not in _TYPES:
            raise ValueError(f"{path} isn't a matrix of rows of {', '.join(_TYPES)}")
        return shape, dtype, f.tell()


def _files(path: str) -> list[dict]:
    store, inner = open_folder(path)
    if path.endswith(".npy"):
        return [{"file": inner, "first": 0, "n": _header(store, inner)[0][0]}]
    with store.open_input_file(f"{inner}/{_MANIFEST}") as f:
        return [x | {"file": f"{inner}/{x['file']}"} for x in json.loads(f.read())]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rowspertask", 1 << 18))

    def partitions(self) -> list[Rows]:
        """At least one task, as a source without any is asked to read None."""
        found = [Rows(x["file"], x["first"], at, min(at + self.rows, x["n"])) for x in _files(self.path) for at in range(0, x["n"], self.rows)]
        return found or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        store, _ = open_folder(self.path)
        (_, width), dtype, before = _header(store, part.file)
        size = dtype.itemsize * width
        with store.open_input_file(part.file) as f:
            f.seek(before + part.start * size)
            for at in range(part.start, part.stop, 4096):
                n = min(4096, part.stop - at)
                flat = pa.array(np.frombuffer(f.read(n * size), dtype).astype(dtype.newbyteorder("="), copy=False))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n) + part.first), vec], ["id", "vec"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], dtype: str) -> None:
        self.path, self.rows, self.dtype = options["path"], int(options.get("rowsperfile", 1 << 16)), dtype

    def _save(self, ids: list[np.ndarray], rows: list[np.ndarray]) -> list[dict]:
        """One file of consecutive ids."""
        at, matrix = np.concatenate(ids), np.concatenate(rows)
        if (np.diff(at) != 1).any():
            raise ValueError("ids must be whole and without gaps or repeats")
        store, inner = open_folder(self.path)
        name = f"part-{uuid.uuid4().hex}.npy"
        store.create_dir(inner)
        with store.open_output_stream(f"{inner}/{name}") as out:
            np.lib.format.write_array_header_1_0(out, {"shape": matrix.shape, "fortran_order": False, "descr": np.lib.format.dtype_to_descr(matrix.dtype)})
            out.write(np.ascontiguousarray(matrix).tobytes())
        return [{"file": name, "first": int(at[0]), "n": len(at), "width": matrix.shape[1]}]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, ids, rows, held = [], [], [], 0
        for batch in batches:
            vec = batch.column("vec")
            if batch.column("id").null_count or vec.null_count or vec.flatten().null_count:
                raise ValueError("an array has no nulls")
            matrix = vec.flatten().to_numpy(zero_copy_only=False).astype(self.dtype, copy=False)
            width = len(matrix) // max(len(batch), 1)
            if (np.diff(vec.offsets.to_numpy()) != width).any():
                raise ValueError("rows must be of one length")
            at, matrix = batch.column("id").to_numpy(), matrix.reshape(len(batch), width)
            while len(at):
                n = min(len(at), self.rows - held)
                ids, rows, held = [*ids, at[:n]], [*rows, matrix[:n]], held + n
                at, matrix = at[n:], matrix[n:]
                if held == self.rows:
                    done += self._save(ids, rows)
                    ids, rows, held = [], [], 0
        return Written(done + (self._save(ids, rows) if held else []))

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["first"])
        ends = np.cumsum([0] + [f["n"] for f in files])
        if [f["first"] for f in files] != list(ends[:-1]) or len({f["width"] for f in files}) > 1:
            raise ValueError("ids must run from 0 without gaps or repeats, and rows be of one length")
        store, inner = open_folder(self.path)
        store.create_dir(inner)
        with store.open_output_stream(f"{inner}/{_MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a manifest are never read."""


class ArraySource(DataSource):
    """Options: ``path``, ``rowsPerTask`` (262,144) for reads, ``rowsPerFile`` (65,536) for writes."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        store, _ = open_folder(self.options["path"])
        item = _TYPES[_header(store, files[0]["file"])[1].name] if files else T.DoubleType()
        return T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(item))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        item = schema["vec"].dataType.elementType
        return _Writer(self.options, next(name for name, t in _TYPES.items() if t == item))


def write_arrays(rows: DataFrame, path: str, **options) -> None:
    """Writes (id, vec) in ranges of ids; other columns are left out."""
    rows.sparkSession.dataSource.register(ArraySource)
    ranged = rows.select(F.col("id").cast("long").alias("id"), "vec").repartitionByRange("id").sortWithinPartitions("id")
    ranged.write.format("arrays").mode("append").options(path=path, **options).save()


def read_arrays(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArraySource)
    return spark.read.format("arrays").options(path=path, **options).load()
