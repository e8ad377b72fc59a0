"""A source of JSON-lines parts that may fail: reads are tried again, and a part that stays bad is reported, not dropped.

``spark.read.format("parts")`` and ``spark.readStream.format("parts")`` read the ``.jsonl`` and ``.jsonl.gz`` files of a folder and
its folders. Each row has its part's path in the folder in ``_part``; a rejected part gives one row with nothing else but ``_error``. Paths with a
scheme go through pyarrow's file systems; a part is held whole by a task.
"""

from __future__ import annotations

import gzip
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.json
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PART, ERROR = "_part", "_error"


def retried(read: Callable[[], bytes], tries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """What ``read`` gives; after an OSError it is tried again, each time after twice the wait, up to ``tries`` times."""
    for left in range(tries - 1, -1, -1):
        try:
            return read()
        except OSError:
            if not left:
                raise
            sleep(wait)
            wait *= 2
    raise ValueError("tries must be positive")


def parse_part(name: str, data: bytes, schema: pa.Schema) -> pa.Table:
    """The rows of a part; anything in it that isn't JSON of the schema raises ValueError."""
    try:
        data = gzip.decompress(data) if name.endswith(".gz") else data
        if not data.strip():
            return schema.empty_table()
        options = pyarrow.json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
        reading = pyarrow.json.ReadOptions(block_size=max(len(data) + 1, 1 << 20))  # a row never spans blocks
        return pyarrow.json.read_json(pa.BufferReader(data), reading, options)
    except (OSError, EOFError, zlib.error, pa.ArrowException) as e:
        raise ValueError(type(e).__name__) from e


@dataclass
class Parts(InputPartition):
    names: list[str]


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class _Reading:
    """What batch and stream reads share."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.tries, self.wait = int(options.get("tries", 4)), float(options.get("wait", 0.5))
        self.suffixes = tuple(options.get("suffixes", ".jsonl,.jsonl.gz").split(","))
        self.per_task = int(options.get("partspertask", 16))

    def listed(self) -> list[str]:
        store, path = open_folder(self.path)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        names = [i.path[i.path.index(path.lstrip("/")) + len(path.strip("/")) + 1 :] for i in found if i.is_file and i.base_name.endswith(self.suffixes)]
        return sorted(n for n in names if not any(x[0] in "._" for x in n.split("/")))

    def dealt(self, names: list[str]) -> list[Parts]:
        """At least one task, as a source without any is asked to read None."""
        return [Parts(names[at : at + self.per_task]) for at in range(0, max(len(names), 1), self.per_task)]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(self.path)
        whole = to_arrow_schema(self.schema)
        wanted = pa.schema([f for f in whole if f.name not in (PART, ERROR)])

        def content(name: str) -> bytes:
            with store.open_input_stream(f"{path}/{name}", compression=None) as part:
                return part.read()

        for name in partition.names:
            try:
                rows, error = parse_part(name, retried(lambda: content(name), self.tries, self.wait), wanted), None
            except (OSError, ValueError) as e:
                rows, error = pa.Table.from_arrays([pa.nulls(1, f.type) for f in wanted], schema=wanted), str(e) if isinstance(e, ValueError) else type(e).__name__
            rows = rows.append_column(PART, pa.array([name] * len(rows), pa.string())).append_column(ERROR, pa.array([error] * len(rows), pa.string()))
            yield from rows.select(whole.names).cast(whole).to_batches(max_chunksize=10_000)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Parts]:
        return self.dealt(self.listed())


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are the last name read, so a part must sort after those that came before it."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.listed(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Parts]:
        return self.dealt([n for n in self.listed() if start["after"] < n <= end["after"]])

    def commit(self, end: dict) -> None:
        pass


class PartsSource(DataSource):
    """Options: ``path``, ``tries`` (4), ``wait`` (0.5 s before the second try, then doubled), ``partsPerTask`` (16),
    ``suffixes`` (``.jsonl,.jsonl.gz``)."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def _schema(columns: StructType) -> StructType:
    return StructType([*columns.fields]).add(PART, "string").add(ERROR, "string")


def read_parts(spark: SparkSession, path: str, columns: StructType, **options) -> DataFrame:
    spark.dataSource.register(PartsSource)
    return spark.read.format("parts").schema(_schema(columns)).options(path=path, **options).load()


def stream_parts(spark: SparkSession, path: str, columns: StructType, **options) -> DataFrame:
    spark.dataSource.register(PartsSource)
    return spark.readStream.format("parts").schema(_schema(columns)).options(path=path, **options).load()


def accepted(rows: DataFrame) -> DataFrame:
    """The rows of good parts."""
    return rows.where(F.col(ERROR).isNull()).drop(ERROR)


def rejected(rows: DataFrame) -> DataFrame:
    """(part, error): the parts that no try could read or parse."""
    return rows.where(F.col(ERROR).isNotNull()).select(F.col(PART).alias("part"), F.col(ERROR).alias("error"))
