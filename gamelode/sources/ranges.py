"""Float files read by ranges of bytes: a Spark data source whose partitions are ranges of whole records, so that a large file
with a header, or of any size, is many tasks and no task holds more than a few thousand records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS_AT_A_TIME = 4096
RANGE_BYTES = 64 << 20


@dataclass
class Range(InputPartition):
    """n records of the file at `path` from the byte `offset` on; the first has the number `first`."""

    path: str
    offset: int
    first: int
    n: int


class FloatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.dim, self.size = json.loads(options["files"]), int(options["dim"]), int(options["rangebytes"])

    def partitions(self) -> list[Range]:
        step = max(1, self.size // (4 * self.dim))
        return [Range(path, offset + 4 * self.dim * at, first + at, min(step, n - at)) for path, offset, first, n in self.files for at in range(0, n, step)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        store, name = FileSystem.from_uri(partition.path)
        with store.open_input_file(name) as f:
            f.seek(partition.offset)
            for at in range(0, partition.n, RECORDS_AT_A_TIME):
                n = min(RECORDS_AT_A_TIME, partition.n - at)
                raw = f.read(4 * self.dim * n)
                if len(raw) != 4 * self.dim * n:
                    raise ValueError(f"{partition.path} is shorter than when it was listed")
                values = pa.array(np.frombuffer(raw, dtype="<f4"))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dim), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.first + at, pa.int64()), vectors], names=["vector_index", "vector"])


class FloatFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "f32_files"

    def schema(self) -> str:
        return "vector_index bigint, vector array<float>"

    def reader(self, schema) -> FloatReader:
        return FloatReader(dict(self.options))


def read_float_files(spark: SparkSession, files: list[tuple[str, int, int, int]], dim: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files: path, bytes before the first record, number of the first record, how many records."""
    spark.dataSource.register(FloatFiles)
    named = [(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p, *rest) for p, *rest in files]
    return spark.read.format("f32_files").options(files=json.dumps(named), dim=str(dim), rangebytes=str(range_bytes)).load()
