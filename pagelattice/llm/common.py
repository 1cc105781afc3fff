"""What the operators of this subpackage share: the shared folder, tables written to it, and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id given to a null identifier inside numpy code; it sorts after every real identifier.
NULL_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset (tests) one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = _own_dir()
    if "://" not in found and not found.startswith("file:"):
        found = "file://" + os.path.abspath(found)
    return found.rstrip("/")


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="pagelattice-"))
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, and survives the loss of any executor. It is deleted when the application ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    files, place = _file_system(df.sparkSession, df._written_to)
    files.delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: the size that partition counts are planned from."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of `texts` of about `limit` characters, at least one text each, so that working memory is bounded."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def in_parts(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part's texts take about `limit` bytes, one row at least: an Arrow batch has a number of rows, whatever their size.

    In the end what the task has freed goes back to the system, as the worker process lives on beside those of other stages."""
    for b in batches:
        rows = max(1, len(b) * limit // max(1, b.column(column).nbytes))
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """Values of `make`, kept for at most `limit` keys of at most `longest` characters; when it is full the later half goes (what is frequent came first)."""

    def __init__(self, make, limit: int, longest: int = 200):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                for k in list(self)[self.limit // 2 :]:
                    del self[k]
            self[key] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """`n` odd 64-bit multipliers, the same in every process."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
