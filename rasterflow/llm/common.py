"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: the space and 0x09 to 0x0D.
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rasterflow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """materialize() for tables that are deleted at the end of the block; what is returned from it must not read them."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame, label: str) -> DataFrame:
        own = f"{path}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(own)
        return spark.read.schema(df.schema).parquet(own)

    try:
        yield keep
    finally:
        _delete(spark, path)


@contextmanager
def bucketed(df: DataFrame, key: str, label: str) -> Iterator[DataFrame]:
    """df as a table under the shared folder with a bucket for each shuffle partition, so that joins on key don't shuffle it; dropped at the end."""
    spark = df.sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}", partitions(spark)
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


def named(df: DataFrame, name: str) -> Column:
    """The column of that very name, dots and backquotes included."""
    return df["`" + name.replace("`", "``") + "`"]


def spare(df: DataFrame, word: str) -> str:
    """A name that no column of df has, in lower or upper case."""
    taken = {c.lower() for c in df.columns}
    while word in taken:
        word += "_"
    return word


def over_columns(df: DataFrame, kept: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], extra: Sequence[tuple[str, T.DataType | str]] = ()) -> DataFrame:
    """The columns kept of df as run gives them for each Arrow batch, and then the extra ones; names can hold dots."""
    plain = df.select(*[named(df, c).alias(f"c{i}") for i, c in enumerate(kept)])
    schema = T.StructType(list(plain.schema.fields))
    for i, (_, t) in enumerate(extra):
        schema = schema.add(f"x{i}", t)
    names = list(schema.names)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in run(given):
            yield pa.RecordBatch.from_arrays(arrays, names)

    return plain.mapInArrow(batches, schema).toDF(*kept, *[n for n, _ in extra])


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- word hashing inside Arrow tasks -------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (multiply and shift, wrapping)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def byte_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offsets of the words (runs outside ASCII white space) of data, and the bytes as an array."""
    b = np.frombuffer(data, dtype=np.uint8)
    solid = np.empty(len(b) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2], b


#: Powers of a factor that a task keeps.
POWERS = 1 << 16


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor % 2**64, dtype=np.uint64)
    out[:1] = 1
    return out.cumprod(dtype=np.uint64)


_kept_powers = lru_cache(maxsize=32)(_powers)


def powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd factor and of its inverse, modulo 2^64, from the power 0 on."""
    make, size = (_kept_powers, POWERS) if n <= POWERS else (_powers, n)
    return make(factor, size)[:n], make(pow(factor, -1, 2**64), size)[:n]


@lru_cache(maxsize=32)
def _byte_hashes(seed: int) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) * _MUL)


def word_hashes(data: bytes, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of data, the same wherever the word stands: a polynomial of its bytes, from sums over the bytes before its ends."""
    start, end, b = byte_words(data)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    factor = 0x100000001B3 + 2 * seed
    power, inverse = powers(factor, len(b))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_byte_hashes(seed)[b] * power, out=sums[1:])
    return mix(((sums[end] - sums[start]) * inverse[start] * np.uint64(factor)) ^ ((end - start).astype(np.uint64) * _MUL))


def rolling(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of width consecutive hashes: the order-sensitive sum of their products with fixed odd factors."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factors = mix(np.arange(1 + 1000 * seed, width + 1 + 1000 * seed, dtype=np.uint64) * _MUL) | np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out += h[i : i + n] * factors[i]
    return mix(out)
