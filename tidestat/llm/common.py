"""What the operators share: the cluster's shared folder, Arrow batches, and byte classes of the contracts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# The white space that the contracts strip or split at.
SPACE = b" \t\n\x0b\x0c\r"
_upper = bytes(range(65, 91))
#: Byte tables: A-Z to lower case; the same with every SPACE byte as a blank; the same with every byte that is no word byte as a blank.
LOWER = bytes.maketrans(_upper, _upper.lower())
LOWER_BLANK = bytes(32 if b in SPACE else LOWER[b] for b in range(256))
BLANK = bytes(32 if b in SPACE else b for b in range(256))
WORD_ONLY = bytes(LOWER[b] if 48 <= b <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidestat-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2 MB: texts may be long, and several workers share an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


#: Rows of a Parquet batch: their texts lie in one array on the heap, for each task.
READ_ROWS = 256


def short_reads(spark: SparkSession) -> None:
    """Parquet batches of READ_ROWS at most (Spark's 4096 rows of 2 KB are arrays of 8 MB and more, far longer ones of longer texts)."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, str(min(READ_ROWS, int(spark.conf.get(name)))))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there and lost executors lose nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def stored(df: DataFrame, name: str) -> str:
    """The path in the shared folder where df now lies as Parquet."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote and that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns alone: by exact name, else in any case, whatever other columns are called."""
    at = [next((i for i, c in enumerate(df.columns) if c == n), None) for n in names]
    at = [next(i for i, c in enumerate(df.columns) if c.lower() == n.lower()) if i is None else i for i, n in zip(at, names, strict=True)]
    placed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def with_fields(schema: StructType, *fields: StructField) -> StructType:
    """schema with fields added, each replacing one of the same name (in any case)."""
    names = {f.name.lower() for f in fields}
    return StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system when a task ends: workers live on, and share an executor."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(
    df: DataFrame,
    text: str | None,
    fields: list[StructField],
    make: Callable[[], Callable[[pa.RecordBatch, list[bytes | None]], dict[str, pa.Array]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df with columns computed from whole texts, one Arrow batch at a time.

    ``make()`` runs once a task and returns f(batch, texts) -> new columns; it may replace existing ones.
    Without a text column the list of texts is empty. Columns in ``drop`` are inputs that do not come back.
    """
    small_batches(df.sparkSession)
    kept = StructType([f for f in df.schema.fields if f.name not in drop])
    out = with_fields(kept, *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            made = each(b, raw(b.column(b.schema.get_field_index(text))) if text is not None else [])
            names = [f.name for f in out.fields]
            yield pa.RecordBatch.from_arrays(
                [made[n] if n in made else b.column(b.schema.get_field_index(n)) for n in names], names=names
            )

    return df.mapInArrow(tidy(run), out)


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if pa.types.is_large_string(column.type) or pa.types.is_string(column.type) else column.to_pylist()


def strings(values: list[bytes | None]) -> pa.Array:
    """A string column of UTF-8 bytes."""
    return pa.array(values, pa.binary()).cast(pa.string())


def code_points(b: bytes) -> int:
    """The number of code points in UTF-8 bytes."""
    return len(b) if b.isascii() else len(b.decode())


def column(df: DataFrame, name: str):
    """A column by its exact name, whatever it contains."""
    return df[f"`{name}`"]


def spread(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of uint64 values (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def n_chars_of(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_chars, if it has that column, brought up to date."""
    return df.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


#: A key of this share of the rows (one in so many) is hot.
HOT = 1_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """The inner join of left with right, whose rows are unique by keys and say in `weight` how many of left's `total` rows
    have them. Hot keys, HOT at most, are broadcast, so that none of them meets in one task."""
    hot = F.broadcast(right.where(F.col(weight) * HOT >= total))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(weight) * HOT < total), keys)
    return left.join(hot, keys).unionByName(rest)
