"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Arrow batches of whole texts have about so many bytes, in the JVM and in the Python worker.
BATCH_BYTES = 8_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset and the
    master is local (tests on one machine) a temporary folder is made and set
    as checkpoint folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            path = sc.getCheckpointDir()
    return path.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let the session's Arrow batches have at most ``most`` bytes; a smaller bound stays.

    Spark's own bound is 64 MB, which a task's texts rarely reach, so that its
    whole partition stood at once in the JVM's and in the worker's memory. No
    result depends on where batches end.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower())
    if size is None or int(size[1]) << 10 * " kmgtp".index(size[2] or " ") > most:
        spark.conf.set(name, most)


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int] | None:
    """glibc's call that gives free memory back to the system, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def giving_back(run: Callable) -> Callable:
    """A function for mapInArrow whose worker, at the end of a task, gives the memory it has freed back to the system.

    Workers are reused and wait beside those of the next stages; what numpy
    and Arrow have freed would stay with them.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := _malloc_trim():
            trim(0)

    return whole


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows of a stable input (a file scan or a written table)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def packed_rows(df: DataFrame, name: str = "doc") -> DataFrame:
    """Every row as one struct, so that columns beside it cannot clash with the row's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as make it none of the columns' (whatever their case)."""
    taken = {c.casefold() for c in columns}
    while name.casefold() in taken:
        name = f"_{name}"
    return name


def by_bytes(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices [a, b) of consecutive items with about ``most`` bytes each; at least one item."""
    a = total = seen = 0
    for i, n in enumerate(lengths):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
        seen = i + 1
    if seen > a:
        yield a, seen


def ragged_take(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows ``index`` of (flat, offsets).

    Returns the concatenation and the end of every row in it.
    """
    lengths = offsets[1:][index] - offsets[:-1][index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return flat[:0], ends
    step = np.ones(total, dtype=np.int64)
    has = lengths > 0
    first = offsets[:-1][index][has]
    at = (ends - lengths)[has]
    step[at[0]] = first[0]
    step[at[1:]] = first[1:] - (first[:-1] + lengths[has][:-1]) + 1
    return flat[np.cumsum(step)], ends
