"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that Spark opens (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def needs(df: DataFrame, *columns: str) -> None:
    """A clear error for a missing column, before any job starts."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def own_name(df: DataFrame, label: str) -> str:
    """A column name that ``df`` does not use, so that extra columns with any names pass through untouched."""
    taken = {c.lower() for c in df.columns}
    while True:
        name = f"{label}_{uuid.uuid4().hex[:8]}"
        if name.lower() not in taken:
            return name


def without_results(df: DataFrame, *results: str) -> DataFrame:
    """``df`` without the columns an operator is about to add: its results win over columns of the same name."""
    lowered = {r.lower() for r in results}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


#: Rows and bytes of text that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering its session's limits on Arrow batches to what whole texts allow.

    Ten thousand texts in a batch would be held several times over by the executor and its workers. Limits that are lower
    already stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def map_rows(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``run`` over Arrow batches of ``df``, whose columns it takes by position; the result has the names of ``schema``.

    Inside, columns have plain names: Spark's own call does not take names with dots.
    """

    def renamed(batches: Iterator) -> Iterator:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(len(schema.fields))])

    plain = in_small_batches(df).toDF(*[f"c{i}" for i in range(len(df.columns))])
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(renamed, inner).toDF(*schema.names)


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library: nothing to hand back by hand
        return lambda _: 0


def tidy(run: Callable, after: Callable[[], None] | None = None) -> Callable:
    """``run`` over a task's batches; at its end ``after``, then unused memory goes back: workers outlive their tasks."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped
