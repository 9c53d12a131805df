"""Reading the named tables and the live tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from larder.sources.schemas import CATALOG


def load_table(
    spark: SparkSession,
    folder: str,
    name: str,
    schema: T.StructType | None = None,
    file_format: str = "csv",
    keep: bool = False,
) -> DataFrame:
    """One named table, ``<folder>/<name>.<format>``, as a lazy DataFrame with a fixed schema.

    CSV files are matched to the schema by their header, whatever the column order; columns the file lacks are
    left out and extra ones are not read. ``keep`` caches the table. A missing table raises AnalysisException.
    """
    schema = schema or CATALOG[name]
    path = f"{folder.rstrip('/')}/{name}.{file_format}"
    if file_format == "csv":
        options = {"header": True, "escape": '"', "multiLine": False}
        present = spark.read.options(**options).csv(path).columns  # reads the header line only
        known = {f.name: f for f in schema.fields}
        full = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in present])
        wanted = [f.name for f in schema.fields if f.name in present]
        df = spark.read.schema(full).options(**options, enforceSchema=False).csv(path).select(*wanted)
    else:
        df = spark.read.schema(schema).format(file_format).load(path)
    return df.persist(StorageLevel.MEMORY_AND_DISK) if keep else df


def load_catalog(
    spark: SparkSession,
    folder: str,
    names: list[str] | None = None,
    file_format: str = "csv",
    views: bool = True,
    keep: bool = False,
) -> dict[str, DataFrame]:
    """All (or the chosen) tables that exist in the folder, each also as a temp view under its own name."""
    found: dict[str, DataFrame] = {}
    for name in names or list(CATALOG):
        try:
            found[name] = load_table(spark, folder, name, file_format=file_format, keep=keep)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            continue
        if views:
            found[name].createOrReplaceTempView(name)
    return found


def load_transactional(
    spark: SparkSession,
    location: str,
    name: str,
    schema: T.StructType,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """A live table: from the shared append folder, or over JDBC when connection options are given.

    ``jdbc`` takes Spark's own reader options; give partitionColumn, lowerBound, upperBound and numPartitions so
    that a large table is read in parallel.
    """
    if jdbc is not None:
        return spark.read.format("jdbc").options(url=location, dbtable=name, **jdbc).load()
    return spark.read.schema(schema).parquet(f"{location.rstrip('/')}/{name}")
