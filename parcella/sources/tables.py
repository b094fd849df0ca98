"""Reading and writing the raw and sales tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella import schema as S
from parcella.session import shared_dir

# Upper bounds on one output file, so that a large year becomes many files.
RECORDS_PER_FILE = 20_000_000
ROWS_PER_ROW_GROUP = 200_000
# Rows of a page, the least that a look-up by a sorted column reads.
ROWS_PER_PAGE = 2_000


def read_raw_csv(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = S.RAW_SCHEMA
) -> DataFrame:
    """Yearly transaction files (CSV, plain or gzip) with a ``year`` column.

    The schema is given, never inferred, so codes keep their leading zeros and
    no extra pass over the files is made. Empty fields become NULL.
    """
    rows = spark.read.csv(
        paths,
        schema=schema,
        header=True,
        nullValue="",
        emptyValue="",
        dateFormat="yyyy-MM-dd",
        mode="FAILFAST",
        enforceSchema=False,
    )
    return with_year(rows)


def with_year(rows: DataFrame) -> DataFrame:
    """Parse textual dates and add the year of the sale."""
    if dict(rows.dtypes)["date_mutation"] == "string":
        rows = rows.withColumn("date_mutation", F.to_date("date_mutation", "yyyy-MM-dd"))
    return rows.withColumn("year", F.year("date_mutation"))


def _write_by_year(df: DataFrame, path: str, sort_by: list[str], mode: str):
    (
        df.sortWithinPartitions("year", *sort_by)
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .option("parquet.block.row.count.limit", ROWS_PER_ROW_GROUP)
        .option("parquet.page.row.count.limit", ROWS_PER_PAGE)
        .partitionBy("year")
        .parquet(path)
    )


def write_raw(rows: DataFrame, path: str, mode: str = "overwrite"):
    """Raw rows by year, in ranges of sale ids.

    Rows are dealt to writers by ranges of (year, sale id), so the files of a year
    have id ranges that do not overlap (up to their ends), and a look-up by id opens
    few of them. A hash of the row is the last range key: a year that came from one gzip
    file, and a sale that holds a large part of a year, are still cut at any size.
    """
    splitter = F.xxhash64(*sorted(rows.columns))
    _write_by_year(rows.repartitionByRange("year", "id_mutation", splitter), path, ["id_mutation"], mode)


def write_sales(sales: DataFrame, path: str, mode: str = "overwrite"):
    """Sales by year, clustered so that department and box filters skip data.

    ``rebalance`` brings the rows of a year together and lets adaptive execution split a
    year between the outputs of the tasks before. Derived sales come out of a shuffle, so there are many.
    """
    _write_by_year(sales.hint("rebalance", "year"), path, ["department_code", "latitude"], mode)


def read_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """A stored table, optionally registered as a temporary view."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def ingest(spark: SparkSession, paths: str | list[str], out: str, schema=S.RAW_SCHEMA) -> DataFrame:
    """Yearly CSV files to year-partitioned Parquet.

    A gzip file cannot be split, and dealing rows to ranges reads its input twice: once for a
    sample of the keys, once for the rows. So the files are parsed once into a staged copy,
    which both passes read in parallel, and which is deleted in the end.
    """
    staged = materialise(read_raw_csv(spark, paths, schema), "staged")
    write_raw(staged, out)
    discard(staged)
    return read_table(spark, out)


def load_report(table: DataFrame) -> DataFrame:
    """Rows, columns and stored bytes of each year of a stored table."""
    files = table.select("year", "_metadata.file_path", "_metadata.file_size")
    per_file = files.groupBy("year", "file_path").agg(
        F.count("*").alias("rows"), F.max("file_size").alias("bytes")
    )
    return per_file.groupBy("year").agg(
        F.sum("rows").alias("rows"),
        F.lit(len(table.columns)).cast("bigint").alias("n_columns"),
        F.sum("bytes").alias("bytes"),
    )


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that cuts lineage."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/parcella/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Unlike a cache it survives the loss of executors, and readers still get
    column pruning and filter push-down.
    """
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


def discard(stored: DataFrame):
    """Delete a table of :func:`materialise` that nothing will read again."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Region outlines of a GeoJSON feature collection: code, nom, geometry."""
    schema = "features ARRAY<STRUCT<properties: STRUCT<code: STRING, nom: STRING>, geometry: STRING>>"
    return (
        spark.read.schema(schema)
        .json(path, multiLine=True)
        .select(F.inline("features"))
        .select("properties.code", "properties.nom", "geometry")
    )
