"""Stored raw and sales tables of a test-data folder."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella import schema as S
from parcella.operators.derive import derive_sales
from parcella.plans.fixtures import raw_rows
from parcella.sources import tables as io


@dataclass(frozen=True)
class Store:
    """The pipeline's tables, each written on first use and then read.

    Queries read stored tables, as a user's would: partition pruning, column
    pruning and filter push-down apply, and a lost executor costs no rebuild.
    """

    spark: SparkSession
    sf_dir: str

    @cached_property
    def raw(self) -> DataFrame:
        path = io.workspace(self.spark, "raw")
        io.write_raw(raw_rows(self.spark, self.sf_dir), path)
        return io.read_table(self.spark, path)

    @cached_property
    def sales(self) -> DataFrame:
        path = io.workspace(self.spark, "sales")
        io.write_sales(derive_sales(self.raw), path)
        return io.read_table(self.spark, path)

    @cached_property
    def csv_path(self) -> str:
        """The raw rows as yearly gzip CSV files."""
        path = io.workspace(self.spark, "csv")
        (
            self.raw.withColumn("file_year", F.col("year"))
            .drop("year")
            .hint("rebalance", "file_year")
            .write.partitionBy("file_year")
            .csv(path, header=True, compression="gzip", dateFormat="yyyy-MM-dd", emptyValue="")
        )
        return path

    @property
    def csv_schema(self) -> T.StructType:
        """The part of the raw layout that the test tables can feed."""
        known = {f.name: f for f in S.RAW_SCHEMA}
        return T.StructType([known[c] for c in self.raw.columns if c != "year"])

    @cached_property
    def boundaries_path(self) -> str:
        """A feature collection of all departments plus one without sales."""
        path = io.workspace(self.spark, "boundaries")
        nation = self.spark.read.parquet(f"{self.sf_dir}/nation.parquet")
        regions = nation.select(
            F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("code"),
            F.col("n_name").alias("nom"),
        ).union(self.spark.sql("SELECT '99' AS code, 'nowhere' AS nom"))
        feature = F.struct(
            F.lit("Feature").alias("type"),
            F.struct("code", "nom").alias("properties"),
            F.struct(
                F.lit("Point").alias("type"), F.array(F.lit(0), F.lit(0)).alias("coordinates")
            ).alias("geometry"),
        )
        collection = regions.agg(
            F.to_json(
                F.struct(
                    F.lit("FeatureCollection").alias("type"),
                    F.collect_list(feature).alias("features"),
                )
            ).alias("value")
        )
        collection.write.text(path)
        return path

    def searches(self) -> DataFrame:
        """One saved search per supplier, written as a shareable address."""
        supplier = self.spark.read.parquet(f"{self.sf_dir}/supplier.parquet")
        return self.spark.sql(SEARCHES_SQL, supplier=supplier)


# One text for Spark and the oracle: an address per supplier that exercises
# open bounds, all departments, repeated and unknown building specs.
SEARCHES_SQL = """
SELECT s_suppkey AS search_id,
       'ymin=' || CAST(1995 + s_suppkey % 5 AS STRING)
       || '&ymax=' || CAST(1997 + s_suppkey % 6 AS STRING)
       || CASE WHEN s_suppkey % 10 = 0 THEN ''
               ELSE '&dept=' || lpad(CAST(s_nationkey + 1 AS STRING), 2, '0') END
       || CASE WHEN s_suppkey % 3 = 0 THEN '&pmin=50000&pmax=300000' ELSE '' END
       || CASE WHEN s_suppkey % 4 = 0 THEN '&amin=100' ELSE '' END
       || CASE WHEN s_suppkey % 7 = 0 THEN '&lamax=2000' ELSE '' END
       || CASE WHEN s_suppkey % 5 = 0 THEN '&bs=Maison%3A%3A%3A4%3A%3BMaison%3A%3A%3A4%3A'
               WHEN s_suppkey % 5 = 1 THEN '&bs=chateau%3A60%3A90%3A%3A'
               WHEN s_suppkey % 5 = 2 THEN '&bs=Appartement%3A%3A%3A%3A6%3BMaison%3A50%3A%3A%3A'
               ELSE '' END AS query
FROM {supplier}
"""

_STORES: dict[tuple[str, str], Store] = {}


def open_store(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = Store(spark, sf_dir)
    return _STORES[key]
