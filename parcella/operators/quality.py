"""Data-quality reports over raw transaction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions import columns as C
from parcella.operators import summaries as Q
from parcella.sources.tables import materialise

# Fixed value: the label of rows without a type.
PARCEL_LABEL = "(null — terrain/parcel)"

# Rows that may prove a column to have many values.
PROOF_ROWS = 10_000


# Ids that become a filter of the scan; the winners of a top-k report are far fewer.
MAX_PUSHED_IDS = 1_000


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given sales, looked up by id.

    The ids are found by a first job and go into the scan as a filter. Stored raw
    rows lie in ranges of ids, so files, row groups and pages without any of them are skipped.
    Past ``MAX_PUSHED_IDS`` ids, of which no more are fetched, the rows are joined instead.
    """
    few = [r[0] for r in ids.select("id_mutation").limit(MAX_PUSHED_IDS + 1).collect()]
    if len(few) > MAX_PUSHED_IDS:
        return rows.join(ids.select("id_mutation"), "id_mutation", "left_semi")
    return rows.where(F.col("id_mutation").isin(few))


def _total(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def rows_per_year(rows: DataFrame) -> DataFrame:
    sales = F.count_distinct("id_mutation")
    return (
        rows.groupBy("year")
        .agg(
            F.count("*").alias("rows"),
            sales.alias("sales"),
            F.round(F.count("*") / sales, 3).alias("rows_per_sale"),
        )
        .orderBy("year")
    )


def rows_per_sale_histogram(rows: DataFrame, limit: int = 15) -> DataFrame:
    return (
        rows.groupBy("id_mutation")
        .agg(F.count("*").alias("rows_per_sale"))
        .groupBy("rows_per_sale")
        .agg(F.count("*").alias("n_sales"))
        .orderBy("rows_per_sale")
        .limit(limit)
    )


def largest_sales_by_rows(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Sales with the most rows.

    The ranking needs only the ids; the details are then read for the winners.
    """
    top = (
        rows.groupBy("id_mutation")
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), "id_mutation")
        .limit(limit)
    )
    return (
        only_ids(rows, top)
        .groupBy("id_mutation")
        .agg(
            F.count("*").alias("n_rows"),
            F.min("date_mutation").alias("date_min"),
            F.max("date_mutation").alias("date_max"),
            F.min("valeur_fonciere").alias("price_min"),
            F.max("valeur_fonciere").alias("price_max"),
            F.count_distinct("code_commune").alias("n_communes"),
        )
        .orderBy(F.desc("n_rows"), "id_mutation")
        .limit(limit)
    )


def _varies(column: str) -> Column:
    """More than one distinct non-null value, from a state of two values."""
    return F.coalesce(F.min(column) < F.max(column), F.lit(False))


def _sales_varying(rows: DataFrame, column: str, name: str) -> DataFrame:
    return (
        rows.groupBy("id_mutation")
        .agg(_varies(column).alias("varies"))
        .agg(F.count_if("varies").alias(name))
    )


def inconsistent_price(rows: DataFrame) -> DataFrame:
    return _sales_varying(rows, "valeur_fonciere", "sales_with_inconsistent_price")


def inconsistent_date(rows: DataFrame) -> DataFrame:
    return _sales_varying(rows, "date_mutation", "sales_with_inconsistent_date")


def multi_commune(rows: DataFrame) -> DataFrame:
    return _sales_varying(rows, "code_commune", "sales_spanning_communes")


def id_collisions(rows: DataFrame) -> DataFrame:
    return _sales_varying(rows, "year", "ids_in_several_years")


def consistency_summary(rows: DataFrame) -> DataFrame:
    """The three consistency counts from one pass over the rows."""
    return (
        rows.groupBy("id_mutation")
        .agg(
            _varies("valeur_fonciere").alias("price"),
            _varies("date_mutation").alias("date"),
            _varies("code_commune").alias("commune"),
        )
        .agg(
            F.count_if("price").alias("inconsistent_price"),
            F.count_if("date").alias("inconsistent_date"),
            F.count_if("commune").alias("multi_commune"),
        )
    )


def transaction_types(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("nature_mutation")
        .agg(F.count_distinct("id_mutation").alias("sales"))
        .orderBy(F.desc("sales"), F.asc_nulls_last("nature_mutation"))
    )


def row_types(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(F.coalesce("type_local", F.lit(PARCEL_LABEL)).alias("type_local"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "type_local")
    )


def missingness(rows: DataFrame) -> DataFrame:
    checked = {
        "null_price": "valeur_fonciere",
        "null_lat": "latitude",
        "null_lon": "longitude",
        "null_commune": "code_commune",
        "null_built_area": "surface_reelle_bati",
        "null_type": "type_local",
    }
    rooms = F.coalesce("nombre_pieces_principales", F.lit(0))
    return rows.agg(
        F.count("*").alias("total_rows"),
        *[_total(F.col(c).isNull()).alias(name) for name, c in checked.items()],
        _total(rooms == 0).alias("null_or_zero_rooms"),
    )


def price_percentiles(rows: DataFrame) -> DataFrame:
    """Distribution of the price per sale."""
    prices = (
        rows.where(F.col("valeur_fonciere").isNotNull())
        .groupBy("id_mutation")
        .agg(C.any_of("valeur_fonciere").alias("price"))
        .select("price")
    )
    wanted = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "p999": 0.999}
    return Q.summarise(
        materialise(prices, "prices"),
        [],
        {
            "sales": Q.count(),
            "min_price": Q.smallest("price"),
            **{name: Q.quantile("price", p) for name, p in wanted.items()},
            "max_price": Q.largest("price"),
        },
    ).withColumns({name: F.round(name) for name in wanted})


def biggest_sales(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Dearest sales; ranked on the price alone, then described."""
    order = [F.desc_nulls_last("price"), F.col("id_mutation")]
    top = (
        rows.groupBy("id_mutation")
        .agg(C.any_of("valeur_fonciere").alias("price"))
        .orderBy(*order)
        .limit(limit)
    )
    return (
        only_ids(rows, top)
        .groupBy("id_mutation")
        .agg(
            C.any_of("valeur_fonciere").alias("price"),
            C.any_of("nom_commune").alias("commune"),
            C.any_of("date_mutation").alias("date"),
            C.any_of("nature_mutation").alias("nature"),
        )
        .orderBy(*order)
        .limit(limit)
    )


def geocoding_quality(rows: DataFrame) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    located = lat.isNotNull() & lon.isNotNull()
    # The box outside of which a row counts as misplaced.
    return rows.agg(
        _total(located).alias("geocoded_rows"),
        _total(~located).alias("missing_coords"),
        _total((lat == 0) & (lon == 0)).alias("null_island"),
        _total(~lat.between(41, 52)).alias("lat_out_of_france"),
        _total(~lon.between(-5.5, 10)).alias("lon_out_of_france"),
    )


def rooms_histogram(
    rows: DataFrame, limit: int = 20, between: tuple[int, int] | None = None
) -> DataFrame:
    """House rows by number of rooms."""
    rooms = F.col("nombre_pieces_principales")
    wanted = rooms.isNotNull() if between is None else rooms.between(*between)
    return (
        rows.where(C.is_house() & wanted)
        .groupBy(F.col("nombre_pieces_principales").alias("rooms"))
        .agg(F.count("*").alias("rows"))
        .orderBy("rooms")
        .limit(limit)
    )


def _column_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of every (column, value), counted in one pass over all columns."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        rows.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("rows"))
    )


def categorical_rundown(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Value, rows, share and English label of low-cardinality columns.

    Without ``columns``, those of the usual ones that the table has.

    The window that relates a value to its column runs over the counted values
    of one column, of which there are few (see :func:`low_cardinality_columns`).
    """
    columns = columns or [c for c in S.CATEGORICAL_COLUMNS if c in rows.columns]
    of_column = Window.partitionBy("column")
    return (
        _column_values(rows, columns)
        .withColumn(
            "pct", F.round(F.lit(100.0) * F.col("rows") / F.sum("rows").over(of_column), 3)
        )
        .withColumn("value", F.coalesce("value", F.lit("(null)")))
        .withColumn("english", C.english_label(F.col("value")))
    )


def low_cardinality_columns(
    rows: DataFrame, columns: list[str] | None = None, max_values: int = 10
) -> DataFrame:
    """Columns with at most ``max_values`` distinct values.

    Columns that show more values in some rows are ruled out by that alone, so
    that counting the others exactly rarely shuffles ids or prices. Which rows
    these are changes what is counted, never the result.
    """
    columns = columns or rows.columns
    shown = rows.select(*columns).limit(PROOF_ROWS).agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    undecided = [c for c in columns if shown[c] <= max_values]
    if not undecided:
        return rows.sparkSession.createDataFrame([], "column string, n_values bigint")
    return (
        _column_values(rows, undecided)
        .groupBy("column")
        .agg(F.count("value").alias("n_values"))
        .where(F.col("n_values") <= max_values)
    )


