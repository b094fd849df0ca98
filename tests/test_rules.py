"""The semantic rules one by one, on hand-made frames."""

from __future__ import annotations

import datetime

import pytest
from frames import flat, house, parcel, raw, sales
from pyspark.sql import functions as F

from parcella.functions import columns as C
from parcella.functions.filters import FRANCE, Bbox, BuildingSpec, SaleFilter
from parcella.operators import derive, houses, lookup, maps, market, policy, quality

ALL = SaleFilter()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_split_house_counts_once(spark):
    rows = raw(spark, house("a", 130.0, 5, surface_terrain=100.0), house("a", 130.0, 5, surface_terrain=50.0))
    sale = one(derive.derive_sales(rows))
    assert (sale.n_maisons, sale.n_maison_rows, sale.built_area_m2) == (1, 2, 130.0)
    assert sale.composition == "1M"
    # Land is summed over all rows.
    assert sale.land_area_m2 == 150.0


def test_real_pair_and_order_of_buildings(spark):
    rows = raw(spark, house("a", 90.0, 4), flat("a", 40.0, 2), house("a", 130.0, 5))
    sale = one(derive.derive_sales(rows))
    assert (sale.composition, sale.primary_type) == ("2M+1A", "Mixed")
    assert [b.area_m2 for b in sale.buildings] == [40, 130, 90]
    assert (sale.rooms_total, sale.rooms_min, sale.rooms_max) == (11, 2, 5)
    assert sale.price_per_m2 == pytest.approx(200_000 / 260)


def test_half_areas_round_to_even(spark):
    rows = raw(spark, house("a", 2.7, 1), house("a", 2.5, 1), house("a", 1.5, 1))
    sale = one(derive.derive_sales(rows))
    assert [b.area_m2 for b in sale.buildings] == [3, 2, 2]
    assert sale.built_area_m2 == pytest.approx(6.7)
    assert sale.price_per_m2 is None


def test_buildings_without_area_are_dropped(spark):
    assert derive.derive_sales(raw(spark, house("a", None, 4), house("b", 0.0, 4))).count() == 0


def test_missing_rooms(spark):
    sale = one(derive.derive_sales(raw(spark, house("a", 80.0, None))))
    assert (sale.rooms_total, sale.rooms_min, sale.rooms_max) == (None, None, None)
    mixed = one(derive.derive_sales(raw(spark, house("a", 80.0, None), house("a", 60.0, 3))))
    assert (mixed.rooms_total, mixed.rooms_min) == (3, 3)


def test_row_counts_of_a_parcel_only_sale(spark):
    row = one(derive.sale_totals(raw(spark, parcel("a"), parcel("a"), parcel("a"))))
    assert (row.n_maison_rows, row.n_parcel_rows, row.n_rows) == (None, 3, 3)


@pytest.mark.parametrize(
    "change",
    [
        {"valeur_fonciere": 999.0},
        {"valeur_fonciere": None},
        {"nature_mutation": "Echange"},
        {"nature_mutation": None},
        {"code_commune": None},
    ],
)
def test_policy_rejects(spark, change):
    assert derive.derive_sales(raw(spark, house("a", 100.0, 4, **change))).count() == 0


def test_policy_rejects_several_communes_and_bulk(spark):
    two = raw(spark, house("a", 100.0, 4), parcel("a", code_commune="01005"))
    assert derive.derive_sales(two).count() == 0
    ten = [house("b", 100.0, 4)] + [parcel("b")] * 9
    assert derive.derive_sales(raw(spark, *ten)).count() == 1
    assert derive.derive_sales(raw(spark, *ten, parcel("b"))).count() == 0


def test_any_value_skips_missing_values(spark):
    rows = raw(spark, house("a", 100.0, 4, code_postal=None), parcel("a", nature_mutation=None))
    sale = one(derive.derive_sales(rows))
    assert (sale.postal_code, sale.transaction_type) == ("01500", "Vente")


def test_smallest_nature_decides(spark):
    mixed = raw(spark, house("a", 100.0, 4), parcel("a", nature_mutation="Echange"))
    assert derive.derive_sales(mixed).count() == 0
    later = raw(spark, house("a", 100.0, 4), parcel("a", nature_mutation="Vente terrain à bâtir"))
    assert derive.derive_sales(later).count() == 1


def test_coordinates_prefer_houses_and_stay_together(spark):
    rows = raw(
        spark,
        flat("a", 40.0, 2, latitude=48.0, longitude=2.0),
        house("a", 90.0, 4, latitude=47.0, longitude=1.0),
        house("a", 91.0, 4, latitude=46.0, longitude=None),
        parcel("a", latitude=45.0, longitude=0.5),
    )
    sale = one(derive.derive_sales(rows))
    assert (sale.latitude, sale.longitude) == (47.0, 1.0)


def test_nearest_rank_bounds(spark):
    shown = spark.createDataFrame([(float(i),) for i in range(1, 21)], "price double")
    assert tuple(one(maps.price_rank_bounds(shown, "price"))) == (2.0, 20.0)
    single = shown.where("price = 7")
    assert tuple(one(maps.price_rank_bounds(single, "price"))) == (7.0, 7.0)
    assert tuple(one(maps.price_rank_bounds(shown.where("price < 0"), "price"))) == (0.0, 1e6)


def test_price_scale(spark):
    shown = spark.createDataFrame([(1.0,), (11.0,), (None,)], "price double")
    hues = {r.price: r.hue for r in maps.price_scale(shown, "price").collect()}
    assert hues == {1.0: 120, 11.0: 0, None: None}


@pytest.mark.parametrize(
    "day, week", [((2021, 1, 1), "2020-12-28"), ((2021, 1, 4), "2021-01-04"), ((2021, 1, 10), "2021-01-04")]
)
def test_week_bucket_is_the_iso_monday(spark, day, week):
    df = sales(spark, {"sale_date": datetime.date(*day)})
    assert one(df.select(C.time_bucket("week").alias("b"))).b == week
    assert one(df.select(C.time_bucket("month").alias("b"))).b == "2021-01"


def test_building_specs(spark):
    df = sales(
        spark,
        {"id_mutation": "one", "buildings": [("Maison", 100, 5)]},
        {"id_mutation": "two", "buildings": [("Maison", 100, 5), ("Maison", 80, 6)]},
        {"id_mutation": "unknown", "buildings": [("Maison", 100, None)] * 2},
        {"id_mutation": "none", "buildings": None},
    )

    def ids(*specs):
        kept = df.where(SaleFilter(building_specs=specs).predicate())
        return sorted(r.id_mutation for r in kept.collect())

    large = BuildingSpec("Maison", rooms_min=5)
    assert ids(large) == ["one", "two"]
    assert ids(large, large) == ["two"]
    # Different specs may be met by the same building.
    assert ids(large, BuildingSpec("any", area_min=90)) == ["one", "two"]
    assert ids(BuildingSpec()) == ["one", "two", "unknown"]
    assert ids(BuildingSpec("Appartement")) == []


def test_any_number_of_specs(spark):
    df = sales(spark, {})
    n = len(df.first().buildings)
    assert df.where(SaleFilter(building_specs=(BuildingSpec(),) * n).predicate()).count() == 1
    assert df.where(SaleFilter(building_specs=(BuildingSpec(),) * 7).predicate()).count() == 0


def test_address_round_trip():
    flt = SaleFilter(
        year_min=2022,
        department="2A",
        price_max=250_000,
        land_area_min=0,
        building_specs=(BuildingSpec("Maison", 50, None, 4, None), BuildingSpec()),
    )
    assert SaleFilter.from_query(flt.to_query()) == flt
    assert SaleFilter.from_query("") == ALL
    assert ALL.to_query() == ""
    odd = SaleFilter.from_query("?bs=chateau:10:::;Maison&dept=75&amin=")
    assert odd.building_specs == (BuildingSpec("any", 10), BuildingSpec("Maison"))
    assert (odd.department, odd.area_min) == ("75", 0)


def test_bbox(spark):
    df = sales(
        spark,
        {"id_mutation": "in", "latitude": 45.0, "longitude": 1.0},
        {"id_mutation": "out", "latitude": -21.0, "longitude": 55.5},
        {"id_mutation": "nowhere"},
    )
    assert market.count_sales(df, ALL).first().n == 3
    assert market.count_sales(df, ALL, FRANCE).first().n == 1
    assert [r.id_mutation for r in maps.map_points(df, ALL).collect()] == ["in"]
    assert maps.clamp_to_france(Bbox(30, 45, -20, 60)) == Bbox(40, 45, -7, 11)
    assert maps.clamp_to_france(None) == FRANCE


@pytest.mark.parametrize("zoom, mode", [(7.9, "department"), (8, "commune"), (11, "commune"), (12, "points")])
def test_map_mode(zoom, mode):
    assert maps.map_mode(zoom) == mode


def test_map_points_cap(spark):
    df = sales(spark, *[{"latitude": 45.0, "longitude": 1.0}] * 4)
    assert {r.capped for r in maps.map_points(df, ALL, cap=4).collect()} == {True}
    assert {r.capped for r in maps.map_points(df, ALL, cap=5).collect()} == {False}


def test_summary_of_nothing(spark):
    row = one(market.summary_stats(sales(spark, {}).where("year = 1900"), ALL))
    assert tuple(row) == (0, None, None)


def test_implausible_ppm2_leaves_the_median_only(spark):
    df = sales(spark, {"price_per_m2": 99.0}, {"price_per_m2": 500.0}, {"price_per_m2": None})
    assert tuple(one(market.summary_stats(df, ALL))) == (3, 200_000, 500)


def test_missing_category_is_dropped(spark):
    df = sales(spark, {"n_maisons": 0, "n_appartements": 0}, {"n_maisons": 6}, {})
    types = market.trend(df, ALL, None, "year", "type").collect()
    assert [(r.category, r.n_sales) for r in types] == [("Maison", 2)]
    counts = market.trend(df, ALL, None, "year", "n_houses").collect()
    assert [(r.category, r.n_sales) for r in counts] == [("1", 1)]


def test_trend_wide_keeps_all_categories(spark):
    long = market.trend(sales(spark, {}), ALL, None, "year", "type")
    row = one(market.trend_wide(long, "type"))
    assert (row["Maison__n_sales"], row["Mixed__n_sales"]) == (1, None)
    plain = market.trend_wide(market.trend(sales(spark, {}), ALL, None, "year"))
    assert one(plain)["__all____n_sales"] == 1


def test_pages_are_stable_and_complete(spark):
    df = sales(spark, *[{"sale_date": datetime.date(2021, 1, 1 + i % 3)} for i in range(23)])
    pages = [
        [r.id_mutation for r in lookup.sales_page(df, ALL, page=p).collect()] for p in range(3)
    ]
    seen = [i for page in pages for i in page]
    assert len(seen) == len(set(seen)) == 23
    last = df.where(F.col("id_mutation") == pages[0][-1]).first()
    after = lookup.sales_after(df, ALL, last.sale_date, last.id_mutation)
    assert [r.id_mutation for r in after.collect()] == pages[1]
    assert one(lookup.page_total(lookup.sales_page(df, ALL, 2), 2)).total == 23
    assert one(lookup.page_total(lookup.sales_page(df, ALL, 0), 0)).total is None


def test_commune_term_has_wildcards(spark):
    df = sales(spark, {"commune_name": "L'Isle"}, {"commune_name": "Paris"})
    assert lookup.browse_commune(df, "l'i").count() == 1
    assert lookup.browse_commune(df, "P_R").count() == 1
    assert lookup.browse_commune(df, "").count() == 2


def test_sale_card_location(spark):
    df = sales(spark, {"latitude": 45.0, "longitude": 0.0}, {"latitude": 45.0, "longitude": 1.5})
    rows = {r.id_mutation: r for r in lookup.sale_card(df).collect()}
    assert not rows["s000"].has_location
    assert rows["s001"].location == "45.0,1.5"


def test_normalised_buildings(spark):
    df = sales(spark, {"buildings": None}, {"buildings": [(None, None, None)]})
    lists = [r.b for r in df.select(derive.normalise_buildings().alias("b")).collect()]
    assert [[tuple(b) for b in x] for x in lists] == [[], [("", 0, 0)]]


def test_symbolic_prices_count_as_dropped(spark):
    rows = raw(spark, house("a", 1.0, 1, valeur_fonciere=None), house("b", 1.0, 1, valeur_fonciere=1.0))
    row = one(policy.filter_impact(rows))
    assert (row.all_sales, row.drop_symbolic, row.keep_loose) == (2, 2, 0)


def test_raw_and_distinct_houses_differ(spark):
    rows = raw(spark, house("a", 130.0, 5), house("a", 130.0, 6))
    assert houses.two_house_sales(rows).count() == 1
    twins = raw(spark, house("a", 130.0, 5), house("a", 130.0, 5))
    assert houses.two_house_sales(twins).count() == 1
    assert one(derive.derive_sales(twins)).n_maisons == 1


def test_low_cardinality(spark):
    rows = spark.range(200).select(
        (F.col("id") % 10).cast("string").alias("ten"),
        (F.col("id") % 11).cast("string").alias("eleven"),
        F.col("id").cast("string").alias("many"),
        F.lit(None).cast("string").alias("nothing"),
    )
    found = {r.column: r.n_values for r in quality.low_cardinality_columns(rows).collect()}
    assert found == {"ten": 10, "nothing": 0}


def test_labels(spark):
    df = spark.createDataFrame([("Maison",), ("?",), (None,)], "v string")
    labels = [r.e for r in df.select(C.english_label(F.col("v")).alias("e")).collect()]
    assert labels == ["House", "", ""]


def test_boundaries_keep_the_name_with_most_sales(spark):
    regions = spark.createDataFrame(
        [("01", "Old", 1, 100, 10), ("01", "New", 5, 300, 20), ("02", "Two", 2, None, None)],
        "code string, name string, n_sales bigint, median_price bigint, median_per_m2 bigint",
    )
    outlines = spark.createDataFrame(
        [("01", "Ain", "{}"), ("02", None, "{}"), ("99", "x", "{}")],
        "code string, nom string, geometry string",
    )
    rows = {r.code: r for r in maps.choropleth_boundaries(outlines, regions).collect()}
    assert set(rows) == {"01", "02"}
    assert (rows["01"].n_sales, rows["01"].grey) == (5, False)
    assert (rows["02"].nom, rows["02"].grey) == ("02", True)
