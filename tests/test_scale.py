"""Skew, plans and the other way of size-checked joins."""

from __future__ import annotations

import collections
import io
import math
import random
import re
import statistics
from contextlib import redirect_stdout

import numpy as np
import pytest
from frames import house, parcel, raw, sales
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions.filters import SaleFilter
from parcella.operators import (
    bulk,
    derive,
    houses,
    lookup,
    maps,
    market,
    policy,
    quality,
    search_blocks,
    searches,
)
from parcella.operators import summaries as Q
from parcella.plans.queries import BOX, YEARS
from parcella.plans.store import open_store

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def store(spark):
    return open_store(spark, SF)


@pytest.fixture(scope="module")
def skewed(spark, store):
    """A third of all rows under one id, spread over types, areas and communes."""
    n = store.raw.count() // 2
    hot = spark.range(n).select(
        *[
            {
                "id_mutation": F.lit("1997-hot"),
                "year": F.lit(1997),
                "nature_mutation": F.lit("Vente"),
                "valeur_fonciere": F.lit(5e6),
                "type_local": F.when(F.col("id") % 2 == 0, "Maison"),
                "surface_reelle_bati": (F.col("id") % 5000).cast("double"),
                "nombre_pieces_principales": (F.col("id") % 9).cast("int"),
                "code_commune": F.lit("01001"),
            }
            .get(c, F.lit(None).cast(t))
            .alias(c)
            for c, t in store.raw.dtypes
        ]
    )
    return store.raw.unionByName(hot), n


def test_hot_sale_is_left_out_before_the_shuffle(skewed, store, monkeypatch):
    rows, n = skewed
    monkeypatch.setattr(bulk, "SAMPLE_SHARE", 0.01)
    assert [r.id_mutation for r in bulk.bulk_ids(rows).collect()] == ["1997-hot"]
    assert bulk.without_bulk(rows).count() == store.raw.count()
    assert derive.derive_sales(rows).exceptAll(store.sales.select(rows_of(store))).count() == 0
    assert derive.derive_sales(rows).count() == store.sales.count()


def rows_of(store):
    return [F.col(c) for c in S.SALES_SCHEMA.fieldNames()]


def test_sample_never_changes_the_result(store, monkeypatch):
    counts = set()
    for share in (0.0, 0.2, 0.9):
        monkeypatch.setattr(bulk, "SAMPLE_SHARE", share)
        found = derive.derive_sales(store.raw).agg(F.count("*"), F.sum("built_area_m2")).first()
        counts.add(tuple(found))
    assert len(counts) == 1


def test_reports_with_a_hot_sale(skewed, store):
    rows, n = skewed
    top = quality.largest_sales_by_rows(rows, 1).first()
    assert (top.id_mutation, top.n_rows, top.n_communes) == ("1997-hot", n, 1)
    assert policy.kept_types(rows).exceptAll(policy.kept_types(store.raw)).count() == 0
    assert quality.biggest_sales(rows, 1).first().id_mutation == "1997-hot"


def test_hot_group_median(spark):
    # One group and one value hold most rows.
    df = spark.range(100_000).selectExpr(
        "CASE WHEN id % 10 < 9 THEN 'hot' ELSE 'cold' END AS k",
        "CASE WHEN id % 3 = 0 THEN 7D ELSE CAST(id AS DOUBLE) END AS x",
    )
    got = {r.k: r.m for r in Q.summarise(df, ["k"], {"m": Q.median("x")}).collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("x").alias("m")).collect()}
    assert got == want


def test_derivation_shuffles_rows_once(store):
    text = plan(derive.derive_sales(store.raw))
    tree = text.split("\n\n")[0]
    # One exchange for the rows, one for the sampled ids, no sort-merge join.
    assert tree.count(" Exchange") == 2
    assert "BroadcastHashJoin LeftAnti" in tree and "SortMergeJoin" not in tree
    assert "Python" not in text and "Window" not in tree


def test_year_filter_prunes_partitions(store):
    text = plan(market.count_sales(store.sales, SaleFilter(year_min=1997, year_max=1997)))
    assert "(year" in text.split("PartitionFilters:")[1].split("\n")[0]
    assert "ReadSchema: struct<>" in text


def test_filters_and_columns_reach_the_scan(store):
    text = plan(maps.choropleth_department(store.sales, SaleFilter(price_min=5), BOX))
    assert "GreaterThanOrEqual(price_eur,5" in text and "GreaterThanOrEqual(latitude,45" in text
    assert "buildings" not in text.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize(
    "query",
    [
        lambda t: lookup.browse_commune(t.sales, "nation"),
        lambda t: lookup.sales_page(t.sales, YEARS, 2),
        lambda t: maps.map_points(t.sales, YEARS, BOX),
        lambda t: quality.biggest_sales(t.raw),
        lambda t: policy.sample_dropped(t.raw),
        lambda t: houses.giant_houses(t.raw, t.sales),
    ],
)
def test_top_k_without_global_sort(query, store):
    text = plan(query(store))
    assert "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "query",
    [
        lambda t: quality.largest_sales_by_rows(t.raw),
        lambda t: quality.biggest_sales(t.raw),
        lambda t: houses.two_house_extremes(t.raw, True),
        lambda t: policy.biggest_after_policy(t.raw),
        lambda t: policy.sample_dropped(t.raw),
        lambda t: houses.sampled_sale_rows(t.raw, t.sales),
        lambda t: houses.dedup_examples(t.raw, t.sales),
    ],
)
def test_details_are_looked_up(query, store):
    """The winners' ids are a filter of the scan; pages of the sorted raw rows without them are not read."""
    found = query(store)
    text = plan(found)
    assert "PushedFilters: [In(id_mutation" in text and "Join" not in text
    found.collect()
    assert rows_scanned(found) < store.raw.count() / 1.5


def rows_scanned(df) -> int:
    """Rows that the scans of an executed plan gave."""
    inside = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in inside:
            todo.append(getattr(node, inside[kind])())
        elif node.nodeName().startswith("Scan"):
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return total


def test_look_ups_of_many_ids_join(spark, monkeypatch):
    rows = raw(spark, *[parcel(f"s{i % 5}") for i in range(10)])
    ids = spark.createDataFrame([(f"s{i}",) for i in range(3)] + [(None,)], "id_mutation string")
    for most in (1_000, 2):
        monkeypatch.setattr(quality, "MAX_PUSHED_IDS", most)
        assert quality.only_ids(rows, ids).count() == 6
    assert quality.only_ids(rows, ids.where("false")).count() == 0


def test_type_reports_do_not_join(store):
    assert "Join" not in plan(policy.kept_types(store.raw))
    assert "Join" not in plan(houses.two_house_sales(store.raw))


def test_saved_searches_count_as_one_by_one(store, spark):
    few = store.searches().where("search_id <= 20")
    found = searches.saved_search_report(store.sales, few).collect()
    for row in found:
        text = few.where(F.col("search_id") == row.search_id).first().query
        assert market.count_sales(store.sales, SaleFilter.from_query(text)).first().n == row.n_sales
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = searches.saved_search_report(store.sales, few).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(found) == sorted(shuffled)


def test_saved_searches_do_not_pair_everything(store):
    text = plan(searches.matching_pairs(store.sales, store.searches()))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_saved_searches_medians_one_by_one(store):
    """Both medians of every search against the single-search summary."""
    few = store.searches().where("search_id <= 8")
    for row in searches.saved_search_report(store.sales, few).collect():
        text = few.where(F.col("search_id") == row.search_id).first().query
        one = market.summary_stats(store.sales, SaleFilter.from_query(text)).first()
        assert (row.median_price, row.median_per_m2) == (one.median_price, one.median_per_m2)


def test_saved_searches_join_sales_once_for_counts(store):
    """The counts by range are shuffled once and read twice; the second join also matches the range."""
    report = searches.saved_search_report(store.sales, store.searches())
    report.collect()
    text = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReusedExchange \[search_id#\d+L?, series#\d+, range#\d+L?", text)) == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_saved_searches_missing_values(spark):
    df = sales(spark, *[{"price_eur": p, "price_per_m2": m} for p, m in ((100.0, None), (200.0, None), (None, 2000.0), (None, 4000.0))])
    asked = spark.createDataFrame([(1, "ymin=1990"), (2, "dept=none")], "search_id int, query string")
    found = {r.search_id: r for r in searches.saved_search_report(df, asked).collect()}
    assert (found[1].n_sales, found[1].median_price, found[1].median_per_m2) == (4, 150, 3000)
    assert (found[2].n_sales, found[2].median_price, found[2].median_per_m2) == (0, None, None)


def rows_out_of_joins(df) -> int:
    """Rows that the joins of a DataFrame that has run gave out."""
    seen = 0

    def walk(node):
        nonlocal seen
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            seen += node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return seen


def test_saved_searches_do_not_join_every_match(spark):
    """Blocks of sales meet packed searches, so what leaves the joins does not grow with the matches."""
    df = sales(spark, *[{"price_eur": 1000.0 + 7 * i, "price_per_m2": 1000.0 + 3 * i} for i in range(400)])
    asked = spark.createDataFrame([(i, f"ymin=1990&pmin={1000 + i}") for i in range(50)], "search_id int, query string")
    report = searches.saved_search_report(df, asked)
    found = {r.search_id: r for r in report.collect()}
    assert found[0].n_sales == 400 and found[49].n_sales == 393
    assert (found[0].median_price, found[49].median_price) == (2397, 2421)
    assert rows_out_of_joins(report) < 2000
    text = report._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastHashJoin \[department", text), "packed rows are not broadcast"


def test_saved_searches_by_brute_force(spark):
    """Repeated and missing ids, several departments and specs, missing values, ranks at the ends of blocks."""
    draw = random.Random(11)
    data = []
    for _ in range(500):
        built = [(draw.choice([S.HOUSE, S.APARTMENT]), draw.choice([None, 40, 80, 120]), draw.choice([None, 1, 4])) for _ in range(draw.randrange(4))]
        data.append(
            {
                "price_eur": draw.choice([None, *(float(draw.randrange(1000, 1040)) for _ in range(9))]),
                "price_per_m2": draw.choice([None, 50.0, float(draw.randrange(90, 200))]),
                "year": draw.choice([2020, 2021, 2022, 2023]),
                "department_code": draw.choice(["01", "02", "2A", None]),
                "built_area_m2": draw.choice([None, 50.0, 100.0]),
                "land_area_m2": draw.choice([None, 0.0, 300.0]),
                "buildings": built or draw.choice([None, built]),
                "n_maisons": sum(b[0] == "Maison" for b in built),
                "n_appartements": sum(b[0] == "Appartement" for b in built),
            }
        )
    parts = ["pmin=1010", "pmax=1030", "amin=60", "amax=", "lamin=0", "lamax=299", "ymin=1990", "ymax=2022", "dept=01", "dept=2A", "bs=Maison:50:::", "bs=any::::;any::::", "bs=Appartement:::2:;Maison::::"]
    asked = [(draw.choice([*range(25), None]), "&".join(draw.sample(parts, draw.randrange(5)))) for _ in range(40)]
    df = sales(spark, *data)
    got = {}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for r in searches.saved_search_report(df, spark.createDataFrame(asked, "search_id int, query string")).collect():
            got.setdefault(r.search_id, []).append((r.n_sales, r.median_price, r.median_per_m2))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    union = collections.defaultdict(list)
    for i, text in asked:
        union[i] += df.where(SaleFilter.from_query(text).predicate()).select("price_eur", "price_per_m2").collect()

    def middle(values):
        return math.floor(statistics.median(values) + 0.5) if values else None

    want = {}
    for i, rows in union.items():
        prices = [r[0] for r in rows if r[0] is not None]
        plausible = [r[1] for r in rows if r[1] is not None and 100 <= r[1] <= 30000]
        want[i] = (len(rows), middle(prices), middle(plausible)) if i is not None else (0, None, None)
    assert sum(n > 20 for n, *_ in want.values()) > 5
    assert {i: set(v) for i, v in got.items()} == {i: {v} for i, v in want.items()}


def test_numbers_of_blocks_sort_like_values():
    values = np.array([-math.inf, -1e300, -2.5, -1e-300, 0.0, 1e-300, 3.0, math.inf, math.nan])
    found = search_blocks.ordered(values)
    assert (np.diff(found) > 0).all() and found[0] > search_blocks.MISSING and found[-1] < search_blocks.OPEN
    assert (search_blocks.ordered(np.array([-0.0, math.copysign(math.nan, -1)])) == found[[4, 8]]).all()


def test_search_defaults_and_empty_values(spark):
    df = sales(spark, {}, {"year": 1999}, {"department_code": "75"})
    asked = spark.createDataFrame(
        [(1, ""), (2, "dept=75"), (3, "pmax="), (4, "ymin=1990"), (5, "dept=")],
        "search_id int, query string",
    )
    found = {r.search_id: r.n_sales for r in searches.saved_search_report(df, asked).collect()}
    assert found == {1: 2, 2: 1, 3: 0, 4: 3, 5: 0}


def test_one_address_contract(spark):
    """Both decoders agree on odd addresses, and a bad one spoils no other."""
    df = sales(spark, {}, {"year": 1999}, {"department_code": "75"}, {"year": 2022})
    good = ["?ymin=1990", "??ymin=1990&", "ymin=2021&ymin=2022", "ymin=2022&x=%41&x", "bs=" + "any%3A1%3A%3A%3A%3B" * 7, "dept=75&dept=33", "amin"]
    bad = ["pmin=abc", "bs=any:1:x::", "ymax=20x1", "pmax=1,5"]
    asked = spark.createDataFrame(list(enumerate([*good, *bad])), "search_id int, query string")
    found = {r.search_id: r for r in searches.saved_search_report(df, asked).collect()}
    for i, text in enumerate(good):
        flt = SaleFilter.from_query(text)
        assert (found[i].status, found[i].n_sales) == ("ok", df.where(flt.predicate()).count()), text
    for i, text in enumerate(bad, len(good)):
        assert (found[i].status, found[i].n_sales) == ("malformed", None)
        with pytest.raises(ValueError):
            SaleFilter.from_query(text)


def test_totals_agree(store):
    total = market.trend_total(store.sales, YEARS, split="type").first().total_sales
    assert total == market.count_sales(store.sales, YEARS).first().n == store.sales.count()
    odd = store.sales.where(
        (F.size("buildings") != F.col("n_maisons") + F.col("n_appartements"))
        | (F.col("n_maisons") > F.col("n_maison_rows"))
        | (F.aggregate("buildings.area_m2", F.lit(0), lambda a, x: a + x) != F.col("built_area_m2"))
    )
    assert odd.count() == 0


def test_one_pass_equals_parts(spark):
    rows = raw(
        spark,
        *[house(f"a{i}", 50.0 + i % 3, 1 + i % 2) for i in range(12)],
        *[house(f"a{i}", 50.0, None) for i in range(6)],
        *[parcel(f"a{i}", surface_terrain=9.0) for i in range(4)],
    )
    both = derive.sale_totals(rows).join(derive.building_totals(rows), "id_mutation")
    parts = both.where(derive.residential_policy())
    columns = sorted(set(parts.columns) & set(S.SALES_SCHEMA.fieldNames()))
    whole = derive.derive_sales(rows).select(*columns)
    assert whole.exceptAll(parts.select(*columns)).count() == 0
    assert whole.count() == parts.count() == 12
