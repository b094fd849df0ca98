"""Exact grouped quantiles against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parcella.operators import summaries as Q


def expected(values: pd.Series, p: float) -> float:
    return float(values.quantile(p)) if values.notna().any() else None


def frame(spark, pdf):
    data = [
        tuple(None if v is None or v != v else v for v in row)
        for row in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(data, "k string, x double, flag boolean")


def check(spark, pdf):
    df = frame(spark, pdf)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    measures = {
        "n": Q.count(),
        "flagged": Q.count("flag"),
        "mean": Q.mean("x"),
        "low": Q.smallest("x"),
        "high": Q.largest("x"),
        **{f"p{i}": Q.quantile("x", p) for i, p in enumerate(ps)},
        "rank": Q.nearest_rank("x", 0.5),
    }
    rows = {r.k: r for r in Q.summarise(df, ["k"], measures).collect()}
    groups = pdf.groupby("k", dropna=False)
    assert len(rows) == groups.ngroups
    for key, g in groups:
        row = rows[None if key != key else key]
        x = g.x.dropna()
        assert row.n == len(g) and row.flagged == int(g.flag.fillna(False).sum())
        for i, p in enumerate(ps):
            want = expected(g.x, p)
            got = row[f"p{i}"]
            assert got == want or got == pytest.approx(want, rel=1e-12, abs=1e-12)
        if len(x):
            assert (row.low, row.high) == (x.min(), x.max())
            assert row["rank"] == sorted(x)[min(len(x) // 2, len(x) - 1)]


def test_random_groups(spark):
    rng = np.random.default_rng(3)
    n = 4_000
    pdf = pd.DataFrame(
        {
            "k": rng.choice(np.array(["a", "b", "c", None], dtype=object), n, p=[0.9, 0.05, 0.04, 0.01]),
            "x": np.where(rng.random(n) < 0.3, 100.0, np.round(rng.normal(0, 1e4, n), 2)),
            "flag": rng.random(n) < 0.2,
        }
    )
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    check(spark, pdf)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]),
            st.one_of(st.none(), st.floats(-1e9, 1e9), st.sampled_from([0.0, 1.0, 1.0000001])),
            st.booleans(),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_property(spark, rows):
    pdf = pd.DataFrame(rows, columns=["k", "x", "flag"])
    pdf["x"] = pdf["x"].astype(float) + 0.0
    check(spark, pdf)


def test_without_keys_and_by_shuffle(spark):
    df = spark.range(1, 101).selectExpr("CAST(id AS DOUBLE) AS x", "id % 2 AS bucket")
    whole = Q.summarise(df, [], {"n": Q.count(), "m": Q.median("x")}).first()
    assert tuple(whole) == (100, 50.5)
    nothing = Q.summarise(df.where("x < 0"), [], {"n": Q.count(), "m": Q.median("x")}).first()
    assert tuple(nothing) == (0, None)
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            found = sorted(map(tuple, Q.summarise(df, ["bucket"], {"m": Q.median("x")}).collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert found == [(0, 51.0), (1, 50.0)]


def test_no_group_in_one_buffer(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS x")
    plan = Q.summarise(df, ["k"], {"n": Q.count(), "m": Q.median("x")})._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "ObjectHashAggregate" not in text and "NestedLoop" not in text
    assert "CartesianProduct" not in text


def test_dense_values_of_one_hot_group(spark):
    """Very many different values within one bucket: exact, and spread over many cells."""
    df = spark.range(400_000).selectExpr(
        "CASE WHEN id % 1000 = 0 THEN 'rare' ELSE 'hot' END AS k",
        "1000 + (id * 7919 % 400000) / 2e7D AS x",
    )
    rows = {r.k: r for r in Q.summarise(df, ["k"], {"n": Q.count(), "m": Q.median("x"), "p": Q.quantile("x", 0.999)}).collect()}
    for key, g in df.toPandas().groupby("k"):
        assert (rows[key].n, rows[key].m, rows[key].p) == (len(g), pytest.approx(g.x.median(), rel=1e-15), pytest.approx(g.x.quantile(0.999), rel=1e-15))
    scaled = np.log1p(df.toPandas().x.to_numpy()) * Q.BUCKETS_PER_E
    buckets = np.floor(scaled)
    assert len(np.unique(buckets)) <= 2
    _, counts = np.unique(buckets * Q.CELLS + np.floor((scaled - buckets) * Q.CELLS), return_counts=True)
    assert counts.max() <= 10
