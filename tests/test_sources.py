"""CSV ingest, partitioned tables, lineage cuts and boundaries."""

from __future__ import annotations

import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.session import shared_dir
from parcella.sources import tables as io


def write_csv(path, rows: list[dict]):
    names = S.RAW_SCHEMA.fieldNames()
    lines = [",".join(names)]
    lines += [",".join(str(r.get(n, "")) for n in names) for r in rows]
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture
def files(tmp_path):
    write_csv(
        tmp_path / "sales-2021.csv.gz",
        [
            {
                "id_mutation": "2021-1",
                "date_mutation": "2021-12-31",
                "code_postal": "01500",
                "code_departement": "01",
                "adresse_numero": "007",
                "valeur_fonciere": 100,
                "type_local": "Dépendance",
                "nombre_pieces_principales": 3,
            },
            {"id_mutation": "2021-2", "date_mutation": "2021-01-01", "code_departement": "2A"},
        ],
    )
    write_csv(
        tmp_path / "sales-2022.csv.gz",
        [{"id_mutation": "2022-1", "date_mutation": "2022-01-01", "valeur_fonciere": 1.5}],
    )
    return str(tmp_path / "*.csv.gz")


def test_csv_types_codes_and_blanks(spark, files):
    rows = {r.id_mutation: r for r in io.read_raw_csv(spark, files).collect()}
    first, second = rows["2021-1"], rows["2021-2"]
    assert (first.code_postal, first.code_departement, first.adresse_numero) == ("01500", "01", "007")
    assert (first.valeur_fonciere, first.type_local, first.year) == (100.0, "Dépendance", 2021)
    assert str(first.date_mutation) == "2021-12-31"
    assert (second.code_postal, second.valeur_fonciere, second.latitude) == (None, None, None)


def test_wrong_values_fail_loudly(spark, tmp_path):
    write_csv(tmp_path / "bad.csv.gz", [{"id_mutation": "x", "valeur_fonciere": "abc"}])
    with pytest.raises(Exception, match="MALFORMED|abc"):
        io.read_raw_csv(spark, str(tmp_path / "bad.csv.gz")).collect()


def test_ingest_and_report(spark, files, tmp_path):
    out = str(tmp_path / "raw")
    table = io.ingest(spark, files, out)
    assert {r.year: r.rows for r in io.load_report(table).collect()} == {2021: 2, 2022: 1}
    assert dict(table.dtypes)["year"] == "int"
    view = io.read_table(spark, out, "raw_rows")
    assert spark.sql("SELECT count(*) AS n FROM raw_rows WHERE year = 2021").first().n == 2
    assert set(view.columns) == {*S.RAW_SCHEMA.fieldNames(), "year"}


def test_ingest_parses_each_file_once(spark, files, tmp_path, monkeypatch):
    """The files are gone before the rows are dealt to ranges, and nothing staged is left behind."""
    seen, write = [], io.write_raw

    def late(rows, out):
        for file in tmp_path.glob("*.csv.gz"):
            file.unlink()
        seen.append(rows.stored_path)
        write(rows, out)

    monkeypatch.setattr(io, "write_raw", late)
    table = io.ingest(spark, files, str(tmp_path / "stored"))
    assert table.count() == 3 and not glob.glob(f"{seen[0]}*")


def test_row_groups_and_statistics(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    out = str(tmp_path / "t")
    df = spark.range(450_000).select(
        F.lit(2021).alias("year"), F.col("id").cast("string").alias("id_mutation")
    )
    io.write_raw(df.coalesce(1), out)
    files = glob.glob(f"{out}/year=2021/*.parquet")
    groups = [
        pq.ParquetFile(f).metadata.row_group(i)
        for f in files
        for i in range(pq.ParquetFile(f).metadata.num_row_groups)
    ]
    assert max(g.num_rows for g in groups) <= io.ROWS_PER_ROW_GROUP
    assert all(g.column(0).compression == "ZSTD" for g in groups)
    assert all(g.column(0).statistics.has_min_max for g in groups)


def test_textual_dates(spark):
    df = spark.createDataFrame([("2021-02-03",), (None,)], "date_mutation string")
    assert [r.year for r in io.with_year(df).collect()] == [2021, None]


def test_materialise_cuts_lineage_in_the_shared_folder(spark):
    df = io.materialise(spark.range(10), "numbers")
    assert df.count() == 10
    assert all(shared_dir(spark) in f for f in df.inputFiles())


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")


def test_boundaries(spark, tmp_path):
    path = tmp_path / "regions.geojson"
    geometry = {"type": "Point", "coordinates": [1, 2]}
    features = [
        {"type": "Feature", "properties": {"code": c, "nom": n}, "geometry": geometry}
        for c, n in (("01", "Ain"), ("2A", "Corse"))
    ]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = io.read_boundaries(spark, str(path)).orderBy("code").collect()
    assert [(r.code, r.nom) for r in rows] == [("01", "Ain"), ("2A", "Corse")]
    assert json.loads(rows[0].geometry) == geometry


def test_raw_files_have_disjoint_ids_and_a_hot_sale_is_cut(spark, tmp_path):
    """A year from one gzip file, a third of it one sale, is written by several tasks."""
    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN '2021-hot' ELSE concat('2021-', lpad(id, 6, '0')) END AS id_mutation",
        "CAST(id AS DOUBLE) AS valeur_fonciere",
        "repeat(md5(CAST(id AS STRING)), 4) AS nom_commune",
    )
    rows.coalesce(1).write.csv(str(tmp_path / "one"), compression="gzip", header=True)
    one = spark.read.csv(str(tmp_path / "one"), header=True).withColumn("year", F.lit(2021))
    assert one.rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test data is tiny
    try:
        io.write_raw(one, str(tmp_path / "raw"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = io.read_table(spark, str(tmp_path / "raw"))
    files = stored.groupBy("_metadata.file_path").agg(
        F.min("id_mutation").alias("low"), F.max("id_mutation").alias("high"), F.count("*").alias("n")
    )
    ranges = sorted((r.low, r.high, r.n) for r in files.collect())
    assert len(ranges) > 3 and stored.count() == 30_000
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert stored.where("id_mutation = '2021-hot'").select("_metadata.file_path").distinct().count() > 1
