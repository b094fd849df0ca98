"""Property rows built from the TPC-H-like test tables.

``RAW_ROWS_SQL`` is dialect neutral: Spark runs it to build the raw table, and
the oracle statements embed the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "customer", "nation", "part")

RAW_ROWS_SQL = """
SELECT
  CAST(year(o.o_orderdate) AS STRING) || '-' || CAST(o.o_orderkey AS STRING) AS id_mutation,
  CAST(o.o_orderdate AS DATE) AS date_mutation,
  CAST(year(o.o_orderdate) AS INT) AS year,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
       WHEN o.o_orderkey % 53 = 0 THEN CAST(1 AS DOUBLE)
       WHEN o.o_orderkey % 211 = 0 THEN o.o_totalprice + l.l_linenumber
       ELSE o.o_totalprice END AS valeur_fonciere,
  CASE WHEN o.o_orderkey % 16 = 0 THEN 'Echange'
       WHEN o.o_orderkey % 16 = 1 THEN 'Adjudication'
       WHEN o.o_orderkey % 16 = 2 THEN 'Vente terrain à bâtir'
       ELSE 'Vente' END AS nature_mutation,
  CASE WHEN p.p_type IN ('STANDARD', 'LARGE') THEN 'Maison'
       WHEN p.p_type = 'SMALL' THEN 'Appartement'
       WHEN p.p_type = 'MEDIUM' THEN 'Dépendance'
       WHEN p.p_type = 'PROMO' AND l.l_returnflag = 'R'
            THEN 'Local industriel. commercial ou assimilé' END AS type_local,
  CASE WHEN p.p_type IN ('STANDARD', 'LARGE') THEN '1'
       WHEN p.p_type = 'SMALL' THEN '2'
       WHEN p.p_type = 'MEDIUM' THEN '3'
       WHEN p.p_type = 'PROMO' AND l.l_returnflag = 'R' THEN '4' END AS code_type_local,
  CASE WHEN p.p_type IN ('STANDARD', 'LARGE', 'SMALL') AND l.l_linenumber < 7
       THEN CAST(20 * ceil(l.l_quantity / 10) + 10 AS DOUBLE) END AS surface_reelle_bati,
  CASE WHEN p.p_type IN ('STANDARD', 'LARGE', 'SMALL')
       THEN CAST(ceil(l.l_quantity / 10) AS INT) + CAST(l.l_suppkey % 3 AS INT) END
       AS nombre_pieces_principales,
  lpad(CAST(c.c_nationkey + 1 AS STRING), 2, '0') AS code_departement,
  lpad(CAST(c.c_nationkey + 1 AS STRING), 2, '0')
    || lpad(CAST(CASE WHEN o.o_orderkey % 31 = 0 THEN l.l_linenumber
                      ELSE c.c_custkey % 4 END AS STRING), 3, '0') AS code_commune,
  n.n_name || '-' || CAST(CASE WHEN o.o_orderkey % 31 = 0 THEN l.l_linenumber
                               ELSE c.c_custkey % 4 END AS STRING) AS nom_commune,
  lpad(CAST(c.c_nationkey + 1 AS STRING), 2, '0') || '000' AS code_postal,
  CASE WHEN o.o_orderkey % 499 = 0 THEN n.n_name || '-ancienne' END AS ancien_nom_commune,
  CASE WHEN p.p_type <> 'SMALL'
       THEN CAST(100 + 50 * (l.l_partkey % 20) AS DOUBLE) END AS surface_terrain,
  CASE WHEN l.l_returnflag = 'N' THEN 'sols' ELSE 'jardins' END AS nature_culture,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
       WHEN c.c_nationkey = 24 THEN CAST(-21 AS DOUBLE)
       ELSE 41 + CAST(c.c_custkey % 1000 AS DOUBLE) / 100
               + CAST(l.l_linenumber AS DOUBLE) / 1000 END AS latitude,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
       WHEN c.c_nationkey = 24 THEN CAST(55.5 AS DOUBLE)
       ELSE -5 + CAST(c.c_custkey * 7 % 1400 AS DOUBLE) / 100
               + CAST(l.l_linenumber AS DOUBLE) / 1000 END AS longitude
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {part} p ON l.l_partkey = p.p_partkey
"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transaction rows derived from the test tables, as a lazy DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(RAW_ROWS_SQL, **tables)


def raw_rows_oracle() -> str:
    """The same rows for an engine that has the tables registered by name."""
    return RAW_ROWS_SQL.format(**{t: t for t in TABLES})
