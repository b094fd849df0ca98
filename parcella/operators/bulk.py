"""Keeping bulk sales, which hold very many rows under one id, out of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella import schema as S

SAMPLE_SHARE = 0.001
SAMPLE_SEED = 20
# Proven bound of the broadcast side.
MAX_BROADCAST_IDS = 10_000


def bulk_ids(rows: DataFrame, max_rows: int = S.MAX_ROWS_PER_SALE) -> DataFrame:
    """At most ``MAX_BROADCAST_IDS`` ids that have more than ``max_rows`` rows.

    An id seen more than ``max_rows`` times in a sample has more than
    ``max_rows`` rows, so nothing is listed by mistake. The list is not
    complete: it holds the most frequent ids, and an id with a sizeable share
    of the rows is practically always among them.
    """
    return (
        rows.select("id_mutation")
        .sample(fraction=SAMPLE_SHARE, seed=SAMPLE_SEED)
        .groupBy("id_mutation")
        .count()
        .where(F.col("count") > max_rows)
        .orderBy(F.desc("count"), "id_mutation")
        .limit(MAX_BROADCAST_IDS)
        .select("id_mutation")
    )


def without_bulk(rows: DataFrame, max_rows: int = S.MAX_ROWS_PER_SALE) -> DataFrame:
    """Rows without the hottest sales of more than ``max_rows`` rows.

    Only for computations that discard every such sale in the end: dropping
    some of them early then changes no result, and no hot id reaches a shuffle.
    """
    return rows.join(F.broadcast(bulk_ids(rows, max_rows)), "id_mutation", "left_anti")
