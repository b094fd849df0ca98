"""Exact top-k search by distributed selection on score histograms.

Vectors are quantised and packed into blocks. Every block of queries meets
every block of candidates; all scores of a pair are one matrix product, and
no score is stored. A few rounds of the following find each query's k-th
score: count scores in 1,024 cells of the query's range, add the counts up over
all blocks, and make the cell that holds the k-th score the next range. When
every range is a single score, a last pass keeps the scores that reach it; the
order by (score, smaller id) then breaks ties, inside each block first, so
that even millions of equal vectors give at most k rows per block.

Defined cases: a row without id, a null vector, and a vector with a null or
non-finite component take no part. Vectors meet only vectors of their own
length. Rows that repeat an id are candidates each by itself, never for a query
of that id; as queries they are one, with the smallest of their vectors. Scores
are exact while they fit into 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcella.llm.common import Scratch, importable

CELLS = 1024
QUERY_ROWS = 512
BLOCK_ROWS = 2048
#: Copies of a query block, so that its pairs spread over tasks; each copy meets one share of the candidates.
SHARES = 64
LIMIT = 2**62

BLOCK = "dim int, share int, ids binary, vectors binary, top double"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) with whole components, of the rows that take part."""
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    )
    return usable.select("vec_id", F.expr(f"transform(x, c -> floor({scale} * c))").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _packed(batches):
    """Candidate rows of a partition as blocks of one vector length."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.asarray(batch.column(1).value_lengths())
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            matrix = _matrix(batch.column(1).take(pa.array(at)), dim)
            for i in range(0, len(at), BLOCK_ROWS):
                own, part = ids[at[i : i + BLOCK_ROWS]], matrix[i : i + BLOCK_ROWS]
                share = int(own.sum() % SHARES)
                top = float(np.sqrt((part.astype(float) ** 2).sum(1)).max(initial=0))
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": pa.array([dim], pa.int32()),
                        "share": pa.array([share], pa.int32()),
                        "ids": [own.tobytes()],
                        "vectors": [part.tobytes()],
                        "top": [top],
                    }
                )


def _scores(row) -> np.ndarray:
    """Scores of a pair of blocks, queries by candidates; own ids get the least value.

    Products are taken in the smallest type that holds every partial sum exactly.
    """
    q_ids, ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
    q = np.frombuffer(row.q_vectors, np.int64).reshape(len(q_ids), row.dim)
    c = np.frombuffer(row.vectors, np.int64).reshape(len(ids), row.dim)
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, row.dim)
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    scores = q.astype(kind) @ c.astype(kind).T
    for i in np.flatnonzero(np.isin(q_ids, ids)):
        scores[i, ids == q_ids[i]] = -LIMIT
    return scores


def _reaching(scores: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of scores from each query's bound on; never those of own ids, as bounds are above -LIMIT.

    A bound that the scores' type cannot hold lies beyond all of them, and rounded it still does.
    """
    return np.nonzero(scores >= low.astype(scores.dtype)[:, None])


def _counts(k: int):
    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                scores, ids = _scores(row), np.frombuffer(row.q_ids, np.int64)
                low, width = np.frombuffer(row.low, np.int64), np.frombuffer(row.width, np.int64)
                # Scores below the k-th of this block alone cannot be the k-th of all, nor can they decide which cell holds it.
                least, n = low.astype(scores.dtype), scores.shape[1]
                if n > k:
                    least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
                which, where = _reaching(scores, least)
                cell = np.minimum((scores[which, where].astype(np.int64) - low[which]) // width[which], CELLS)
                found, n = np.unique(which * (CELLS + 1) + cell, return_counts=True)
                yield pd.DataFrame({"query_id": ids[found // (CELLS + 1)], "cell": found % (CELLS + 1), "n": n})

    return run


def _best(k: int):
    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                scores, ids = _scores(row), np.frombuffer(row.ids, np.int64)
                low = np.frombuffer(row.low, np.int64)
                which, where = _reaching(scores, low)
                found = pd.DataFrame({"q": which, "vec_id": ids[where], "score": scores[which, where].astype(np.int64)})
                found = found.sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
                found = found[found.groupby("q").cumcount() < k]
                own = np.frombuffer(row.q_ids, np.int64)[found["q"].to_numpy()]
                yield pd.DataFrame({"query_id": own, "vec_id": found["vec_id"], "score": found["score"]})

    return run


def top_k(vectors: DataFrame, query_modulus: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best candidates of every row whose id is divisible by ``query_modulus``.

    No join is left to Spark's guess of sizes: it takes packed rows for small, and would send the copies of all
    query blocks through the driver.
    """
    spark = importable(vectors.sparkSession)
    scratch = Scratch(spark, "topk")
    whole = quantised(vectors, scale)
    blocks = scratch.write(whole.mapInArrow(_packed, BLOCK), "blocks")
    largest = blocks.agg(F.max("top")).first()[0] or 0.0

    queries = whole.where(F.col("vec_id") % query_modulus == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.expr("aggregate(v, 0D, (s, c) -> s + double(c) * c)"))
    reach = F.least(F.ceil(norm * largest * 1.0000001) + 1, F.lit(LIMIT // 4)).cast("bigint")
    queries = queries.select(
        F.col("vec_id").alias("query_id"),
        "v",
        (-reach).alias("low"),
        F.ceil((2 * reach + 1) / CELLS).cast("bigint").alias("width"),
    )
    queries = scratch.write(queries, "queries")
    n_groups = max(1, math.ceil(queries.count() / QUERY_ROWS))

    def paired(state: DataFrame) -> DataFrame:
        grouped = queries.select("query_id", "v").hint("merge").join(state, "query_id")
        grouped = grouped.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)))
        grouped = grouped.groupBy(F.size("v").alias("dim"), "part").agg(
            F.sort_array(F.collect_list(F.struct("query_id", "v", "low", "width"))).alias("rows")
        )

        def pack(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    rows = row["rows"]
                    column = lambda name: np.array([r[name] for r in rows], np.int64).tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([row["dim"]], pa.int32()),
                            "q_ids": [column("query_id")],
                            "q_vectors": [column("v")],
                            "low": [column("low")],
                            "width": [column("width")],
                        }
                    )

        packed = grouped.mapInArrow(pack, "dim int, q_ids binary, q_vectors binary, low binary, width binary")
        packed = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        return blocks.hint("merge").join(packed, ["dim", "share"])

    state = scratch.write(queries.select("query_id", "low", "width"), "range")
    while state.where("width > 1").limit(1).count():
        counts = paired(state).mapInPandas(_counts(k), "query_id long, cell long, n long")
        counts = counts.groupBy("query_id", "cell").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query_id").orderBy(F.desc("cell"))
        reached = counts.withColumn("total", F.sum("n").over(above)).where(F.col("total") >= k)
        kth = reached.groupBy("query_id").agg(F.max("cell").alias("cell"))
        # A query with fewer than k candidates keeps its lowest bound, so it gets all of them.
        cell = F.coalesce("cell", F.lit(0))
        nxt = state.hint("merge").join(kth, "query_id", "left").select(
            "query_id",
            (F.col("low") + cell * F.col("width")).alias("low"),
            F.when(F.col("cell").isNull(), 1).otherwise(F.ceil(F.col("width") / CELLS)).cast("bigint").alias("width"),
        )
        state = scratch.write(nxt, "range")
    best = paired(state).mapInPandas(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
