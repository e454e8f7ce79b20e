"""Exact top-k search: exhaustive term-at-a-time accumulation over quantised vectors.

A vector's components become integers; those that are not 0 are its terms. The queries are written in blocks of about
BLOCK_BYTES of components. One block after another is read to the driver, broadcast, searched for, written and let go, so
that driver and workers hold one block whatever the number of queries, and no plan grows with it. A task keeps a run of
candidates as postings lists, one for each dimension: places and weights of the non-zero components. A query's terms
scatter their products into a dense array of scores, one slot a candidate; a partial selection takes the best k of it,
and the runs' bests are merged by a grouped selection. Every candidate is scored against every query: no index is
asked and nothing is pruned.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids. Shorter
vectors lack the later terms, which then count 0. Rows that repeat an id count once, as the smallest of their
vectors. Ties go to the smaller id. With fewer candidates than k, all are returned. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, named, together, written

#: Components of a block of queries, eight bytes each.
BLOCK_BYTES = 64 << 20
RUN = 16_384


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id long, v array<long> of floor(scale * x) with x as double; a row an id."""
    x = named(vector_col).cast("array<double>")
    sound = named(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(named(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def accumulate(queries: list[np.ndarray], postings: list[tuple[np.ndarray | None, np.ndarray]], scores: np.ndarray) -> Iterator[np.ndarray]:
    """The dense scores of each query, in one array that is used again: term by term, over the terms' postings.

    A posting's places are None if it names every candidate.
    """
    product = np.empty_like(scores)
    for q in queries:
        scores[:] = 0
        for term in np.flatnonzero(q[: len(postings)]).tolist():
            places, weights = postings[term]
            if places is None:
                np.multiply(weights, q[term], out=product)
                np.add(scores, product, out=scores)
            else:
                scores[places] += weights * q[term]
        yield scores


def _exact_type(queries: list[np.ndarray], matrix: np.ndarray) -> type:
    """The fastest type that holds every partial score exactly."""
    most = max((int(np.abs(q).max()) for q in queries), default=0) * int(np.abs(matrix).max(initial=0)) * matrix.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _search(block, k: int):
    """mapInArrow over (id, v): the k best of each run for each query of the broadcast block (ids, vectors)."""

    def best(ids: np.ndarray, scores: np.ndarray, own: int) -> np.ndarray:
        """Places of the k best by (score descending, id), without the query's own."""
        if len(ids) > k + 1:
            at_least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            places = np.flatnonzero(scores >= at_least)
        else:
            places = np.arange(len(ids))
        places = places[ids[places] != own]
        return places[np.lexsort((ids[places], -scores[places]))[:k]]

    def run(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        query_ids, query_vectors = block.value
        kind = _exact_type(query_vectors, matrix)
        postings = []
        for column in matrix.T:
            places = np.flatnonzero(column)
            dense = 4 * len(places) >= 3 * len(column)
            postings.append((None, column.astype(kind)) if dense else (places, column[places].astype(kind)))
        queries = [v.astype(kind) for v in query_vectors]
        q, v, s = [], [], []
        for own, scores in zip(query_ids, accumulate(queries, postings, np.zeros(len(ids), dtype=kind)), strict=True):
            places = best(ids, scores, own)
            q.append(np.full(len(places), own))
            v.append(ids[places])
            s.append(scores[places])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (q, v, s)], names=["query_id", "vec_id", "score"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[int] = []
        held: list[list[int]] = []

        def flush() -> pa.RecordBatch:
            matrix = np.zeros((len(held), max(map(len, held))), dtype=np.int64)
            for i, row in enumerate(held):
                matrix[i, : len(row)] = row
            ids = np.array(held_ids, dtype=np.int64)
            held.clear()
            held_ids.clear()
            return run(ids, matrix)

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                held_ids.append(i)
                held.append(v)
                if len(held) == RUN:
                    yield flush()
        if held:
            yield flush()

    return over


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, query_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors. is_query: a condition on the column id.

    query_block: queries of a block; without it, as many as BLOCK_BYTES hold.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id_col, vector_col, scale), "vectors")
    count, widest = rows.where(is_query).agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-count // (query_block or max(1, BLOCK_BYTES // (8 * widest))))
    queries = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    queries = written(queries.repartition("block").sortWithinPartitions("block"), "queries")
    # Spark cuts each task's rows to k a query before the shuffle, and sorts what is left without holding a group.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found: list[DataFrame] = []
    for number in range(blocks):
        mine = queries.where(F.col("block") == number).select("id", "v").toPandas()
        if not len(mine):
            continue
        block = spark.sparkContext.broadcast((mine["id"].to_numpy(dtype=np.int64), [np.array(v, dtype=np.int64) for v in mine["v"]]))
        del mine
        best = rows.mapInArrow(_search(block, k), "query_id long, vec_id long, score long")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(written(best, "best"))
        block.destroy()
    discard(queries, rows)
    return together(found)
