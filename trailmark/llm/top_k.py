"""Exact top-k by inner product: tiled matrix products, partial selection, tree merge.

Queries are dealt into blocks of at most ``QUERY_BLOCK`` vectors; a block is broadcast, so its size is bounded, and
all candidates pass once for each block. Every task multiplies tiles of queries and candidates, keeps the best
of each tile by partial selection and merges them into one running list per query, so it returns k + 1 rows per
query however many candidates it has read. The lists of the tasks are merged by query in two
steps, groups of tasks first.

Integers are multiplied as doubles, which is exact while every partial sum stays below 2 ** 53; larger
ones are multiplied as Python integers. In a tile the candidates stand in the order of their ids, and
(score, place) is one 64-bit number, so partial selection respects ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import materialise, scratch_path

K = 10
QUERY_BLOCK = 16_384
QUERY_TILE = 512
TILE = 2048
FAN_IN = 16


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as double; null if any component is null or not finite."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A missing vector gives a null and not false, so both are left out.
    return F.when(~bad, F.transform(doubles, lambda x: F.floor(x * scale)))


def tile_best(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best candidates of each query in one tile, unordered."""
    order = np.argsort(ids, kind="stable")
    candidates, ids = candidates[order], ids[order]
    dimension = max(1, queries.shape[1])
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * dimension
    if largest < 1 << 53:
        scores = (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    else:
        exact = queries.astype(object) @ candidates.astype(object).T
        if exact.size and max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
            raise OverflowError("a score does not fit 64 bits")
        scores = exact.astype(np.int64)
    n = len(ids)
    if n <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    if largest < (1 << 62) // n:
        best = np.argpartition(scores * n - np.arange(n), n - k, axis=1)[:, n - k :]
    else:
        best = np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, best, axis=1), ids[best]


def merge_best(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists per query, by falling score and rising id."""
    scores, ids = b if a is None else (np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1))
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, axis=1), np.take_along_axis(ids, by_id, axis=1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _matrix(column: pa.Array, dimension: int, rows: np.ndarray) -> np.ndarray:
    return np.array(column.take(pa.array(rows)).flatten(), np.int64).reshape(len(rows), dimension)


def _block_lists(vectors: DataFrame, queries: list[tuple[int, list[int]]], first: int, k: int) -> DataFrame:
    """query (number), task, vec_id, score: the best of each task for one block of queries."""
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(v) for _, v in queries}:
        own = [i for i, (_, v) in enumerate(queries) if len(v) == size]
        by_size[size] = np.array(own), np.array([queries[i][1] for i in own], np.int64).reshape(len(own), size)
    sent = vectors.sparkSession.sparkContext.broadcast(by_size)  # at most QUERY_BLOCK vectors

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in source:
            ids, column = np.asarray(batch.column("vec_id")), batch.column("vector")
            sizes = np.asarray(pc.list_value_length(column))
            for size, (_, own) in sent.value.items():
                rows = np.nonzero(sizes == size)[0]
                for begin in range(0, len(rows), TILE):
                    part = rows[begin : begin + TILE]
                    candidates = _matrix(column, size, part)
                    for at in range(0, len(own), QUERY_TILE):
                        found = tile_best(own[at : at + QUERY_TILE], candidates, ids[part], k)
                        best[size, at] = merge_best(best.get((size, at)), found, k)
        task = TaskContext.get().partitionId()
        for (size, at), (scores, ids) in best.items():
            number = np.repeat(first + sent.value[size][0][at : at + QUERY_TILE], scores.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(np.full(len(number), task)), pa.array(ids.ravel()), pa.array(scores.ravel())],
                names=["query", "task", "vec_id", "score"],
            )

    return vectors.mapInArrow(run, "query bigint, task bigint, vec_id bigint, score bigint")


def _merged(lists: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for every query row.

    Rows whose vector is null or has null or non-finite components, or whose id is null, take no part. Vectors of
    different length are not compared. A repeated row is a query and a candidate of its own; only a
    query's own row is left out of its list. Other columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding"), scale).alias("vector"))
    vectors = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL")
    chosen = vectors.where(is_query)
    blocks = max(1, -(-chosen.count() // (QUERY_BLOCK - 1024)))
    chosen = materialise(chosen.repartition(blocks).withColumn("block", F.spark_partition_id()), "queries")
    path, first, owners = scratch_path(spark, "lists"), 0, None
    for block in range(blocks):
        queries = [(r.vec_id, r.vector) for r in chosen.where(F.col("block") == block).collect()]
        lists = _block_lists(vectors, queries, first, k + 1)
        lists = _merged(lists.withColumn("group", F.floor(F.col("task") / FAN_IN)), k + 1, "query", "group")
        lists = _merged(lists.drop("rank"), k + 1, "query")
        own = spark.createDataFrame(
            [(first + i, q, sum(x * x for x in v)) for i, (q, v) in enumerate(queries)], "query bigint, query_id bigint, own bigint"
        )
        joined = lists.join(own, "query").select("query", "query_id", "rank", "vec_id", "score", (F.col("own") == F.col("score")).alias("like_own"))
        joined.write.mode("append").parquet(path)
        first += len(queries)
    found = spark.read.schema("query bigint, query_id bigint, rank int, vec_id bigint, score bigint, like_own boolean").parquet(path)
    # The query's own row scores its square under its own id: one such row goes, if it is among the k + 1 best.
    each = Window.partitionBy("query")
    own_rank = F.min(F.when((F.col("vec_id") == F.col("query_id")) & F.col("like_own"), F.col("rank"))).over(each)
    found = found.withColumn("own_rank", F.coalesce(own_rank, F.lit(k + 1))).where("rank != own_rank")
    return found.select("query_id", (F.col("rank") - (F.col("rank") > F.col("own_rank")).cast("int")).alias("rank"), "vec_id", "score")
