"""Exact top-k inner product search with block-at-a-time pruning.

Vectors lie in blocks of neighbouring ids. A block knows the largest and smallest value of each component (its
term maxima), so a query's summed maxima bound every score in the block. Blocks are scored through their forward
index, best bound first, until the bounds of the rest fall below the query's k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.llm.tables import Scratch

BLOCK_ROWS = 256
SHARD_ROWS = 8192
QUERY_ROWS = 1024
K = 5
SCALE = 256.0
# Rows of a shard are megabytes: few of them at once are read, sent to Python, or held outside the memory that Spark manages.
LARGE_ROWS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4",
    "spark.sql.parquet.columnarReaderBatchSize": "4",
    "spark.sql.cartesianProductExec.buffer.in.memory.threshold": "4",
    "spark.sql.files.openCostInBytes": "1m",  # more of the small files in a task, so fewer pairs of partitions
}
PACKED = "shard int, n int, width int, ids binary, cells binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, cells) whose id is set and whose components are all finite; cells are still to be floored."""
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * SCALE)
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), scaled.alias("cells")
    )


def packed(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Matrices of at most ``size`` rows of neighbouring ids, one per row; shorter vectors are padded with zeros.

    ``shard`` numbers the ranges of ids; a range that came out larger than ``size`` has several matrices.
    """
    rows = rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        cells: list[list] = []
        held = shard = 0

        def flush() -> pa.RecordBatch:
            names = np.concatenate(ids)
            width = max(map(len, cells))
            matrix = np.zeros((len(cells), width))
            for i, row in enumerate(cells):
                matrix[i, : len(row)] = np.floor(row)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([len(cells)], pa.int32()), pa.array([width], pa.int32()),
                 pa.array([names.astype("<i8").tobytes()], pa.binary()), pa.array([matrix.astype("<f8").tobytes()], pa.binary())],
                names=["shard", "n", "width", "ids", "cells"],
            )

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - held)
                ids.append(piece.column("vec_id").to_numpy())
                cells += piece.column("cells").to_pylist()
                held += piece.num_rows
                at += piece.num_rows
                if held == size:
                    yield flush()
                    ids, cells, held = [], [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, PACKED)


def unpack(ids: bytes, cells: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(cells, "<f8").reshape(n, width)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products over the shared components, exact; those beyond a long are held at its limits."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    top = width * (np.abs(left).max(initial=0) * np.abs(right).max(initial=0))
    if top < 2**53:
        return (left @ right.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(left) @ whole(right).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best candidates of each query so far: higher score first, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.floor = np.full(queries, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~score, query))  # ~ reverses the order of all longs
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.ids, rank = query[keep], score[keep], ids[keep], rank[keep]
        last = rank == self.k - 1
        self.floor[self.query[last]] = self.score[last]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
           block: int = BLOCK_ROWS, best: Best | None = None) -> tuple[Best, int]:
    """The best k of one shard for each query, and the number of (query, block) pairs that were scored.

    ``best`` holds what other shards gave the same queries; the shard is added to it.
    """
    width = min(queries.shape[1], vectors.shape[1])
    edges = np.arange(0, len(ids), block)
    highest = np.maximum.reduceat(vectors[:, :width], edges, axis=0)
    lowest = np.minimum.reduceat(vectors[:, :width], edges, axis=0)
    own = queries[:, :width]
    bound = np.maximum(own, 0) @ highest.T + np.minimum(own, 0) @ lowest.T
    bound += np.abs(bound) * 1e-12  # above any rounding of the sums
    if best is None:
        best = Best(len(query_ids), k)
    scored = 0
    for b in np.argsort(-bound.max(axis=0), kind="stable"):
        # Longs below the k-th score as doubles stay below it, so no tie is lost.
        open_ = np.flatnonzero(bound[:, b] >= best.floor.astype(np.float64))
        if not len(open_):
            continue
        rows = slice(edges[b], edges[b] + block)
        score = products(queries[open_], vectors[rows])
        fit = (score >= best.floor[open_][:, None]) & (ids[rows][None, :] != query_ids[open_][:, None])
        q, j = np.nonzero(fit)
        best.add(open_[q], score[q, j], ids[rows][j])
        scored += len(open_)
    return best, scored


def top_k(vectors: DataFrame, is_query: Column, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row, exact.

    Rows with a null id, a null vector or a null or non-finite component take no part. A query never meets rows of
    its own id; a query id with several vectors asks with the smallest one. Vectors of different width meet in the
    components they share. Ties go to the smaller id. Every block of queries meets every shard in a product of two stored
    tables: a task reads a few files of each, and neither is broadcast or shuffled. What a task holds is one shard, the
    blocks of its files, which spill, and the best rows of these.
    """
    rows = usable(vectors, id_col, vec_col)
    asked = usable(vectors.filter(is_query), id_col, vec_col).groupBy("vec_id").agg(F.min("cells").alias("cells"))
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    stored = scratch.write(packed(rows, shards, SHARD_ROWS), "shards")
    blocks = scratch.write(packed(asked, max(1, -(-n // (50 * QUERY_ROWS))), QUERY_ROWS), "queries")
    # As an equi-join on copies of the blocks, the copies, estimated as small as the blocks, would be broadcast by the driver.
    asking = blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "cells")])
    visits = stored.hint("shuffle_replicate_nl").crossJoin(asking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, Best]] = {}  # by the ids of a block, which no other block has
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, queries = unpack(row["q_ids"], row["q_cells"], row["q_n"], row["q_width"])
                ids, cells = unpack(row["ids"], row["cells"], row["n"], row["width"])
                _, so_far = best.get(row["q_ids"], (None, None))
                best[row["q_ids"]] = query_ids, search(query_ids, queries, ids, cells, k, best=so_far)[0]
        for query_ids, kept in best.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[kept.query]), pa.array(kept.ids), pa.array(kept.score)],
                names=["query_id", "vec_id", "score"],
            )

    found = visits.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    local = scratch.write(found, "local-best", LARGE_ROWS)
    scratch.close(local)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
