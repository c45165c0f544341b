"""Best-fit packing of token pieces into sequences of a fixed capacity.

Documents and gaps are held range-sorted as runs of equal length: there are at most ``capacity`` different
lengths, so the sorted runs stay small however many rows they stand for, and every sweep over them is a
synchronous step for all rows of a run. Rows get their rank within their run by distributed prefix counts,
and a rank names the sequence and the place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.llm.tables import Scratch
from panelkite.llm.textcodes import chunks
from panelkite.llm.tokens import SMALL, TEXT_BYTES, Encoder, default_path

CAPACITY = 2048
END_ID = 0
ROWS_PER_BUCKET = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: whole ones of ``capacity``, the first takes what is over."""
    head = n % capacity if n > capacity else n
    first = [(0, head)] if head else []
    return first + [(at, capacity) for at in range(head, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on demand.

    Null and empty texts are one piece that holds the end id alone. Only documents longer than ``capacity``
    are cut. A null id stays null. Repeated rows give repeated pieces. An empty table gives no piece.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in chunks(batches, "text", TEXT_BYTES):
            flat, offsets = encoder.encode(batch.column("text").to_pylist())
            rows: list[tuple] = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.concatenate([flat[offsets[k] : offsets[k + 1]], end]).astype("<u4", copy=False)
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc, number, start, length, zlib.crc32(own.tobytes()), own if with_ids else None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            width = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns[:width], kinds, strict=False)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:width],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, PIECES + (", ids array<bigint>" if with_ids else ""))


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over sorted runs: rows (length, first rank, bins, items per bin, first sequence, offset).

    Lengths go from large to small. Each step finds the successor, the smallest gap that holds the length,
    gives the next ranks of the run to the bins of that gap, and puts the bins back under their new gap.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, bins)
    present = 0  # bit g: some bin has the gap g
    made = 0
    out = []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            above = present >> length
            if above:
                gap = length + (above & -above).bit_length() - 1
                first, bins = runs[gap].pop()
                if not runs[gap]:
                    present &= ~(1 << gap)
            else:
                gap, first = capacity, made
                bins = -(-left // (capacity // length))
                made += bins
            each = gap // length
            used = min(bins, left // each)
            if not used:  # the last of the run share one bin
                each, used = left, 1
            out.append((length, rank, used, each, first, capacity - gap))
            for at, number, room in ((first, used, gap - each * length), (first + used, bins - used, gap)):
                if number and room:
                    runs[room].append((at, number))
                    present |= 1 << room
            left -= used * each
            rank += used * each
    return out


PLAN = T.StructType([
    T.StructField(name, T.IntegerType() if name in ("run_length", "run_offset") else T.LongType())
    for name in ("run_length", "run_rank", "run_bins", "run_each", "run_first", "run_offset")
])


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, length_col: str = "length",
         order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """The rows of a written table of pieces with ``sequence_id`` and ``offset``.

    Ranks of equal lengths follow ``order``; rows that tie in it are interchangeable. Every length must lie
    between 1 and ``capacity``. The plan has a few rows for each different length, so its size is bounded by
    the capacity, not by the data.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(8, -(-total // ROWS_PER_BUCKET))
    keyed = pieces.withColumn("pack_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counted = keyed.groupBy(F.col(length_col).alias("run_length"), "pack_bucket").agg(F.count("*").alias("run_count"))
    # Each bucket of a run starts where the buckets before it end.
    before = Window.partitionBy("run_length").orderBy("pack_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.write(
        counted.withColumn("run_base", F.coalesce(F.sum("run_count").over(before), F.lit(0))), "pack-runs"
    )
    counts = {r[0]: r[1] for r in base.groupBy("run_length").agg(F.sum("run_count")).collect()}  # at most capacity rows
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    plan = spark.createDataFrame(plan_runs(counts, capacity), PLAN)
    own = Window.partitionBy(length_col, "pack_bucket").orderBy(*order)
    ranked = keyed.withColumn("rank_in_bucket", F.row_number().over(own) - 1).alias("p")
    ranked = ranked.join(
        base.alias("b"), (F.col(f"p.{length_col}") == F.col("b.run_length")) & (F.col("p.pack_bucket") == F.col("b.pack_bucket"))
    ).select(*[F.col(f"p.{c}") for c in pieces.columns], (F.col("b.run_base") + F.col("p.rank_in_bucket")).alias("run_of"))
    within = F.col("run_of") - F.col("run_rank")
    placed = ranked.join(
        F.broadcast(plan),
        (F.col(length_col) == F.col("run_length")) & (within >= 0) & (within < F.col("run_bins") * F.col("run_each")),
    )
    return placed.select(
        *pieces.columns,
        (F.col("run_first") + F.floor(within / F.col("run_each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (within % F.col("run_each")) * F.col(length_col)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize documents, cut those longer than ``capacity`` and pack the pieces by best fit."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(token_pieces(docs, id_col, text_col, path, capacity, end_id), "pieces", SMALL)
    return pack(pieces, scratch, capacity)
