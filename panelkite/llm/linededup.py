"""Lines that many documents share, found by a sorted stream of line hashes.

Every line becomes a record of its key's 128-bit hash, its document and its places there; the text stays behind. The
records are range-partitioned by hash and document and sorted by hash, document and place, so each task reads one stream
in which the documents of a line follow each other. The stream counts a line's first occurrences (one per document),
holds back the records of fewer than ``min_docs`` documents, and passes the rest on as it comes. A line may fill many
ranges: a run at the border of a range reports its count, and the few records held back there are decided from the summed
counts. The result is a compressed bitmap of kept lines per document; ``apply_keep`` cuts the texts by it.

Documents are told apart by id and text together: rows equal in both are one document, rows of one id with different
texts are several, and rows without an id take part like any other. A null or empty text is one empty line. Empty keys are
never dropped. Very long texts are never cut, and only one text of such a size is in memory at a time. An empty table gives
an empty table. Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkite.llm.tables import Scratch, row_key, shuffle_parts
from panelkite.llm.textcodes import CHUNK_BYTES, chunks

SPACE = b" \t\n\x0b\x0c\r"
# What a stream reports: places that go; a border line's documents; places that wait for the sum of these; the first place
# of a line in its range, which goes if an earlier range holds the line too.
GONE, COUNT, WAIT, OPENED = 0, 1, 2, 3
EVENT_NAMES = ("kind", "part", "h1", "h2", "docs", "row", "places", "id")
EVENT_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
EVENTS = "kind int, part int, h1 long, h2 long, docs long, row long, places array<int>, id "


def line_keys(text: str | None) -> list[bytes]:
    """The keys of all lines: without ASCII white space at both ends, A-Z lower-cased."""
    return [line.strip(SPACE).lower() for line in (text or "").encode().split(b"\n")]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per document and distinct key of at least one code point."""
    for batch in chunks(batches, "text", CHUNK_BYTES):
        at, first, second, places = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            where: dict[bytes, list[int]] = {}
            for place, key in enumerate(line_keys(text)):
                if key:
                    where.setdefault(key, []).append(place)
            for key, found in where.items():
                digest = hashlib.blake2b(key, digest_size=16).digest()
                first.append(int.from_bytes(digest[:8], "big", signed=True))
                second.append(int.from_bytes(digest[8:], "big", signed=True))
                places.append(found)
            at += [i] * len(where)
        picked = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(picked), batch.column("row").take(picked), pa.array(first, pa.int64()),
             pa.array(second, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
            names=["id", "row", "h1", "h2", "places"])


def _streamed(min_docs: int, keep_first: bool):
    """The kernel over one sorted range."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key, docs, last, held, opened, is_border = None, 0, None, [], None, True
        out: list[tuple] = []
        id_type = pa.null()

        def closed(is_border: bool) -> None:
            """End of a run. Inside the range, a line of too few documents keeps its places; at a border they wait."""
            if key is not None and is_border:
                out.append((COUNT, part, *key, docs, None, None, None))
                out.extend((WAIT, part, *key, docs, *h) for h in held)
                if opened is not None:
                    out.append((OPENED, part, *key, docs, *opened))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(EVENT_NAMES)
            made = [pa.array(c, t) for c, t in zip(columns, (*EVENT_TYPES, id_type))]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=list(EVENT_NAMES))

        for batch in batches:
            id_type = batch.column("id").type
            for h1, h2, row, places, doc in zip(*[batch.column(c).to_pylist() for c in ("h1", "h2", "row", "places", "id")]):
                if key != (h1, h2):
                    closed(is_border)
                    is_border = key is None
                    key, docs, last, held, opened = (h1, h2), 0, None, [], None
                elif (doc, row) == last:
                    continue  # an equal row has the same places
                docs, last = docs + 1, (doc, row)
                if keep_first and docs == 1:
                    opened, places = (row, places[:1], doc), places[1:]
                held.append((row, places, doc))
                if docs >= min_docs:
                    out.extend((GONE, part, h1, h2, docs, *h) for h in held)
                    held = []
            if len(out) > 20_000:
                yield flushed()
        closed(True)
        if out:
            yield flushed()

    return kernel


def shared_lines(
    docs: DataFrame, scratch: Scratch, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, row, places`` of the lines that go: a document's id and row key (``row_key``), and its 0-based lines.

    Lines whose key occurs in at least ``min_docs`` documents go everywhere; with ``keep_first`` the very first occurrence,
    by id, row and place, stays. A row may come back in several pieces.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    order = ["h1", "h2", "id", "row"]
    # Written first, as the range borders are sampled from the records in a pass of their own.
    records = scratch.write(texts.mapInArrow(_records, f"id {kind}, row long, h1 long, h2 long, places array<int>"), "lines")
    ranged = records.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    events = scratch.write(ranged.mapInArrow(_streamed(min_docs, keep_first), EVENTS + kind), "line-events")
    scratch.drop(records)
    # At most two border runs a range, each with fewer than min_docs records: as few rows as there are ranges.
    counts = events.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min("part").alias("from_part"))
    waiting = events.filter(F.col("kind").isin(WAIT, OPENED)).join(F.broadcast(counts.filter(F.col("total") >= min_docs)), ["h1", "h2"])
    late = waiting.filter((F.col("kind") == WAIT) | (F.col("from_part") < F.col("part")))
    return events.filter(F.col("kind") == GONE).select("id", "row", "places").unionByName(late.select("id", "row", "places"))


def _bitmap(text_lines: int, gone: np.ndarray) -> bytes:
    kept = np.ones(text_lines, bool)
    kept[gone] = False
    return zlib.compress(np.packbits(kept).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Whether each line of a document stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def keep_bitmaps(
    docs: DataFrame, scratch: Scratch, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, row, n_lines, n_dropped, bitmap`` of every document that loses a line; those that lose none have no row."""
    row = row_key(id_col, text_col).alias("row")
    ends = (F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1).cast("long")
    sizes = docs.select(F.col(id_col).alias("id"), row, ends.alias("n_lines"), F.lit(None).cast("array<int>").alias("places"))
    gone = shared_lines(docs, scratch, min_docs, keep_first, id_col, text_col)
    # One document's places: each of its keys reports once, and equal rows share them.
    both = gone.withColumn("n_lines", F.lit(None).cast("long")).unionByName(sizes)
    places = both.groupBy("id", "row").agg(
        F.first("n_lines", ignorenulls=True).alias("n_lines"), F.flatten(F.collect_list("places")).alias("places"))

    def kernel(batches):
        for batch in batches:
            n, gone = batch.column("n_lines").to_pylist(), batch.column("places").to_pylist()
            maps = [_bitmap(k, np.array(g, np.int64)) for k, g in zip(n, gone)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "row", "n_lines")], pa.array([len(g) for g in gone], pa.int64()),
                 pa.array(maps, pa.binary())],
                names=["id", "row", "n_lines", "n_dropped", "bitmap"])

    kind = docs.schema[id_col].dataType.simpleString()
    return places.filter(F.size("places") > 0).mapInArrow(kernel, f"id {kind}, row long, n_lines long, n_dropped long, bitmap binary")


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, str]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), "\n".join(lines)
    return len(lines), "\n".join([line for line, keep in zip(lines, unpack(bitmap, len(lines))) if keep])


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_lines``, ``n_dropped`` and ``kept_text``, which is empty if no line stays."""
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    maps = bitmaps.select(F.col("id").alias("id_"), F.col("row").alias("row_"), "n_dropped", "bitmap")
    joined = texts.join(maps, (F.col("row") == F.col("row_")) & F.col("id").eqNullSafe(F.col("id_")), "left")

    def kernel(batches):
        for batch in chunks(batches, "text", CHUNK_BYTES):
            made = [kept_text(*pair) for pair in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist())]
            dropped = [n or 0 for n in batch.column("n_dropped").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n for n, _ in made], pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array([t for _, t in made], pa.string())],
                names=["id", "n_lines", "n_dropped", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.select("id", "text", "n_dropped", "bitmap").mapInArrow(kernel, f"id {kind}, n_lines long, n_dropped long, kept_text string")
    return out.withColumnRenamed("id", id_col)
