"""Substring dedup: runs of words that already start in an earlier document are removed.

Documents are cut into overlapping segments at anchors: the smallest code of a few words within each window. Equal
windows have equal anchors, so all occurrences of a window lie in segments of one anchor, and the shard of an
anchor sees every one of them. Anchors that one document alone holds are set aside first. Each shard builds a
compressed FM-index of its different segments and streams them through it; matches of a whole window tell the
smallest document in which the window starts. The cost grows in proportion to the text, as no document meets
shards that it shares no anchor with.

A common phrase can be the anchor of more segments than a shard holds. Segments of such an anchor are cut into their
windows, and the smallest document of each window comes from an aggregation by two codes of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkite.llm.fmindex import FMIndex
from panelkite.llm.tables import Scratch, row_key
from panelkite.llm.textcodes import Coder, Words, chunks, gram_codes, mix

WINDOW = 13
ANCHOR = 5
SHARD_SYMBOLS = 250_000
NEVER = np.iinfo(np.int64).max
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def anchored(words: Words, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with the same anchor: first window, number of windows, code of the anchor."""
    codes = words.grams(size)
    n = len(codes) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    best = codes[:n].copy()
    place = np.zeros(n, np.int8)
    for j in range(1, window - size + 1):
        ahead = codes[j : j + n]
        less = ahead < best
        best[less] = ahead[less]
        place[less] = j
    fits = words.room(window)[:n]
    at = np.arange(n) + place
    begins = fits.copy()
    begins[1:] &= ~fits[:-1] | (at[1:] != at[:-1])
    # A text's first window begins a run even if its anchor's place follows on.
    first = np.zeros(n + 1, bool)
    first[words.bounds[:-1][words.bounds[:-1] <= n]] = True
    begins |= fits & first[:n]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(fits & np.append(begins[1:] | ~fits[1:], True)) + 1
    return starts, ends - starts, best[starts]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")
    ).withColumn("row", row_key("doc", "text"))


def anchors_of(docs: DataFrame, window: int, size: int, spread: bool) -> DataFrame:
    """(anchor, lo, hi): the smallest and largest id per anchor and batch; or (anchor, row) for each row's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text"))
            starts, _, code = anchored(words, window, size)
            text = np.searchsorted(words.bounds, starts, "right") - 1
            # Order by anchor, within it by text, each pair once.
            order = np.lexsort((text, code))
            code, text = code[order].astype(np.int64), text[order]
            if spread:
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
                row = batch.column("row").to_numpy()[text[new]]
                yield pa.RecordBatch.from_arrays([pa.array(code[new]), pa.array(row)], names=["anchor", "row"])
            elif len(code):
                doc = batch.column("doc").to_numpy()[text]
                new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[new]), pa.array(np.minimum.reduceat(doc, new)), pa.array(np.maximum.reduceat(doc, new))],
                    names=["anchor", "lo", "hi"],
                )

    return docs.mapInArrow(run, "anchor bigint, row bigint" if spread else "anchor bigint, lo bigint, hi bigint")


SEGMENTS = "side int, seg_a bigint, seg_b bigint, anchor bigint, lo bigint, hi bigint, row bigint, start int, codes binary"


def segments(docs: DataFrame, window: int, size: int) -> DataFrame:
    """Segments of shared anchors. Side 0: each different one of a batch with its codes and the smallest and largest
    id. Side 1: each occurrence (row, id in ``lo``, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text"))
            starts, n, code = anchored(words, window, size)
            text = np.searchsorted(words.bounds, starts, "right") - 1
            lists = batch.column("anchors")
            wanted = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            # Anchors of a row that are in its list, by one search over (row, anchor) pairs.
            known = mix(wanted + mix((owner + 1).astype(np.uint64)))
            shared = np.isin(mix(code + mix((text + 1).astype(np.uint64))), known)
            starts, n, code, text = starts[shared], n[shared], code[shared], text[shared]
            if not len(starts):
                continue
            # Two codes of a segment's words: running sums of coded words, taken back to a common place.
            length = n + window - 1
            keys = []
            for salt in SALTS:
                keys.append(coder.runs(mix(words.codes ^ np.uint64(salt)), starts, starts + length).astype(np.int64))
            doc, row = batch.column("doc").to_numpy()[text], batch.column("row").to_numpy()[text]
            order = np.lexsort((doc, keys[1], keys[0]))
            a, b, d = keys[0][order], keys[1][order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            last = np.append(new[1:], len(order)) - 1
            whole = words.codes.astype("<u8")
            pick = order[new]
            # Neighbours overlap by all but a few words, so text order keeps the written table small.
            by_place = np.argsort(pick)
            pick, new, last = pick[by_place], new[by_place], last[by_place]
            content = [whole[s : s + k].tobytes() for s, k in zip(starts[pick].tolist(), length[pick].tolist(), strict=True)]
            k = len(pick)
            none = pa.nulls(k, pa.int64())
            schema = ["side", "seg_a", "seg_b", "anchor", "lo", "hi", "row", "start", "codes"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), pa.array(a[new]), pa.array(b[new]), pa.array(code[pick].astype(np.int64)),
                 pa.array(d[new]), pa.array(d[last]), none, pa.nulls(k, pa.int32()), pa.array(content, pa.binary())],
                names=schema,
            )
            k = len(starts)
            begin = (starts - words.bounds[text]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.array(keys[0]), pa.array(keys[1]), pa.nulls(k, pa.int64()), pa.array(doc),
                 pa.nulls(k, pa.int64()), pa.array(row), pa.array(begin), pa.nulls(k, pa.binary())],
                names=schema,
            )

    return docs.mapInArrow(run, SEGMENTS)


def first_documents(contents: list[bytes], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each different segment of a shard, the smallest id in which each of its windows starts."""
    lengths = np.array([len(c) // 8 for c in contents])
    codes = np.frombuffer(b"".join(contents), "<u8")
    symbols = np.unique(codes, return_inverse=True)[1] + 1
    ends = np.cumsum(lengths) + np.arange(len(lengths))  # in the text with its separators
    text = np.zeros(len(symbols) + len(lengths), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = symbols
    index = FMIndex(text, window)
    # The id behind each suffix that still has a whole window before its separator.
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    left = ends[owner] - np.arange(len(text))
    held = np.where(left >= window, docs[owner], NEVER)
    smallest = np.minimum.reduceat(held[index.suffixes], index.group_start)
    begins = ends - lengths
    out = np.full(len(text), NEVER)
    for _, at, group in index.matches(text, ends, lengths):
        out[at] = smallest[group]
    return [out[b : e - window + 1] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def judged(side: DataFrame, shards: int, window: int) -> DataFrame:
    """(seg_a, seg_b, firsts) for segments with a window that starts in a document before one of their own."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Batches may repeat a segment: one copy is indexed, with the smallest and largest id of all.
        one = group.groupby(["seg_a", "seg_b"], sort=False).agg(lo=("lo", "min"), hi=("hi", "max"), codes=("codes", "first"))
        firsts = first_documents(list(one["codes"]), one["lo"].to_numpy(), window)
        early = np.array([f.min() for f in firsts]) < one["hi"].to_numpy()
        one = one.reset_index()[early]
        return pd.DataFrame({
            "seg_a": one["seg_a"], "seg_b": one["seg_b"],
            "firsts": [f.astype("<i8").tobytes() for f, e in zip(firsts, early, strict=True) if e],
        })

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return side.select(shard.alias("shard"), "seg_a", "seg_b", "lo", "hi", "codes").groupBy("shard").applyInPandas(
        run, "seg_a bigint, seg_b bigint, firsts binary")


def windows_of(side: DataFrame, window: int) -> DataFrame:
    """(seg_a, seg_b, lo, hi, place, win_a, win_b): each window of each segment, with two codes of its words."""
    names = ["seg_a", "seg_b", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column("codes").to_pylist()
            lengths = np.array([len(b) // 8 for b in blobs])
            codes = np.frombuffer(b"".join(blobs), "<u8")
            count = lengths - window + 1
            owner = np.repeat(np.arange(len(blobs)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(lengths) - lengths, count) + place
            keys = [gram_codes(mix(codes ^ np.uint64(salt)), window)[at].astype(np.int64) for salt in SALTS]
            own = [batch.column(c).take(pa.array(owner)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(place.astype(np.int32)), pa.array(keys[0]), pa.array(keys[1])],
                names=[*names, "place", "win_a", "win_b"],
            )

    return side.select(*names, "codes").mapInArrow(
        run, "seg_a bigint, seg_b bigint, lo bigint, hi bigint, place int, win_a bigint, win_b bigint")


def judged_by_window(side: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """As ``judged``, for whole anchors of any size: nothing is gathered by anchor or by window."""
    cut = windows_of(side, window)
    shared = cut.groupBy("win_a", "win_b").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first < last")
    shared = scratch.write(shared.drop("last"), "shared-windows")
    early = cut.join(shared, ["win_a", "win_b"]).filter("first < hi")
    # A segment has few windows, and each of them one first document.
    found = early.groupBy("seg_a", "seg_b").agg(F.collect_set(F.struct("place", "first")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for pairs in batch.column("found").to_pylist():
                firsts = np.full(max(x["place"] for x in pairs) + 1, NEVER, "<i8")
                for x in pairs:
                    firsts[x["place"]] = x["first"]
                blobs.append(firsts.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("seg_a"), batch.column("seg_b"), pa.array(blobs, pa.binary())], names=["seg_a", "seg_b", "firsts"])

    return found.mapInArrow(run, "seg_a bigint, seg_b bigint, firsts binary")


def removals(hits: DataFrame) -> DataFrame:
    """(row, doc, starts): window starts that an earlier document has, for each occurrence with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("firsts").to_pylist()
            sizes = np.array([len(b) // 8 for b in blobs], np.int64)
            first = np.frombuffer(b"".join(blobs), "<i8")
            owner = np.repeat(np.arange(len(sizes)), sizes)
            offset = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            early = first < batch.column("lo").to_numpy()[owner]
            start = (batch.column("start").to_numpy()[owner] + offset)[early].astype("<i4")
            count = np.bincount(owner[early], minlength=len(sizes))
            edge = np.concatenate([[0], np.cumsum(count)])
            rows = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(rows)), batch.column("lo").take(pa.array(rows)),
                 pa.array([start[edge[i] : edge[i + 1]].tobytes() for i in rows.tolist()], pa.binary())],
                names=["row", "doc", "starts"],
            )

    return hits.select("row", "lo", "start", "firsts").mapInArrow(run, "row bigint, doc bigint, starts binary")


def kept_words(marked: DataFrame, window: int, with_text: bool) -> DataFrame:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out: list[tuple] = []
            for text, blobs in zip(texts, batch.column("marks").to_pylist(), strict=True):
                words = (text or b"").split()  # bytes split at the same six ASCII characters
                removed = 0
                kept = words
                if blobs:
                    starts = np.concatenate([np.frombuffer(b, "<i4") for b in blobs])
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    kept = list(compress(words, (~gone).tolist()))
                joined = b" ".join(kept)
                out.append((len(words), removed, hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            columns = list(zip(*out, strict=True))[: len(names) - 1]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]], names=names
            )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return marked.select("doc", "text", "marks").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, on demand kept_text, for every row of ``docs``.

    Words are runs of other than ASCII white space, unchanged. A word goes if a window of ``window`` words covers it
    whose words also start in a document with a smaller id, judged on the whole input. Null texts have no words. Rows
    that share an id are one document and never count against each other. Rows with a null id lose nothing and count
    against nobody. An empty table gives an empty result.
    """
    source = _source(docs, id_col, text_col)
    named = source.filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    ranges = anchors_of(named, window, anchor, spread=False)
    shared = ranges.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("anchor")
    shared = scratch.write(shared, "shared-anchors")
    pairs = anchors_of(named, window, anchor, spread=True).join(shared, "anchor")
    # The anchors of a row fit one value: there are fewer of them than words.
    lists = scratch.write(pairs.groupBy("row").agg(F.collect_set("anchor").alias("anchors")), "row-anchors")
    listed = named.join(lists, "row").select("doc", "row", "text", "anchors")
    cut = scratch.write(segments(listed, window, anchor), "segments", SMALL)
    scratch.drop(shared, lists)
    side = cut.filter("side = 0")
    symbols = F.sum(F.length("codes")) / 8
    heavy = side.groupBy("anchor").agg(symbols.alias("n")).filter(F.col("n") > SHARD_SYMBOLS).select("anchor")
    heavy = scratch.write(heavy, "heavy-anchors")
    split = not heavy.isEmpty()
    light = side.join(heavy, "anchor", "left_anti") if split else side
    total = int(light.agg(symbols).first()[0] or 0)
    found = judged(light, max(1, -(-total // SHARD_SYMBOLS)), window)
    if split:
        found = found.unionByName(judged_by_window(side.join(heavy, "anchor", "left_semi"), scratch, window))
    found = scratch.write(found, "first-documents")
    hits = cut.filter("side = 1").select("seg_a", "seg_b", "row", "lo", "start").join(found, ["seg_a", "seg_b"])
    marks = scratch.write(removals(hits), "removals")
    scratch.close(marks)
    grouped = marks.distinct().groupBy("row", "doc").agg(F.collect_list("starts").alias("marks"))
    return kept_words(source.join(grouped, ["row", "doc"], "left"), window, with_text)

