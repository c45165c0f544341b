"""Near-duplicates by HyperMinHash: bucketed registers, bands of registers, estimate, exact check.

A register holds the leading-zero count and the first mantissa bits of the smallest hash in its bucket. Empty
buckets borrow from a bucket that a fixed hash sequence names. Documents that agree in a band of registers are
candidates; the Jaccard estimate from equal registers, corrected for chance collisions, rules most of them out,
and the full shingle sets decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkite.llm.graph import components
from panelkite.llm.tables import Scratch
from panelkite.llm.textcodes import SEEDS, Words, chunks, gram_codes, mix

SHINGLE = 5
PERCENT = 75
BUCKETS = 96
BAND = 3  # registers per band: at similarity 0.75 all 32 bands miss with probability 2.4e-8
MANTISSA = 10
COLLISION = 0.17 / (1 << MANTISSA)  # chance that registers of different values agree
SLACK = 6.0  # standard deviations between the estimate and the bound that rule a pair out
GROUP_ROWS = 500  # members of a band or family per chunk; a task compares two chunks
TRIES = 64
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def shingle_codes(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; fewer words than a shingle count as one, no words as none."""
    grams = words.grams(size)
    short = {n: gram_codes(words.codes, n) for n in range(1, size) if (words.counts == n).any()}
    out = []
    for first, n in zip(words.bounds[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= size:
            own = np.sort(grams[first : first + n - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            out.append(mix(short[n][first : first + 1] + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def register_values(smallest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 64-bit hashes, in one 16-bit register."""
    part, exponent = np.frexp((smallest >> np.uint64(11)).astype(np.float64))
    mantissa = np.maximum((part * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return ((53 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; rows of empty sets are zero."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = ((flat >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    smallest = np.full(len(sets) * BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(smallest, row * BUCKETS + bucket, mix(flat ^ np.uint64(0x5851F42D4C957F2D)))
    smallest = smallest.reshape(len(sets), BUCKETS)
    filled = smallest != np.uint64(0xFFFFFFFFFFFFFFFF)
    out = register_values(smallest)
    r, c = np.nonzero(~filled & (sizes > 0)[:, None])
    for attempt in range(1, TRIES + 1):
        if not len(r):
            break
        source = (mix((c + 1).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(BUCKETS)).astype(np.int64)
        found = filled[r, source]
        out[r[found], c[found]] = out[r[found], source[found]]
        r, c = r[~found], c[~found]
    if len(r):  # few buckets are filled: take the next filled one in turn
        turned = (c[:, None] + np.arange(BUCKETS)[None, :]) % BUCKETS
        source = turned[np.arange(len(r)), np.argmax(filled[r[:, None], turned], axis=1)]
        out[r, c] = out[r, source]
    out[sizes == 0] = 0
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: the band's registers side by side, and its number."""
    parts = regs.reshape(len(regs), -1, BAND).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(BAND):
        key = (key << np.uint64(16)) | parts[:, :, j]
    return (key | (np.arange(parts.shape[1], dtype=np.uint64) << np.uint64(16 * BAND))[None, :]).astype(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers, without chance collisions."""
    agree = (a == b).mean(axis=-1)
    return np.maximum(0, (agree - COLLISION) / (1 - COLLISION))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and which pairs can still reach the bound: by set sizes exactly, by the estimate with slack."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    bound = PERCENT / 100
    slack = SLACK * np.sqrt(bound * (1 - bound) / np.minimum(small.clip(1), BUCKETS))
    guess = estimated(a, b)
    return guess, (small * 100 >= large * PERCENT) & (guess >= bound - slack)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, the class of equal word sequences (two codes) and the registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text"), lower=True)
            sets = shingle_codes(words)
            regs = registers(sets)
            whole = np.zeros((2, len(sets) + 1), np.uint64)
            place = (np.arange(len(words.codes)) - np.repeat(words.bounds[:-1], words.counts)).astype(np.uint64)
            for side, (codes, salt) in enumerate(zip((words.codes, words.other_codes()), SEEDS)):
                terms = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes + mix(place * np.uint64(salt) + np.uint64(side + 1))))])
                whole[side, :-1] = mix(terms[words.bounds[1:]] - terms[words.bounds[:-1]] + words.counts.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(whole[0, :-1].astype(np.int64)), pa.array(whole[1, :-1].astype(np.int64)),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "class_a", "class_b", "regs"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_shingles bigint, class_a bigint, class_b bigint, regs binary")


def banded(reps: DataFrame) -> DataFrame:
    """(band, doc): every band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
                keys = band_keys(regs)
                docs = np.repeat(batch.column("doc").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(docs)], names=["band", "doc"])

    return reps.select("doc", "regs").mapInArrow(run, "band bigint, doc bigint")


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and estimate leave the bound in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ru", "rv"))
                _, keep = plausible(a, b, batch.column("nu").to_numpy(), batch.column("nv").to_numpy())
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    left = reps.select(F.col("doc").alias("u"), F.col("n_shingles").alias("nu"), F.col("regs").alias("ru"))
    right = reps.select(F.col("doc").alias("v"), F.col("n_shingles").alias("nv"), F.col("regs").alias("rv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u bigint, v bigint")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar by their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "tv"):
            u = batch.column("u").to_numpy()
            # A hub's text comes many times in a row: its set is made once.
            turns = np.concatenate([[True], u[1:] != u[:-1]])
            own = shingle_codes(Words(batch.column("tu").filter(pa.array(turns)), lower=True))
            left = [own[i] for i in np.cumsum(turns) - 1]
            right = shingle_codes(Words(batch.column("tv"), lower=True))
            keep = []
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(similar(shared, len(a), len(b)) and (
                    min(len(a), len(b)) >= SURE or same_words(batch.column("tu")[i].as_py(), batch.column("tv")[i].as_py())))
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    left = texts.select(F.col("doc").alias("u"), F.col("text").alias("tu"), F.col("code").alias("cu"))
    right = texts.select(F.col("doc").alias("v"), F.col("text").alias("tv"), F.col("code").alias("cv"))
    both = pairs.join(left, "u").join(right, "v").filter("cu <> cv or u <> v")
    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint").distinct()


SURE = 8


def similar(shared: int, a: int, b: int) -> bool:
    return shared > 0 and 100 * shared >= PERCENT * (a + b - shared)


def same_words(a: str, b: str) -> bool:
    """Similarity by the words themselves. Few codes could agree by chance; from ``SURE`` shingles on, six would have to."""
    sets = []
    for text in (a, b):
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, min(len(words), 1)))})
    return similar(len(sets[0] & sets[1]), len(sets[0]), len(sets[1]))


class Unions:
    """Union-find over the components that meet in one group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def in_chunks(rows: DataFrame, group: str, size: str, scratch: Scratch) -> DataFrame:
    """Rows with their chunk: ``pieces`` chunks in the group, ``own`` of them from ``begin`` on for the row's component.

    A component with more than a chunk of a group has chunks of its own (else ``own`` is 0); the others share chunks.
    """
    n = F.col("n")
    parts = rows.filter(F.col(size) > GROUP_ROWS).groupBy(group, "component").agg(F.count("*").alias("n"))
    parts = scratch.write(parts.withColumn("own", F.when(n > GROUP_ROWS, F.ceil(n / GROUP_ROWS)).otherwise(0)), "parts")
    if parts.isEmpty():
        return rows.withColumns({c: F.lit(x) for c, x in (("pieces", 1), ("own", 0), ("begin", 0), ("chunk", 0))}).drop(size)
    shared = F.ceil(F.sum(F.when(F.col("own") == 0, n).otherwise(0)) / GROUP_ROWS)
    groups = parts.groupBy(group).agg(shared.alias("shared"), (shared + F.sum("own")).alias("pieces"))
    before = Window.partitionBy(group).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = parts.filter("own > 0").select(group, "component", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
    groups, large = scratch.write(groups, "chunk-groups"), scratch.write(large, "chunk-components")
    rows = rows.join(groups, group, "left").join(large, [group, "component"], "left").na.fill(0, ["shared", "own", "first"])
    rows = rows.withColumns({"pieces": F.coalesce("pieces", F.lit(1)), "begin": F.when(F.col("own") > 0, F.col("shared") + F.col("first")).otherwise(0)})
    among = F.when(F.col("own") > 0, F.col("own")).otherwise(F.greatest(F.lit(1), "shared"))
    chunk = F.col("begin") + F.pmod(F.xxhash64("doc"), among)
    return rows.withColumns({c: x.cast("int") for c, x in (
        ("chunk", chunk), ("pieces", F.col("pieces")), ("own", F.col("own")), ("begin", F.col("begin")))}).drop(size, "shared", "first")


def paired(rows: DataFrame) -> DataFrame:
    """Rows of ``in_chunks`` with chunk_a and chunk_b: two chunks of a group meet once, in a task of bounded size.

    Chunks of one component do not meet, as a pair inside a component needs no check.
    """
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    rows = rows.withColumn("other", F.explode(F.filter(every, lambda o: (o < F.col("begin")) | (o >= F.col("begin") + F.col("own")))))
    return rows.withColumns({"chunk_a": F.least("chunk", "other"), "chunk_b": F.greatest("chunk", "other")}).drop(
        "other", "pieces", "own", "begin")


def outsiders(component: np.ndarray, chunk: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows outside the largest component, each with the rows of other components (and of the other chunk)."""
    kinds, sizes = np.unique(component, return_counts=True)
    for i in np.flatnonzero(component != kinds[np.argmax(sizes)]):
        other = component != component[i]
        yield i, np.flatnonzero(other if same else other & (chunk != chunk[i]))


def tied_by_estimate(members: DataFrame) -> DataFrame:
    """(u, v): components that a plausible pair of one band ties together, as few pairs as span them.

    ``members`` has band, chunk_a, chunk_b, chunk, doc, component, n_shingles, regs.
    """

    def run(group: pa.Table) -> pa.Table:
        component, n, chunk = (group.column(c).to_numpy() for c in ("component", "n_shingles", "chunk"))
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        known, out = Unions(), []
        for i, at in outsiders(component, chunk, group["chunk_a"][0].as_py() == group["chunk_b"][0].as_py()):
            _, keep = plausible(regs[at], regs[i][None, :], n[at], n[i])
            own = int(component[i])
            out += [(own, x) for x in np.unique(component[at[keep]]).tolist() if known.join(own, x)]
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return members.groupBy("band", "chunk_a", "chunk_b").applyInArrow(run, "u bigint, v bigint").distinct()


def tied_exactly(members: DataFrame) -> DataFrame:
    """(u, v): links between documents of different components of a family, as few as span them.

    ``members`` has family, chunk_a, chunk_b, chunk, doc, component, text. Sets are counted against each other through
    the lists of documents that hold a shingle, so every pair is decided on its full sets.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        doc, component, chunk = (group.column(c).to_numpy() for c in ("doc", "component", "chunk"))
        texts = group.column("text")
        sets = shingle_codes(Words(texts, lower=True))
        n = np.array([len(s) for s in sets])
        edge = np.concatenate([[0], np.cumsum(n)])
        inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
        holders = np.repeat(np.arange(len(sets)), n)[np.argsort(inverse, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(inverse))])
        known, out = Unions(), []
        for i, at in outsiders(component, chunk, group["chunk_a"][0].as_py() == group["chunk_b"][0].as_py()):
            own = inverse[edge[i] : edge[i + 1]]
            size = begin[own + 1] - begin[own]
            rows = holders[np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            shared = np.bincount(rows, minlength=len(sets))[at]
            linked = at[(shared > 0) & (100 * shared >= PERCENT * (n[at] + n[i] - shared))]
            if n[i] < 2 * SURE:  # only then can the smaller set of a link be short
                linked = np.array([j for j in linked.tolist() if min(n[i], n[j]) >= SURE or same_words(texts[i].as_py(), texts[j].as_py())], int)
            out += [(int(doc[i]), int(doc[j])) for j in linked.tolist() if known.join(int(component[i]), int(component[j]))]
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return members.groupBy("family", "chunk_a", "chunk_b").applyInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Words are lower-cased (A to Z) runs of other than ASCII white space; a set holds the distinct five-word
    shingles. Documents are linked from 75 % similarity on, and a component is named by its smallest doc_id; the
    document of that id is kept. Null and empty texts are linked with nothing. Rows that share an id are one node.
    Rows with a null id are linked with nothing, have a null component and are kept. Equal texts are represented
    by the smallest id among them. An empty table gives an empty result.

    First every member of a band is checked against the band's smallest document. Where a band still spans several
    components, those that the estimate leaves in reach form a family, and a family's sets are compared in full, in
    chunks of bounded size. No pair inside a component needs a check, and a task returns only links that span.
    """
    rows = scratch.write(sketches(docs, id_col, text_col), "sketches")
    named = rows.filter(F.col("doc_id").isNotNull())
    least = named.filter("n_shingles > 0").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"))
    joined = named.join(least, ["class_a", "class_b"], "left").withColumn(
        "rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    own = F.when(F.col("doc_id") == F.col("rep"), F.col("regs"))
    members = scratch.write(joined.select("doc_id", "n_shingles", "rep", own.alias("regs")), "members")
    reps = members.filter(F.col("regs").isNotNull() & (F.col("n_shingles") > 0)).select(
        F.col("rep").alias("doc"), "n_shingles", "regs"
    ).distinct()
    reps = scratch.write(reps, "representatives")

    bands = scratch.write(banded(reps), "bands")
    pivots = bands.groupBy("band").agg(F.min("doc").alias("pivot"), F.count("*").alias("band_size")).filter("band_size > 1")
    shared = scratch.write(bands.join(pivots, "band"), "shared-bands")
    scratch.drop(bands)

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    wanted = shared.select("doc").distinct()
    texts = source.join(wanted, "doc").withColumn("code", F.xxhash64("text")).dropDuplicates(["doc", "code"])
    texts = scratch.write(texts, "texts")

    star = shared.filter("doc <> pivot").select(F.col("pivot").alias("u"), F.col("doc").alias("v")).distinct()
    tried = scratch.write(likely(star, reps), "star-pairs")
    links = scratch.write(confirmed(tried, texts), "star-links", SMALL)
    # An id with several texts ties their classes together.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    tied = members.filter("doc_id <> rep").join(several, "doc_id", "left_semi").select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v")
    )
    links = scratch.write(links.unionByName(tied.distinct()), "links")
    labels = components(links, scratch)

    # A band of two is settled by its one pair; so is every pair with the band's pivot. Components that may still be
    # linked form families, whose sets are compared in full.
    open_ = shared.filter("band_size > 2 and doc <> pivot").select("band", "doc", "band_size")
    open_ = open_.join(labels, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = scratch.write(open_.drop("node"), "open-bands")
    torn = open_.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    rest = in_chunks(open_.join(torn.select("band"), "band", "left_semi"), "band", "band_size", scratch)
    near = scratch.write(tied_by_estimate(paired(rest.join(reps, "doc"))), "near-components")
    families = components(near, scratch).select(F.col("node").alias("component"), F.col("component").alias("family"))
    alone = families.select(F.col("component").alias("doc"), "component").join(
        labels.select(F.col("node").alias("doc")), "doc", "left_anti")
    placed = labels.select(F.col("node").alias("doc"), "component").unionByName(alone)
    kin = scratch.write(placed.join(families, "component"), "families")
    sizes = kin.groupBy("family").agg(F.count("*").alias("family_size"))
    kin = paired(in_chunks(kin.join(sizes, "family"), "family", "family_size", scratch)).join(texts.select("doc", "text"), "doc")
    found = scratch.write(tied_exactly(kin), "family-links", SMALL)
    links = scratch.write(links.unionByName(found), "links")
    labels = components(links, scratch)

    result = members.join(labels, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    result = result.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    unnamed = rows.filter(F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    result = scratch.write(result.unionByName(unnamed), "near-duplicates")
    scratch.close(result)
    return result


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns; rows with a null id stay.

    Where several rows share the id that is kept, the first by text and hash of the row stays.
    """
    found = near_duplicates(docs, scratch, id_col, text_col).filter(F.col("kept") & F.col("doc_id").isNotNull())
    counted = scratch.write(found.groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    one = docs.join(counted.filter("n = 1").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    several = docs.join(counted.filter("n > 1").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(text_col).cast("string"), F.xxhash64(F.to_json(row, {"ignoreNullFields": "false"})))
    first = several.groupBy(id_col).agg(F.min_by(row, order).alias("first")).select("first.*")
    return one.unionByName(first).unionByName(docs.filter(F.col(id_col).isNull()))
