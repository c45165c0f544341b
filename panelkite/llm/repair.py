"""Cheapest repair of conversations to ``(s?(ua)+)?``, by a Viterbi pass that runs in parallel along a conversation.

Rows are put in order by one range shuffle and numbered; consecutive rows form blocks of bounded length, so a
conversation of any size is spread over many tasks. A chunk is a conversation's part of a block, held as one byte a row.

The backward pass keeps, per row, the cheapest cost to the end from each of four states (nothing, after s, after u, after
a). Each chunk starts from a speculative vector, that of the conversation's end. Vectors that differ only by a constant lead
to the same edits, so a chunk is right as soon as the vector it started from and the true one of the chunk after it differ
by a constant only; else a fix-up pass runs it again from the true vector, until the new and the old vectors differ by a
constant, which then holds for all rows before. A chunk in which they never do (its edits keep every difference, as in long
runs of rows that must go) is run from each state alone; these four vectors are its exact step, so it needs no further
pass. The stitched costs then drive the tracing: chunks are traced from all four states, the true start states are
composed, and each chunk yields the least string of edits.

Order of rows: turn (nulls first), then role, then a hash of the text; rows equal in all are interchangeable. A null role or
text counts as one space; an empty role has no initial and is never kept. A null conversation id is a conversation of its
own. Very long texts are read whole, an empty table gives empty tables, and further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite.llm.tables import Scratch, shuffle_parts

VISIBLE, FINISHED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
# What edits cost. A row of a fault that requires deletion has no other choice.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK_ROWS = 1 << 13
# States and the letter that leads on from each; only the first may be followed by s.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT_LETTER, NEXT_STATE = "uuau", (USER, USER, ASSISTANT, USER)
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
MUST_GO = 8

Vector = tuple[int, int, int, int]


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept row of initial s, u, a (0, 1, 2) or another (3)."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    return NEXT_STATE[state] if initial < 3 and "sua"[initial] == NEXT_LETTER[state] else None


def level(v: Vector) -> tuple[Vector, int]:
    """The vector less its least cost, and that cost."""
    least = min(v)
    return (v[0] - least, v[1] - least, v[2] - least, v[3] - least), least


class Steps:
    """One row backward, remembered: levelled vectors form a small set, so a pass is a walk over a table."""

    def __init__(self):
        self.made: dict[tuple[Vector, int], tuple[Vector, int, list]] = {}

    def __call__(self, after: Vector, symbol: int) -> tuple[Vector, int, list]:
        """``after`` is levelled. Gives the levelled vector before the row, its least cost, and per state the least edits
        of the row (with insertions before it), the state they lead to, and what they leave (see ``Trace``)."""
        found = self.made.get((after, symbol))
        if found is None:
            found = self.made[after, symbol] = self._make(after, symbol)
        return found

    def _make(self, after: Vector, symbol: int):
        options = []
        for state in range(4):
            ways = [(DELETE + after[state], "D", state, "")]
            if symbol != MUST_GO:
                fault, kept = TRUNCATED * (symbol >= 4), _kept(state, symbol % 4)
                if kept is not None:
                    ways.append((fault + after[kept], "K", kept, "="))
                letter, onward = NEXT_LETTER[state], NEXT_STATE[state]
                ways.append((REROLE + fault + after[onward], "R", onward, letter))
            options.append(ways)
        raw = _inserted([min(w[0] for w in ways) for ways in options])
        edits = []
        for state in range(4):
            here, text, left = state, "", ""
            while True:
                best = [w[1:] for w in options[here] if w[0] == raw[here]]
                can_insert = INSERT + raw[NEXT_STATE[here]] == raw[here]
                if best and (best[0][0] == "D" or not can_insert):
                    edits.append((text + best[0][0], best[0][1], left + best[0][2]))
                    break
                text, left, here = text + "I", left + NEXT_LETTER[here].upper(), NEXT_STATE[here]
        before, least = level(raw)
        return before, least, edits


def _inserted(costs: list[int]) -> Vector:
    """Costs where messages may be inserted first; two insertions lead from u to u, so one round settles it."""
    u = min(costs[USER], INSERT + costs[ASSISTANT])
    a = min(costs[ASSISTANT], INSERT + u)
    return min(costs[NOTHING], INSERT + u), min(costs[SYSTEM], INSERT + u), u, a


def run(steps: Steps, symbols: bytes, after: Vector) -> Vector:
    """The costs before a chunk, given the costs after it."""
    here, cost = level(after)
    for symbol in reversed(symbols):
        here, least, _ = steps(here, symbol)
        cost += least
    return tuple(c + cost for c in here)


def rerun(steps: Steps, symbols: bytes, old: Vector, old_before: Vector, new: Vector) -> tuple[Vector, bool]:
    """The costs before a chunk from another start, and whether they came to differ from the old ones by a constant."""
    (a, paid_a), (b, paid_b) = level(old), level(new)
    for symbol in reversed(symbols):
        if a == b:
            return tuple(c + paid_b - paid_a for c in old_before), True
        (a, least_a, _), (b, least_b, _) = steps(a, symbol), steps(b, symbol)
        paid_a, paid_b = paid_a + least_a, paid_b + least_b
    return tuple(c + paid_b for c in b), a == b


def units() -> list[Vector]:
    return [tuple(0 if q == state else FAR for q in range(4)) for state in range(4)]


def product(matrix: list[int], after: Vector) -> Vector:
    """Costs before a chunk from its four single-state runs: row by row the cheapest state to end in."""
    return tuple(min(matrix[4 * end + state] + after[end] for end in range(4)) for state in range(4))


def trace(steps: Steps, symbols: bytes, after: Vector, start: int) -> tuple[list[tuple[str, str]], int]:
    """Per row its edits and what they leave, and the state at the end.

    Left letters: ``=`` the row as it is, u or a the row under that role, U or A an inserted message.
    """
    here, _ = level(after)
    moves = []
    for symbol in reversed(symbols):
        here, _, edits = steps(here, symbol)
        moves.append(edits)
    out, state = [], start
    for edits in reversed(moves):
        text, state, left = edits[state]
        out.append((text, left))
    return out, state


def closing(state: int) -> str:
    """Letters inserted after the last row."""
    return {NOTHING: "", SYSTEM: "UA", USER: "A", ASSISTANT: ""}[state]


# ---------------------------------------------------------------------------------------------------------------------


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def ordered_rows(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, role, text, said, place``, written in order: places rise along each conversation.

    Equal rows are dealt by their place in the table, so any number of them spreads over the ranges.
    """
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("said", said).withColumn("nth", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "said", "nth")]
    ranged = rows.repartitionByRange(shuffle_parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    return scratch.write(ranged.drop("nth").withColumn("place", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, place, initial, fault`` per row; the fault is its first of blank, duplicate, truncated, or NULL."""
    slim = rows.select(
        "conv_id", "turn", "place", "said", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(VISIBLE)).alias("blank"), (~F.col("text").rlike(FINISHED)).alias("open"))
    # The first of equal messages is found by partial aggregates; places are unique, so the join has no hot key.
    firsts = slim.filter("NOT blank").groupBy("conv_id", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated"))
    return slim.join(firsts, "place", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault"))


def _block(place: Column) -> Column:
    return F.shiftright(place, BLOCK_ROWS.bit_length() - 1)


def _chunks(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per chunk with its symbols, the pairs that meet out of turn inside, and its speculative run."""
    initial = F.coalesce(F.nullif(F.array_position(F.lit(["s", "u", "a"]), F.col("initial")), F.lit(0)) - 1, F.lit(3))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(initial + F.when(F.col("fault").isNotNull(), 4).otherwise(0))
    rows = slim.select("conv_id", "place", _block(F.col("place")).alias("block"), "initial", symbol.cast("int").alias("symbol"))
    dealt = rows.repartition(shuffle_parts(slim.sparkSession), "block").sortWithinPartitions("block", "place")
    kind = _type(slim, "conv_id")
    names = ("conv_id", "place", "symbols", "illegal", "first", "last", "after", "before", "matrix")
    fields = (f"conv_id {kind}, place long, symbols binary, illegal long, first string, last string, "
              "after array<long>, before array<long>, matrix array<long>")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, held, made = Steps(), None, []
        id_type = pa.null()

        def closed() -> None:
            conv, _, place, symbols, illegal, first, last = held
            made.append((conv, place, bytes(symbols), illegal, first, last, list(END), list(run(steps, bytes(symbols), END)), None))

        def flushed() -> pa.RecordBatch:
            longs = pa.list_(pa.int64())
            types = (id_type, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), longs, longs, longs)
            arrays = [pa.array(c, t) for c, t in zip(zip(*made), types)]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names=list(names))

        for batch in batches:
            id_type = batch.column("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "block", "place", "initial", "symbol")]
            for conv, block, place, initial, symbol in zip(*columns):
                if held is None or held[0] != conv or held[1] != block:
                    if held is not None:
                        closed()
                    held = [conv, block, place, bytearray(), 0, initial, initial]
                else:
                    held[4] += held[6] + initial not in ("su", "ua", "au")
                held[3].append(symbol)
                held[6] = initial
            if len(made) > 5_000:
                yield flushed()
        if held is not None:
            closed()
        if made:
            yield flushed()

    return scratch.write(dealt.mapInArrow(kernel, fields), "chunks")


def _stitched(chunks: pd.DataFrame) -> tuple[list, list, bool]:
    """Costs after and before every chunk of a conversation, last to first; False if some chunk must run again.

    A chunk that must run again passes its speculative costs on, so that one pass mends as many chunks as it can.
    """
    after, before, right = [], [], True
    costs: Vector = END
    for old_after, old_before, matrix in zip(*[reversed(chunks[c].tolist()) for c in ("after", "before", "matrix")]):
        after.append(costs)
        if matrix is not None:
            costs = product(list(matrix), costs)
        else:
            (known, paid_known), (here, paid) = level(tuple(old_after)), level(costs)
            right = right and known == here
            costs = tuple(int(c) - paid_known + paid for c in old_before)
        before.append(costs)
    return after[::-1], before[::-1], right


def _settled(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Fix-up passes until every chunk has started from its true costs, but for a constant.

    A pass may turn the costs before a chunk, and so make the chunk before it run again. The third pass therefore runs all
    chunks of the conversations that are still open from single states, which ends it, whatever their number.
    """
    ids = chunks.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    rest = chunks.join(ids, F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    several = scratch.write(chunks.join(ids, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), "open-chunks")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        after, _, right = _stitched(pdf)
        return pd.DataFrame({"place": pdf["place"].to_numpy(), "wanted": [list(a) for a in after], "right": right})

    def mended(last_pass: bool):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps = Steps()
            for batch in batches:
                rows = batch.to_pylist()
                for row in rows:
                    old, old_before, new = tuple(row["after"]), tuple(row["before"]), tuple(row.pop("wanted"))
                    same = row.pop("right") or row["matrix"] is not None
                    if not same and level(old)[0] != level(new)[0]:
                        row["before"], same = rerun(steps, row["symbols"], old, old_before, new)
                        row["after"] = new
                    else:
                        same = same or not last_pass
                    if not same:
                        row["matrix"] = [c for unit in units() for c in run(steps, row["symbols"], unit)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([f for f in batch.schema if f.name not in ("wanted", "right")]))

        return kernel

    for number in count(1):
        slim = several.select("conv_id", "place", "after", "before", "matrix")
        wanted = scratch.write(slim.groupBy("conv_id").applyInPandas(stitch, "place long, wanted array<long>, right boolean"), "wanted")
        if wanted.filter("NOT right").isEmpty():
            break
        last = several
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in several.schema)
        rows = several.join(wanted.select("place", "wanted", "right"), "place").select(*several.columns, "wanted", "right")
        several = scratch.write(rows.mapInArrow(mended(number >= 3), fields), "open-chunks")
        scratch.drop(last, wanted)
    return rest.unionByName(several)


def _traced(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Per chunk its start state, the costs after it, and whether it is the first and the last of its conversation."""
    ids = f"conv_id {_type(chunks, 'conv_id')}"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            rows = zip(batch.column("symbols").to_pylist(), batch.column("wanted").to_pylist())
            made = [[trace(steps, s, tuple(w), q)[1] for q in range(4)] for s, w in rows]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(made, pa.list_(pa.int32()))], names=["place", "ends"])

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        after, before, _ = _stitched(pdf)
        out = pdf[["conv_id", "place"]].assign(wanted=[list(level(a)[0]) for a in after], cost=float("nan"), illegal=0, ending=False)
        met = [a + b not in ("su", "ua", "au") for a, b in zip(pdf["last"].tolist(), pdf["first"].tolist()[1:])]
        out["illegal"] = pdf["illegal"].to_numpy() + [0, *map(int, met)]
        out["cost"] = [before[0][NOTHING], *[0] * (len(pdf) - 1)]
        out["ending"] = [False] * (len(pdf) - 1) + [True]
        return out

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        state, starts = NOTHING, []
        for step in pdf["ends"].tolist():
            starts.append(state)
            state = int(step[state])
        return pd.DataFrame({"place": pdf["place"].to_numpy(), "start": starts})

    slim = chunks.select("conv_id", "place", "first", "last", "illegal", "after", "before", "matrix")
    sized = chunks.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    is_several = F.col("conv_id").eqNullSafe(F.col("c"))
    alone = slim.join(sized, is_several, "left_anti").select(
        "conv_id", "place", F.array(*[F.lit(c).cast("long") for c in END]).alias("wanted"), F.get("before", F.lit(NOTHING)).alias("cost"),
        "illegal", F.lit(True).alias("ending"), F.lit(NOTHING).alias("start"))
    known = scratch.write(slim.join(sized, is_several, "left_semi").groupBy("conv_id").applyInPandas(
        stitch, f"{ids}, place long, wanted array<long>, cost long, illegal long, ending boolean"), "stitched")
    states = chunks.select("place", "symbols").join(known.select("conv_id", "place", "wanted"), "place").select("conv_id", "place", "symbols", "wanted")
    ended = states.select("place", "symbols", "wanted").mapInArrow(ends, "place long, ends array<int>")
    composed = known.select("conv_id", "place").join(ended, "place").groupBy("conv_id").applyInPandas(compose, "place long, start int")
    return scratch.write(alone.unionByName(known.join(composed, "place")), "stitched")


def _edits(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """``conv_id, place, edits, left`` with arrays over the rows of a chunk; the closing insertions join the last row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            edits, left = [], []
            for symbols, wanted, start, ending in zip(*[batch.column(c).to_pylist() for c in ("symbols", "wanted", "start", "ending")]):
                rows, state = trace(steps, symbols, tuple(wanted), start)
                if ending:
                    more = closing(state)
                    rows[-1] = (rows[-1][0] + "I" * len(more), rows[-1][1] + more)
                edits.append([r[0] for r in rows])
                left.append([r[1] for r in rows])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("place"), pa.array(edits, strings), pa.array(left, strings)],
                names=["conv_id", "place", "edits", "left"])

    rows = chunks.select("conv_id", "place", "symbols").join(known.select("place", "wanted", "start", "ending"), "place")
    return rows.select("conv_id", "place", "symbols", "wanted", "start", "ending").mapInArrow(
        kernel, f"conv_id {_type(chunks, 'conv_id')}, place long, edits array<string>, left array<string>")


class Repair:
    """What a repair yields: ``report`` (a row per conversation) and ``turns`` (the repaired messages, in order).

    ``turns`` has ``conv_id, place, part, role, text``; place and part give the order. ``report`` has ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit``.
    """

    def __init__(self, report: DataFrame, turns: DataFrame):
        self.report, self.turns = report, turns


def repair(turns: DataFrame, scratch: Scratch) -> Repair:
    """Repair the conversations of ``turns`` (``conv_id, turn, role, text``).

    The audit of a conversation is one string and so lies in one row; all else of a conversation is spread over tasks.
    """
    rows = ordered_rows(turns, scratch)
    slim = scratch.write(faults(rows), "faults")
    chunks = scratch.write(_settled(_chunks(slim, scratch), scratch), "chunks")
    known = _traced(chunks, scratch)
    edits = scratch.write(_edits(chunks, known), "edits")
    counts = slim.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    costs = known.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    audits = edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.array_join("edits", "").alias("a")))).alias("a"))
    audits = audits.select("conv_id", F.array_join(F.transform("a", lambda x: x["a"]), "").alias("audit"))
    report = counts
    for part in (costs, audits):
        named = part.withColumnRenamed("conv_id", "c")
        report = report.join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    # Rows of a chunk have consecutive places.
    each = edits.select("place", F.posexplode("left").alias("at", "left")).filter(F.col("left") != "").select(
        (F.col("place") + F.col("at")).alias("place"), F.posexplode(F.split("left", "")).alias("part", "letter")).filter("letter <> ''")
    letter = F.col("letter")
    role = F.when(letter == "=", F.col("role")).when(F.lower(letter) == "u", "user").otherwise("assistant")
    text = F.when(letter.isin("U", "A"), "").otherwise(F.col("text"))
    made = rows.join(each, "place").select("conv_id", "place", "part", role.alias("role"), text.alias("text"))
    return Repair(report, made)


def hashed(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` joined by newlines.

    The hash is sequential, so one conversation's messages pass one after another through one task, in bounded memory.
    """
    kind = _type(turns, "conv_id")
    lines = turns.select("conv_id", "place", "part", F.concat_ws(":", "role", "text").alias("line"))
    dealt = lines.repartition(shuffle_parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place", "part")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, conv, done = None, None, []
        id_type = pa.null()

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in done], id_type), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
            done.clear()
            return made

        for batch in batches:
            id_type = batch.column("conv_id").type
            for here, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or here != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    digest, conv = hashlib.sha256(line.encode()), here
                else:
                    digest.update(b"\n" + line.encode())
            if len(done) > 10_000:
                yield flushed()
        if digest is not None:
            done.append((conv, digest.hexdigest()))
        if done:
            yield flushed()

    return dealt.mapInArrow(kernel, f"conv_id {kind}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Seeded damage by crc32 of ``conv_id:turn`` modulo 20 (nulls read as one space in the key, the role and the text):
    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats the row, 4 makes it the user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    role, text = named("role"), named("text")
    rows = conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), code.alias("code"))
    return rows.filter("code <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))).drop("code", "copy")
