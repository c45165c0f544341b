"""Spelling variants: words of a corpus one edit apart, found by dynamic programming over sorted lists.

The vocabulary is dealt into lists. Two words one edit apart agree before the edit and after it, so a word is listed
under what lies outside a region that may hold the edit: words of equal length, and the next longer ones, that agree there
meet in one list. A list too long for a task is dealt again with its region halved, down to one place, where an alphabet
bounds it; no pair is lost, as its edit lies in one of the halves.

Within a list the middles are sorted, and each word scans the list with a banded edit matrix of three cells a row. A row
belongs to a prefix, so rows are reused up to the common prefix of neighbours; where all cells of a row exceed one edit,
every word with that prefix is skipped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkite.llm.tables import Scratch, shuffle_parts

# Fixed values of the contract: letters after lower-casing A-Z, shortest word, and the rate of deleted code points.
RUN, MIN_LENGTH, RATE = "[a-zÀ-ÿ]{5,}", 5, 97
LIST_WORDS, HELD_WORDS = 100, 200_000
FAR = 2
LAST = chr(0x10FFFF)


def runs_of(text: str | None) -> list[str]:
    """Maximal letter runs of at least five letters, A-Z lower-cased; shorter ones are never words."""
    return re.findall(RUN, (text or "").encode().lower().decode())


def damaged(doc, run: str, rate: int = RATE) -> str:
    """The run, without one code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(rate: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        total: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for run, n in Counter(runs_of(text)).items():
                    total[damaged(doc, run, rate)] += n
                if len(total) > HELD_WORDS:
                    yield flushed()
        yield flushed()

    return kernel


def vocabulary(
    docs: DataFrame, min_count: int = 3, rate: int = RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n``: words of at least five code points and ``min_count`` occurrences over whole texts.

    Null and empty texts have none; every row counts, repeated ones too; a null id reads as no characters.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = texts.mapInArrow(_counted(rate), "word string, n long").filter(F.char_length("word") >= MIN_LENGTH)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _listed(rows: DataFrame) -> DataFrame:
    """Key columns and middle of each (word, m, i, j): the region [i, j) of words of m and m + 1 code points, and the rest."""
    longer = (F.char_length("word") - F.col("m")).cast("int")
    after = F.col("j") + longer
    return rows.select(
        "m", "i", "j", F.expr("substring(word, 1, i)").alias("head"),
        F.substring("word", after + 1, F.char_length("word")).alias("tail"),
        F.substring("word", F.col("i") + 1, after - F.col("i")).alias("middle"))


KEY = ["m", "i", "j", "head", "tail"]


def _regions(words: DataFrame) -> DataFrame:
    """Every word as one of its length and as one longer than the words before, with the edit in either half."""
    sizes = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    halves = lambda m: F.array(F.struct(F.lit(0).alias("i"), F.floor(m / 2).cast("int").alias("j")),
                               F.struct(F.floor(m / 2).cast("int").alias("i"), (m + 1).alias("j")))
    sized = words.select("word", sizes.alias("m")).filter(F.col("m") >= MIN_LENGTH)
    return sized.select("word", "m", F.inline(halves(F.col("m"))))


def _lists(words: DataFrame, scratch: Scratch, list_words: int) -> DataFrame:
    """All lists that can hold a pair, none longer than ``list_words`` but those whose region is one place."""
    open_, done = scratch.write(_listed(_regions(words)), "open-lists"), []
    while True:
        counts = scratch.write(open_.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1"), "list-sizes")
        is_long = (F.col("n") > list_words) & (F.col("j") - F.col("i") > 1)
        done.append(scratch.write(open_.join(counts.filter(~is_long).select(*KEY), KEY, "left_semi"), "lists"))
        hot = counts.filter(is_long).select(*KEY)
        if hot.isEmpty():
            break
        middle = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
        halves = F.array(F.struct(F.col("i"), middle.alias("j")), F.struct(middle.alias("i"), F.col("j")))
        again = open_.join(hot, KEY, "left_semi").select(F.concat("head", "middle", "tail").alias("word"), "m", F.inline(halves))
        last, open_ = open_, scratch.write(_listed(again), "open-lists")
        scratch.drop(last, counts)
    scratch.drop(open_, counts)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _next_row(row: tuple[int, int, int], d: int, ch: str, q: str) -> tuple[int, int, int]:
    """Cells d, d + 1, d + 2 of the row one deeper, from cells d - 1, d, d + 1 of the row at depth d."""
    n = len(q)
    a = min(row[1] + 1, row[0] + (q[d - 1] != ch)) if 0 < d <= n else (row[1] + 1 if d <= n else FAR)
    b = min(row[2] + 1, row[1] + (q[d] != ch), a + 1) if d < n else FAR
    c = min(row[2] + (q[d + 1] != ch), b + 1) if d + 1 < n else FAR
    return (a if a < FAR else FAR, b if b < FAR else FAR, c if c < FAR else FAR)


def prefixes(words: list[str]) -> list[int]:
    """Length of the common prefix of each word with the one before."""
    out = [0]
    for a, b in zip(words, words[1:]):
        k, end = 0, min(len(a), len(b))
        while k < end and a[k] == b[k]:
            k += 1
        out.append(k)
    return out


def near(q: str, words: list[str], lcp: list[int]) -> list[int]:
    """Places of the sorted words exactly one edit from ``q``."""
    out, rows, k, depth = [], [(FAR, 0, 1 if q else FAR)], 0, 0
    while k < len(words):
        word = words[k]
        end = len(word)
        while depth < end:
            row = _next_row(rows[depth], depth, word[depth], q)
            depth += 1
            del rows[depth:]
            rows.append(row)
            if row == (FAR, FAR, FAR):
                break
        if rows[depth] == (FAR, FAR, FAR):
            k = bisect_left(words, word[:depth] + LAST, k + 1)
        else:
            place = len(q) - end + 1
            if 0 <= place <= 2 and rows[end][place] == 1:
                out.append(k)
            k += 1
        if k < len(words):
            depth = min(depth, lcp[k])
    return out


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one list after another from rows sorted by list and middle."""
    left, right = [], []

    def scanned() -> None:
        m, _, _, head, tail = key
        lcp, size = prefixes(held), m - len(head) - len(tail)
        for k, middle in enumerate(held):
            if len(middle) == size:
                for other in near(middle, held, lcp):
                    # Equal lengths meet from both sides; the longer words ask in lists of their own.
                    if other > k or len(held[other]) > len(middle):
                        left.append(head + middle + tail)
                        right.append(head + held[other] + tail)

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])
        left.clear()
        right.clear()
        return made

    key, held = None, []
    for batch in batches:
        for *here, middle in zip(*[batch.column(c).to_pylist() for c in (*KEY, "middle")]):
            if here != key:
                if len(held) > 1:
                    scanned()
                if len(left) > 50_000:
                    yield flushed()
                key, held = here, []
            held.append(middle)
    if len(held) > 1:
        scanned()
    yield flushed()


def near_pairs(words: DataFrame, scratch: Scratch, list_words: int = LIST_WORDS) -> DataFrame:
    """``a, b``: every pair of ``word`` exactly one inserted, deleted or replaced code point apart, once."""
    dealt = _lists(words, scratch, list_words).repartition(shuffle_parts(words.sparkSession), *KEY).sortWithinPartitions(*KEY, "middle")
    return dealt.mapInArrow(_paired, "a string, b string").distinct()


def _followed(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root``: forms followed to the last; each round doubles the way, and counts double at every step."""
    ways = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.write(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                      F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(ways)
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        ways = after.drop("moved")


def variants(words: DataFrame, scratch: Scratch, list_words: int = LIST_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``words`` (word, n).

    The form is the most frequent near word (ties: the smallest), if at least twice as frequent; the root is the last of
    the forms that follow. An empty vocabulary gives an empty table.
    """
    words = scratch.write(words.select("word", "n"), "vocabulary")
    pairs = scratch.write(near_pairs(words, scratch, list_words), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("other")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other")).alias("minus"), F.col("b"))).alias("best"))
    is_form = -F.col("best.minus") >= 2 * F.col("n")
    found = scratch.write(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    roots = _followed(found.filter("form IS NOT NULL"), scratch)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
