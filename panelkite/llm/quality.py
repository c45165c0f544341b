"""Quality rules in a short-circuit cascade, by DataFrame functions only.

A sample tells what each rule costs and how much it rejects. Rules then run in order of rejection per cost, and a
row that one rule rejects is not looked at by the later ones. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkite.llm.tables import without

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SAMPLE_ROWS = 400  # rows that costs and rejections are estimated on
MIN_WORDS = 50
OWN = (
    "q_words", "q_word_chars", "q_symbols", "q_lines", "q_dup_lines", "q_repeat_words", "base_failed", "kept",
    "q_list", "q_line_list", "q_windows", "q_sorted", "q_places",
)
MOST_REPEATED = 50  # percent


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns with q_words, q_word_chars, q_symbols, q_lines, q_dup_lines and q_repeat_words (longs).

    Null counts as the empty text. ``q_repeat_words`` counts the words inside three-word windows that occur at
    least twice in the text: windows are compared by 64-bit hash, positions are sorted only where one repeats.
    """
    docs = without(docs, *OWN)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    parts = docs.withColumns({"q_list": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "q_line_list": lines})
    n = F.greatest(F.size("q_list") - 2, F.lit(0))
    triples = F.arrays_zip(*[F.slice("q_list", F.lit(k), n) for k in (1, 2, 3)])
    parts = parts.withColumns({
        "q_words": size("q_list"),
        "q_word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "q_symbols": less(SYMBOLS).cast("long"),
        "q_lines": size("q_line_list"),
        "q_dup_lines": size("q_line_list") - size(F.array_distinct("q_line_list")),
        "q_windows": F.transform(triples, lambda t: F.xxhash64(t)),
    })
    windows = F.col("q_windows")
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    parts = parts.withColumn("q_sorted", F.when(repeats, F.sort_array(placed)))
    ordered = F.col("q_sorted")
    # Equal windows stand side by side; keep the places of those with an equal neighbour.
    twin = lambda x, j: (
        F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))
    )
    found = F.filter(F.transform(ordered, lambda x, j: F.when(twin(x, j), x["i"])), lambda i: i.isNotNull())
    parts = parts.withColumn("q_places", F.when(F.size(ordered) > 0, F.sort_array(found)))
    places = F.col("q_places")
    gains = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
    covered = F.aggregate(gains, F.lit(0), lambda a, b: a + b)
    return parts.withColumn("q_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "q_list", "q_line_list", "q_windows", "q_sorted", "q_places"
    )


@dataclass(frozen=True)
class Rule:
    """A name and a condition that is true for rows to reject; null counts as false."""

    name: str
    rejects: Column


def base_failed() -> Column:
    return (F.col("q_words") < MIN_WORDS) | (F.col("q_repeat_words") * 100 > F.col("q_words") * MOST_REPEATED)


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules on the metrics and on the raw text; none speaks against ordinary prose of any length or language."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [
        Rule("few_words", F.col("q_words") < MIN_WORDS),
        Rule("repeated_words", F.col("q_repeat_words") * 100 > F.col("q_words") * MOST_REPEATED),
        Rule("short_words", F.col("q_word_chars") < F.col("q_words") * 2),
        Rule("symbols", F.col("q_symbols") * 10 > F.col("q_words") * 3),
        Rule("repeated_lines", F.col("q_dup_lines") * 2 > F.col("q_lines")),
        Rule("no_letters", ~text.rlike("\\p{L}")),
        Rule("markup", (F.length(text) - F.length(F.translate(text, "{}[]\\", ""))) * 10 > F.length(text)),
    ]


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Measured seconds and share of rejected rows of each rule, over at most ``rows`` rows."""
    spark = docs.sparkSession
    sample = spark.createDataFrame(docs.take(rows), docs.schema).coalesce(1)
    out = []
    for rule in rules:
        share = sample.agg(F.avg(F.coalesce(rule.rejects, F.lit(False)).cast("double")))
        start = time.perf_counter()
        rejected = share.first()[0]
        out.append(Estimate(rule.name, time.perf_counter() - start, rejected or 0.0))
    return out


def ordered_rules(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """Most rejection per cost first; ties keep the given order."""
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: Sequence[Rule]) -> Column:
    """Whether a row passes all rules, asked one after the other until one rejects."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns with the metrics, ``base_failed`` and ``kept``.

    ``kept`` is false if the base rules fail, else the verdict of the cascade. Null and empty texts fail the base
    rules. Repeated rows are each judged; an empty table gives an empty result.
    """
    rules = default_rules(text_col) if rules is None else list(rules)
    measured = with_metrics(docs, text_col)
    order = ordered_rules(rules, estimate(measured, rules, rows)) if len(rules) > 1 else rules
    return measured.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & cascade(order)})
