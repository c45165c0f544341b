"""Line dedup against brute force, with lines that fill several ranges."""

from __future__ import annotations

import hashlib
import os
import sys
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from conftest import spark  # noqa: E402, F401
from test_llm_operators import DDL, ROWS  # noqa: E402

from panelkite.llm import linededup, queries  # noqa: E402
from panelkite.llm.tables import Scratch  # noqa: E402

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, keep_first=False):
    """``doc, n_lines, n_dropped, text`` per row; a document is an (id, text)."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add((doc, text))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [bool(key_of(x)) and len(holders[key_of(x)]) >= min_docs for x in lines]
        if keep_first:
            firsts = {k: min((d is not None, d or 0) for d, _ in h) for k, h in holders.items()}
            seen = set()
            for i, x in enumerate(lines):
                k = key_of(x)
                if gone[i] and k not in seen and firsts[k] == (doc is not None, doc or 0):
                    gone[i] = False
                seen.add(k)
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def rows_of_lines():
    rows = [(i, f"Common footer \nown {i}\n\tCOMMON FOOTER\n{'pair ' + str(i // 2)}") for i in range(400)]
    rows += [(400 + i, "É\né\nË") for i in range(10)]  # only A-Z are folded
    rows += [(410 + i, "ten lines" if i < 10 else "nine") for i in range(19)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "x\n" * 5000 + "common footer"), (504, " \t\n\x0b\x0c\r ")]
    rows += [(505, "common footer"), (505, "common footer"), (505, "other text of one id\ncommon footer")]
    rows += [(None, f"no id {i % 3}\nten lines") for i in range(12)]
    return rows


def ordered(rows):
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in rows)


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_line_dedup(spark, min_docs):  # noqa: F811
    rows = rows_of_lines()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, n_dropped string").repartition(7)
    bitmaps = linededup.keep_bitmaps(docs, Scratch(spark), min_docs=min_docs)
    out = linededup.apply_keep(docs, bitmaps).collect()
    assert ordered(out) == ordered(brute(rows, min_docs))
    kept = {r.id: linededup.unpack(r.bitmap, r.n_lines).tolist() for r in bitmaps.filter("id < 400").collect()}
    if min_docs == 10:
        assert len(kept) == 400 and all(v == [False, True, False, True] for v in kept.values())


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_first_occurrence_stays(spark, min_docs):  # noqa: F811
    rows = [r for r in dict.fromkeys(rows_of_lines()) if r[0] not in (None, 505)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bitmaps = linededup.keep_bitmaps(docs, Scratch(spark), min_docs=min_docs, keep_first=True)
    assert ordered(linededup.apply_keep(docs, bitmaps).collect()) == ordered(brute(rows, min_docs, True))


def test_a_line_of_all_documents_spreads_over_ranges(spark):  # noqa: F811
    docs = spark.range(4000).selectExpr("id AS doc_id", "'every document' AS text")
    scratch = Scratch(spark)
    lines = linededup.shared_lines(docs, scratch)
    assert lines.count() == 4000
    events = [df for df, path in scratch.paths.values() if "line-events" in path][0]
    per_range = [r["count"] for r in events.filter(f"kind = {linededup.GONE}").groupBy("part").count().collect()]
    assert len(per_range) > 1 and max(per_range) < 3000


def test_line_dedup_of_awkward_tables(spark, tmp_path):  # noqa: F811
    docs = spark.createDataFrame(ROWS, DDL)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op11_line_dedup(spark, str(tmp_path)).collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute([(r[0], r[1]) for r in ROWS], 10)]
    assert ordered(out) == ordered(want)
    empty = docs.limit(0)
    assert linededup.apply_keep(empty, linededup.keep_bitmaps(empty, Scratch(spark))).count() == 0
