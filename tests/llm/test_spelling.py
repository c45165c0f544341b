"""Spelling variants against brute force over all pairs, and the sorted-list scan alone."""

from __future__ import annotations

import os
import random
import re
import sys
import zlib
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from conftest import spark  # noqa: E402, F401
from test_llm_operators import DDL, ROWS  # noqa: E402

from panelkite.llm import queries, spelling  # noqa: E402
from panelkite.llm.tables import Scratch  # noqa: E402


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_vocabulary(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    forms = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = (n, len(near), best if best and words[best] >= 2 * n else None)
    out = []
    for w, (n, k, form) in forms.items():
        root = w
        while forms[root][2]:
            root = forms[root][2]
        out.append((w, n, k, form, words.get(form), root))
    return sorted(out)


def test_scan_of_sorted_lists():
    rng = random.Random(1)
    for letters in ("ab", "abcé"):
        for _ in range(300):
            words = sorted({"".join(rng.choices(letters, k=rng.randint(0, 7))) for _ in range(rng.randint(1, 60))})
            lcp = spelling.prefixes(words)
            for q in words:
                assert spelling.near(q, words, lcp) == [k for k, w in enumerate(words) if one_edit(q, w)]


def test_scan_skips_ranges(monkeypatch):
    """A prefix two edits away is left after one row, whatever the number of words below it."""
    steps = []
    step = spelling._next_row
    monkeypatch.setattr(spelling, "_next_row", lambda *a: steps.append(1) or step(*a))
    words = sorted(["abcdefgh"] + ["xyz" + format(i, "05d") for i in range(5000)])
    assert spelling.near("abcdefgh", words, spelling.prefixes(words)) == [] and len(steps) < 20


@pytest.mark.parametrize("list_words", [1, 4, 1000])
def test_variants(spark, list_words):  # noqa: F811
    """Also with words that share a long prefix or suffix, so that lists are halved down to single places."""
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 9))): rng.randint(3, 60) for _ in range(250)}
    words |= {"prefix" + "".join(rng.choices("abcd", k=3)): rng.randint(3, 9) for _ in range(40)}
    words |= {"".join(rng.choices("abcd", k=3)) + "suffix": rng.randint(3, 9) for _ in range(40)}
    words |= {"a" * k: 2**k for k in range(5, 14)} | {"long" * 600: 3, "long" * 600 + "x": 8}
    table = spark.createDataFrame([(w, n, "x", "y") for w, n in words.items()], "word string, n long, form string, m string")
    out = spelling.variants(table, Scratch(spark), list_words).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, out)) == brute_variants(words)
    assert spelling.variants(table.limit(0), Scratch(spark)).count() == 0


def test_spelling_of_awkward_tables(spark, tmp_path):  # noqa: F811
    rows = [(*r[:1], r[1], *r[2:]) for r in ROWS]
    rows += [(900 + i, t, *rows[0][2:]) for i, t in enumerate(["Recieve RECEIVE receive÷ recéive"] * 40 + ["über übér ab×cd " * 300, "b" * 30_000, "cdefg" * 9])]
    docs = spark.createDataFrame(rows, DDL)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_spelling_variants(spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    words = brute_vocabulary([(r[0], r[1]) for r in rows])
    assert sorted(map(tuple, out)) == brute_variants(words) and len(out) > 100
    assert any(r.form for r in out)
    assert spelling.vocabulary(docs.limit(0)).count() == 0
