"""Words whose polynomial codes would cancel, alone and in windows, against brute force."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import brute  # noqa: E402
from conftest import spark  # noqa: E402, F401

from panelkite.llm import minhash, substring, textcodes  # noqa: E402
from panelkite.llm.tables import Scratch  # noqa: E402


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def rows_of_patterns():
    rng = random.Random(8)
    prose = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    rows = []
    for n in (16, 64, 512, 1024, 2048, 4096):
        before, after = prose(14), prose(14)
        for flip in (0, 1):
            word = thue_morse(n, flip)
            rows += [word, f"{word} {word[:5]}", f"{before[:40]} {word} {after}", " ".join(thue_morse(n, flip)), f"{before} {word} {after} {word}"]
    return list(enumerate(rows))


def test_codes_are_those_of_the_bytes():
    words = [thue_morse(n, f) for n in (1, 7, 8, 9, 64, 512, 1024, 1025, 4096, 70_000) for f in (0, 1)] + ["é", "a" * 8, "a" * 9, "a\0", "a\0\0"]
    text = pa.array([" ".join(words), None, "x " + " ".join(reversed(words))])
    made = textcodes.Words(text)
    assert len(set(made.codes.tolist())) == len(set(words)) + 1
    first, second = made.codes[: len(words)], made.codes[len(words) + 1 :]
    assert (first == second[::-1]).all() and (made.other_codes() != made.codes).all()
    many = textcodes.Words(pa.array([" ".join(map(str, range(200_000)))]))
    assert len(np.unique(many.codes)) == 200_000


def test_patterned_words_stay_apart(spark):  # noqa: F811
    rows = rows_of_patterns()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring.remove_repeats(docs, Scratch(spark)).collect()
    assert sorted(map(tuple, out)) == sorted(brute.repeats_removed(rows))
    found = minhash.near_duplicates(docs, Scratch(spark)).collect()
    want = brute.near_components(rows)
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {d: len(brute.shingles(t)) for d, t in rows}
