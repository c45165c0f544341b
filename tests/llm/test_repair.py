"""Conversation repair against a plain dynamic program over whole conversations, with chunks of a few rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from conftest import spark  # noqa: E402, F401

from panelkite.llm import queries, repair  # noqa: E402
from panelkite.llm.tables import Scratch  # noqa: E402

DDL = "conv_id long, turn long, role string, text string, place string, audit string, c string"
LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        for _ in range(2 if code == 3 else 1):
            yield conv, turn, "user" if code == 4 else role, text


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
        turns = {t for t, _, _ in g if t is not None}
        faults, seen = [], set()
        for _, role, text in g:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        met = [a[1][:1] + b[1][:1] for a, b in zip(g, g[1:])]

        @lru_cache(None)
        def best(i, state, inserted):
            """Least (cost, audit, lines) from row i on, given the last initial; at most two insertions in a row help."""
            ways = []
            if i == len(g) and state in ("", "a"):
                ways.append((0, "", ()))
            letter = "a" if state == "u" else "u"
            word = {"u": "user", "a": "assistant"}[letter]
            if inserted < 2:
                c, e, t = best(i, letter, inserted + 1)
                ways.append((c + 5, "I" + e, (word + ":", *t)))
            if i < len(g):
                _, role, text = g[i]
                c, e, t = best(i + 1, state, 0)
                ways.append((c + 2, "D" + e, t))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    if role[:1] == letter or (role[:1] == "s" and state == ""):
                        c, e, t = best(i + 1, role[:1], 0)
                        ways.append((c + more, "K" + e, (role + ":" + text, *t)))
                    c, e, t = best(i + 1, letter, 0)
                    ways.append((c + more + 1, "R" + e, (word + ":" + text, *t)))
            return min(ways, default=(10**9, "", ()))

        for i in range(len(g), -1, -50):  # keeps the recursion shallow
            for state in ("", "s", "u", "a"):
                best(i, state, 0)
        cost, audit, lines = best(0, "", 0)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(m not in ("su", "ua", "au") for m in met), cost, audit, list(lines))
    return out


def repaired(spark, rows):  # noqa: F811
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DDL).repartition(3)
    made = repair.repair(table, Scratch(spark))
    lines = defaultdict(list)
    for r in made.turns.orderBy("place", "part").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.hashed(made.turns).collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    report = made.report.collect()
    assert len(report) == len({r.conv_id for r in report})
    for conv, found in hashes.items():
        assert found == hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest()
    return {r.conv_id: (*[r[n] for n in names], lines[r.conv_id]) for r in report}


def conversations(seed, n=40, longest=25):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        style = rng.choice(["fine", "any", "open", "blank", "one"])
        for turn in range(rng.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if style == "fine" and rng.random() < 0.9 else rng.choice(
                ["user", "assistant", "system", "tool", "", None, "User"] if style == "any" else ["user", "assistant"])
            text = {"open": "no end", "blank": " \n"}.get(style, "Said.") + str(rng.randint(0, 30)) + rng.choice([".", "?", "! \n", ""])
            text = rng.choice(["", " \t", None]) if style == "blank" and rng.random() < 0.95 else text
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, text))
    return rows + [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (None, None, None, None)]


@pytest.mark.parametrize("block", [1, 2, 4, 8192])
def test_repair(spark, monkeypatch, block):  # noqa: F811
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rows = conversations(block)
    got, want = repaired(spark, rows), brute(rows)
    assert got == want
    for *_, lines in got.values():
        assert LEGAL.fullmatch("".join(x[0] for x in lines))


def test_long_conversation_over_many_chunks(spark, monkeypatch):  # noqa: F811
    """Also one whose rows keep every difference of costs, so that no chunk converges."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", 16)
    rng = random.Random(4)
    rows = [(0, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(401)]
    rows += [(1, i, "assistant", f"open {i}" + "." * (i > 395)) for i in range(400)]
    rows += [(2, i, "user", " ") for i in range(300)] + [(2, 300, "assistant", "end.")]
    rows += [(3, i, rng.choice(["user", "assistant", "system"]), f"say {rng.randint(0, 150)}" + rng.choice([".", "", "?"])) for i in range(400)]
    rows += [(4, 7, "user", "same.")] * 300
    rows += [(5, i // 3, rng.choice(["user", "assistant"]), "x" * 50_000 + ".") for i in range(6)]
    assert repaired(spark, rows) == brute(rows)


def test_vectors_of_a_chunk():
    """The exact step of a chunk equals a run from any costs, and converged runs differ by a constant."""
    rng = random.Random(2)
    steps, converged = repair.Steps(), 0
    for _ in range(400):
        symbols = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(1, 30)))
        start = repair._inserted([rng.randint(0, 9) for _ in range(4)])
        matrix = [c for unit in repair.units() for c in repair.run(steps, symbols, unit)]
        true = repair.run(steps, symbols, start)
        assert repair.product(matrix, start) == true
        old = repair.run(steps, symbols, repair.END)
        again, same = repair.rerun(steps, symbols, repair.END, old, start)
        assert again == true
        if same:
            converged += 1
            assert len({a - b for a, b in zip(true, old)}) == 1
    assert converged > 200


def test_repair_query(spark, tmp_path):  # noqa: F811
    rows = conversations(9, 60, 12) + [(900 + i, t, "user", "gone?") for i, t in enumerate(range(30))]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DDL)
    table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(out) == {r[0] for r in rows}
    want = brute(damaged(rows))
    assert len(want) < len(out)
    for conv, r in out.items():
        *counts, audit, lines = want.get(conv, (0, 0, 0, 0, 0, 0, "", []))
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [*counts, audit]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    made = repair.repair(table.limit(0), Scratch(spark))
    assert made.report.count() == made.turns.count() == repair.hashed(made.turns).count() == 0
