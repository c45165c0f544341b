"""The pipeline with columns of any name, and its packed rows against the tokenizer itself."""

from __future__ import annotations

import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

from conftest import spark  # noqa: E402, F401
from test_llm_operators import ROWS  # noqa: E402

import corpus_pipeline  # noqa: E402
from panelkite.llm import langid  # noqa: E402
from panelkite.llm.tables import Scratch  # noqa: E402
from panelkite.llm.tokens import default_path  # noqa: E402

NAMES = ("score", "Lang_Pred", "redacted", "pii_spans", "source_size", "mix_size", "a.b", "row", "mix_prefix", "pii_text", "component",
         "packed_rest", "first", "n", "cut_source", "kept", "band", "select", "x y")
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in NAMES)


def test_columns_of_any_name_keep_their_values(spark, tmp_path):  # noqa: F811
    rows = [(*r[:5], *(1000 * i + k for k in range(len(NAMES)))) for i, r in enumerate(ROWS)]
    rows += [(800, "a text with all of its other columns null", "aa", "s1", None, *[None] * len(NAMES))]
    table = spark.createDataFrame(rows, DDL).repartition(4)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    allowed = {r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, table, str(tmp_path))
        assert made.columns == list(table.columns) and made.schema["a.b"].dataType == table.schema["a.b"].dataType
        table = Scratch(spark).write(made)
        kept = table.collect()
        assert kept and all(tuple(r)[5:] in allowed for r in kept)
        ids = {(r[0], r[5:]) for r in rows}
        assert all((r.doc_id, tuple(r)[5:]) in ids for r in kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_run_packs_what_the_stages_leave(spark, tmp_path):  # noqa: F811
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([r[:5] for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = Scratch(spark).write(stage(spark, table, str(tmp_path)))
    whole = Tokenizer.from_file(default_path())
    want, totals = Counter(), Counter()
    for r in table.collect():
        ids = [*whole.encode(r.text, add_special_tokens=False).ids, 0]
        totals[r.doc_id, len(ids)] += 1
        if len(ids) <= 2048:
            want[r.doc_id, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cut = {(d, n): k for (d, n), k in totals.items() if n > 2048}
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if (r.doc_id in {d for d, _ in cut}) is False) == Counter(
        {k: v for k, v in want.items() if k[0] not in {d for d, _ in cut}})
    assert sum(r.length for r in rows) == sum(n * k for (_, n), k in totals.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_language_of_texts_without_letters(spark):  # noqa: F811
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("hello there", "en"), ("bonjour toi", "fr")] * 20)]
    rows += [(100 + i, t, "en") for i, t in enumerate(["² ½", "٣ ⅷ", "_", "①", "", None, " \n", "€ 12 !?"])] + [(200, "ªº", None), (201, "é", None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[100 + i].lang_pred == "und" and out[100 + i].score == 0 for i in range(8))
    assert out[200].lang_pred in ("en", "fr") and out[201].lang_pred in ("en", "fr")
    assert all(out[i].lang_pred == rows[i][2] for i in range(40))
