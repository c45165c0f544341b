"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkite.llm.tables import REST, pack, unpack, without
from panelkite.llm.textcodes import chunks

BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
TRAIN_PER_LANG = 5_000  # documents per language that a model is fitted on, at most
UNDETERMINED = "und"
CHUNK = 1_000_000


def features(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and the offsets of each text's share.

    Texts are lower-cased; digits, ASCII punctuation and white space count as one blank kind. As many blanks as the
    longest n-gram reaches ahead come before each text and one behind it, so none has a letter of another text.
    """
    ahead = max(orders) - 1
    lead, end = " " * ahead, " " * ahead

    def joined(parts: list[str]) -> str:
        return lead + (" " + lead).join(parts) + " " + end

    frame = ahead + 1
    points = np.frombuffer(joined(texts).lower().encode("utf-32-le"), "<u4")
    if sum(map(len, texts)) + frame * len(texts) + ahead != len(points):  # lower-casing can change the length
        texts = [t.lower() for t in texts]
        points = np.frombuffer(joined(texts).encode("utf-32-le"), "<u4")
    points = np.where((points < 97) | ((points > 122) & (points < 170)), np.uint32(32), points)
    sizes = np.array([len(t) + frame for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    n, shift = len(points), np.uint32(32 - bits)
    out = np.empty((n, len(orders)), np.uint32)
    for j, order in enumerate(orders):
        code = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            part = points[k:] if k else points
            code[: n - k] = (code[: n - k] ^ part) * np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(15)
        out[:, j] = (code * np.uint32(0xC2B2AE35)) >> shift
    return out[: n - ahead], begins


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and the log-probability of each hashed n-gram in each of them."""

    langs: tuple[str, ...]
    log_prob: np.ndarray  # n-grams x languages


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_lang: int = TRAIN_PER_LANG, bits: int = BITS) -> LanguageModel:
    """Fit on at most about ``per_lang`` documents of each language, picked by a hash of id and text.

    Rows without text or language are no evidence. Nothing to learn from gives a model without languages.
    """
    rows = labelled.select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("pick"),
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return LanguageModel((), np.zeros((1 << bits, 0)))
    # The share of hash values that leaves about per_lang documents of a language.
    keep = F.lit(False)
    for lang, n in counts.items():
        bound = (1 << 63) - 1 if n <= per_lang else int((2 * per_lang / n - 1) * (1 << 63))
        keep = keep | ((F.col("lang") == lang) & (F.col("pick") <= F.lit(bound)))
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text", CHUNK):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own, _ = features([t for t, x in zip(texts, langs, strict=True) if x == lang], bits)
                sums[lang] = sums.get(lang, 0) + np.bincount(own.ravel(), minlength=width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())],
            names=["lang", "counts"],
        )

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, "<i8") for b in part["counts"])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [total.tobytes()]})

    sample = rows.filter(keep).select("text", "lang").repartition(8)
    found = sample.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary")
    learned = sorted((r[0], np.frombuffer(r[1], "<i8")) for r in found.collect())  # one vector per language
    table = np.stack([c for _, c in learned], axis=1) + SMOOTHING
    return LanguageModel(tuple(lang for lang, _ in learned), np.log(table / table.sum(axis=0)))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = (),
            bits: int = BITS) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``, the posterior probability of the prediction.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model has no language. Ties go to the first language in order.
    The whole text counts, whatever its length.
    """
    docs = without(docs, "lang_pred", "score")
    keep = tuple(c for c in keep if c.lower() not in ("lang_pred", "score"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.log_prob))
    text = "lang_text"
    while text in keep:
        text += "_"
    source = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    out = source.drop(text).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        names = np.array([*langs, UNDETERMINED], object)
        for batch in chunks(batches, text, CHUNK):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts])
            code, begins = features(texts, bits)
            total = sum(np.add.reduceat(table[code[:, j]], begins, axis=0) for j in range(code.shape[1]))
            if langs:
                best = np.argmax(total, axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            best[~lettered] = len(langs)
            score[~lettered] = 0
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return source.mapInArrow(run, out)


def fold(id_col: str = "doc_id"):
    """The fold of a document, 0 to 4: crc32 of its id's decimal text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """Learn from the folds 1 to 4 of documents (doc_id, text, lang) and predict all of them.

    Returns doc_id, held_out (fold 0), lang_pred, score. The label, source and id are no input of a prediction.
    """
    held = docs.withColumn("held_out", fold() == 0)
    model = fit(held.filter(~F.col("held_out")), per_lang=per_lang)
    return predict(held, model, keep=("doc_id", "held_out"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and whose language is determined with at least ``least``.

    Learns from the labels of ``docs`` itself; without any label every text with a letter stays. A missing ``lang``
    is filled with the prediction.
    """
    needed = ("doc_id", "text", "lang")
    packed = pack(docs, *needed)
    model = fit(packed.filter(fold() != 0))
    found = predict(packed, model, keep=(*needed, REST))
    keep = F.col("lang_pred") != UNDETERMINED if model.langs else F.col("text").rlike("\\p{L}")
    found = found.filter(keep & ((F.col("score") >= least) if model.langs else F.lit(True)))
    filled = F.coalesce(F.col("lang"), F.when(F.col("lang_pred") != UNDETERMINED, F.col("lang_pred")))
    return unpack(found, docs.columns, needed, {"lang": filled})
