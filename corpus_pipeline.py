"""A training corpus from documents: language, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``docs``: columns other than doc_id, text, lang, source and n_chars pass through unchanged, whatever their names.
Null and empty texts are rejected by the first stage; null ids are documents of their own; repeated rows and rows of one id
are one document to near_duplicates, which keeps the first by text and hash of the row; very long texts are read whole; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import langid, minhash, mixing, packing, pii
from panelkite.llm.tables import REST, Scratch, pack, unpack


def _with_text(df: DataFrame, docs: DataFrame, needed: tuple[str, ...], text: Column) -> DataFrame:
    """The columns of ``docs`` with another text, and n_chars to match."""
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unpack(df, docs.columns, needed, made)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an undetermined language go: null and empty texts, texts without a letter, even scores."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return minhash.keep_one(docs, Scratch(spark))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    found = pii.detect(pack(docs, "text"), keep=(REST,), with_redacted=True)
    return _with_text(found, docs, (), F.col("redacted"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their targets: documents repeat, are cut or left out as the mixture takes them."""
    needed = ("doc_id", "text", "source")
    packed = pack(docs, *needed)
    mixed = mixing.apply_mix(mixing.mix(packed, Scratch(spark)), packed.columns)
    return _with_text(mixed, docs, needed, F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each in its sequence; a document that the mixture repeats is packed each time."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

# Tokenizing and similarity have no SQL form. The tests hold near-duplicates and personal data against brute force stage by
# stage, language and mixture by bounds and totals, packing by its own test; of run() they only check that rows come out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents: each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for number, (name, stage) in enumerate(STAGES):
        last = docs
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.write(docs, name)
        scratch.drop(last) if number < len(STAGES) - 1 else None
    return docs
