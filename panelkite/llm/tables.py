"""Intermediate tables in the shared folder, and small schema helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.session import new_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Hands out written tables and removes them when they are superseded.

    A table cuts the lineage: it lies in the folder of ``spark.checkpoint.dir`` and survives lost executors.
    The shuffle files of the job that wrote it are released with the job.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str = "llm", conf: dict[str, str] | None = None) -> DataFrame:
        """Write and reread; ``conf`` holds while the job runs."""
        path = new_path(self.spark, name)
        wanted = {CLEANUP: "true"} | (conf or {})
        before = {key: self.spark.conf.get(key, None) for key in wanted}
        for key, value in wanted.items():
            self.spark.conf.set(key, value)
        try:
            df.write.parquet(path)
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            found = self.paths.pop(id(df), None)
            if found:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def close(self, *keep: DataFrame) -> None:
        """Remove every table but those that the result still reads."""
        spared = {id(k) for k in keep}
        self.drop(*[df for key, (df, _) in self.paths.items() if key not in spared])


def row_key(id_col: str, text_col: str):
    """One key for rows with the same id and text; rows that share it are interchangeable."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that carry one of the names an operator makes itself."""
    clashing = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clashing])


REST = "packed_rest"


def pack(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator works on, and all others in one struct, so that no name of theirs can clash with its own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*[F.col(f"`{c}`") for c in needed], F.struct(F.lit(None).cast("int").alias("_"), *rest).alias(REST))


def unpack(df: DataFrame, columns: list[str], needed: tuple[str, ...], made: dict[str, Column] | None = None) -> DataFrame:
    """``columns`` again, in order; ``made`` gives new values for some of them."""
    made = made or {}
    own = lambda c: F.col(c) if c in needed else F.col(REST).getField(c)
    return df.select(*[(made[c] if c in made else own(c)).alias(c) for c in columns])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
