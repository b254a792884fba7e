"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.session import configure, materialize, work_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A lookup table of so many rows or fewer is sent to every executor; a longer one is joined.
LOOKUP_ROWS = 10_000
#: Shares into which a key of a longer lookup table is dealt.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def lookup(df: DataFrame, entries: DataFrame, key: str, row_id: str = "doc_id") -> DataFrame:
    """Left join of a table with one row per key.

    entries is materialised and counted. Up to LOOKUP_ROWS rows it is broadcast. Beyond that the
    keys are salted by row_id, so that a key that holds a third of all rows spreads over SALTS
    tasks.
    """
    entries = materialize(entries)
    if entries.count() <= LOOKUP_ROWS:
        return df.join(F.broadcast(entries), key, "left")
    salted = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = df.withColumn("_salt", F.pmod(F.hash(F.col(row_id)), F.lit(SALTS)))
    return mine.join(salted, [key, "_salt"], "left").drop("_salt")


def bitmap(hashes: DataFrame, longs: int) -> DataFrame:
    """One row, bits: longs numbers of 64 bits with the bit of every hash h set; its size is fixed."""
    slot = f"pmod(h, {longs * 64}L)"
    used = hashes.selectExpr(f"cast({slot} div 64 AS long) AS id", f"shiftleft(1L, cast({slot} % 64 AS int)) AS bit")
    used = used.groupBy("id").agg(F.bit_or("bit").alias("bits"))
    cell = F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return (
        hashes.sparkSession.range(longs)
        .join(used, "id", "left")
        .agg(F.array_sort(F.collect_list(cell)).alias("all"))
        .select(F.expr("transform(all, x -> x.bits)").alias("bits"))
    )


def in_bitmap(bits: Column, longs: int, h: Column) -> Column:
    """Whether the bit of h is set; true for every hash put in, rarely for another."""
    slot = F.pmod(h, F.lit(longs * 64))
    word = F.get(bits, F.floor(slot / 64).cast("int"))
    return F.call_function("getbit", word, (slot % 64).cast("int")) == 1


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Compressed tables in the shared folder that an operator needs for a while.

    drop() deletes them; whatever is returned must not read them by then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(work_dir(self.spark, "scratch"))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


__all__ = ["Scratch", "ascii_lower", "bitmap", "delete", "in_bitmap", "lookup", "materialize", "table", "whole_text"]
