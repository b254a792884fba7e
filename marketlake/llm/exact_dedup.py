"""Exact deduplication: tree-merge of sorted digest runs.

Each input partition is a run of (digest, smallest doc_id, rows). Runs meet in binomial rounds: in
round r the runs whose numbers agree above bit r * FAN_BITS merge, 2**FAN_BITS at a time. A merge
keeps one entry per digest with the smallest identifier: both sides of every exchange sort their
entries by digest and merge neighbours in one pass over the order, the sending side first, so that
a digest that holds a third of all rows travels once per task. No node of the tree is one task: its
entries are spread by digest.

Merged entries agree in SHA-256, a second 64-bit hash and the length; entries that differ in any
of them never merge, at any level.

Edge cases: NULL and empty texts are equal (one group). Rows that repeat a doc_id count in
group_size and share their fate within a group of equal texts; with different texts each row is
decided by its own group. A NULL doc_id is never a smallest identifier unless its whole group has
none; then the rows of the group stay. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import materialize, table, whole_text

RUN_BITS = 6
FAN_BITS = 3
KEY = ("digest", "check", "length")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")


def text_key(text: Column) -> dict[str, Column]:
    """What equal texts, after normalisation, agree in."""
    return {"digest": F.unhex(F.sha2(text, 256)), "check": F.xxhash64(text), "length": F.length(text)}


def digest_runs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normalised(whole_text()).alias("t")).select(
        "doc_id",
        *[c.alias(k) for k, c in text_key(F.col("t")).items()],
        F.pmod(F.spark_partition_id(), F.lit(1 << RUN_BITS)).alias("run"),
    )


def merge_tree(runs: DataFrame) -> DataFrame:
    """One entry per digest, by rounds of merges."""
    # a struct has no slot that a hash table could overwrite, so entries are sorted and merged in order
    entry = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    merged = runs.select(*KEY, "run", entry.alias("least"), F.lit(1).cast("long").alias("rows"))
    for _ in range(RUN_BITS // FAN_BITS):
        merged = (
            merged.withColumn("run", F.shiftright("run", FAN_BITS))
            .groupBy("run", *KEY)
            .agg(F.min("least").alias("least"), F.sum("rows").alias("rows"))
        )
    return merged.select(*KEY, F.col("least.id").alias("keep_id"), "rows")


def decided(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the text's key of every row."""
    runs = materialize(digest_runs(docs))
    groups = merge_tree(runs).where("rows > 1")
    return runs.join(groups, list(KEY), "left").select(
        "doc_id",
        *KEY,
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return decided(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    names = [f"_{k}" for k in KEY]
    gone = decided(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), *[F.col(k).alias(f"_{k}_gone") for k in KEY])
    gone = gone.distinct()
    mine = docs.withColumns(dict(zip(names, text_key(normalised(whole_text())).values())))
    same = mine["doc_id"].eqNullSafe(gone["_gone"])
    for k in names:
        same = same & (mine[k] == gone[f"{k}_gone"])
    return mine.join(gone, same, "left_anti").drop(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
