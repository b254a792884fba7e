"""Benchmark decontamination: prefix-filtered join of documents with item-sized windows.

A window is a run of WINDOW consecutive words of an item (all of it if shorter). Its shingles are
runs of up to SHINGLE words; they are ordered by rarity over the documents, and the rarest one is
the window's prefix: a document that contains the window contains that shingle, at a known
distance from the window's start. So

1. one scan of the documents finds the places of benchmark shingles (a bitmap of fixed size drops
   nearly all other words, a join on the whole hash drops the rest);
2. these places give the rarity of every benchmark shingle;
3. places of prefix shingles, moved by their distance, are candidate windows; those that would
   begin before the first word or end after the last are dropped (positional and length bounds);
4. a candidate is verified word by word on the words around its place.

All steps are DataFrame operations. Words of a document are never gathered from several rows, and
only the bitmap is sent to all executors; its size does not depend on the benchmark.

Edge cases: NULL or empty texts have no words, no hits and no items; an item without words has no
window. Items that share a window are all counted. Repeated items count once. Rows that repeat a
doc_id or have none are each decided by their own text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import ascii_lower, bitmap, in_bitmap, materialize, table, whole_text

WINDOW = 10
SHINGLE = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap, as longs of 64.
LONGS = 1 << 14


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def shingle_hash(words: str, at: str, size: int) -> str:
    """SQL of the hash of size words from position at (from 0)."""
    return f"xxhash64({size}, {', '.join(f'{words}[{at} + {j}]' for j in range(size))})"


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, window_id) of every distinct window of every item."""
    words = items.select("item_id", words_of(whole_text()).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - window, F.lit(0))
    return (
        words.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item_id", F.slice("w", F.col("at") + 1, window).alias("words"))
        .distinct()
        .withColumn("window_id", F.xxhash64("words"))
    )


def shingles_of(windows: DataFrame) -> DataFrame:
    """(window_id, words, off, size, h): the shingles of each distinct window."""
    size = f"least(size(words), {SHINGLE})"
    cases = " ".join(f"WHEN {k} THEN {shingle_hash('words', 'off', k)}" for k in range(1, SHINGLE + 1))
    return (
        windows.select("window_id", "words")
        .distinct()
        .selectExpr("*", f"{size} AS size")
        .selectExpr("*", "explode(sequence(0, size(words) - size)) AS off")
        .selectExpr("window_id", "words", "off", "size", f"CASE size {cases} END AS h")
    )


def row_key() -> Column:
    """Digest of doc_id and text: rows that agree in it are copies."""
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole_text()), 256))


def places(docs: DataFrame, shingles: DataFrame, sizes: list[int], reach: int) -> DataFrame:
    """(row_key, at, h, left, around, n_words) of every benchmark shingle in the documents.

    around: the words from left before the place to reach after it.
    """
    bits = bitmap(shingles.select("h"), LONGS).scalar()
    hashes = F.expr(
        "array(" + ", ".join(f"CASE WHEN at + {k} <= size(w) THEN {shingle_hash('w', 'at', k)} END" for k in sizes) + ")"
    ) if len(sizes) > 1 else F.expr(f"CASE WHEN at + {sizes[0]} <= size(w) THEN {shingle_hash('w', 'at', sizes[0])} END")

    words = docs.select(row_key().alias("row_key"), words_of(whole_text()).alias("w")).where("size(w) > 0")
    each = words.select("row_key", "w", F.posexplode("w").alias("at", "word")).drop("word")
    each = each.select("row_key", "w", "at", (F.explode(hashes) if len(sizes) > 1 else hashes).alias("h"))
    found = each.where(F.col("h").isNotNull() & in_bitmap(bits, LONGS, F.col("h")))
    return found.select(
        "row_key",
        "at",
        "h",
        F.least("at", F.lit(reach)).alias("left"),
        F.expr(f"slice(w, greatest(at - {reach}, 0) + 1, least(at, {reach}) + {reach})").alias("around"),
        F.size("w").alias("n_words"),
    )


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(row_key, window_id, start, length) of every window in every document."""
    shingles = materialize(shingles_of(windows))
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    if not sizes:
        return docs.where("false").select(row_key().alias("row_key")).selectExpr("row_key", "0L AS window_id", "0 AS start", "0 AS length")
    reach = shingles.agg(F.max(F.size("words"))).first()[0]
    known = shingles.select("h").distinct()
    found = materialize(places(docs, shingles, sizes, reach).join(known, "h", "left_semi"))
    rarity = found.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    prefix = (
        shingles.join(rarity, "h")
        .groupBy("window_id")
        .agg(
            F.count(F.lit(1)).alias("seen"),
            F.min(F.struct("df", "off", "h", "words", "size")).alias("p"),
        )
        # every shingle of an occurring window occurs
        .where("seen = size(p.words) - p.size + 1")
        .select("window_id", "p.h", "p.off", "p.words")
    )
    start = F.col("at") - F.col("off")
    return (
        found.join(prefix, "h")
        .where((start >= 0) & (start + F.size("words") <= F.col("n_words")))
        .where(F.expr("slice(around, left - off + 1, size(words)) = words"))
        .select("row_key", "window_id", start.alias("start"), F.size("words").alias("length"))
        .distinct()
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    windows = materialize(windows_of(items, window))
    found = materialize(occurrences(docs, windows))
    # words inside any occurrence: what each adds beyond the end of those before it
    before = "max(start + length) OVER (PARTITION BY row_key ORDER BY start, length, window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    hits = (
        found.selectExpr("row_key", "start", "length", f"coalesce({before}, 0) AS reached")
        .groupBy("row_key")
        .agg(F.sum(F.expr("greatest(start + length - greatest(start, reached), 0)")).alias("n_hit"))
    )
    owners = windows.select("window_id", "item_id").distinct()
    of_items = (
        found.select("row_key", "window_id")
        .join(owners, "window_id")
        .select("row_key", "item_id")
        .distinct()
        .groupBy("row_key")
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    )
    hit = hits.join(of_items, "row_key").select(
        F.col("row_key").alias("hit_key"), "n_hit", "n_items", F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")
    )
    zero = F.lit(0).cast("long")
    return (
        docs.select("doc_id", row_key().alias("row_key"), F.size(words_of(whole_text())).cast("long").alias("n_words"))
        .join(hit, F.col("row_key") == F.col("hit_key"), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window; all columns."""
    found = occurrences(docs, materialize(windows_of(items, window)))
    gone = found.select(F.col("row_key").alias("_gone")).distinct()
    mine = docs.withColumn("_row_key", row_key())
    return mine.join(gone, mine["_row_key"] == gone["_gone"], "left_anti").drop("_row_key")


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS MATERIALIZED (
  SELECT DISTINCT doc_id, i, n, g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) x,
    LATERAL (SELECT array_to_string(w[i:i + n - 1], ' ') AS g) y
  WHERE (g, n) IN (SELECT g, n FROM win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256
  FROM occ JOIN win USING (g, n) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
