"""N-gram Jaccard self-join: size-aware, small sets by subsets, large sets by inverted lists.

A document is the set of its distinct word shingles (64-bit hashes). Shingles are ordered by
rarity, so that two sets with Jaccard similarity of at least J share

* a shingle among the first  n - ceil(J n) + 1  of each (large sets: one entry of an inverted list
  per such shingle), and also
* two shingles among the first  n - ceil(J n) + 2  (small sets: one entry per pair of them, so that
  a list holds sets that agree in a whole subset).

The boundary between small and large is the size with the least expected cost over the sizes of
this corpus. Pairs across the boundary meet in the lists of single shingles, which small sets
within reach of a large one also enter. Rarity comes from a table of counts over all documents, of
fixed width; any order gives the same result, a true one gives short lists.

Work per list is not the square of its length. Sets that are identical count as one. The fullest
set of a list (the one with the fewest rare shingles, which is next to the original of a group of
near copies) is compared with the others first; links give components. Then only members outside
the component of that leader are compared with the rest, under the length and positional bounds,
until no candidate across components is left. Candidates first pass a bound from bitmaps: each set
has PARITY bits, each flipped once per shingle that hashes to it, and two bitmaps differ in no more
bits than the sets differ in shingles. What passes is verified on its whole sets.

Edge cases: NULL or empty texts have the empty set and link with nothing, also not with each
other. Texts with fewer words than a shingle have one shingle, the whole sequence. Repeated rows
of a doc_id appear as often in the result; rows with one doc_id or none but with other texts are
decided each for itself. A component's first document has the least doc_id; one without a doc_id
is first only where none has one, and then the rows of the component's least set stay. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marketlake.llm.common import Scratch, bitmap, in_bitmap, materialize, table, whole_text
from marketlake.llm.graph import components

#: Counters of the rarity table, and how many travel as one row.
WIDTH = 1 << 19
CHUNK = 1 << 14
#: Lists of shingles more frequent than this are dealt over several tasks. Their salts begin at 1.
HOT = 20_000
SUBSET = 2
#: Bits of the bitmap of wanted documents, as longs of 64.
LONGS = 1 << 15
#: Bits of a set's parity bitmap.
PARITY = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)
SPIN = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * SPIN
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < width:
        return np.array([xxh64_intdigest(b" ".join(words), n + 1)] if n else [], np.uint64)
    ids = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    h = ids[: n - width + 1]
    for j in range(1, width):
        h = mixed(h * MIX + ids[j : n - width + 1 + j])
    return np.unique(h)


def set_name(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxh64_intdigest(s.tobytes(), len(s))).astype(np.int64)) if len(s) else 0


def parity(s: np.ndarray) -> np.ndarray:
    """The set's parity bitmap as longs."""
    bits = np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def needed(n: np.ndarray | int, percent: int):
    """Least overlap that a set of n shingles needs with a set of any size."""
    return -(-percent * n // 100)


def row_hash() -> Column:
    """Hash of doc_id and text; names a row whether or not it has an id."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), whole_text())


def describe(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (doc_id, row, n, set_id, parity), and the counts of all shingles in chunks."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(WIDTH, np.int64)
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            full = [s for s in sets if len(s)]
            if full:
                counts += np.bincount((np.concatenate(full) % np.uint64(WIDTH)).astype(np.int64), minlength=WIDTH)
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "no_id": batch["no_id"],
                    "row": batch["row"],
                    "n": [len(s) for s in sets],
                    "set_id": [set_name(s) for s in sets],
                    "parity": [parity(s) for s in sets],
                    "chunk": -1,
                    "counts": None,
                }
            )
        if counts.any():
            chunks = range(0, WIDTH, CHUNK)
            yield pd.DataFrame(
                {
                    "id": 0,
                    "no_id": True,
                    "row": 0,
                    "n": 0,
                    "set_id": 0,
                    "parity": None,
                    "chunk": [c // CHUNK for c in chunks],
                    "counts": [zlib.compress(counts[c : c + CHUNK].astype("<u4").tobytes(), 1) for c in chunks],
                }
            )

    # a NULL among them would make all ids of a batch floating-point numbers
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id")
    rows = docs.select(*ids, row_hash().alias("row"), whole_text().alias("text")).mapInPandas(
        scan, "id long, no_id boolean, row long, n int, set_id long, parity array<long>, chunk int, counts binary"
    )
    return rows.select(F.expr("CASE WHEN NOT no_id THEN id END AS doc_id"), "row", "n", "set_id", "parity", "chunk", "counts")


def rarity(rows: DataFrame) -> np.ndarray:
    """The summed counters: WIDTH numbers whatever the corpus."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch["chunk"], batch["counts"]):
                own = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
                total[chunk] = total[chunk] + own if chunk in total else own
        yield pd.DataFrame({"chunk": list(total), "counts": [v.tobytes() for v in total.values()]})

    sums = (
        rows.where("chunk >= 0")
        .select("chunk", "counts")
        .repartition("chunk")
        .mapInPandas(add, "chunk int, counts binary")
        .collect()
    )
    counts = np.zeros(WIDTH, np.int64)
    for r in sums:
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return counts


def boundary(sizes: list[tuple[int, int]], counts: np.ndarray, percent: int) -> int:
    """The largest size for which pairs of shingles cost less than inverted lists.

    A list costs one row and the rows it meets: the mean load of a shingle relative to the mean
    load of a counter. sizes: (n, sets) of the sets small enough to be considered.
    """
    total = counts.sum()
    load = 1.0 + float((counts.astype(float) ** 2).sum() / max(total, 1)) / max(1.0, total / WIDTH)

    def cost(limit: int) -> float:
        out = 0.0
        for n, sets in sizes:
            prefix = n - needed(n, percent) + 1
            if n <= limit:
                out += sets * comb(prefix + 1, SUBSET)
                if n >= needed(limit + 1, percent):
                    out += sets * prefix
            else:
                out += sets * prefix * load
        return out

    return min((0, 16, 24, 32, 48, 64, 96, 128), key=cost)


def list_entries(docs: DataFrame, counts: np.ndarray, limit: int, width: int, percent: int) -> DataFrame:
    """Rows (key, salt, set_id, n, pos, full): the lists that each distinct set enters."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts.astype(np.uint32))

    def entries(s: np.ndarray):
        n = len(s)
        own = shared.value[(s % np.uint64(WIDTH)).astype(np.int64)]
        order = np.lexsort((s, own))
        prefix = n - needed(n, percent) + 1
        full = int(np.log2(own + 1.0).mean() * 256)
        keys, salts, places = [], [], []
        if n > limit or n >= needed(limit + 1, percent):
            first = order[:prefix]
            keys.append(mixed(s[first] + MIX))
            salts.append(own[first] // HOT)
            places.append(np.arange(prefix))
        if n <= limit:
            first = s[order[: prefix + SUBSET - 1]]
            i, j = np.triu_indices(len(first), 1)
            keys.append(mixed(mixed(first[i]) * MIX + first[j]))
            salts.append(np.zeros(len(i), np.int64))
            places.append(np.full(len(i), -1))
        return n, full, np.concatenate(keys), np.concatenate(salts), np.concatenate(places)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # identical sets enter once per task
        for batch in batches:
            parts = []
            for text in batch["text"]:
                s = shingle_set(text, width)
                name = set_name(s)
                # with fewer shingles, a set this similar is the same set
                if len(s) * 100 >= percent * (len(s) + 1) and name not in seen:
                    seen.add(name)
                    n, full, keys, salts, places = entries(s)
                    share = np.where(salts > 0, 1 + abs(name) % (1 << 30) % (salts.astype(np.int64) + 1), 0)
                    meta = (np.int64(full) << 48) | (np.int64(n) << 24) | (places.astype(np.int64) + 1)
                    parts.append((keys.view(np.int64), share, np.full(len(keys), name, np.int64), meta))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pd.DataFrame(dict(zip(("key", "salt", "set_id", "meta"), columns)))

    return (
        docs.select(whole_text().alias("text"))
        .mapInPandas(scan, "key long, salt int, set_id long, meta long")
        .repartition("key", "salt")
    )


UNPACK = (
    "key",
    "salt",
    "set_id",
    "cast(meta & 16777215 as int) - 1 AS pos",
    "cast((meta >> 24) & 16777215 as int) AS n",
    "meta >> 48 AS full",
)


def shared_lists(entries: DataFrame) -> DataFrame:
    """Entries of lists with more than one set, each with the fullest set of its list.

    Every part of a dealt list stays: a set alone in its part may meet others of the list in another one.
    """
    rows = entries.selectExpr(*UNPACK)
    lists = rows.groupBy("key", "salt").agg(
        F.min("set_id").alias("low"), F.max("set_id").alias("high"), F.max(F.struct("full", "set_id", "n", "pos")).alias("lead")
    )
    return (
        rows.join(lists.where("low <> high OR salt > 0"), ["key", "salt"])
        .dropDuplicates(["key", "salt", "set_id"])
        .selectExpr(
            "key", "salt", "set_id", "n", "pos", "lead.set_id AS lead_id", "lead.n AS lead_n", "lead.pos AS lead_pos",
            "lead.full AS lead_full",
        )
    )


def near(percent: int, x: str, y: str) -> str:
    """Length and positional bounds of a candidate pair, as SQL."""
    need = f"{percent} * ({x}.n + {y}.n) <= {100 + percent} * "
    return (
        f"{percent} * greatest({x}.n, {y}.n) <= 100 * least({x}.n, {y}.n) AND ({x}.pos < 0 OR {y}.pos < 0 OR "
        f"{need} least({x}.n - {x}.pos, {y}.n - {y}.pos))"
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    one = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def bounded(pairs: DataFrame, of_sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity bitmaps allow enough overlap.

    Sets of sizes n and m that differ in d shingles overlap in (n + m - d) / 2.
    """
    one = of_sets.selectExpr("set_id AS a", "n AS n1", "parity AS p1")
    two = of_sets.selectExpr("set_id AS b", "n AS n2", "parity AS p2")
    differ = "aggregate(zip_with(p1, p2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    enough = f"(200 + 2 * {percent}) * ({differ}) <= 2 * (100 - {percent}) * (n1 + n2)"
    return pairs.join(one, "a").join(two, "b").where(enough).select("a", "b")


def as_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.select(F.expr(f"least({a}, {b}) AS a"), F.expr(f"greatest({a}, {b}) AS b")).where("a <> b").distinct()
    )


def sets_of(pairs: DataFrame, docs: DataFrame, of_docs: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of the sets in pairs, from one document of each.

    A bitmap of fixed size drops nearly all other documents before their texts are shuffled.
    """

    def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({"set_id": [set_name(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    ids = of_docs.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("row").alias("row"))
    ids = materialize(ids.select("row").distinct())
    bits = bitmap(ids.select(F.col("row").alias("h")), LONGS).scalar()
    return (
        docs.select(row_hash().alias("row"), whole_text().alias("text"))
        .where(in_bitmap(bits, LONGS, F.col("row")))
        .join(ids, "row", "left_semi")
        .mapInPandas(as_sets, "set_id long, shingles binary")
    )


def linked_sets(docs: DataFrame, described: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label) of every set that links with another one; label is the least set of its component."""
    counts = rarity(described)
    of_docs = described.where("chunk < 0").select("row", "n", "set_id", "parity")
    of_sets = materialize(of_docs.groupBy("set_id").agg(F.first("n").alias("n"), F.first("parity").alias("parity")))
    sizes = [
        (r["n"], r["sets"])
        for r in of_docs.where("n BETWEEN 1 AND 128").groupBy("n").agg(F.count_distinct("set_id").alias("sets")).collect()
    ]
    limit = boundary(sizes, counts, percent)
    scratch = Scratch(docs.sparkSession)
    lists = scratch.keep(shared_lists(list_entries(docs, counts, limit, width, percent)))
    leaders = lists.select("key", "salt", "lead_id", "lead_n", "lead_pos", "lead_full").distinct()
    # lists that were dealt over several tasks have a leader each, and one of them leads all
    dealt = leaders.where("salt > 0").select("key").distinct()
    tops = leaders.join(dealt, "key").groupBy("key").agg(
        F.max(F.struct("lead_full", "lead_id", F.col("lead_n").alias("n"), F.col("lead_pos").alias("pos"))).alias("top")
    )

    # leaders first: against the members of their list, and of a dealt list against the first of them
    entry, lead = "named_struct('n', n, 'pos', pos) AS x", "named_struct('n', lead_n, 'pos', lead_pos) AS y"
    star = lists.selectExpr("set_id AS one", "lead_id AS two", entry, lead)
    across = leaders.join(tops, "key").selectExpr("lead_id AS one", "top.lead_id AS two", lead.replace("AS y", "AS x"), "top AS y")
    star = star.where(near(percent, "x", "y")).select("one", "two").unionByName(
        across.where(near(percent, "x", "y")).select("one", "two")
    )
    star = as_pairs(star, "one", "two")
    close = materialize(bounded(star, of_sets, percent))
    edges = materialize(verified(close, scratch.keep(sets_of(close, docs, of_docs, width)), percent))
    labels = materialize(components(edges))

    # then whoever is not in the component of the leader of its list, against all of the list
    of_lead = tops.selectExpr("key", "top.lead_id AS top_id").unionByName(
        leaders.join(dealt, "key", "left_anti").selectExpr("key", "lead_id AS top_id")
    )
    of_lead = of_lead.join(labels.selectExpr("node AS top_id", "label AS top_label"), "top_id", "left").selectExpr(
        "key", "coalesce(top_label, top_id) AS top_label"
    )
    rows = (
        lists.select("key", "set_id", "n", "pos")
        .join(labels.selectExpr("node AS set_id", "label"), "set_id", "left")
        .withColumn("label", F.coalesce("label", "set_id"))
        .join(of_lead, "key")
    )
    open_lists = rows.groupBy("key").agg(F.max(F.col("label") != F.col("top_label")).alias("open")).where("open").select("key")
    rows = scratch.keep(rows.join(open_lists, "key", "left_semi"))
    rest = rows.where("label <> top_label").alias("r")
    other = rows.alias("o")
    meet = "r.key = o.key AND r.label <> o.label AND (o.label = o.top_label OR r.set_id < o.set_id) AND "
    pairs = rest.join(other, F.expr(meet + near(percent, "r", "o"))).selectExpr("r.set_id AS one", "o.set_id AS two")
    pairs = bounded(as_pairs(pairs, "one", "two"), of_sets, percent)
    pairs = materialize(pairs.join(close, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        more = verified(pairs, scratch.keep(sets_of(pairs, docs, of_docs, width)), percent)
        # every component so far is a star by now
        labels = materialize(components(labels.selectExpr("node AS a", "label AS b").unionByName(more)))
    scratch.drop()
    return labels


def named_sets(docs: DataFrame, described: DataFrame, width: int, percent: int) -> DataFrame:
    """(set_id, first, copies, label, component_id, chosen) of every set that is not empty.

    first: its least doc_id. chosen: the set of the component's first document.
    """
    of_docs = described.where("chunk < 0").select("doc_id", "n", "set_id")
    labels = linked_sets(docs, described, width, percent)
    first = of_docs.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    named = first.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id")
    )
    named = materialize(named)
    least = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "set_id")).alias("least"))
    return named.join(least.selectExpr("label", "least.first AS component_id", "least.set_id AS chosen"), "label")


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    described = materialize(describe(docs, width))
    of_docs = described.where("chunk < 0").select("doc_id", "n", "set_id")
    # a set that only one document has, in a component of its own, needs no entry
    known = (
        named_sets(docs, described, width, percent)
        .where("copies > 1 OR NOT component_id <=> first OR label <> set_id")
        .select("set_id", "component_id")
    )
    return of_docs.join(known, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One document, the first, of every group of linked documents; all columns."""
    described = materialize(describe(docs, width))
    of_docs = described.where("chunk < 0 AND n > 0").select("doc_id", "row", "set_id")
    known = named_sets(docs, described, width, percent).where("copies > 1 OR set_id <> chosen")
    gone = of_docs.join(known.select("set_id", "component_id", "chosen"), "set_id").where(
        "set_id <> chosen OR NOT doc_id <=> component_id"
    )
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("row").alias("_gone_row")).distinct()
    mine = docs.withColumn("_row", row_hash())
    same = mine["doc_id"].eqNullSafe(gone["_gone"]) & (mine["_row"] == gone["_gone_row"])
    return mine.join(gone, same, "left_anti").drop("_row")


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS sh
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(doc_id, least) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT l.b, r.least FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.least) AS component_id
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""
