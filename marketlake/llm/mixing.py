"""Mixing sources to target weights: Poisson replication.

Every document of a source is repeated a Poisson number of times whose mean is the source's target
rate: total * weight / documents of the source. The number is drawn by inverting the Poisson
distribution at a uniform number taken from a hash of seed, doc_id, text digest and the row's place
among equal ones, so that it needs no state, survives recomputation and can be restated in SQL. A
mean above PART is drawn as a sum of independent draws of at most PART each. The copies are then
shuffled globally: dealt over all partitions by another hash and ordered by it within each.

Default weights are the sources' shares to the power alpha, rescaled; with targets given, sources
not among them get none.

Rows are told apart by (doc_id, text). Those that occur once, which is nearly all, are hashed as
they are. Rows equal in both are numbered by a running count over range partitions, so that each
has a draw of its own also where they hold a third of the table. docs must be reproducible: a scan
or a materialised table.

Edge cases: a NULL source is a source of its own. A NULL doc_id or text is hashed as ''; rows
without an id are told apart by their texts, equal rows by their number (which of them has which
is open). Empty and NULL texts are documents like others. Extra columns stay, whatever their
names: where the caller has a column copy_no or shuffle_key, the new one gets '_' appended.
Weights must not be negative; a weight of 0 drops its source, those of a repeated target add up.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import LOOKUP_ROWS, lookup, materialize, table, whole_text
from marketlake.operators.ordered import running_exact

PART = 64.0
#: Longest table of one draw: the tail beyond mean 64 + 160 is far below the grid of uniforms.
TERMS = 224
NO_SOURCE = "\u0000"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) on a grid of 2**-52 from a hash."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, until it no longer grows."""
    terms = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.least(terms, F.lit(TERMS))), start, step, lambda acc: acc["c"])


def rates(docs: DataFrame, targets: DataFrame | None, alpha: float, total: float) -> DataFrame:
    """(name, parts, steps) per source: number of draws and the distribution of each.

    targets: (source, weight). total: documents wanted, in units of the documents there are.
    """
    name = F.coalesce("source", F.lit(NO_SOURCE)).alias("name")
    n = docs.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighed = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        wanted = targets.groupBy(name).agg(F.sum(F.col("weight").cast("double")).alias("w"))
        weighed = n.join(wanted, "name", "left").fillna(0.0, "w")
    all_n, all_w = weighed.agg(F.sum("n")).scalar(), weighed.agg(F.nullif(F.sum("w"), F.lit(0.0))).scalar()
    mean = F.lit(total) * all_n * F.col("w") / all_w / F.col("n")
    return (
        weighed.select("name", F.coalesce(mean, F.lit(0.0)).alias("mean"))
        .withColumn("parts", F.greatest(F.ceil(F.col("mean") / PART), F.lit(1)).cast("int"))
        .select("name", "parts", cumulative(F.col("mean") / F.col("parts")).alias("steps"))
    )


def row_key(text: str = "text") -> Column:
    """Digest by which rows are told apart."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(whole_text(text))))


def with_ordinal(rows: DataFrame) -> DataFrame:
    """Add ordinal: a row's place, from 0, among those with the same key."""
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    again = materialize(again)
    n = again.count()
    if not n:
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    if n <= LOOKUP_ROWS:
        again = F.broadcast(again)
    alone = rows.join(again, "key", "left_anti").withColumn("ordinal", F.lit(0).cast("long"))
    equal = running_exact(materialize(rows.join(again, "key", "left_semi")), ["key"], {"ordinal": F.lit(1)}, scale=0)
    return alone.unionByName(equal.withColumn("ordinal", F.col("ordinal").cast("long") - 1))


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def mix(
    docs: DataFrame,
    targets: DataFrame | None = None,
    alpha: float = 0.5,
    total: float = 1.0,
    seed: str = "mix",
    key: Column | None = None,
) -> DataFrame:
    """All columns of docs, copy_no (from 0) and shuffle_key; rows in a globally shuffled order.

    key: what tells rows apart, if not row_key().
    """
    # the caller's columns travel in one struct, apart from the names used here
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        F.coalesce("source", F.lit(NO_SOURCE)).alias("name"),
        (row_key() if key is None else key).alias("key"),
    )
    known = lookup(with_ordinal(rows), rates(docs, targets, alpha, total), "name", "key")

    def draw(part: Column) -> Column:
        u = uniform(F.lit(seed), "key", "ordinal", part)
        return F.size(F.filter("steps", lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), draw), F.lit(0), lambda a, b: a + b)
    copies = (
        known.withColumn("count", count)
        .where("count > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), "key", "ordinal", "copy_no")))
        .select("row", "copy_no", "shuffle_key")
    )
    own = [F.col(c).alias(free_name(c, docs.columns)) for c in ("copy_no", "shuffle_key")]
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("row.*", *own)


def query(spark, sf_dir: str) -> DataFrame:
    """One row per copy of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", row_key().alias("key"))
    return mix(docs, key=F.col("key")).select("doc_id", "source", "copy_no", "shuffle_key")


def mixed_sql(docs: str, columns: str) -> str:
    """SQL of the default mix of a table or subquery with doc_id, source, text; columns: what to return of d."""
    return f"""
WITH RECURSIVE given AS ({docs}),
keyed AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM given),
docs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS ordinal FROM keyed),
n AS (SELECT coalesce(source, '') AS name, count(*) AS n FROM docs GROUP BY 1),
r AS (SELECT name, (SELECT sum(n) FROM n) * sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM n) / n AS mean FROM n),
c(name, mean, k, p, c) AS (
  SELECT name, mean, 0, exp(-mean), exp(-mean) FROM r
  UNION ALL
  SELECT name, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c
  WHERE k < ceil(mean + 12 * sqrt(mean) + 20)),
steps AS (SELECT name, list(c ORDER BY k) AS steps FROM c GROUP BY name),
d AS (
  SELECT docs.*, len(list_filter(steps, lambda s: s <=
    ('0x' || substr(md5('mix|' || key || '|' || ordinal || '|0'), 1, 13))::BIGINT / 4503599627370496.0)) AS times
  FROM docs JOIN steps ON coalesce(source, '') = name),
e AS (SELECT d.*, unnest(range(0, times))::INTEGER AS copy_no FROM d WHERE times > 0)
SELECT {columns} FROM e d"""


SQL = mixed_sql(
    "SELECT doc_id, source, text FROM documents",
    "doc_id, source, copy_no, md5('mix|' || key || '|' || ordinal || '|' || copy_no) AS shuffle_key",
)
