"""Total order and ordered scans: against plain versions, with hot keys, hot instants, ties and NULLs."""

import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.operators import asof
from marketlake.operators.ordered import PART, in_order, inherited, number_rows, running_exact


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_number_rows(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2, 2]), rng.choice("xy")) for _ in range(500)]
    out = number_rows(spark.createDataFrame(rows, "k int, v string"), "k", F.desc("v"), parts=parts).collect()
    assert sorted(r["seq"] for r in out) == list(range(500))
    by_seq = [(r["k"], r["v"]) for r in sorted(out, key=lambda r: r["seq"])]
    assert by_seq == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -ord(r[1])))
    assert number_rows(spark.createDataFrame([], "k int"), "k", parts=parts).count() == 0


def test_rows_that_tie_in_everything_spread(spark):
    placed = in_order(spark.range(8000).selectExpr("cast(NULL AS int) AS k"), "k", parts=8)
    sizes = [r["count"] for r in placed.groupBy(PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8


def plain_asof(left, right, tolerance):
    out = []
    for i, k, t in left:
        fit = [] if k is None or t is None else [(u, v) for q, u, v in right if q == k and u is not None and u <= t]
        best = max(fit, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=(None, None))
        out.append((i, *(best if best[0] is not None and (tolerance is None or t - best[0] <= tolerance) else (None, None))))
    return sorted(out)


@pytest.mark.parametrize("tolerance", [None, 0, 5])
@pytest.mark.parametrize("parts", [1, 4, 13])
def test_asof_scan_against_plain(spark, tolerance, parts):
    rng = random.Random(7)
    key = lambda: rng.choice([None, "hot", "hot", "hot", "b", "c"])
    time = lambda: rng.choice([None, 50, 50, 50, rng.randint(0, 99)])
    left = [(i, key(), time()) for i in range(300)] + [(300, "unknown", 5), (301, "b", -1)]
    right = [(key(), time(), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(200)]
    out = asof.asof_scan(
        spark.createDataFrame(left, "i int, k string, t long"),
        spark.createDataFrame(right, "k string, t long, v double"),
        ["k"], "t", ["v"], tolerance, parts,
    )
    assert sorted(tuple(r) for r in out.select("i", "_right_t", "v").collect()) == plain_asof(left, right, tolerance)


def test_asof_scan_spreads_one_instant(spark):
    """All ticks of all keys in one second: as many parts as asked for, and the same result as in chunks."""
    left = spark.range(4000).selectExpr("id AS i", "'k' AS k", "100L AS t")
    right = spark.range(4000).selectExpr("'k' AS k", "100L AS t", "cast(id AS double) AS v")
    placed = in_order(left.select("k", "t"), "k", "t", parts=8)
    assert placed.groupBy(PART).count().agg(F.max("count")).first()[0] < 1000
    scan = asof.asof_scan(left, right, ["k"], "t", ["v"], parts=8)
    assert scan.where("v = 3999.0 AND _right_t = 100").count() == 4000
    assert asof.asof_join(left, right, ["k"], "t", ["v"]).where("v = 3999.0").count() == 4000


def test_a_part_inherits_one_row_at_most(spark):
    rows = spark.range(6000).selectExpr("pmod(hash(id), 7) AS k", "id AS t")
    placed = in_order(rows, "k", "t", parts=9)
    tails = placed.groupBy("k", PART).agg(F.max("t").alias("tail"))
    carried = inherited(tails, ["k"], "tail", lambda w: F.max("tail").over(w))
    assert carried.groupBy(PART).count().agg(F.max("count")).first()[0] == 1


def test_asof_anchor_scan_equals_anchor(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"s": rng.choice(["a", "b"], 400), "t": np.arange(400) * 7, "v": rng.normal(size=400)})
    bars = spark.createDataFrame(rows)
    want = asof.asof_anchor(bars, ["s"], "t", ["v"], 300, 500).orderBy("t").collect()
    got = asof.asof_anchor_scan(bars, ["s"], "t", ["v"], 300, 5).orderBy("t").collect()
    assert got == want and len(got) == 400


def test_running_sums_do_not_depend_on_parts(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "hot", "hot", "x"]), rng.choice([1, 2]), rng.choice([None, 0.1, 1e8 / 3, -0.7])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, t int, v double")
    results = []
    for parts in (1, 5, 17):
        out = running_exact(df, ["k"], {"total": F.col("v"), "n": F.lit(1)}, "t", "i", parts=parts)
        assert out.columns == ["i", "k", "t", "v", "total", "n"]
        results.append(sorted((r["i"], r["total"], r["n"]) for r in out.collect()))
    assert results[0] == results[1] == results[2]
    sums = {}
    want = []
    place = Decimal(1).scaleb(-10)
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        total, n = sums.get(k, (Decimal(0), 0))
        sums[k] = total + (Decimal(repr(v)).quantize(place) if v is not None else 0), n + 1
        want.append((i, *sums[k]))
    assert results[0] == sorted(want)


def test_numbers_count_on_over_batches_and_replays(spark, tmp_path):
    """Two runs of a stream, then its last batch again, as after a lost commit."""
    import shutil

    from marketlake.streaming import pipeline

    def add(low, high):
        rows = spark.range(low, high).selectExpr("cast(id AS string) AS key", "cast(pmod(hash(id), 5) AS string) AS value")
        rows.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))

    def run(checkpoint):
        rows = spark.readStream.schema("key string, value string").parquet(str(tmp_path / "in"))
        pipeline.drain(
            [pipeline.sink_numbered(rows, "n", "topic", str(tmp_path / checkpoint), str(tmp_path), ["value"], pipeline.DRAIN, 4)]
        )
        out = spark.read.schema("key string, value string, seq long, batch int").json(str(tmp_path / "topic"))
        return sorted(out.collect(), key=lambda r: r["seq"])

    add(0, 400)
    first = run("a")
    assert [r["seq"] for r in first] == list(range(400))
    assert [r["value"] for r in first] == sorted(r["value"] for r in first)
    add(400, 500)
    both = run("a")
    assert [r["seq"] for r in both] == list(range(500)) and both[:400] == first
    assert len(list((tmp_path / "topic" / "batch=0").glob("part-*"))) > 1
    shutil.copytree(tmp_path / "a", tmp_path / "b", ignore=_without_last_commit)
    again = run("b")
    assert again == both


def _without_last_commit(folder, names):
    return [n for n in names if folder.rstrip("/").endswith("commits") and n in ("1", ".1.crc")]
