"""Edges of fills, as-of joins, bars and features; plan shapes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.operators import asof, chunks, features, resample, stats
from marketlake.operators.resample import Grains


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def walk():
    """An irregular second-by-second price path with gaps, for two series."""
    rng = np.random.default_rng(5)
    rows = []
    for s in ("a", "b"):
        secs = np.sort(rng.choice(np.arange(10_000, 22_000), 900, replace=False))
        for sec in secs:
            rows.append((s, int(sec), float(rng.uniform(90, 110)), float(rng.uniform(0.1, 0.9))))
    return pd.DataFrame(rows, columns=["series", "sec", "btc_mid", "poly_p_up"])


def test_carry_forward_limits(spark):
    rows = [("A", 0, 100.0, 0.6), ("A", 29, None, None), ("A", 30, None, None), ("A", 31, None, None),
            ("A", 1800, None, None), ("A", 1801, None, None), ("B", 5, None, 0.4)]
    df = spark.createDataFrame(rows, "asset string, sec bigint, btc_mid double, poly_prob double")
    out = features.carry_forward(df, 0.001, chunk=60)
    got = {(r["asset"], r["sec"]): (r["btc_mid"], r["poly_prob"], r["forecast"] is None) for r in out.collect()}
    assert got["A", 29] == got["A", 30] == (100.0, 0.6, False)
    assert got["A", 31] == got["A", 1800] == (None, 0.6, True)
    assert got["A", 1801] == (None, None, True)
    assert got["B", 5] == (None, 0.4, True)


@pytest.mark.parametrize("tolerance", [None, 7])
def test_asof_join(spark, walk, tolerance):
    left = walk[["series", "sec"]].assign(sec=walk["sec"] + 3).rename(columns={"sec": "t"})
    right = walk.sample(frac=0.3, random_state=1)[["series", "sec", "btc_mid"]].rename(columns={"sec": "t"})
    out = asof.asof_join(
        spark.createDataFrame(left), spark.createDataFrame(right), ["series"], "t", ["btc_mid"], tolerance, 500
    ).toPandas()
    want = pd.merge_asof(
        left.sort_values("t"), right.sort_values("t"), on="t", by="series", tolerance=tolerance
    )
    got = out.sort_values(["series", "t"])["btc_mid"].to_numpy()
    assert np.allclose(got, want.sort_values(["series", "t"])["btc_mid"].to_numpy(), equal_nan=True)


def test_row_index_and_running_sum(spark, walk):
    df = spark.createDataFrame(walk)
    got = chunks.row_index(df, ["series"], "sec", 300, total="n").toPandas()
    want = walk.sort_values(["series", "sec"])
    got = got.sort_values(["series", "sec"])
    assert (got["idx"].to_numpy() == want.groupby("series").cumcount().to_numpy()).all()
    assert (got["n"] == 900).all()
    run = chunks.running_columns(df, ["series"], "sec", 300, {"s": F.col("btc_mid")}).toPandas()
    run = run.sort_values(["series", "sec"])["s"].to_numpy()
    assert np.allclose(run, want.groupby("series")["btc_mid"].cumsum().to_numpy())


def live_scorer(points, g, sigma):
    """A plain one-series scorer: bars closed by the first point of a minute, then features."""
    seen, bars, last_minute, out_bars, out = {}, [], -1, [], []
    for sec, mid, prob in points:
        seen[sec] = (mid, prob)
        if sec // 60 > last_minute:
            last_minute = sec // 60
            at = last_minute * 60
            pick = lambda stale, leg: next(
                (seen[s][leg] for s in range(at, at - stale - 1, -1) if s in seen), None
            )
            bar = (at, pick(g.spot_stale, 0), pick(g.prob_stale, 1))
            if None not in bar:
                bars.append(bar)
                out_bars.append(bar)
        kept = bars[-12:]
        last10 = kept[-10:]
        if len(last10) == 10 and all(b[0] - a[0] == 60 for a, b in zip(last10, last10[1:])):
            rets = [np.log(last10[i][1] / last10[i - 5][1]) for i in range(5, 10)]
            out.append((sec, "exact", last10[-1][2], last10[-1][2] - last10[-6][2], np.std(rets, ddof=1)))
            continue
        path = list(kept)
        if not path or path[-1][0] < sec:
            path.append((sec, mid, prob))
        anchor = next((b[2] for b in reversed(path) if b[0] <= sec - 300), path[0][2])
        rets = [np.log(b[1] / a[1]) for a, b in zip(path, path[1:])][-5:]
        vol = max(np.std(rets, ddof=1) * 5**0.5, sigma / 4) if len(rets) >= 2 else sigma
        out.append((sec, "warm", prob, prob - anchor, vol))
    return out_bars, out


def test_bars_and_live_features_against_a_plain_scorer(spark, walk):
    g = Grains(chunk_rows=16)
    points = spark.createDataFrame(walk)
    bars = features.minute_bars(points, g)
    got_bars = bars.toPandas().sort_values(["series", "t"])
    got = features.live_features(points, bars, 0.0005, g).toPandas().sort_values(["series", "sec"])
    assert set(got["feature_mode"]) == {"warm", "exact"}
    for s, part in walk.groupby("series"):
        rows = [tuple(r) for r in part[["sec", "btc_mid", "poly_p_up"]].itertuples(index=False)]
        want_bars, want = live_scorer(rows, g, 0.0005)
        mine = got_bars[got_bars["series"] == s]
        assert [tuple(r) for r in mine[["t", "btc_mid", "poly_p_up"]].itertuples(index=False)] == want_bars
        mine = got[got["series"] == s]
        assert list(mine["feature_mode"]) == [w[1] for w in want]
        assert np.allclose(mine[["x_prob", "x_change", "x_vol"]], [w[2:] for w in want])


def test_training_table_against_pandas(spark):
    """Whole-series pandas resample / ffill / reindex / rolling on a live-grain feed."""
    rng = np.random.default_rng(11)
    base = pd.Timestamp("2024-03-01", tz="UTC")
    n = 20_000
    spot_t = np.sort(rng.uniform(30, 9_000, n // 8))
    prob_t = np.sort(rng.uniform(0, 7_000, 160))
    ticks = pd.DataFrame(
        {
            "ts": list(base + pd.to_timedelta(spot_t, unit="s")) + list(base + pd.to_timedelta(prob_t, unit="s")),
            "price": np.concatenate([rng.uniform(90, 110, len(spot_t)), rng.uniform(0.1, 0.9, len(prob_t))]),
            "source": ["binance"] * len(spot_t) + ["polymarket"] * len(prob_t),
            "type": ["bookTicker"] * len(spot_t) + ["price_change"] * len(prob_t),
            "ident": ["btcusdt"] * len(spot_t) + ["tok"] * len(prob_t),
            "asset": "BTC",
            "market_slug": [None] * len(spot_t) + ["btc-updown-5m-1"] * len(prob_t),
            "market_outcome": [None] * len(spot_t) + ["Up"] * len(prob_t),
        }
    )
    # remove a stretch, so the grid has holes
    ticks = ticks[~((ticks["ts"] > base + pd.Timedelta("40min")) & (ticks["ts"] < base + pd.Timedelta("44min")))]

    def leg(source, limit):
        s = ticks[ticks["source"] == source].sort_values("ts").set_index("ts")["price"]
        return s.resample("1s").last().ffill(limit=limit)

    spot, prob = leg("binance", 10), leg("polymarket", 120)
    grid = pd.date_range(spot.index.min().ceil("1min"), spot.index.max().floor("1min"), freq="1min")
    want = pd.DataFrame({"btc_mid": spot.reindex(grid), "poly_p_up": prob.reindex(grid)})
    want["btc_return_5m"] = np.log(want["btc_mid"] / want["btc_mid"].shift(5))
    want["btc_volatility_5m"] = want["btc_return_5m"].rolling(5).std()
    want["poly_p_up_change_5m"] = want["poly_p_up"] - want["poly_p_up"].shift(5)
    want["log_return_5m"] = np.log(want["btc_mid"].shift(-5) / want["btc_mid"])
    want = want.dropna()

    got = resample.build_training_table(spark.createDataFrame(ticks), Grains(chunk_rows=16)).toPandas()
    got = got.sort_values("t")
    assert len(want) > 30 and list(got["t"]) == [int(t.timestamp()) for t in want.index]
    assert np.allclose(got[list(want.columns)], want, atol=1e-12)


def test_percentiles_from_brackets(spark):
    """Short lists force several rounds; one group holds most rows, one has a single value."""
    from marketlake.operators.quantiles import exact_percentiles

    rng = np.random.default_rng(3)
    groups = {"hot": rng.lognormal(0, 3, 6000), "few": rng.normal(size=37), "one": np.array([4.0]),
              "ties": np.repeat([1.0, 2.0, 3.0], 400), None: rng.normal(size=501)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame([*rows, ("few", None)], "g string, v double")
    want = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ("g",), "v", want, listed=16).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose([got[g][n] for n in want], np.quantile(vs, list(want.values())))
    (whole,) = exact_percentiles(df, (), "v", want, listed=16).collect()
    assert np.allclose(list(whole), np.quantile([v for _, v in rows], list(want.values())))


def test_percentiles_of_odd_values(spark):
    from marketlake.operators.quantiles import exact_percentiles, summary_with_percentiles, value_cells

    nan = float("nan")
    rows = [("nan", nan)] * 3 + [("mix", v) for v in (nan, 1.0, -0.0, 0.0, float("inf"))] + [("none", None)] * 2
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, ("g",), "v", {"p0": 0.0, "p50": 0.5, "p75": 0.75}, listed=1).collect()}
    assert set(got) == {"nan", "mix"} and all(np.isnan(got["nan"][n]) for n in ("p0", "p50"))
    assert (got["mix"]["p0"], got["mix"]["p50"], got["mix"]["p75"]) == (0.0, 1.0, float("inf"))
    out = {r["g"]: r for r in summary_with_percentiles(df, ("g",), "v", {"p50": 0.5}).collect()}
    assert (out["none"]["n"], out["none"]["p50"], out["mix"]["n"]) == (0, None, 5)
    (empty,) = summary_with_percentiles(df.limit(0), (), "v", {"p50": 0.5}).collect()
    assert (empty["n"], empty["p50"]) == (0, None)
    assert summary_with_percentiles(df.limit(0), ("g",), "v", {"p50": 0.5}).count() == 0
    # a value that fills a group is one cell
    assert value_cells(spark.range(5000).selectExpr("7.0D AS v"), (), "v").count() == 1


def test_percentiles_scan_once_and_sort_no_group(spark, tmp_path):
    """One pass over the source, and no window."""
    from marketlake.operators.quantiles import summary_with_percentiles

    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scans.add(len(batch))
            yield batch

    df = spark.range(20_000).selectExpr("id % 3 AS g", "cast(hash(id) AS double) AS v").mapInPandas(seen, "g long, v double")
    out = summary_with_percentiles(df, ("g",), "v", {"p10": 0.1, "p90": 0.9})
    got = {r["g"]: r for r in out.collect()}
    assert scans.value == 20_000 and "Window" not in plan_of(out)
    values = spark.range(20_000).selectExpr("id % 3 AS g", "cast(hash(id) AS double) AS v").toPandas()
    for g, own in values.groupby("g")["v"]:
        r = got[g]
        assert np.allclose([r["n"], r["mean"], r["std"], r["min"], r["max"]], [len(own), own.mean(), own.std(), own.min(), own.max()])
        assert np.allclose([r["p10"], r["p90"]], np.quantile(own, [0.1, 0.9]))


def test_throttle_is_one_per_second(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 1.0), ("a", 2, 5.0)], "k string, sec bigint, v double")
    assert sorted((r["sec"], r["v"]) for r in features.throttle(df, ["k"], "sec").collect()) == [(1, 1.0), (2, 5.0)]


def test_windows_never_span_a_whole_series(spark, walk):
    """Every ordered step is partitioned by (series, chunk)."""
    points = spark.createDataFrame(walk)
    for df in (
        features.bar_features(features.minute_bars(points)),
        features.carry_forward(points.withColumnsRenamed({"series": "asset", "poly_p_up": "poly_prob"})),
    ):
        plan = plan_of(df)
        specs = [line for line in plan.splitlines() if "windowspecdefinition" in line]
        assert specs and all("_chunk" in line for line in specs)


def test_tick_reductions_are_hash_aggregates(spark, sf):
    from marketlake.plans.queries import _ticks

    ticks = _ticks(spark, sf)
    for df in (resample.minute_cells(ticks), resample.last_per_bucket(ticks), stats.forecast_stats(ticks)):
        plan = plan_of(df)
        assert "HashAggregate" in plan and "SortAggregate" not in plan
        # one shuffle by key; the small test file is also dealt out to the cores
        assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz" in plan_of(resample.minute_cells(ticks))


def test_throttle_counts_from_the_last_row_kept(spark):
    import random

    rng = random.Random(1)
    rows = [(k, t) for k in ("a", "b", None) for t in sorted(rng.sample(range(4000), 600))]
    df = spark.createDataFrame([(k, t, float(t)) for k, t in rows], "k string, sec long, v double")
    for interval, chunk in ((7, 10), (60, 100), (500, 100)):
        want, last = [], {}
        for k, t in rows:
            if k not in last or t - last[k] >= interval:
                last[k] = t
                want.append((k, t))
        got = [(r["k"], r["sec"]) for r in features.throttle(df, ["k"], "sec", interval, chunk).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_asof_join_with_microseconds_copies_no_row_far(spark):
    from marketlake.operators.asof import asof_join

    second = 1_000_000
    right = spark.createDataFrame([("k", i * 30 * second, i) for i in range(50)], "k string, t long, v int")
    left = spark.createDataFrame([("k", i * 47 * second) for i in range(40)], "k string, t long")
    joined = asof_join(left, right, ["k"], "t", ["v"], 60 * second)
    assert {r["t"]: r["v"] for r in joined.collect()} == {i * 47 * second: min(i * 47 // 30, 49) if i * 47 - min(i * 47 // 30, 49) * 30 <= 60 else None for i in range(40)}
