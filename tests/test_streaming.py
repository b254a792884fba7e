"""Streams against their batch form, across micro-batches and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from marketlake.operators import arma, features, stats
from marketlake.operators.normalize import normalize_ticks
from marketlake.operators.resample import Grains
from marketlake.schemas import TOPIC_FORECAST, TOPIC_STATS
from marketlake.sources import envelope, forecasts
from marketlake.sources.ticks import read_ticks, tick_source
from marketlake.streaming import pipeline, state, timers
from marketlake.streaming.pipeline import DRAIN, PipelineConfig

START = 1_704_067_200


def messages(first: int, last: int, step: int = 2):
    """Quotes and up-probabilities of one asset, one of each every `step` seconds."""
    out = []
    for i, t in enumerate(range(first, last, step)):
        mid = 100.0 + (i * 7 % 13)
        out.append(
            (
                "binance.book",
                {"source": "binance", "type": "bookTicker", "recv_ts": START + t + 0.25, "symbol": "btcusdt",
                 "payload": {"b": str(mid - 1), "a": str(mid + 1), "B": "1", "A": "2"}},
            )
        )
        if i % 5 == 0:
            out.append(
                (
                    "polymarket.events",
                    {"source": "polymarket", "type": "price_change", "recv_ts": START + t + 0.5,
                     "asset_id": "tok", "market": {"slug": "btc-updown-5m-1", "outcome": "Up"},
                     "payload": {"price": str(0.3 + (i % 4) / 10)}},
                )
            )
    return out


def land(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"topic": topic, "key": "k", "value": json.dumps(body)}) for topic, body in rows]
    (folder / name).write_text("\n".join(lines))


def batch_ticks(spark, folder):
    raw = spark.read.schema("topic string, key string, value string").json(str(folder))
    return normalize_ticks(envelope.parse_envelope(raw))


def run(spark, folder, out):
    config = PipelineConfig(output=f"{out}/out", checkpoint=f"{out}/checkpoint", trigger=DRAIN, salts=1)
    raw = tick_source(spark, "files", str(folder))
    ticks = normalize_ticks(envelope.parse_envelope(raw))
    # drained one after the other: the last hop reads what the one before has written
    first = [
        pipeline.sink_ticks(ticks, f"{config.output}/ticks", config.checkpoint, DRAIN, 1),
        pipeline.sink_messages(
            pipeline.stats_messages(stats.windowed_stats(ticks, config.window, config.watermark)),
            "stats", TOPIC_STATS, config.checkpoint, "files", config.output, DRAIN,
        ),
        pipeline.sink_forecast_points(ticks, config, DRAIN),
    ]
    pipeline.drain(first)
    carried = forecasts.forecast_messages(pipeline.live_forecast(spark, config)).withColumn(
        "ts", F.get_json_object("value", "$.ts")
    )
    pipeline.drain(
        [pipeline.sink_messages(carried, "forecast", TOPIC_FORECAST, config.checkpoint, "files",
                                config.output, DRAIN, order_by="ts")]
    )
    return config


def published(spark, config, topic):
    return spark.read.option("recursiveFileLookup", "true").json(f"{config.output}/{topic}")


def rounded(row) -> str:
    """The message with floats cut to ten digits: partial sums merge in another order."""
    body = json.loads(row["value"])
    return json.dumps({k: round(v, 10) if isinstance(v, float) else v for k, v in body.items()})


def test_pipeline_restart_equals_one_run(spark, tmp_path):
    rows = messages(0, 400)
    land(tmp_path / "whole", "a.json", rows)
    land(tmp_path / "parts", "a.json", [r for r in rows if r[1]["recv_ts"] < START + 200])
    once = run(spark, tmp_path / "whole", tmp_path / "once")
    run(spark, tmp_path / "parts", tmp_path / "twice")
    land(tmp_path / "parts", "b.json", [r for r in rows if r[1]["recv_ts"] >= START + 200])
    twice = run(spark, tmp_path / "parts", tmp_path / "twice")

    for topic in (TOPIC_STATS, TOPIC_FORECAST):
        a, b = (sorted(map(rounded, published(spark, c, topic).collect())) for c in (once, twice))
        assert a and a == b
    assert read_ticks(spark, f"{once.output}/ticks").count() == len(rows)
    assert read_ticks(spark, f"{twice.output}/ticks").count() == len(rows)

    # batch ≡ stream on the seconds the 10 s watermark has closed
    batch = stats.forecast_stats(batch_ticks(spark, tmp_path / "whole")).withColumn(
        "sec", F.col("ts").cast("bigint")
    )
    last = max(r[1]["recv_ts"] for r in rows)
    closed = batch.where(F.col("sec") + 1 <= F.lit(last - 10))
    want = {
        (r["sec"], r["btc_mid"], r["poly_prob"], r["forecast"])
        for r in features.carry_forward(closed).collect()
    }
    body = "ts string, btc_mid double, poly_prob double, forecast double"
    got = published(spark, once, TOPIC_FORECAST).select(F.from_json("value", body).alias("m"))
    got = {
        (r["sec"], r["btc_mid"], r["poly_prob"], r["forecast"])
        for r in got.select(
            F.unix_timestamp(F.to_timestamp("m.ts")).alias("sec"), "m.btc_mid", "m.poly_prob", "m.forecast"
        ).collect()
    }
    assert got == want


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    land(tmp_path / "in", "a.json", messages(0, 300))
    ticks = lambda: normalize_ticks(
        envelope.parse_envelope(tick_source(spark, "files", str(tmp_path / "in"), options={"maxFilesPerTrigger": "1"}))
    )
    sink = {"format": "parquet", "path": str(tmp_path / "out")}

    def drain():
        rows = stats.windowed_stats(ticks(), "1 minute", "30 seconds")
        pipeline.drain([pipeline.run_stream(rows, "late", str(tmp_path / "cp"), sink, trigger=DRAIN)])
        return spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))

    before = drain().where("source = 'binance'").agg(F.sum("n"), F.max("window_end")).first()
    land(tmp_path / "in", "b.json", messages(0, 60) + messages(300, 420))
    after = drain().where("source = 'binance'")
    # windows 0-4 hold 30 quotes each; the repeated first minute came too late to count again
    first = after.where(F.col("window_start") == F.lit(START).cast("timestamp")).agg(F.sum("n")).first()[0]
    assert first == 30
    assert after.agg(F.sum("n")).first()[0] > before[0]


@pytest.fixture(scope="module")
def params(spark):
    row = ("BTC", "ok", 100, 2, 1, 0.0, 0.01, [0.02, 0.01, 0.3], [0.5, -0.2], [0.3],
           ["poly_p_up", "poly_p_up_change_5m", "btc_volatility_5m"], "log_return_5m")
    return spark.createDataFrame([row], arma.PARAMS_DDL)


def test_scorer_stream_in_two_runs_equals_batch(spark, tmp_path, params):
    from marketlake.operators.score import score_batch

    points = [("BTC", START + t, 100.0 + (t * 7 % 13), 0.3 + (t % 40) / 100) for t in range(0, 2400, 4)]
    df = spark.createDataFrame(points, "asset string, sec bigint, btc_mid double, poly_prob double")
    extra = ("log_return", "drift", "forecast", "sigma", "sigma_log")
    text = forecasts.forecast_messages(df.withColumns({c: F.lit(None).cast("double") for c in extra}))
    rows = [r.asDict() for r in text.collect()]
    g = Grains(chunk_rows=16)
    folder, sink = tmp_path / "in", {"format": "parquet", "path": str(tmp_path / "out")}
    folder.mkdir()
    for name, part in (("a", rows[:333]), ("b", rows[333:])):
        (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in part))
        raw = spark.readStream.schema("key string, value string").json(str(folder))
        scored = state.score_stream(forecasts.read_forecast_points(raw), params, g)
        pipeline.drain([pipeline.run_stream(scored, "score", str(tmp_path / "cp"), sink, trigger=DRAIN)])
    got = spark.read.schema(scored.schema).parquet(str(tmp_path / "out")).toPandas().sort_values("ts_unix")
    batch = df.select(F.col("asset").alias("series"), "sec", "btc_mid", F.col("poly_prob").alias("poly_p_up"))
    want = score_batch(batch, features.minute_bars(batch, g), params, g, chunk=16).toPandas().sort_values("ts_unix")
    assert len(got) == len(points) == len(want)
    assert list(got["feature_mode"]) == list(want["feature_mode"])
    for c in ("log_return_pred", "sarimax_forecast", "sarimax_prob_up"):
        assert abs(got[c].to_numpy() - want[c].to_numpy()).max() < 1e-9


def test_kafka_is_asked_for_what_the_pipeline_needs(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        tick_source(spark, "kafka", "nowhere:9092")
    with pytest.raises(ValueError):
        tick_source(spark, "carrier pigeon", "x")


def test_run_pipeline_starts_all_queries(spark, tmp_path):
    """All queries run side by side; the second forecast hop may start before the first has written."""
    land(tmp_path / "in", "a.json", messages(0, 120))
    config = PipelineConfig(
        output=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), salts=1,
        trigger={"processingTime": "500 milliseconds"},
    )
    queries = pipeline.run_pipeline(tick_source(spark, "files", str(tmp_path / "in")), config)
    try:
        assert [q.name for q in queries] == ["ticks", "stats", "forecast_points", "forecast"]
        for q in queries:
            q.processAllAvailable()
        assert all(q.exception() is None for q in queries)
    finally:
        for q in queries:
            q.stop()
    assert read_ticks(spark, f"{config.output}/ticks").count() == len(messages(0, 120))
    assert published(spark, config, TOPIC_FORECAST).count() > 0


def test_idle_series_are_forgotten(spark, tmp_path):
    """A series behind the stream by more than its idle time loses its state; late rows are reported."""
    ddl = "asset string, ts double, btc_mid double, poly_prob double"
    parts = [
        [("A", START + 0.0, 100.0, 0.5), ("B", START + 0.0, 10.0, 0.4)],
        # B moves on for two hours, then twice more, so that A's timer has passed
        [("B", START + 7200.0, 11.0, 0.4)],
        [("B", START + 7300.0, 12.0, 0.4)],
        # A speaks again: nothing is known of it; one row comes far too late
        [("A", START + 7301.0, None, 0.6), ("B", START + 10.0, 1.0, 0.1)],
    ]
    sink = {"format": "parquet", "path": str(tmp_path / "out")}
    dropped = 0
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
        points = spark.readStream.schema(ddl).parquet(str(tmp_path / "in/*"))
        carried = state.carry_forward_stream(points, prob_stale=10**6, spot_stale=10**6, idle_ms=60_000, lateness="10 minutes")
        query = pipeline.run_stream(carried, "idle", str(tmp_path / "cp"), sink, trigger=DRAIN)
        pipeline.drain([query])
        dropped += sum(
            op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators
        )
    got = {(r["asset"], r["sec"] - START): r["btc_mid"] for r in spark.read.schema(carried.schema).parquet(str(tmp_path / "out")).collect()}
    assert got[("A", 0)] == 100.0 and got[("B", 7300)] == 12.0
    assert got[("A", 7301)] is None
    assert ("B", 10) not in got and dropped == 1


def test_backlog_in_several_micro_batches(spark, tmp_path, params):
    """Whatever the bound on a micro-batch, the scores are the same."""
    points = [("BTC", START + t, 100.0 + (t * 7 % 13), 0.3 + (t % 40) / 100) for t in range(0, 1500, 5)]
    df = spark.createDataFrame(points, "series string, sec long, btc_mid double, poly_p_up double")
    for i in range(5):
        df.where(f"sec >= {START + i * 300} AND sec < {START + (i + 1) * 300}").coalesce(1).write.parquet(
            str(tmp_path / f"in/part={i}")
        )
    results = []
    for bound in (1, 100):
        raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", bound).parquet(str(tmp_path / "in/*"))
        scored = state.score_stream(raw, params, Grains(chunk_rows=16))
        sink = {"format": "parquet", "path": str(tmp_path / f"out{bound}")}
        pipeline.drain([pipeline.run_stream(scored, f"score{bound}", str(tmp_path / "cp"), sink, trigger=DRAIN)])
        rows = spark.read.schema(scored.schema).parquet(sink["path"]).collect()
        results.append(sorted((r["ts_unix"], r["feature_mode"], round(r["log_return_pred"], 12)) for r in rows))
    assert results[0] == results[1] and len(results[0]) == len(points)


def test_timed_bars_over_batches_and_a_restart(spark, tmp_path):
    """Legs apart, gaps, NULLs, ties and late rows: the bars of the batch operator, and no state for silent keys."""
    g = Grains(spot_stale=150, prob_stale=400)
    rows = [
        (f"s{k}", START + t, 100.0 + t if t % 3 else None, 0.4 if t % 70 == k else None)
        for k in range(3)
        for t in [*range(k, 900, 7), *range(2500, 2600 + 400 * k, 11)]
    ]
    cuts = (START + 500, START + 905, START + 2700, START + 10_000)
    schema = "series string, sec long, btc_mid double, poly_p_up double"
    late = [("s0", START + 3, 1.0, 0.9)]  # behind the watermark by then
    start = START
    for i, end in enumerate(cuts):
        part = [r for r in rows if start <= r[1] < end]
        spark.createDataFrame(part + (late if i == 2 else []), schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        sink = {"format": "parquet", "path": f"{tmp_path}/out"}
        bars = timers.timed_bars(stream, g, lateness="30 seconds")
        pipeline.drain([pipeline.run_stream(bars, "bars", f"{tmp_path}/checkpoint", sink, trigger=DRAIN)])
        start = end
    last = max(r[1] for r in rows) - 30
    wanted = features.minute_bars(spark.createDataFrame(rows, schema), g, opened=False).where(f"t <= {last}")
    got = spark.read.parquet(f"{tmp_path}/out").select(wanted.columns)
    assert sorted(got.collect()) == sorted(wanted.collect()) and got.count() > 40
    held = {r["key"]["series"] for r in timers.open_state(spark, f"{tmp_path}/checkpoint/bars").collect()}
    newest = {k: max(r[1] for r in rows if r[0] == k) for k in ("s0", "s1", "s2")}
    assert held == {k for k, sec in newest.items() if last // 60 * 60 + 60 - sec <= 400}


def test_minutes_close_in_order():
    g = Grains(spot_stale=100, prob_stale=200)
    minutes = [(60, (1.0, 55, 0.5, 50)), (120, (2.0, 110, None, None)), (6000, (3.0, 5999, 0.7, 6000))]
    bars, legs, at = timers.close_minutes(timers.NOTHING, 0, minutes, 6100, g)
    assert bars == [(60, 1.0, 0.5), (120, 2.0, 0.5), (180, 2.0, 0.5), (6000, 3.0, 0.7), (6060, 3.0, 0.7)]
    assert legs == (3.0, 5999, 0.7, 6000) and at == 6060
    assert timers.close_minutes(legs, at, [], 60_000, g) == ([], timers.NOTHING, 6180)


def test_throttled_stream_equals_batch(spark, tmp_path):
    """Rows out of order, repeated in a later batch, two in one second, NULLs: the rows of the batch operator."""
    schema = "series string, sec long, price double, note long"
    rows = [
        (f"s{k}", START + t, None if t % 11 == 0 else float(t % 13), t % 4 if t % 5 else None)
        for k in range(3)
        for t in (i * 37 % 901 + 901 * (i // 901) for i in range(0, 2500, k + 1))
    ] + [("s0", START + 50, 0.0, 9), ("s9", START + 5, 1.0, 1)]
    parts = [rows[0::2], rows[1::2], rows[0:900:3]]  # the second and third come late and repeat
    sink = {"format": "parquet", "path": f"{tmp_path}/out"}
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        kept = timers.throttle_stream(stream, ["series"], "sec", 30, lateness="1 hour")
        pipeline.drain([pipeline.run_stream(kept, "kept", f"{tmp_path}/checkpoint", sink, trigger=DRAIN)])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 0  # the watermark has not come so far
    spark.createDataFrame([("s1", START + 100_000, 1.0, 1)], schema).write.parquet(f"{tmp_path}/in/part=9")
    pipeline.drain([pipeline.run_stream(kept, "kept", f"{tmp_path}/checkpoint", sink, trigger=DRAIN)])
    wanted = features.throttle(spark.createDataFrame(rows, schema), ["series"], "sec", 30, chunk=300)
    got = spark.read.parquet(f"{tmp_path}/out").select(wanted.columns)
    assert sorted(got.collect(), key=repr) == sorted(wanted.collect(), key=repr) and got.count() > 200
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/checkpoint/kept")
    assert held.count() == 0  # the last row of s1 still waits, but holds nothing back yet


def test_single_partition_is_sorted_before_its_one_task(spark, tmp_path):
    """One file in order, written by a task that sorts nothing."""
    rows = [("k", f"{i * 7919 % 1000:04d}", "x" * 20) for i in range(1000)] + [("k", None, "n")]
    spark.createDataFrame(rows, "key string, ts string, value string").repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts string, value string").parquet(f"{tmp_path}/in")
    sent = stream.withColumn("value", F.coalesce("ts", "value"))
    pipeline.drain(
        [pipeline.sink_messages(sent, "one", "t", f"{tmp_path}/checkpoint", "files", str(tmp_path), DRAIN, "ts", True)]
    )
    (file,) = (tmp_path / "t").rglob("*.json")
    assert [json.loads(x)["value"] for x in file.read_text().splitlines()] == ["n", *(f"{i:04d}" for i in range(1000))]
    batch = spark.read.schema("key string, ts string, value string").parquet(f"{tmp_path}/in")
    plan = pipeline._in_one_partition(batch, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" in plan and "Sort [ts" not in plan


def test_files_in_order_over_blocks(spark):
    from marketlake.plans.queries import _files_in_order

    def found(*rows):
        schema = "file string, block long, t string, line long"
        return tuple(_files_in_order(spark.createDataFrame(list(rows), schema)).first())

    assert found(("a", 0, "1", 5), ("a", 0, "2", 6), ("a", 9, "2", 0), ("b", 0, "1", 8)) == (2, 4, True)
    assert found(("a", 0, "1", 5), ("a", 0, "3", 6), ("a", 9, "2", 0)) == (1, 3, False)
    assert found(("a", 0, "2", 5), ("a", 0, "1", 6)) == (1, 2, False)
    assert found(("a", 0, "2", 5), ("a", 0, None, 6), ("a", 9, None, 1)) == (1, 3, True)
    assert found(("a", 0, None, 5), ("a", 9, "1", 1)) == (1, 2, False)
    assert found() == (0, None, None)


def test_cuts_land_as_several_files(spark, sf, monkeypatch):
    """Each cut of a stream is one micro-batch, whatever its files."""
    from marketlake.plans import queries

    seen = []

    def land(batch, batch_id):
        seen.append((batch.count(), batch.rdd.getNumPartitions()))

    cuts = lambda events: [events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")]
    base = queries.work_dir(spark, "cuts")
    queries._parts(
        spark, sf, cuts, lambda ticks: pipeline.run_stream(ticks, "cuts", base, trigger=DRAIN, each_batch=land)
    )
    assert len(seen) == 2 and all(parts > 1 for _, parts in seen)


def test_throttle_state_has_an_entry_per_stretch(spark, tmp_path):
    rows = [("s", 7200 + t, 1.0) for t in range(0, 3600, 4)]
    spark.createDataFrame(rows, "series string, sec long, price double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("series string, sec long, price double").parquet(f"{tmp_path}/in")
    kept = timers.throttle_stream(stream, ["series"], "sec", 30, lateness="2 hours")
    sink = {"format": "parquet", "path": f"{tmp_path}/out"}
    pipeline.drain([pipeline.run_stream(kept, "kept", f"{tmp_path}/checkpoint", sink, trigger=DRAIN)])
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/checkpoint/kept")
    assert held.count() == 1
