"""Hand-written messages, frames and catalogues."""

import json

import pytest
from pyspark.sql import functions as F

from marketlake.operators.normalize import normalize_ticks
from marketlake.sources import catalogue, envelope, forecasts, frames, models, ticks


def texts(spark, *rows, column="raw"):
    return spark.createDataFrame([(r,) for r in rows], f"{column} string")


def test_spot_frames(spark):
    raw = texts(
        spark,
        '{"stream":"btcusdt@aggTrade","data":{"p":"75000.10","q":"0.02","m":true,"T":1776670201123}}',
        '{"stream":"btcusdt@bookTicker","data":{"b":"75000.0","B":"1.2","a":"75000.2","A":"0.9"}}',
        '{"stream":"ethusdt@depth20@100ms","data":{"bids":[["3000.1","2"]],"asks":[]}}',
        '{"stream":"","data":{}}',
        '{"stream":"nosplit","data":{}}',
        "not json",
    )
    rows = frames.decode_spot_frames(raw).orderBy("symbol", "type").collect()
    assert [(r["symbol"], r["type"], r["topic"]) for r in rows] == [
        ("btcusdt", "aggTrade", "binance.trades"),
        ("btcusdt", "bookTicker", "binance.book"),
        ("ethusdt", "depth20@100ms", "binance.book"),
        ("nosplit", "", "binance.book"),
    ]
    assert (rows[1]["payload"]["b"], rows[1]["payload"]["B"]) == ("75000.0", "1.2")


BOOK = json.dumps(
    [
        {
            "event_type": "price_change",
            "price_changes": [
                {"asset_id": "1", "price": "0.55", "size": "10", "side": "BUY", "best_bid": "0.54"},
                {"asset_id": "", "price": "0.1"},
                {"asset_id": "2", "price": "0.45", "size": "5", "side": "SELL"},
            ],
        },
        {"event_type": "book", "asset_id": "1", "bids": [{"price": "0.54", "size": "3"}], "asks": [],
         "last_trade_price": "0.55"},
        {"event_type": "tick_size_change", "asset_id": "1"},
    ]
)
TRADE = '{"type":"last_trade_price","asset_id":"2","price":"0.44","size":"1","side":"SELL"}'


def test_book_frames(spark):
    raw = texts(spark, BOOK, TRADE, "{broken", '{"asset_id":"9"}')
    rows = frames.flatten_book_frames(raw, drop_noise=True).collect()
    assert sorted((r["type"], r["asset_id"], r["payload"]["price"]) for r in rows if r["type"] != "?") == [
        ("book", "1", None),
        ("last_trade_price", "2", "0.44"),
        ("price_change", "1", "0.55"),
        ("price_change", "2", "0.45"),
    ]
    assert [r["asset_id"] for r in rows if r["type"] == "?"] == ["9"]
    assert frames.flatten_book_frames(raw).count() == 6


def test_top_of_book_with_an_empty_side(spark):
    (row,) = frames.top_of_book(texts(spark, BOOK, TRADE)).collect()
    assert (row["best_bid"], row["bid_depth"], row["best_ask"], row["ask_depth"]) == (0.54, 1, None, 0)


def test_token_map(spark):
    rows = [
        (1, "Q1", "btc-updown-5m-300", '["t1","t2"]', '["Up","Down"]'),
        (2, "Q2", "eth-updown-5m-300", '["t3","t4"]', '["Up"]'),
        (3, "Q3", "bad", "[oops", '["Up"]'),
        (4, "Q4", "later", '["t1"]', None),
    ]
    cat = spark.createDataFrame(
        rows, "position int, question string, slug string, clobTokenIds string, outcomes string"
    )
    got = {r["asset_id"]: (r["question"], r["outcome"]) for r in catalogue.token_map(cat).collect()}
    assert got == {"t1": ("Q4", None), "t2": ("Q1", "Down"), "t3": ("Q2", "Up"), "t4": ("Q2", None)}


def message(kind, payload, source="binance", **extra):
    return json.dumps({"source": source, "type": kind, "recv_ts": 1704067200.5, "payload": payload, **extra})


def test_prices_and_rejects(spark):
    up = {"asset_id": "1", "market": {"slug": "btc-updown-5m-1704067200", "outcome": "Up"}}
    good = [
        message("aggTrade", {"p": "101.5"}, symbol="btcusdt"),
        message("bookTicker", {"b": "1", "B": "7", "a": "3", "A": "9"}, symbol="ETHUSDT"),
        message("book", {"last_trade_price": "0.55"}, "polymarket", **up),
        message("price_change", {"price": "0.3"}, "polymarket", asset_id="1"),
    ]
    dropped = [
        message("aggTrade", {"p": "abc"}, symbol="btcusdt"),
        message("aggTrade", {"p": "0"}, symbol="btcusdt"),
        message("aggTrade", {"p": "-1"}, symbol="btcusdt"),
        message("kline", {"p": "5"}, symbol="btcusdt"),
    ]
    bad = ["{oops", '{"source":"binance"}', None]
    raw = texts(spark, *good, *dropped, *bad, column="value").withColumn("topic", F.lit("t"))
    rows = normalize_ticks(envelope.parse_envelope(raw)).collect()
    got = {(r["type"], r["asset"], r["series"], r["price"], r["price_bucket"]) for r in rows}
    assert got == {
        ("aggTrade", "BTC", "BTCUSDT", 101.5, 100.0),
        ("bookTicker", "ETH", "ETHUSDT", 2.0, 0.0),
        ("book", "BTC", "BTC Up", 0.55, 0.5),
        ("price_change", None, None, 0.3, 0.3),
    }
    assert {r["date"] for r in rows} == {"2024-01-01"} and {r["hour"] for r in rows} == {0}
    rejects = {(r["raw"], r["reason"]) for r in envelope.parse_rejects(raw).collect()}
    assert rejects == {("{oops", "malformed"), ('{"source":"binance"}', "incomplete")}


def test_forecast_points(spark):
    raw = texts(
        spark,
        '{"asset":"BTC","ts":"2024-01-01T00:00:01.900Z","btc_mid":1.0,"poly_prob":"0.5"}',
        '{"asset":"BTC","ts_unix":7.9,"ts":"x","btc_mid":2,"poly_prob":0.25}',
        '{"asset":"BTC","ts":"9","btc_mid":"NaN","poly_prob":0.25}',
        '{"asset":"BTC","ts":"9","poly_prob":0.25}',
        '{"asset":"BTC","ts":"soon","btc_mid":1,"poly_prob":0.25}',
        "nope",
        column="value",
    )
    got = {(r["sec"], r["btc_mid"], r["poly_p_up"]) for r in forecasts.read_forecast_points(raw).collect()}
    assert got == {(1704067201, 1.0, 0.5), (7, 2.0, 0.25)}


def test_sigma_lookup(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "series string")
    meta = spark.createDataFrame([("a", "0.001"), ("b", "text"), ("c", "50")], "series string, sigma_log string")
    got = dict(models.sigma_lookup(keys, meta).collect())
    assert got == {"a": 0.001, "b": 0.0005, "c": 0.0005, "d": 0.0005}


def test_model_with_other_features_is_refused(spark, tmp_path):
    row = ("s", "ok", 1, 1, 0, 0.0, 0.1, [1.0], [0.5], [], ["other"], "y")
    models.save_model(spark.createDataFrame([row], models.PARAMS_DDL), str(tmp_path))
    with pytest.raises(Exception, match="feature mismatch"):
        models.load_model(spark, str(tmp_path)).select("exog").collect()


def test_archive_skips_empty_files_and_prunes(spark, tmp_path):
    root = str(tmp_path / "ticks")
    raw = texts(
        spark, message("aggTrade", {"p": "1"}, symbol="btcusdt"), column="value"
    ).withColumn("topic", F.lit("t"))
    ticks.write_ticks(normalize_ticks(envelope.parse_envelope(raw)), root)
    (tmp_path / "ticks/source=binance/date=2024-01-01/hour=0/left.parquet").write_bytes(b"")
    rows = ticks.read_ticks(spark, root).where((F.col("source") == "binance") & (F.col("price") > 0))
    assert [(r["ident"], r["hour"]) for r in rows.collect()] == [("btcusdt", 0)]
    plan = rows.select("ts")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "GreaterThan(price,0.0)" in plan
    assert "market_slug" not in plan.split("ReadSchema")[1]


def test_compaction_replaces_only_its_dates(spark, tmp_path):
    from marketlake.sources.ticks import compact_ticks, read_ticks, write_ticks

    days = [f"2024-01-0{d}" for d in range(1, 5)]
    rows = [(d, h, i) for d in days for h in range(2) for i in range(30)]
    ticks = spark.createDataFrame(rows, "date string, hour int, i int").selectExpr(
        "'aggTrade' AS type", "'btcusdt' AS ident", "'BTC' AS asset", "'BTCUSDT' AS series",
        "timestamp(concat(date, ' 0', hour, ':00:', lpad(i, 2, '0'))) AS ts", "100.0D AS price", "100.0D AS price_bucket",
        "CAST(NULL AS STRING) AS market_slug", "CAST(NULL AS STRING) AS market_outcome",
        "'binance' AS source", "date", "hour",
    )
    for part in range(5):  # many small files
        write_ticks(ticks.where(f"second(ts) % 5 = {part}"), str(tmp_path / "small"))
    target = tmp_path / "compact"
    compact_ticks(spark, str(tmp_path / "small"), str(target), days[:2])
    compact_ticks(spark, str(tmp_path / "small"), str(target), days[2:])
    compact_ticks(spark, str(tmp_path / "small"), str(target), days[2:3])
    assert read_ticks(spark, str(target)).count() == len(rows)
    files = lambda at: len(list(at.rglob("*.parquet")))
    assert files(target) == 8 < files(tmp_path / "small")


def test_compaction_rewrites_changed_folders_only(spark, tmp_path):
    import pyarrow.parquet as pq

    from marketlake.sources.ticks import compact_changed, read_ticks, write_ticks

    def ticks(day, low, high):
        return spark.range(low, high).selectExpr(
            "'aggTrade' AS type", "concat('k', id % 7) AS ident", "'BTC' AS asset", "'BTCUSDT' AS series",
            f"timestamp('{day} 00:00:00') + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "100.0D AS price", "100.0D AS price_bucket",
            "CAST(NULL AS STRING) AS market_slug", "CAST(NULL AS STRING) AS market_outcome",
            "'binance' AS source", f"'{day}' AS date", "0 AS hour",
        )

    root, target = str(tmp_path / "small"), tmp_path / "compact"
    for low in (0, 40, 80):
        for day in ("2024-01-01", "2024-01-02"):
            write_ticks(ticks(day, low, low + 40), root)
    files = lambda: {f: f.stat().st_mtime_ns for f in target.rglob("*.parquet")}
    assert compact_changed(spark, root, str(target)).count() == 2
    first = files()
    assert len(first) == 2
    assert compact_changed(spark, root, str(target)).count() == 0 and files() == first
    write_ticks(ticks("2024-01-02", 120, 150), root)
    (row,) = compact_changed(spark, root, str(target)).collect()
    assert (row["date"], row["n_before"], row["n_after"]) == ("2024-01-02", 120, 150)
    kept = [f for f in files() if f in first]
    assert len(kept) == 1 and "date=2024-01-01" in str(kept[0])
    assert sorted(read_ticks(spark, str(target)).collect()) == sorted(read_ticks(spark, root).collect())
    for f in files():
        table = pq.ParquetFile(f).read(columns=["ident", "ts"]).to_pylist()
        assert table == sorted(table, key=lambda r: (r["ident"], r["ts"]))


def test_top_markets_looks_at_all(spark):
    from marketlake.sources.catalogue import top_markets

    rows = [(f"big-{i}", "q", 1000.0 + i, "") for i in range(300)] + [(f"eth-{i}", "q", float(i), '["1"]') for i in range(250)]
    df = spark.createDataFrame(rows, "slug string, question string, volume double, clobTokenIds string")
    assert top_markets(df, 2, "ETH").first()["slug"] == "eth-249"
    assert top_markets(df, 240).count() == 240
    assert top_markets(df).count() == 100 and top_markets(df, keyword="eth").count() == 20


def test_messages_are_parsed_once(spark):
    from marketlake.operators.normalize import normalize_ticks
    from marketlake.operators.stats import windowed_stats
    from marketlake.sources.envelope import parse_envelope

    raw = spark.createDataFrame([("t", "{}")], "topic string, value string").repartition(2)
    ticks = normalize_ticks(parse_envelope(raw))
    for df in (ticks, windowed_stats(ticks, "1 hour")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, plan


def test_compaction_gathers_no_folders_into_one_task(spark, tmp_path):
    """Folders stay dealt over the tasks, and compact_ticks sorts no rows to write them."""
    from marketlake.sources.ticks import compact_changed, compact_ticks, read_ticks, write_ticks

    rows = spark.range(4000).selectExpr(
        "'aggTrade' AS type", "concat('k', id % 7) AS ident", "'BTC' AS asset", "'BTCUSDT' AS series",
        "timestamp('2024-01-01') + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "100.0D AS price", "100.0D AS price_bucket",
        "CAST(NULL AS STRING) AS market_slug", "CAST(NULL AS STRING) AS market_outcome",
        "'binance' AS source", "concat('2024-01-', lpad(id % 20 + 1, 2, '0')) AS date", "CAST(id % 24 AS INT) AS hour",
    )
    write_ticks(rows, f"{tmp_path}/small")
    for name, run in (("ticks", compact_ticks), ("changed", compact_changed)):
        run(spark, f"{tmp_path}/small", f"{tmp_path}/{name}")
        files = list((tmp_path / name).rglob("part-*.parquet"))
        # a file's name has the number of its task
        assert len(files) == 120 and len({f.name.split("-")[1] for f in files}) > 1
        assert read_ticks(spark, f"{tmp_path}/{name}").count() == 4000
