"""Archive to dataset to model, as the command-line jobs do it."""

from marketlake.plans import jobs
from marketlake.plans.queries import _ticks
from marketlake.sources import models, ticks
from marketlake.sources.shared_tables import SLOW


def test_archive_to_model(spark, tmp_path):
    rows = _ticks(spark, "/root/testdata/sf0.01").drop("event_id")
    # one folder per source is enough here; the hourly layout is tested with the archive queries
    archive, training, model = (str(tmp_path / n) for n in ("ticks", "training", "model"))
    rows.write.parquet(archive)
    coverage = {r["asset"]: r for r in jobs.build_dataset(spark, archive, training, SLOW).collect()}
    assert set(coverage) == {"BTC", "ETH", "SOL"} and coverage["BTC"]["spot_seconds"] > 500
    result = {(r["series"], r["forecaster"]): r for r in jobs.train(spark, training, model).collect()}
    assert {f for _, f in result} == {"model, in sample", "model", "market", "zero"}
    assert result["BTC", "model"]["rmse"] < result["BTC", "zero"]["rmse"] * 1.05
    params = models.load_model(spark, model).collect()
    assert {p["status"] for p in params} == {"ok"}
    assert models.load_aic_grid(spark, model).count() == 45


def test_implausible_sigma_is_refused(spark):
    import argparse

    import pytest

    with pytest.raises(SystemExit):
        jobs._sigmas(spark, argparse.Namespace(sigma_log=50.0, model=None))


def test_read_schema_is_declared(spark, tmp_path):
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "price double").write.parquet(empty)
    assert "market_slug" in ticks.read_ticks(spark, empty).columns
