"""Model parameters and metadata, one row per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.pricing import finite, number
from marketlake.operators.arma import PARAMS_DDL
from marketlake.schemas import DEFAULT_SIGMA_LOG, EXOG

# A 5-minute log-return deviation above this is a unit mistake (basis points, percent).
MAX_SIGMA_LOG = 1.0


def save_model(params: DataFrame, path: str, grid: DataFrame | None = None) -> None:
    """Write the parameters and, if given, the AIC grid beside them."""
    params.write.mode("overwrite").parquet(f"{path}/params")
    if grid is not None:
        grid.write.mode("overwrite").parquet(f"{path}/aic_grid")


def load_model(spark: SparkSession, path: str, exog: tuple[str, ...] = EXOG) -> DataFrame:
    """Read parameters; refuse a model trained on other features."""
    params = spark.read.schema(PARAMS_DDL).parquet(f"{path}/params")
    wanted = F.array(*[F.lit(c) for c in exog])
    checked = F.when(F.col("exog") == wanted, F.col("exog")).otherwise(
        F.raise_error(
            F.concat(
                F.lit(f"feature mismatch: scorer computes {list(exog)}, model expects "),
                F.to_json(F.col("exog")),
            )
        ).cast("array<string>")
    )
    return params.withColumn("exog", checked)


def load_aic_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/aic_grid")


def sigma_lookup(
    keys: DataFrame, metadata: DataFrame | None, on: str = "series", default: float = DEFAULT_SIGMA_LOG,
    max_sigma: float = MAX_SIGMA_LOG,
) -> DataFrame:
    """σ of each key from the metadata; missing, non-numeric or implausible ones get the default."""
    if metadata is None:
        return keys.withColumn("sigma_log", F.lit(default))
    sigma = finite(number(F.col("sigma_log").cast("string")))
    usable = metadata.select(
        on, F.when((sigma > 0) & (sigma <= max_sigma), sigma).alias("sigma_log")
    )
    return keys.join(usable, on, "left").withColumn(
        "sigma_log", F.coalesce("sigma_log", F.lit(default))
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Feature metadata files (JSON documents); a broken file gives a row without σ."""
    return spark.read.schema(
        "series STRING, sigma_log STRING, target STRING, exog ARRAY<STRING>, `order` ARRAY<INT>"
    ).json(path, multiLine=True)
