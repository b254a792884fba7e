"""The common message envelope: parse, reject, build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.schemas import ENVELOPE_DDL

ENVELOPE_COLUMNS = ("source", "type", "recv_ts", "symbol", "asset_id", "market", "payload")


def parse_envelope(raw: DataFrame) -> DataFrame:
    """Message bytes to typed columns, with the topic kept.

    The text is parsed once: filters on parsed fields would be pushed through a plain
    projection, each with a parse of its own, but not through an explode.
    """
    once = F.array(F.from_json(F.col("value").cast("string"), ENVELOPE_DDL))
    parsed = raw.where(F.col("value").isNotNull()).select("topic", F.explode(once).alias("env"))
    return parsed.select("topic", *[F.col(f"env.{c}").alias(c) for c in ENVELOPE_COLUMNS])


def parse_rejects(raw: DataFrame) -> DataFrame:
    """Messages that are no envelope, with their text: bad JSON or no source / type."""
    text = F.col("value").cast("string")
    env = F.from_json(
        text,
        f"{ENVELOPE_DDL}, _corrupt STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return (
        raw.where(F.col("value").isNotNull())
        .select("topic", text.alias("raw"), env.alias("env"))
        .select(
            "topic",
            "raw",
            F.when(F.col("env._corrupt").isNotNull(), "malformed")
            .when(F.col("env.source").isNull() | F.col("env.type").isNull(), "incomplete")
            .alias("reason"),
        )
        .where(F.col("reason").isNotNull())
    )


def to_envelope(
    source: Column,
    kind: Column,
    recv_ts: Column,
    payload: Column,
    **extra: Column,
) -> Column:
    """Canonical JSON text; identifiers (symbol, asset_id, market) stay at the top level."""
    return F.to_json(
        F.struct(
            source.alias("source"),
            kind.alias("type"),
            recv_ts.alias("recv_ts"),
            payload.alias("payload"),
            *[c.alias(n) for n, c in extra.items()],
        )
    )
