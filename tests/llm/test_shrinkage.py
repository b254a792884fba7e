"""Posteriors of the quality classifier against a plain version; secrets of very long texts."""

import time

import brute
import numpy as np
import pytest
from marketlake.llm import quality, secrets
from pyspark.sql import functions as F


def plain_strength(groups):
    """groups: (n, p, n of the larger group, p of the larger group)."""
    n, p, all_n, all_p = (np.array(x, float) for x in zip(*groups))
    noise, rest = all_p * (1 - all_p), 1 - n / all_n
    if not (n * rest).sum():
        return quality.STRENGTH[1]
    between = ((n * (p - all_p) ** 2).sum() - (noise * rest).sum()) / (n * rest).sum()
    return float(np.clip((n * noise).sum() / n.sum() / max(between, 1e-9) - 1, *quality.STRENGTH))


def plain_scores(rows):
    """rows: (host, path, evidence); (host rate, path rate, score) of each."""
    good = [1 / (1 + np.exp(-e)) for _, _, e in rows]
    hosts, paths = {}, {}
    for (h, path, _), g in zip(rows, good):
        hosts.setdefault(h, []).append(g)
        paths.setdefault((h, path), []).append(g)
    rate = float(np.clip(np.mean(good), 1e-6, 1 - 1e-6))
    k_host = plain_strength([(len(v), np.mean(v), len(good), rate) for v in hosts.values()])
    k_path = plain_strength([(len(v), np.mean(v), len(hosts[h]), np.mean(hosts[h])) for (h, _), v in paths.items()])
    out = []
    for (h, path, e), g in zip(rows, good):
        host = (sum(hosts[h]) + k_host * rate) / (len(hosts[h]) + k_host)
        own = paths[h, path]
        at = min((max(sum(own) - g, 0) + k_path * host) / (len(own) - 1 + k_path), 1 - 1e-9)
        out.append((host, at, 1 / (1 + np.exp(-(e + np.log(at / (1 - at)) - np.log(rate / (1 - rate)))))))
    return out


@pytest.mark.parametrize("switch", [False, True])
def test_posteriors_against_plain(spark, monkeypatch, switch):
    if switch:  # the join of long lookup tables
        monkeypatch.setattr("marketlake.llm.common.LOOKUP_ROWS", 0)
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    # a NULL id, an empty and a very long text, repeated rows, sites of one document, a column of a helper's name
    odd = [(None, None, None, None), (5_000_001, "", "lonely", "xx"), (5_000_002, "some words! " * 200_000, "lonely", "de")]
    docs = docs.select("doc_id", "text", "source", "lang").unionAll(spark.createDataFrame(odd + odd[1:2], docs.select("doc_id", "text", "source", "lang").schema))
    docs = docs.withColumn("path", F.lit(1))
    found = quality.scored_rows(docs, labels).join(
        docs.select(quality.row_key().alias("row_key"), "source", "lang").distinct(), "row_key"
    ).collect()
    assert len(found) == docs.count()
    for r, (host, path, score) in zip(found, plain_scores([(r.source, r.lang, r.evidence) for r in found])):
        assert (r.host_rate, r.path_rate, r.score) == pytest.approx((host, path, score), abs=1e-9)


def test_sparse_paths_stay_near_their_host(spark):
    """Hosts far apart do not count as paths far apart."""
    groups = [(50, p + d, 100, p) for p in (0.1, 0.5, 0.9) for d in (-0.01, 0.01)]
    frame = spark.createDataFrame([tuple(map(float, g)) for g in groups], "n double, p double, all_n double, all_p double")
    assert quality.strength(frame) == pytest.approx(plain_strength(groups)) == quality.STRENGTH[1]
    alone = spark.createDataFrame([(5.0, 0.2, 5.0, 0.2), (9.0, 0.9, 9.0, 0.9)], frame.schema)
    assert quality.strength(alone) == quality.STRENGTH[1]
    assert quality.strength(frame.where("false")) == quality.STRENGTH[1]


def test_secrets_of_a_very_long_text(spark):
    texts = ["token=abcdef9 é x " * 40_000, "0123456789abcdef01234567 " * (secrets.BLOCK * 3), "api_key: '" + "a" * 300_000, "x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert time.time() - begun < 60
    for i, text in enumerate(texts):
        assert got[i].base_sha256 == brute.sha(brute.joined(brute.base_secrets(text)))
