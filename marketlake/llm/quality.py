"""Quality classifier by hierarchical empirical Bayes.

Evidence of a document: a logistic regression on cheap properties of its whole text, fitted to the
training labels. Then three levels of grouped aggregation over all documents: the global rate of
good documents, a posterior per host (source) shrunk toward it, and a posterior per path (source
and lang, the finest site level that the table has) shrunk toward its host. A prior's strength is
the method-of-moments estimate from the spread of the group means around what they shrink to (hosts
around the global rate, paths around their host), so that sparse sites stay near the prior and large
ones follow their own documents. A document's score is its own evidence moved by how far the
posterior odds of its path, without the document itself, are from the global odds. In the rate of its
host and the global rate it counts like others.

A document is rejected only if its score is below reject_below, which is set low: the cost of a
lost clean document is higher than that of a kept poor one.

Labels are read from rows whose crc32(doc_id as text) mod 5 is not 0, at most FIT_ROWS of them, in
the order of a hash of doc_id. Everything else covers all documents.

Edge cases: NULL or empty texts have properties of 0 and get a score like others; NULL source or
lang form a group each; without usable labels of both kinds every document gets the even score 0.5
and is accepted. Repeated rows count as often as they occur; rows with one doc_id or none but with
other texts or sites are decided each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import lookup, materialize, table, whole_text

#: Most labelled rows that a fit reads.
FIT_ROWS = 20_000
#: Least and greatest strength of a prior, in documents.
STRENGTH = (10.0, 10_000.0)
REJECT_BELOW = 0.2
NONE = "\u0000"


def properties(text: Column) -> dict[str, Column]:
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    left = lambda chars: F.length(F.translate(text, chars, ""))
    share = lambda chars: (F.length(text) - left(chars)) / size
    words = F.split(text, r"[\x09-\x0D\x20]+")
    n = F.size(words).cast("double")
    return {
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊÎÔÛÑÓÍÁÚ"),
        "marks": share("!#$%&*|@^~<>{}[]=_\\"),
        "digits": share("0123456789"),
        "distinct": F.size(F.array_distinct(words)) / n,
        "word": F.least(F.length(text) / n, F.lit(50.0)) / 10.0,
        "short": F.lit(1.0) / (F.lit(1.0) + n / 20.0),
    }


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (last: intercept) by ridge-penalised Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(x) / 100 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def strength(groups: DataFrame) -> float:
    """Strength of the prior of groups (n, p) within larger ones (all_n, all_p): m (1 - m) / variance between groups, less 1.

    Spread and sampling noise are those of deviations from a mean that the group is itself part of, so
    a group that is all of the larger one tells nothing.
    """
    noise, rest = F.col("all_p") * (1 - F.col("all_p")), 1 - F.col("n") / F.col("all_n")
    r = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("p") - F.col("all_p"), 2)).alias("spread"),
        F.sum(noise * rest).alias("noise"),
        F.sum(F.col("n") * rest).alias("weight"),
        (F.sum(F.col("n") * noise) / F.sum("n")).alias("within"),
    ).first()
    if not r["weight"]:
        return STRENGTH[1]
    # what sampling alone spreads is not spread between groups
    between = (r["spread"] - r["noise"]) / r["weight"]
    return float(np.clip(r["within"] / max(between, 1e-9) - 1, *STRENGTH))


def row_key() -> Column:
    """Digest of all that a row's score depends on."""
    parts = [F.coalesce(c, F.lit(NONE)) for c in ("source", "lang")]
    return F.unhex(F.sha2(F.concat_ws("\u0001", *parts, whole_text()), 256))


def scored_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row_key, evidence, host_rate, path_rate, score of every row."""
    text = docs.select(
        "doc_id",
        row_key().alias("row_key"),
        F.coalesce("source", F.lit(NONE)).alias("host"),
        F.concat_ws("\u0001", F.coalesce("source", F.lit(NONE)), F.coalesce("lang", F.lit(NONE))).alias("path"),
        whole_text().alias("text"),
    )
    props = properties(F.col("text"))
    names = list(props)
    found = materialize(text.select("doc_id", "row_key", "host", "path", *[c.alias(k) for k, c in props.items()]))

    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("y"))
    rows = (
        found.select("doc_id", *names)
        .join(known.dropDuplicates(["doc_id"]), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_ROWS)
        .toPandas()
    )
    if rows.empty or rows["y"].nunique() < 2:
        evidence = F.lit(0.0)
    else:
        centre, scale, w = fit_logistic(rows[names].to_numpy(float), rows["y"].to_numpy(float))
        evidence = F.lit(float(w[-1]))
        for k, c, s, v in zip(names, centre, scale, w):
            evidence = evidence + (F.col(k) - float(c)) / float(s) * float(v)
    scored = found.select("doc_id", "row_key", "host", "path", F.least(F.greatest(evidence, F.lit(-30.0)), F.lit(30.0)).alias("evidence"))
    good = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence")))

    # a host that holds a third of all rows is summed on the map side first
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = float(np.clip(total["good"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    mean = (F.col("good") / F.col("n")).alias("p")
    k_host = strength(hosts.select("n", mean, F.lit(total["n"]).alias("all_n"), F.lit(rate).alias("all_p")))
    whole = hosts.select("host", F.col("n").alias("all_n"), mean.alias("all_p"))
    k_path = strength(paths.join(whole, "host").select("n", mean, "all_n", "all_p"))
    hosts = hosts.select("host", ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    sites = paths.join(hosts, "host").select("path", "host_rate", F.col("n").alias("path_n"), F.col("good").alias("path_good"))
    others = F.greatest(F.col("path_good") - good, F.lit(0.0)) + k_path * F.col("host_rate")
    path_rate = F.least(others / (F.col("path_n") - 1 + k_path), F.lit(1 - 1e-9))
    moved = F.col("evidence") + logit(F.col("path_rate")) - F.lit(float(np.log(rate / (1 - rate))))
    return lookup(scored, sites, "path", "row_key").withColumn("path_rate", path_rate).select(
        "doc_id",
        "row_key",
        "evidence",
        "host_rate",
        "path_rate",
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-moved))).alias("score"),
    )


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score of every row; evidence and score are log-odds and probability of good."""
    return scored_rows(docs, labels).drop("row_key")


def classify(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Scores with accepted: whether the document stays."""
    return score(docs, labels).withColumn("accepted", F.col("score") >= reject_below)


def keep_accepted(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    gone = scored_rows(docs, labels).where(~(F.col("score") >= reject_below))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("row_key").alias("_gone_key")).distinct()
    mine = docs.withColumn("_row_key", row_key())
    same = mine["doc_id"].eqNullSafe(gone["_gone"]) & (mine["_row_key"] == gone["_gone_key"])
    return mine.join(gone, same, "left_anti").drop("_row_key")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("held_out", held_out())
