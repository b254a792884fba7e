"""The pipeline against a plain version of its stages."""

import brute
import numpy as np
import pandas as pd

import corpus_pipeline
from marketlake.llm import quality


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    accepted = {r.doc_id for r in quality.classify(docs, labels).where("accepted").collect()}
    assert len(accepted) < docs.count()
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in accepted}
    import re

    first: dict = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    texts = {i: rows[i].text for i in first.values()}
    label, _ = brute.near_components(texts, 5, 80)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i in texts if label[i] == i and not brute.contaminated(texts[i], items)[1]]
    n = pd.Series([rows[i].source or "" for i in left]).value_counts()
    weight = np.sqrt(n)
    mean = len(left) * weight / weight.sum() / n
    wanted = sorted((i, c) for i in left for c in range(brute.poisson_count(i, rows[i].text, mean[rows[i].source or ""])))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "copy_no"]
    found = got.collect()
    assert sorted((r.doc_id, r.copy_no) for r in found) == wanted
    assert all(r.text == rows[r.doc_id].text for r in found)
