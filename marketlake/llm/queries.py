"""One query per operator over its whole table, and the same query in SQL where SQL can state it."""

from __future__ import annotations

from marketlake.llm import (
    bpe,
    chat,
    decontam,
    exact_dedup,
    fim,
    html_text,
    mixing,
    ngram_join,
    pii,
    quality,
    resample,
    secrets,
    toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_poisson_mixing": mixing.query,
    "op5_quality_classifier": quality.query,
    "op6_benchmark_decontamination": decontam.query,
    "op7_pii": pii.query,
    "op8_html_extraction": html_text.query,
    "op9_chat_formatting": chat.query,
    "op10_secret_scan": secrets.query,
    "op11_bpe": bpe.query,
    "op12_importance_resampling": resample.query,
    "op13_fill_in_middle": fim.query,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_ngram_jaccard_join": ngram_join.SQL,
    "op4_poisson_mixing": mixing.SQL,
    "op6_benchmark_decontamination": decontam.SQL,
    "op12_importance_resampling": resample.SQL,
    "op13_fill_in_middle": fim.SQL,
}
