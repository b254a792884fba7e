"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the words of a clause: insult, threat, target, negation and reported
speech. Each turns a word into a class with a weight; their composition is one automaton whose
state is (distance to the last negation, whether a speech verb or quotation mark has opened a
report, whether a target was named). An insult or threat adds its weight to the clause, damped
after a negation or inside a report, raised next to a target; a threat counts in full only with a
target. Clauses without insult or threat score nothing, so isolated words decide little by
themselves: a document's score is a logistic function of its strongest clause, the sum over its
clauses and their share.

The insult transducer's weights come from a seed list and from labelled documents: log-odds of
words and of word beginnings (4 to 6 letters, which follow inflection) among toxic documents. The
logistic weights come from the same documents. Both read only rows with crc32(doc_id as text)
mod 5 <> 0, at most FIT_ROWS of them in the order of a hash of doc_id; at most LEXICON entries are
learned. Every document is scored over its whole text. Labels, lang, source and doc_id are no
inputs of a score.

Edge cases: NULL or empty texts have no clause and get the score of a text without matches.
Without labels of both kinds fixed weights apply. Repeated rows are returned as often as they
occur. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import table, whole_text
from marketlake.llm.quality import fit_logistic, held_out

FIT_ROWS = 20_000
LEXICON = 4_096
#: A learned entry needs this many toxic documents, this z score and this share of toxic ones.
LEAST = 3
Z = 3.5
SHARE = 0.5
BEGINNINGS = (4, 5, 6)

INSULTS = frozenset(
    """idiot idiots moron morons stupid scum trash clown loser losers pathetic worthless disgusting garbage filth
    imbecile dumb fool vermin idiota imbecil estupido estupida basura idiot dummkopf abschaum trottel connard
    imbécile ordure salaud crétin débile""".split()
)
THREATS = frozenset(
    """kill hurt destroy murder beat burn shoot stab strangle choke punish attack die suffer matar morir pegar töten
    sterben schlagen verbrennen tuer mourir frapper brûler""".split()
)
TARGETS = frozenset(
    """you your yours yourself u he him his she her they them their these those people everyone du dich dir ihr euch
    sie tu te ti toi vous tú usted ustedes ellos ellas eux""".split()
)
NEGATIONS = frozenset(
    """not no never nor neither without isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie
    niemals ne pas jamais sans sin nunca jamás""".split()
)
REPORTS = frozenset(
    """said says say wrote writes quoted quote called calls claimed claims alleged reported according sagte schrieb
    dit écrit dijo escribió""".split()
)
QUOTES = frozenset("\"“”«»„")
PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:,\n\"“”«»„]")
WORD = re.compile(r"[^\W\d_]+")
ENDS = frozenset(".!?;:,\n")

NEGATION_REACH = 3
DAMP_NEGATED, DAMP_REPORTED, RAISE_TARGET, THREAT_ALONE = 0.3, 0.5, 1.4, 0.2
SEED_WEIGHT, THREAT_WEIGHT = 3.0, 3.0
FEATURES = ("strongest", "total", "clauses", "share")
#: Without labels: intercept and weights of FEATURES.
DEFAULT = (np.zeros(4), np.ones(4), np.array([0.8, 0.6, 0.3, 1.0, -3.0]))


class Grammar:
    """The composed transducers; entries: learned weights of words ("=word") and beginnings."""

    def __init__(self, entries: dict[str, float]):
        self.words = {w: SEED_WEIGHT for w in INSULTS}
        self.words |= {k[1:]: v for k, v in entries.items() if k[0] == "="}
        self.starts = {k: v for k, v in entries.items() if k[0] != "="}

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                best = max(best, self.starts.get(word[:n], 0.0))
        return best

    def hits(self, words: set[str]) -> dict[str, float]:
        """The insults and threats among words, with their weights; threats are negative."""
        out = {}
        for w in words:
            weight = self.insult(w)
            if weight:
                out[w] = weight
            elif w in THREATS:
                out[w] = -THREAT_WEIGHT
        return out

    def clauses(self, text: str, hits: dict[str, float]) -> tuple[list[float], int]:
        """Scores of matched clauses, and the number of clauses."""
        scores, total = [], 0
        since_negation, reported, target, insults, threat, words = NEGATION_REACH + 1, False, False, 0.0, 0.0, 0
        for m in PIECE.finditer(text):
            piece = m.group()
            if piece in ENDS:
                if words:
                    total += 1
                    score = insults * (RAISE_TARGET if target else 1.0) + threat * (1.0 if target else THREAT_ALONE)
                    if score > 0:
                        scores.append(score)
                    since_negation, target, insults, threat, words = NEGATION_REACH + 1, False, 0.0, 0.0, 0
                    # a report reaches over commas and colons to the end of its sentence
                    reported = reported and piece in ",:"
                continue
            if piece in QUOTES:
                reported = True
                continue
            words += 1
            since_negation += 1
            weight = hits.get(piece, 0.0)
            if weight:
                scale = (DAMP_NEGATED if since_negation <= NEGATION_REACH else 1.0) * (DAMP_REPORTED if reported else 1.0)
                if weight > 0:
                    insults += weight * scale
                else:
                    threat -= weight * scale
            elif piece in NEGATIONS:
                since_negation = 0
            elif piece in TARGETS:
                target = True
            elif piece in REPORTS:
                reported = True
        if words:
            total += 1
            score = insults * (RAISE_TARGET if target else 1.0) + threat * (1.0 if target else THREAT_ALONE)
            if score > 0:
                scores.append(score)
        return scores, total

    def features(self, text: str) -> tuple[float, float, float, float]:
        text = text.lower()
        hits = self.hits(set(WORD.findall(text)))
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        scores, total = self.clauses(text, hits)
        if not scores:
            return 0.0, 0.0, 0.0, 0.0
        return max(scores), float(np.log1p(sum(scores))), float(np.log1p(len(scores))), len(scores) / total


def training(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most so many labelled documents."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most FIT_ROWS rows of two numbers
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Learned entries with their weights."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(WORD.findall(text.lower()))
                own = {"=" + w for w in words} | {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}
                seen[int(toxic > 0)].update(own)
            keys = list(seen[1].keys() | seen[0].keys())
            yield pd.DataFrame({"entry": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]})

    sizes = sample.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") <= 0).alias("c")).first()
    t, c = float(sizes["t"]), float(sizes["c"])
    if not t or not c:
        return {}
    half = F.lit(0.5)
    odds = F.log((F.col("t") + half) / (t - F.col("t") + half)) - F.log((F.col("c") + half) / (c - F.col("c") + half))
    z = odds / F.sqrt(F.lit(1.0) / (F.col("t") + half) + F.lit(1.0) / (F.col("c") + half))
    found = (
        sample.mapInPandas(count, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .where((F.col("t") >= LEAST) & (F.col("t") >= SHARE * (F.col("t") + F.col("c"))))
        .select("entry", odds.alias("odds"), z.alias("z"))
        .where(F.col("z") >= Z)
        .orderBy(F.desc("z"), "entry")
        .limit(LEXICON)
        .collect()
    )
    return {r["entry"]: float(min(r["odds"], 8.0)) for r in found}


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], tuple]:
    """Learned entries, and centre, scale and weights of the logistic score."""
    sample = training(docs, labels)
    entries = lexicon(sample)
    grammar = Grammar(entries)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.array([grammar.features(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({**{k: rows[:, i] for i, k in enumerate(FEATURES)}, "toxic": batch["toxic"].to_numpy()})

    rows = sample.mapInPandas(describe, ", ".join(f"{k} double" for k in FEATURES) + ", toxic int").toPandas()
    y = (rows["toxic"] > 0).to_numpy(float)
    if rows.empty or y.min() == y.max():
        return entries, DEFAULT
    rows = rows.sort_values([*FEATURES, "toxic"])
    return entries, fit_logistic(rows[list(FEATURES)].to_numpy(float), (rows["toxic"] > 0).to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses of every row."""
    entries, (centre, scale, w) = fit(docs, labels)
    grammar = Grammar(entries)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
            z = ((x - centre) / scale) @ w[:-1] + w[-1]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))),
                    "n_clauses": np.rint(np.expm1(x[:, 2])).astype(np.int64),
                }
            )

    return (
        docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"))
        .mapInPandas(rate, "doc_id long, held_out boolean, score double, n_clauses long")
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
