"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates
(names, social-security and bank-account numbers, national phone numbers) are spans that three
kinds of labelers vote on: a regex labeler (strict shape or checksum), a gazetteer labeler (lists
of first names, titles, country codes, common words) and a context labeler (cue words before the
span). Votes are 1, 0 (abstains) or -1.

Spark counts the vote patterns of all candidates, base spans included; their number is bounded by
kinds and patterns, not by the corpus. On these counts, expectation-maximisation estimates each
labeler's reliability and the share of true spans per kind. Its posteriors are the soft labels of
a logistic span classifier over votes and shape, which makes the decision.

Texts are scanned once, by row. Spans are in code points, end exclusive.

Edge cases: NULL or empty texts have no spans. Without candidates nothing is fitted. Repeated rows
are returned, and count, as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import materialize, table, whole_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "ssn", "account", "local_phone")
KINDS = BASE + ADDED
ACCEPT = 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# (?<![0-9]) only keeps the engine from trying again inside a run of digits
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

FIRST_NAMES = frozenset(
    """james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph
    jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty mark sandra paul ashley steven emily
    andrew donna kenneth michelle anna hans peter klaus ursula monika marie jean pierre claire luc jose maria juan
    carmen luis ana carlos pedro""".split()
)
TITLES = frozenset("mr mrs ms dr prof sir herr frau madame monsieur mme senor senora don dona".split())
COMMON = frozenset(
    """the and of to in is it that this with for was are be as at by from on not or an new old first last united
    states north south east west street road university company inc der die das und le la les et de el los""".split()
)
COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CUES = {
    "email": "email mail contact write reach adresse correo".split(),
    "ip": "ip host address server client login".split(),
    "card": "card visa mastercard payment credit karte tarjeta carte".split(),
    "phone": "phone call tel mobile fax telefon telefono contact".split(),
    "name": "name contact by author signed sincerely dear patient customer employee nombre nom".split(),
    "ssn": "ssn social security taxpayer".split(),
    "account": "iban account bank konto cuenta compte transfer".split(),
    "local_phone": "phone call tel mobile fax telefon telefono contact".split(),
}
AGAINST = frozenset("version order invoice figure section isbn page chapter table item number no part".split())
CANDIDATES = {
    # a title is context, not part of the name
    "name": re.compile(
        r"(?<![^\W_])(?!(?:" + "|".join(sorted(t.title() for t in TITLES)) + r") )[A-Z][a-z]{1,20} [A-Z][a-z]{1,20}(?![^\W_])"
    ),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9-])"),
}
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    at, done = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found["email"].append((start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def strict(kind: str, s: str) -> int:
    """The regex labeler."""
    if kind in BASE:
        return 1
    d = digits_of(s)
    if kind == "ssn":
        return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    if kind == "account":
        turned = s[4:] + s[:4]
        return 1 if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else -1
    if kind == "local_phone":
        return 1 if d[0] not in "01" and d[3] not in "01" else -1
    return 0


def listed(kind: str, s: str, before: list[str]) -> int:
    """The gazetteer labeler."""
    if kind == "name":
        words = [w.lower() for w in s.split(" ")]
        if words[0] in FIRST_NAMES or before and before[-1] in TITLES:
            return 1
        return -1 if any(w in COMMON for w in words) else 0
    if kind == "account":
        return 1 if s[:2] in COUNTRIES else -1
    if kind == "email":
        return 1 if s.rpartition(".")[2].lower() in ("com", "org", "net", "de", "fr", "es", "edu", "gov", "io") else 0
    return 0


def in_context(kind: str, before: list[str]) -> int:
    """The context labeler."""
    near = before[-4:]
    if any(w in CUES[kind] for w in near):
        return 1
    return -1 if any(w in AGAINST for w in near) else 0


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple]:
    """(kind, start, end, three votes, length class) of base spans and of free candidates."""
    taken = sorted(x for spans in base.values() for x in spans)
    rows = [(k, *x) for k in BASE for x in base[k]]
    for kind, pattern in CANDIDATES.items():
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                rows.append((kind, *m.span()))
    out = []
    for kind, a, b in rows:
        before = WORD.findall(text[max(0, a - 48) : a].lower())
        s = text[a:b]
        out.append((kind, a, b, strict(kind, s), listed(kind, s, before), in_context(kind, before), min(3, (b - a) // 8)))
    return out


SCAN = "doc_id long, spans array<struct<kind:string,start:int,end:int,shape:int,known:int,context:int,size:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all spans with their votes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ("kind", "start", "end", "shape", "known", "context", "size")
        for batch in batches:
            spans = [[dict(zip(keys, x)) for x in candidates(t, base_spans(t))] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(rows, SCAN)


def reliabilities(votes: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for one kind: share of true spans, accuracy of each labeler, posterior of each pattern.

    votes: patterns x labelers in {-1, 0, 1}. A labeler that votes is right with its accuracy,
    whatever the truth. Accuracies and share have a weak prior (8 to 2 and even).
    """
    share, accuracy = 0.5, np.full(votes.shape[1], 0.8)
    posterior = np.full(len(votes), 0.5)
    for _ in range(steps):
        edge = np.log(accuracy / (1 - accuracy))
        posterior = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + votes @ edge)))
        right = posterior[:, None] * (votes == 1) + (1 - posterior)[:, None] * (votes == -1)
        cast = (counts[:, None] * (votes != 0)).sum(axis=0)
        new = np.clip(((counts[:, None] * right).sum(axis=0) + 8) / (cast + 10), 0.55, 0.99)
        share = float(np.clip((counts @ posterior + 1) / (counts.sum() + 2), 0.01, 0.99))
        moved = np.abs(new - accuracy).max()
        accuracy = new
        if moved < 1e-7:
            break
    return share, accuracy, posterior


def span_classifier(patterns: pd.DataFrame) -> dict[tuple, float]:
    """Probability of every (kind, votes, size) that occurs.

    patterns: one row per such combination with its count n.
    """
    out: dict[tuple, float] = {}
    for kind, rows in patterns.groupby("kind"):
        votes = rows[["shape", "known", "context"]].to_numpy(float)
        n = rows["n"].to_numpy(float)
        _, _, soft = reliabilities(votes, n)
        x = np.column_stack([votes, rows["size"].to_numpy(float) / 3, np.ones(len(rows))])
        w = np.zeros(x.shape[1])
        penalty = np.diag([1.0, 1.0, 1.0, 1.0, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (p - soft)) + penalty @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        for r, q in zip(rows.itertuples(), p):
            out[(kind, r.shape_, r.known, r.context, r.size_)] = float(q)
    return out


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, probability); base spans and accepted candidates."""
    scanned = materialize(scan(docs))
    x = scanned.select(F.explode("spans").alias("x")).select("x.kind", "x.shape", "x.known", "x.context", "x.size")
    patterns = x.groupBy("kind", "shape", "known", "context", "size").agg(F.count(F.lit(1)).alias("n")).toPandas()
    patterns = patterns.sort_values(["kind", "shape", "known", "context", "size"])
    # names that itertuples can carry
    patterns["shape_"], patterns["size_"] = patterns["shape"], patterns["size"]
    chance = span_classifier(patterns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for spans in batch["spans"]:
                kept = []
                for s in spans:
                    p = chance[(s["kind"], s["shape"], s["known"], s["context"], s["size"])]
                    if s["kind"] in BASE or p >= ACCEPT:
                        kept.append({"kind": s["kind"], "start": s["start"], "end": s["end"], "probability": p})
                kept.sort(key=lambda s: (KINDS.index(s["kind"]), s["start"]))
                out.append(kept)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": out})

    return scanned.mapInPandas(rows, "doc_id long, spans array<struct<kind:string,start:int,end:int,probability:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
