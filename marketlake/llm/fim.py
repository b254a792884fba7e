"""Fill-in-the-middle transformation.

A text is a row of units: code points, words with the white space after them, or lines. Two cuts, drawn
from a hash of the document's id, part it into prefix, middle and suffix, which are written in one of two
orders behind markers, so that a model learns to fill the middle in. The cuts are places in units, but
texts are UTF-8: the text's bytes are cut into blocks of fixed length, and a Fenwick tree over the blocks
holds the units and the code points that begin in each. Descending the tree by powers of two finds the
block of the k-th unit and the counts before it; the boundary is then located in that block alone.

Edge cases: NULL is an empty text; empty texts and texts that hold a marker stay plain. A NULL doc_id is
hashed as ''. Rows that share an id are cut at the same hashes, each in its own text; ties of the two cuts
give an empty middle. Empty tables give empty results. The operator adds one struct column, whose name is a
parameter, and keeps all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import table, whole_text

BLOCK = 1 << 12
MARKERS = ("<P>", "<S>", "<M>")
#: Percentages of documents that are transformed, and of those, in suffix-first order.
RATE, SPM_RATE = 90, 20
SEED = "1"
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit; units tile the text."""
    if unit == "char":
        return code_points(data)
    if unit == "word":
        space = SPACES[data]
        starts = ~space & np.concatenate(([True], space[:-1]))
    elif unit == "line":
        starts = np.concatenate(([True], data[:-1] == 10))
    else:
        raise ValueError(f"no unit {unit}")
    starts[:1] = True  # white space ahead of the first word is part of it
    if unit == "word" and len(data) and SPACES[data[0]] and starts[1:].any():
        starts[1 + int(np.argmax(starts[1:]))] = False
    return starts


class Blocks:
    """A text's bytes in blocks, with a Fenwick tree of (units, code points) over them."""

    def __init__(self, text: str, unit: str = "char", block: int = BLOCK):
        self.data = np.frombuffer(text.encode(), np.uint8)
        self.unit, self.block = unit, block
        starts = np.arange(0, len(self.data), block)
        points = code_points(self.data)
        self.starts = points if unit == "char" else unit_starts(self.data, unit)
        self.size = len(starts)
        tree = np.zeros((self.size + 1, 2), np.int64)
        if self.size:
            tree[1:, 0] = np.add.reduceat(self.starts, starts, dtype=np.int64)
            tree[1:, 1] = np.add.reduceat(points, starts, dtype=np.int64)
        self.units, self.chars = (int(x) for x in tree.sum(axis=0))
        self.tree = tree.tolist()
        for i in range(1, self.size + 1):  # every node adds itself to the next one that covers it
            parent = i + (i & -i)
            if parent <= self.size:
                self.tree[parent][0] += self.tree[i][0]
                self.tree[parent][1] += self.tree[i][1]

    def boundary(self, k: int) -> tuple[int, int]:
        """(byte, code point) behind the first k units."""
        if k >= self.units:
            return len(self.data), self.chars
        # the last block before which at most k units begin: the unit number k (from 0) begins in it
        at, units, chars = 0, 0, 0
        step = 1 << self.size.bit_length()
        while step:
            if at + step <= self.size and units + self.tree[at + step][0] <= k:
                at += step
                units += self.tree[at][0]
                chars += self.tree[at][1]
            step >>= 1
        low = at * self.block
        inside = int(np.flatnonzero(self.starts[low : low + self.block])[k - units])
        return low + inside, chars + int(np.count_nonzero(code_points(self.data[low : low + inside])))


def draws(doc_id, seed: str = SEED) -> list[int]:
    """h1 to h4 of a document."""
    shown = "" if pd.isna(doc_id) else str(int(doc_id))
    digest = hashlib.sha256(f"{seed}:{shown}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id, text: str, unit: str, rate: int, spm_rate: int, seed: str, block: int) -> tuple:
    """The fields of one document."""
    blocks = Blocks(text, unit, block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= rate:
        return blocks.units, "plain", None, None, text
    low, high = sorted((h1 % (blocks.units + 1), h2 % (blocks.units + 1)))
    (a, a_chars), (b, b_chars) = blocks.boundary(low), blocks.boundary(high)
    data = blocks.data.tobytes()
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    p, s, m = MARKERS
    if h4 % 100 < spm_rate:
        form, output = "spm", f"{s}{suffix}{p}{prefix}{m}{middle}"
    else:
        form, output = "psm", f"{p}{prefix}{s}{suffix}{m}{middle}"
    return blocks.units, form, a_chars, b_chars - a_chars, output


def fill_in_middle(
    docs: DataFrame,
    unit: str = "char",
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    seed: str = SEED,
    into: str = "fim",
    block: int = BLOCK,
) -> DataFrame:
    """All columns of docs, and a struct of n (units), form, prefix_chars, middle_chars and output."""

    @F.pandas_udf(FIELDS)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rearranged(i, t, unit, rate, spm_rate, seed, block) for i, t in zip(ids, texts)]
        frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    # as text, since a column of numbers with NULLs would reach pandas as doubles
    return docs.withColumn(into, run(F.col("doc_id").cast("string"), whole_text()))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; markers occur in it once each, since no such text holds one."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fim = F.col("fim")
    return fill_in_middle(docs).select(
        "doc_id",
        fim["n"].alias("n"),
        fim["form"].alias("form"),
        fim["prefix_chars"].alias("prefix_chars"),
        fim["middle_chars"].alias("middle_chars"),
        F.sha2(fim["output"], 256).alias("output_sha256"),
        F.sha2(restored(fim["output"], fim["form"]), 256).alias("restored_sha256"),
    )


SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x
  FROM documents),
c AS (
  SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, substr(text, 1, least(c1, c2)) AS a, substr(text, least(c1, c2) + 1, abs(c1 - c2)) AS m,
         substr(text, greatest(c1, c2) + 1) AS b FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN abs(c1 - c2) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || b || '<M>' || m
         ELSE '<S>' || b || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
