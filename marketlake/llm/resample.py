"""Target-distribution importance resampling.

Documents are drawn by how much more their hashed n-grams belong to a target collection than to the corpus
itself. The words are those of the tokenizers library's pre-tokenisation: an untrained Regex Split over the
text with A-Z lowered, which returns each word with its offsets. An n-gram is the window from the start of word i
to the end of word i + k, its words joined by one space; its CRC-32, continued from that of the window a word
shorter, modulo BUCKETS is its bucket. Each task adds its windows to one histogram of fixed size;
the histograms are summed per bucket. A bucket's gain is the logarithm of its smoothed share in the target
over its share in the corpus; a document's weight is the sum of the gains of its windows. A Gumbel number
from a hash of the id is added, and the highest scores are drawn, which is a draw without replacement in
proportion to exp(weight). The draw ranks all documents that may be drawn by a total order over range
partitions, so that no task ranks more than its range.

Texts are read and cut once: the buckets of a document's windows are written to the shared folder, two bytes each,
for the histogram and the scores, and deleted afterwards. Only the table of gains (BUCKETS numbers) passes through
the driver. Words keep offsets per piece of about PIECE characters, cut at white space, so that a long text holds no
offset objects for all of it at once.

Edge cases: NULL and empty texts have no words, weight 0 and are never drawn. A NULL doc_id is hashed as '' and
ranks behind other ids; equal scores go by the smaller id, then by a hash of the text. Repeated rows count, score and
rank each for itself. An empty corpus gives an empty result; with an empty target all gains come from smoothing.
Only doc_id and text are read: extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from marketlake.llm.common import Scratch, table, whole_text
from marketlake.operators.ordered import in_order, numbered, part_sizes
from marketlake.session import materialize

BUCKETS = 10_000
LONGEST = 3
#: Documents of fewer words are never drawn; of the others, so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
SEED = "42"
PIECE = 1 << 16
GAP = re.compile(r"[ \t\n]")
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = bytes(range(256)).lower()


class Windows:
    """Buckets of the n-grams of texts."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest = buckets, longest
        # the untrained model only carries the words' offsets
        self.cut = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
        self.cut.pre_tokenizer = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)

    def words(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            gap = GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = gap.end() if gap else len(text)
            piece = text[at:end]
            out += [piece[a:b] for a, b in self.cut.encode(piece, add_special_tokens=False).offsets]
            at = end
        return out

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every window."""
        # only bytes of A-Z change; those of other characters lie above them
        words = self.words(text.encode().translate(LOWER).decode())
        # the bytes from the end of one word to the end of the next
        steps = [b" " + w.encode() for w in words]
        # checksums of the windows of one word, which those of a word more continue
        last = list(map(zlib.crc32, [s[1:] for s in steps]))
        sums = list(last)
        for k in range(1, self.longest):
            last = list(map(zlib.crc32, steps[k:], last))
            sums += last
        return len(words), np.array(sums, np.int64) % self.buckets


def windows_of(texts: DataFrame, keys: list[str], buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The key columns, n_words, text_key and the buckets of all windows of a column text, as little-endian numbers."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, kind = Windows(buckets, longest), number(buckets)
        for batch in batches:
            found = [windows.of(text) for text in batch["text"]]
            out = batch[keys].assign(
                n_words=[n for n, _ in found],
                text_key=[zlib.crc32(text.encode()) for text in batch["text"]],
                windows=[own.astype(kind).tobytes() for _, own in found],
            )
            yield out

    fields = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.mapInPandas(cut, f"{fields + ', ' if keys else ''}n_words long, text_key long, windows binary")


def number(buckets: int) -> str:
    """The type of a bucket's number."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all windows; each task sends at most one row per bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch["windows"]:
                total += np.bincount(np.frombuffer(own, number(buckets)), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen.astype(np.int32), "n": total[seen]})

    return found.select("windows").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths, from the histograms of both."""
    both = corpus.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    counts = [[0] * buckets, [0] * buckets]
    for row in both.collect():  # at most 2 * buckets rows
        counts[row["side"]][row["bucket"]] = row["n"]
    s, t = counts
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array(
        [math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t)], np.int64
    )


def gumbel(doc_id: str | None, seed: str = SEED) -> int:
    """The document's Gumbel number, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(found: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, text_key of every document."""

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.frombuffer(w, number(len(gain))) for w in batch["windows"]]
            weight = [int(gain[w].sum()) for w in own]
            yield batch[["shown", "n_words", "text_key"]].assign(
                n_features=[len(w) for w in own],
                weight=weight,
                score=[w + gumbel(shown, seed) for w, shown in zip(weight, batch["shown"])],
            )

    fields = "shown string, n_words long, text_key long, n_features long, weight long, score long"
    return found.mapInPandas(rate, fields).withColumn("doc_id", F.col("shown").cast("long")).drop("shown")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is NULL where it is not drawn."""
    scratch, text = Scratch(docs.sparkSession), whole_text().alias("text")
    texts = docs.select(F.col("doc_id").cast("string").alias("shown"), text)
    found = scratch.keep(windows_of(texts, ["shown"], buckets, longest))
    wanted = histogram(windows_of(target.select(text), [], buckets, longest), buckets)
    gain = gains(histogram(found, buckets), wanted, buckets)
    scored = materialize(scores(found, gain, seed))  # small rows, read three times from here on
    scratch.drop()
    may = scored.where(F.col("n_words") >= least_words)
    placed = in_order(may, F.desc("score"), F.asc_nulls_last("doc_id"), "text_key")
    sizes = part_sizes(placed)
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    drawn = F.floor(total * F.lit(percent) / 100)
    ranked = numbered(placed, F.broadcast(sizes), "seq").withColumn(  # one row per part
        "rank", F.when(F.col("seq") < drawn, F.col("seq") + 1)
    )
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(others.select(columns))


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT unnest([1, 2, 3]) AS k),
df AS MATERIALIZED (
  SELECT r, g, count(*) AS n FROM (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k)) GROUP BY r, g),
bf AS MATERIALIZED (
  SELECT g, count(*) AS n FROM (SELECT array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, k)) GROUP BY g),
crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda x, s: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
keys AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
      lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM df UNION SELECT g FROM bf)), crc),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM df JOIN keys USING (g) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bf JOIN keys USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000)
    / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM keys) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN keys USING (g) JOIN gain USING (bucket) GROUP BY r),
x AS (
  SELECT doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
o AS (
  SELECT doc_id, score, n_words, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS total
  FROM x WHERE n_words >= 20)
SELECT doc_id, x.n_features, x.weight, x.score, CASE WHEN n <= total * 5 // 100 THEN n END AS rank
FROM x LEFT JOIN o USING (doc_id)
"""
