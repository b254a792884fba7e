"""BPE encoding and decoding with a public vocabulary.

A text is normalised and cut into words as the vocabulary's file states. A byte table lowers ASCII letters and
cuts runs off at ASCII white space. Runs of characters below KNOWN, but for marks, are lowered and cut by Python,
with the classes that the tokenizers library gives to these characters; the library itself normalises and cuts
the other runs. Each word becomes a doubly linked list of byte symbols, the last one marked as a word end. A priority
queue holds the merges of neighbours by (rank, position); the smallest is taken, skipped if one of its
symbols has gone or changed since, and applied otherwise; the merges of the new symbol with its
neighbours are pushed. A word of n symbols takes O(n log n). Decoding concatenates the strings of the
vocabulary, joined by one space where the file names no decoder. Ids are kept as bytes and exchanged as Arrow lists.

The vocabulary's file is a parameter; its text (at most MAX_BYTES) is read by the driver and broadcast. A
Python process parses it once and keeps, over its tasks, the ids of recent runs of text without white space, at
most about 2 * CACHE short ones. Long texts are cut after white space into pieces of about PIECE characters, which
no word spans, so that the result is that of the whole text.

Edge cases: NULL is encoded as '' (no ids); a NULL list decodes to ''. Strings of special tokens in a text
become their ids, as in the library. Ids outside the vocabulary are skipped in decoding. Every row is
encoded for itself: NULL or repeated doc_ids, repeated rows and ties change nothing. Empty tables give
empty results. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from marketlake.llm.common import table, whole_text

MAX_BYTES = 64 << 20
#: Runs of text whose ids a process keeps, in each of two generations, and the longest such run.
CACHE, LONGEST_KEPT = 1 << 17, 32
#: Bytes with A-Z lowered and ASCII white space made spaces; others belong to characters beyond ASCII or stay.
PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b for b in bytes(range(256)).lower())
#: The same without lower case, for texts with a capital that a mark may follow: a mark composes with some small letters only.
SPACED = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
MARKED = re.compile("[A-Z][^\x00-\u02ff]")
PIECE = 1 << 16
ID = np.dtype("<i4")
#: How words are cut, as far as Python does it, for runs of characters below KNOWN: Latin, Greek, Cyrillic letters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN = 0x530
#: Rows that Python takes from Arrow, or Arrow decodes, at once.
ROWS = 512
ByteLevel = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
#: Bytes that begin a character of several; those that begin none in UTF-8 stand for themselves.
LEADS = {b: chr(b) for b in range(0xC0, 0x100)}
GAP = re.compile(r"[ \t\n]")


class Runs(dict):
    """The ids of runs of text, four bytes each; those of other runs are asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, run: str) -> bytes:
        return self.learn(run)


class WordBPE:
    """A vocabulary of the library's file format: BPE over bytes, with a word-end suffix."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, cut = spec["model"], spec["pre_tokenizer"]
        steps = cut["pretokenizers"] if cut["type"] == "Sequence" else [cut]
        unusual = (
            [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
            + [k for k in ("decoder", "post_processor") if spec.get(k)]
            + [t["content"] for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        )
        split, last = steps[0], steps[-1]
        if (
            unusual or model["type"] != "BPE" or len(steps) != 2 or split["type"] != "Split" or last["type"] != "ByteLevel"
            or last["use_regex"] or last["add_prefix_space"] or not split["invert"] or split["behavior"] != "Removed"
        ):
            raise ValueError(f"not a vocabulary of this kind: {unusual or [s['type'] for s in steps]}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        #: per left symbol, the rank of its merge with a right one, and the look-up of it; the new symbol by rank
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        for rank, (a, b, _) in enumerate(pairs):
            self.ranks[a][b] = rank
        self.rank_with = [r.get for r in self.ranks]
        self.made = [new for _, _, new in pairs]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        longest = sorted(added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        self.normalizer = Tokenizer.from_str(text).normalizer or normalizers.Sequence([])
        # the untrained model only carries the words' offsets
        self.words = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
        self.words.pre_tokenizer = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        cut = self.words.pre_tokenizer.pre_tokenize_str
        if (
            any(" " in w for w, _ in cut(f"a b {string.punctuation} 1 'c d' "))
            or len(cut(string.ascii_letters)) != 1
            or self.normalizer.normalize_str("A \t\nb") != "a b"
        ):
            raise ValueError("not a vocabulary of this kind: words of letters, lower case, white space dropped")
        # the symbols of a byte within a word and at its end
        shown = [self.shown(bytes([b])) for b in range(256)]
        self.inner = [self.vocab[c] for c in shown]
        self.last = [self.vocab[c + self.suffix] for c in shown]
        self.packed = [np.array(i, ID).tobytes() for i in range(max([*self.vocab.values(), *added.values()]) + 1)]
        #: whether a run is cut by known_words() after lower(), as the library would
        self.known = self.known_words = None
        if split["pattern"]["Regex"] == PATTERN:
            self.know(cut)
        self.cache, self.older = Runs(self.learn), {}
        #: words that the library cut out of runs
        self.cut: dict[str, bytes] = {}

    def know(self, cut) -> None:
        """Ask the library for the classes of the characters below KNOWN; left out are those that it does not lower as Python does."""
        kinds: dict[str, int] = {}
        for c in map(chr, range(33, KNOWN)):
            lower = self.normalizer.normalize_str(c)
            # a combining mark may change its neighbour; lower() may depend on the one before
            if not c.isspace() and not unicodedata.combining(c) and len(lower) == 1 and f"a{c}".lower() == f"a{lower}":
                kinds[c] = len(cut(f"a{c}{c}a"))  # 1: a letter, 4: a number, 3: another
        kinds = {c: n for c, n in kinds.items() if n in (1, 3, 4) and c.lower() in kinds}
        letters, numbers = (re.escape("".join(c for c in kinds if kinds[c] == n)) for n in (1, 4))
        self.known = re.compile(f"[{re.escape(''.join(kinds))}]*").fullmatch
        self.known_words = re.compile(PATTERN.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)).findall

    @staticmethod
    def shown(byte: bytes) -> str:
        """The character that stands for a byte in the vocabulary."""
        if byte < b"\x80":
            return ByteLevel.pre_tokenize_str(byte.decode())[0][0]
        if byte < b"\xc0":  # a continuation byte, behind the lead byte of U+0080 to U+00BF
            return ByteLevel.pre_tokenize_str((b"\xc2" + byte).decode())[0][0][1]
        return LEADS[byte[0]]

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges to a list of symbols."""
        rank_with, made, n = self.rank_with, self.made, len(ids)
        bits = n.bit_length()  # of a position, below the rank, in an entry of the queue
        low = (1 << bits) - 1
        # of a symbol, the rank of its merge with the next one; -1: none, or the symbol has gone
        ranks = [rank_with[left](right, -1) for left, right in zip(ids, ids[1:])]
        queue = [rank << bits | i for i, rank in enumerate(ranks) if rank >= 0]
        if not queue:
            return ids
        ranks.append(-1)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & low
            rank = top >> bits
            if ranks[i] != rank:  # stale: a symbol of the pair has gone or changed
                continue
            j = after[i]
            new = ids[i] = made[rank]
            ids[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                rank = ranks[i] = rank_with[new](ids[k], -1)
                if rank >= 0:
                    heappush(queue, rank << bits | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                rank = ranks[h] = rank_with[ids[h]](new, -1)
                if rank >= 0:
                    heappush(queue, rank << bits | h)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        data = word.encode()
        ids = [*map(self.inner.__getitem__, data)]
        ids[-1] = self.last[data[-1]]
        return b"".join(map(self.packed.__getitem__, self.merged(ids)))

    def cut_word(self, word: str) -> bytes:
        """The ids of a word that the library cut out of a run; short ones are kept."""
        found = self.cut.get(word)
        if found is None:
            found = self.word(word)
            if len(word) <= LONGEST_KEPT:
                self.cut[word] = found
        return found

    def learn(self, run: str) -> bytes:
        """The ids of a run of text without ASCII white space; those of a short one go into the cache."""
        found = self.older.get(run)
        if found is None:
            if run.isascii() and run.isalpha():
                found = self.word(run.lower())  # letters only: one word
            elif self.known and self.known(run):
                words = self.known_words(run.lower())
                # a word of these is its only one
                found = self.word(run) if words == [run] else b"".join(map(self.cache.__getitem__, words))
            else:
                plain = self.normalizer.normalize_str(run)
                offsets = self.words.encode(plain, add_special_tokens=False).offsets
                found = b"".join([self.cut_word(plain[low:high]) for low, high in offsets])
        if len(run) <= LONGEST_KEPT:
            self.cache[run] = found
        return found

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            gap = GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = gap.end() if gap else len(text)
            yield text[at:end]
            at = end

    def packed_ids(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        out: list[bytes] = []
        for part in self.special.split(text or "") if self.special else [text or ""]:
            if part in self.added:
                out.append(self.packed[self.added[part]])
                continue
            for piece in self.pieces(part):
                table = SPACED if not piece.isascii() and MARKED.search(piece) else PLAIN
                runs = piece.encode().translate(table).decode().split(" ")
                out.append(b"".join(map(self.cache.__getitem__, runs)))
                if len(self.cache) >= CACHE:
                    self.cache, self.older = Runs(self.learn), self.cache
                if len(self.cut) >= CACHE >> 2:
                    self.cut = {}
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed_ids(text), ID).tolist()


@lru_cache(maxsize=1)
def coder(text: str) -> WordBPE:
    """The coder of a vocabulary's text; a process keeps the last one, with its cache, for its next tasks."""
    return WordBPE(text)


@lru_cache(maxsize=1)
def strings_of(text: str) -> pa.Array:
    """The strings of a vocabulary by their ids."""
    spec = json.loads(text)
    if spec.get("decoder"):
        raise ValueError("not a vocabulary of this kind: it names a decoder")
    found = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([found.get(i) for i in range(max(found) + 1)], pa.string())


def offsets_of(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def id_lists(bpe: WordBPE, texts: pa.Array) -> pa.Array:
    """The ids of each text."""
    data, lengths = bytearray(), []
    for at in range(0, len(texts), ROWS):
        for text in texts.slice(at, ROWS).to_pylist():
            ids = bpe.packed_ids(text)
            data += ids
            lengths.append(len(ids) // ID.itemsize)
    return pa.ListArray.from_arrays(offsets_of(lengths), pa.array(np.frombuffer(data, ID)))


def joined(strings: pa.Array, ids: pa.Array) -> pa.Array:
    """The strings of each list of ids, joined by a space."""
    flat = ids.flatten()
    offsets = offsets_of(pc.fill_null(pc.list_value_length(ids), 0))
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(strings)))
    found = strings.take(pc.if_else(inside, flat, None))
    if found.null_count:
        offsets = offsets_of(found.is_valid().to_numpy(zero_copy_only=False))[offsets]
        found = found.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(offsets, found), " ")


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary's file as a broadcast text."""
    text = Path(path).read_bytes()
    if len(text) > MAX_BYTES:
        raise ValueError(f"{path}: a vocabulary of more than {MAX_BYTES} bytes")
    return spark.sparkContext.broadcast(text.decode())


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """All columns of docs, and the ids of a text column as array<int>."""
    vocabulary = read_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(vocabulary.value)
        for batch in batches:
            yield id_lists(bpe, batch)

    return docs.withColumn(into, run(whole_text(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of tokens, and the text of a column of ids."""
    vocabulary = read_vocabulary(tokens.sparkSession, path)

    # no iterator, so that Spark runs it in one Python process with others over the same ids
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        strings = strings_of(vocabulary.value)
        parts = [joined(strings, batch.slice(at, ROWS)) for at in range(0, len(batch), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return tokens.withColumn(into, run(F.col(ids)))


@F.arrow_udf(StringType())
def ids_digest(ids: pa.Array) -> pa.Array:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    data = memoryview(ids.flatten().to_numpy().astype(ID, copy=False)).cast("B")
    ends = (offsets_of(pc.fill_null(pc.list_value_length(ids), 0)) * ID.itemsize).tolist()
    return pa.array([hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(ends, ends[1:])], pa.string())


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    digested = decode(tokens.withColumn("ids_sha256", ids_digest("ids")), path)
    return digested.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
