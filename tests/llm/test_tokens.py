"""Encoding, importance resampling and fill-in-the-middle against the library, brute force and round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlake.llm import bpe, fim, resample

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, fim int, rank string, bucket int, seq long, _part int"
ODD = [
    "", None, " \t\n", "one", "ONE Two's don't", "naïve Straße ÉCOLE 漢字かな 🙂👩‍👩‍👧 éå", "x" * 3_000, "ab" * 2_000 + "'s",
    "a<|startoftext|>B<|endoftext|><|ENDOFTEXT|> <|startoftext|>", "12345 6,7;8 ½ ² ١٢٣", "́leading mark ́", "İstanbul ΣΑΣ ǅ ﬁ",
    "tab\x1cfile\x85next line wide　gap\x00zero", "<P>", "a <S> b", "<M", "q<", "P>x<", "🙂", "a\nb\n\nc", "  lead and trail  ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéèßÄ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    made = [rng.choice((" ", "\n", "  ")).join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    return ODD + made + [" ".join(rng.choice(words) for _ in range(40_000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "mine", 1, "r", 2, 3, 4) for i, t in enumerate(texts)]
    hot = [(None, texts[30], "mine", 1, "r", 2, 3, 4)] * 40 + [(None, texts[31], None, None, None, None, None, None)] * 3
    return spark.createDataFrame(rows + rows[2:5] + hot, DOCS)


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts], tokenizer


def test_bpe_equals_library(spark, docs, texts):
    tokens = bpe.decode(bpe.encode(docs, PATH, into="out"), PATH, "out", "back")
    assert [c for c in tokens.columns if c not in ("out", "back")] == docs.columns
    rows = [r for r in tokens.collect() if r["doc_id"] is not None]
    expected, tokenizer = library(texts)
    for r in rows:
        assert r["out"] == expected[r["doc_id"]]
        assert r["back"] == tokenizer.decode(r["out"], skip_special_tokens=False)
        assert r["text"] == texts[r["doc_id"]]
    assert len(rows) == len(texts) + 3
    null = tokens.limit(1).select(F.lit(None).cast("array<int>").alias("ids"))
    assert bpe.decode(null, PATH).first()["decoded"] == ""
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_bpe_pieces_and_cache_change_nothing(texts, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "CACHE", 3)
    coder = bpe.WordBPE(open(PATH, encoding="utf-8").read())
    expected, _ = library(texts[:-1])
    assert [coder.encode(t) for t in texts[:-1]] == expected
    assert len(coder.cache) <= 10 and len(coder.older) <= 10


def test_merge_queue_against_plain_merging():
    coder = bpe.WordBPE(open(PATH, encoding="utf-8").read())
    ranks = {(a, b): rank for a, found in enumerate(coder.ranks) for b, rank in found.items()}

    def plain(ids):
        while True:
            pairs = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
            if not pairs:
                return ids
            rank, i = min(pairs)
            ids = [*ids[:i], coder.made[rank], *ids[i + 2 :]]

    rng = random.Random(1)
    for _ in range(400):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40)))
        ids = [coder.vocab[c] for c in word[:-1]] + [coder.vocab[word[-1] + "</w>"]]
        assert coder.merged(list(ids)) == plain(ids)


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.WordBPE(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_bpe_query(spark, sf):
    rows = bpe.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    expected, tokenizer = library([r["text"] for r in rows])
    for r, ids in zip(rows, expected, strict=True):
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def plain_resample(rows, target, percent=5, least=20):
    def grams(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(resample.WORDS, lowered)
        return len(words), [
            zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)
        ]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        n, own = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, n, zlib.crc32((text or "").encode())])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    drawn = len(may) * percent // 100
    ranked = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(may)]
    return ranked + [(*r[:4], None) for r in out if r[4] < least]


@pytest.mark.parametrize("percent", [5, 60])
def test_resample_against_plain(spark, docs, texts, percent):
    target = texts[40:44] + [None, ""]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, n int")
    got = [tuple(r) for r in resample.resample(docs, items, percent).collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(plain_resample(rows, target, percent), key=repr)


def test_resample_pieces_change_nothing(texts, monkeypatch):
    whole = [resample.Windows().of(t or "")[1].tolist() for t in texts]
    monkeypatch.setattr(resample, "PIECE", 5)
    assert [resample.Windows().of(t or "")[1].tolist() for t in texts] == whole


def test_resample_empty_tables(spark, docs):
    empty = docs.limit(0)
    assert resample.resample(empty, docs).count() == 0
    assert resample.resample(docs, empty).count() == docs.count()


def test_resample_ranks_equal_rows(spark):
    rows = spark.range(4000).selectExpr("cast(NULL AS long) AS doc_id", "repeat('same words again ', 8) AS text")
    out = resample.resample(rows, rows.limit(1), percent=100)
    assert sorted(r["rank"] for r in out.select("rank").collect()) == list(range(1, 4001))


def plain_cut(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    lead = re.match(r"[\t-\r ]*", text).group()
    found = re.findall(r"[^\t-\r ]+[\t-\r ]*", text[len(lead) :])
    return [lead + found[0], *found[1:]] if found else [text] if text else []


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_boundaries_against_plain(texts, unit, block):
    for text in [t for t in texts if t is not None][:40]:
        units = plain_cut(text, unit)
        blocks = fim.Blocks(text, unit, block)
        assert (blocks.units, blocks.chars) == (len(units), len(text))
        for k in {0, 1, 2, len(units) // 2, len(units) - 1, len(units), len(units) + 1} - {-1}:
            head = "".join(units[:k])
            assert blocks.boundary(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("unit", ["char", "word"])
def test_fim_round_trip(spark, docs, texts, unit):
    made = fim.fill_in_middle(docs, unit, into="made", block=16)
    assert made.columns == [*docs.columns, "made"]
    made = made.withColumn("back", fim.restored(F.col("made.output"), F.col("made.form")))
    forms = Counter()
    for r in made.collect():
        m, text = r["made"], r["text"] or ""
        assert r["back"] == text and m["n"] == len(plain_cut(text, unit))
        forms[m["form"]] += 1
        if m["form"] == "plain":
            assert m["output"] == text and m["prefix_chars"] is None and m["middle_chars"] is None
            continue
        h = [int(x, 16) for x in re.findall(".{8}", hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest())[:4]]
        low, high = sorted(x % (m["n"] + 1) for x in h[:2])
        units = plain_cut(text, unit)
        a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        assert (m["prefix_chars"], m["middle_chars"]) == (len(a), len(b))
        assert m["form"] == ("spm" if h[3] % 100 < 20 else "psm") and h[2] % 100 < 90
        assert m["output"] == (f"<S>{c}<P>{a}<M>{b}" if m["form"] == "spm" else f"<P>{a}<S>{c}<M>{b}")
    assert set(forms) == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_words_cut_out_of_runs_are_merged_once(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from marketlake.llm.bpe import WordBPE

    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, merged = WordBPE(open(path).read()), []
    plain = bpe.word
    monkeypatch.setattr(bpe, "word", lambda w: merged.append(w) or plain(w))
    text = "mercado, (mercado) mercado. ciónjamen, [ciónjamen] ciónjamen... don't, don't! x'll"
    wanted = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == wanted
    assert merged.count("mercado") == 1 and merged.count("ciónjamen") == 1
    assert bpe.encode(text[::-1] + " " + text) == Tokenizer.from_file(path).encode(text[::-1] + " " + text, add_special_tokens=False).ids


def test_runs_of_known_letters_do_not_ask_the_library(monkeypatch):
    text = open(PATH, encoding="utf-8").read()
    assert bpe.coder(text) is bpe.coder(text)  # kept for the next task
    coder, asked = bpe.WordBPE(text), []
    words = coder.words

    class Asked:
        def encode(self, run, **options):
            asked.append(run)
            return words.encode(run, **options)

    monkeypatch.setattr(coder, "words", Asked())
    texts = ["Élève, l'école's 12½ ÜBER (straße) İ ΣΑΣ привет, МИР! don't", "Πρώτα «déjà» ça"]
    assert [coder.encode(t) for t in texts] == library(texts)[0]
    assert asked == ["i\u0307", "σασ"]
    seen = len(asked)
    assert [coder.encode(t) for t in texts] == library(texts)[0] and len(asked) == seen


def test_bpe_of_random_characters_equals_library():
    coder, rng = bpe.WordBPE(open(PATH, encoding="utf-8").read()), random.Random(2)
    low, marks = [chr(i) for i in range(1, bpe.KNOWN + 0x20)], [chr(i) for i in range(0x300, 0x330)]
    every = [f"{a}{c}{b}" for c in map(chr, range(1, 0x3100)) for a, b in (("", ""), ("a", "É's"))]
    drawn = ["".join(rng.choice(rng.choice((low, marks, low[:128]))) for _ in range(rng.randint(1, 9))) for _ in range(5_000)]
    texts = every + drawn + ["H\u0331 h\u0331", "Y\u030a", "W\u030a\nT\u0308x", "J\u030cA"]  # these compose as small letters only
    for text, ids in zip(texts, library(texts)[0], strict=True):
        assert coder.encode(text) == ids, repr(text)


def test_bpe_decodes_odd_lists(spark):
    strings = {i: s for s, i in Tokenizer.from_file(PATH).get_vocab().items()}
    lists = [None, [], [5], [5, 10**8, 6, -1], [None, 7], [49407, 49406]] * 200
    tokens = spark.createDataFrame([(n, x) for n, x in enumerate(lists)], "n int, ids array<int>").coalesce(1)
    got = {r["n"]: r["decoded"] for r in bpe.decode(tokens, PATH).collect()}
    assert got == {n: " ".join(strings[i] for i in x or [] if i in strings) for n, x in enumerate(lists)}
