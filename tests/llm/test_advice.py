"""Cases from review: each lost rows, links or text before."""

from __future__ import annotations

import random

from marketlake.llm import chat, decontam, exact_dedup, html_text, ngram_join, quality


def test_ngram_join_links_across_the_parts_of_a_dealt_list(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 20)
    rng = random.Random(5)
    rows, parts = [], set()
    for group in range(6):  # 1.5 * HOT copies of a large text, and one variant; two parts per list
        words = [f"g{group}w{rng.randrange(10_000)}" for _ in range(200)]
        variant = [*words[:-1], "other"]
        rows += [(100 * group + i, " ".join(words)) for i in range(30)] + [(100 * group + 99, " ".join(variant))]
        names = [ngram_join.set_name(ngram_join.shingle_set(" ".join(w), 4)) for w in (words, variant)]
        parts.add(tuple(abs(x) % (1 << 30) % 2 for x in names))
    assert {(0, 1), (1, 0)} & parts
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == r.doc_id // 100 * 100 for r in got)


def test_class_words_do_not_lose_articles():
    story = "<h1>Title</h1><p>the whole story</p>"
    for page in (
        f'<body class="single has-sidebar"><article>{story}</article></body>',
        f'<html class="sidebar"><body class="sidebar"><div>{story}</div></body></html>',
        f'<body><div class="layout-no-sidebar"><article>{story}</article></div></body>',
        f'<body><div class="layout-no-sidebar">{story}</div></body>',
        f'<body><div class="sidebar"><article>{story}</article></div></body>',
        f'<body><p>x</p><div class="widget"><main class="search">{story}</main></div></body>',
        f'<body><main><div class="widget"><article>{story}</article></div></main></body>',
        f'<body><article class="post comments">{story}</article></body>',
        f'<body><article class="post has-comments"><div class="article-header"><h1>Title</h1></div><p>the whole story</p></article></body>',
        f'<body>{story}<div class="related"><article>teaser</article></div><div class="ad-box">buy</div></body>',
        f'<body><article>{story}<div class="main sidebar">other</div></article><div class="related"><article>a longer teaser than the story is</article></div></body>',
    ):
        assert html_text.main_text(page) == "Title the whole story", page
    assert html_text.main_text('<div class="x"><p hidden>no</p><p style="display:none">no</p><p>yes</p></div>') == "yes"


def test_chat_chunks_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 8)
    rng = random.Random(4)
    rows = [(None, t, rng.choice(["user", "assistant", None]), f"t{t}") for t in range(100)]
    rows += [(1, None, rng.choice(["user", "assistant"]), rng.choice(["a", "b", None])) for _ in range(100)]
    rows += [(2, 7, "user", f"{i:03}") for i in range(100)] + [(0, 3, "user", "zero")] + [(3, 5, "user", "same")] * 100
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    chunks = chat.ordered(chat.in_chunks(chat.placed(chat.turns_of(table)))).groupBy(*chat.CONV, "chunk").count().collect()
    assert sum(r["count"] for r in chunks) == len(rows)
    assert max(r["count"] for r in chunks) <= 8

    got = chat.repair(table).toPandas()
    assert len(got) == len(rows)
    key = lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for conv in (None, 0, 1, 2, 3):
        turns = got[got["conv_id"].isna() if conv is None else got["conv_id"] == conv].sort_values("piece_no")
        given = sorted((r for r in rows if r[0] == conv), key=key)
        assert list(turns["piece_no"]) == list(range(len(given)))
        assert [r or None for r in turns["given_role"]] == [r[2] for r in given]
        roles = [chat.role_number(r[2]) for r in given]
        states, cost = chat.borders([chat.summary(roles)])
        assert set(turns["conv_cost"]) == {cost}
        # pieces in order hold the texts in order
        for piece, r in zip(turns["piece"], given):
            assert (r[3] or "") in piece
        text = "".join(turns["piece"])
        assert text.startswith("<|") and text.endswith("<|end|>\n")


def test_rows_without_or_with_repeated_ids_are_decided_each(spark):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(10_000)}" for _ in range(n)]
    long, passage, lone = words(150), words(20), words(150)
    near = lambda x, w: " ".join([*x[:-1], w])
    big = 2**60 + 1
    rows = [
        (big, " ".join(long)), (None, " ".join(long)), (None, near(long, "p")), (big + 1, near(long, "q")), (big + 1, "own text of it"),
        (None, near(lone, "r")), (None, near(lone, "s")), (None, "a clean text"), (None, "see " + " ".join(passage)),
        (7, "another clean text"), (7, "again " + " ".join(passage)), (None, None),
    ]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    left = lambda *gone: sorted((i or 0, t or "") for n, (i, t) in enumerate(rows) if n not in gone)

    assert texts(exact_dedup.keep_first(docs)) == left(1)
    assert texts(decontam.keep_clean(docs, items)) == left(8, 10)
    found = decontam.decontaminate(docs, items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in found if r.contaminated) == [(0, 21, 20), (7, 21, 20)]
    assert len(found) == len(rows)

    joined = ngram_join.join(docs).collect()
    assert len(joined) == len(rows)
    assert sorted((r.doc_id or 0) for r in joined if r.component_id == big) == [0, 0, big, big + 1]
    kept = texts(ngram_join.keep_first(docs))
    # the two rows with the passage are near copies of each other
    assert kept in (left(1, 2, 3, 5, 8), left(1, 2, 3, 6, 8))

    poor = [(None, "!#$% 1234 <> !!"), (50, "!#$% 1234 <> !! ##"), (50, "a good text of plain words here")]
    train = [(100 + i, f"good plain words {i}" if i % 2 else f"!#$ {i} <> !!") for i in range(60)]
    docs = spark.createDataFrame(
        [(*r, "en", "s") for r in [*train, *poor, (None, "plain good words that stay")]], "doc_id long, text string, lang string, source string"
    )
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _ in train], "doc_id long, quality int")
    kept = {(r.doc_id, r.text) for r in quality.keep_accepted(docs, labels).collect() if r.doc_id is None or r.doc_id == 50}
    assert kept == {(None, "plain good words that stay"), poor[2]}


def test_dedup_merges_in_sorted_order(spark, capsys):
    docs = spark.createDataFrame([(None, "a b"), (7, "a  b"), (3, "a\tb"), (None, "c"), (5, None), (5, "")], "doc_id long, text string")
    merged = exact_dedup.merge_tree(exact_dedup.digest_runs(docs))
    merged.explain()
    plan = capsys.readouterr().out
    rounds = exact_dedup.RUN_BITS // exact_dedup.FAN_BITS
    assert "HashAggregate" not in plan and plan.count("SortAggregate") == 2 * rounds and plan.count("Exchange") == rounds
    assert sorted(((r.keep_id, r["rows"]) for r in merged.collect()), key=str) == [(3, 3), (5, 2), (None, 1)]
